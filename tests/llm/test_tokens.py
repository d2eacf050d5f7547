"""Operators 2, 5 and 6: ids, counts and checksums against the libraries and against plain code."""

from __future__ import annotations

import base64
import hashlib
import zlib

import numpy as np
import pytest
from llm_rows import LONG, TEXTS, rows_by

from wordloom.llm import byte_bpe, span_hash, token_files, unigram_count
from wordloom.llm.queries import tokenizer_path

WORDS, RANKS, PIECES = "word_bpe_49k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def words():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(WORDS))
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 1]


@pytest.fixture(scope="module")
def bytes_of():
    import public_tokenizers
    import tiktoken

    with open(tokenizer_path(RANKS), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: encoding.encode_ordinary(text or "")


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_token_files_hold_the_librarys_ids(spark, small, small_rows, words):
    path = token_files.write_new(small, tokenizer_path(WORDS), end_id=1)
    got = {r["doc_id"]: r for r in token_files.read_checksums(spark, path).collect()}
    at = 0
    for doc_id, text in sorted(small_rows):
        ids = words(text)
        assert (got[doc_id]["start"], got[doc_id]["n_tokens"], got[doc_id]["ids_crc32"]) == (at, len(ids), crc(ids)), doc_id
        at += len(ids)
    index = {r["doc_id"]: r["start"] for r in token_files.read_index(spark, path).collect()}
    assert index == {k: r["start"] for k, r in got.items()}


def test_token_files_of_odd_texts(spark, odd, empty, words):
    path = token_files.write_new(odd, tokenizer_path(WORDS), end_id=1, shards=3)
    got = token_files.read_ids(spark, path).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, tuple(r["ids"])) for r in got) == sorted((i is not None, i or 0, tuple(words(t))) for i, t, *_ in TEXTS)
    ordered = sorted(got, key=lambda r: r["start"])
    assert ordered[0]["doc_id"] is None and [r["doc_id"] for r in ordered[1:]] == sorted(i for i, *_ in TEXTS if i is not None)
    at = 0
    for r in ordered:
        assert r["start"] == at
        at += r["n_tokens"]
    assert token_files.read_checksums(spark, token_files.write_new(empty, tokenizer_path(WORDS))).collect() == []


def test_token_files_are_pruned_to_the_metadata(spark, odd):
    path = token_files.write_new(odd, tokenizer_path(WORDS))
    plan = token_files.read_index(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "ids:array" not in plan and "n_tokens" in plan


def test_byte_bpe_is_tiktokens(odd, small, small_rows, bytes_of):
    ranks = tokenizer_path(RANKS)
    for docs, rows in ((odd, [(i, t) for i, t, *_ in TEXTS]), (small, small_rows)):
        coded = byte_bpe.encode(docs, ranks)
        got = byte_bpe.digests(coded, ranks).collect()
        want = []
        for doc_id, text in rows:
            ids = bytes_of(text)
            want.append((doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
        assert rows_by(got) == rows_by(want)
        assert rows_by(byte_bpe.round_trip(docs, ranks).collect()) == rows_by(want)
    decoded = byte_bpe.decode(byte_bpe.encode(odd, ranks), ranks).collect()
    assert rows_by((r["doc_id"], bytes(r["decoded"])) for r in decoded) == rows_by((i, (t or "").encode()) for i, t, *_ in TEXTS)


def test_byte_bpe_of_random_texts(bytes_of):
    own = byte_bpe.codec(tokenizer_path(RANKS))
    draw = np.random.default_rng(5)
    signs = list("aZé東9٣ \t\n\r 'stlvedrm.,!_\U0001f600́")
    texts = ["".join(draw.choice(signs, size=n)) for n in draw.integers(0, 60, size=3000)]
    ids, counts = own.encode(texts)
    stops = np.cumsum(counts)
    for text, stop, n in zip(texts, stops, counts):
        assert ids[stop - n : stop].tolist() == bytes_of(text), repr(text)


def test_byte_bpe_of_an_empty_table(empty):
    ranks = tokenizer_path(RANKS)
    assert byte_bpe.digests(byte_bpe.encode(empty, ranks), ranks).collect() == []
    assert byte_bpe.round_trip(empty, ranks).collect() == []


def test_byte_bpe_with_few_places_for_pieces(small_rows, bytes_of, monkeypatch):
    """Pieces that take each other's places, and ids that are dropped meanwhile, change nothing."""
    monkeypatch.setattr(byte_bpe, "PLACES", 64)
    monkeypatch.setattr(byte_bpe, "HELD_IDS", 500)
    own = byte_bpe.Codec(tokenizer_path(RANKS))
    for _, text in small_rows[:60]:
        assert own.encode([text or ""])[0].tolist() == bytes_of(text)


def plain_count(counter, text: str) -> tuple[int, float]:
    """Every piece tried at every place of the whole text; the earliest start stays at equal scores."""
    text = "▁" + text.replace(" ", "▁") if text else ""
    longest = max(map(len, counter.pieces))
    best = [(0.0, 0)]
    for i in range(1, len(text) + 1):
        high, count = float("-inf"), 0
        for j in range(max(0, i - longest), i):
            score = counter.pieces.get(text[j:i])
            if score is not None and best[j][0] + score > high:
                high, count = best[j][0] + score, best[j][1] + 1
        if text[i - 1] not in counter.pieces and best[i - 1][0] + counter.unknown > high:
            high, count = best[i - 1][0] + counter.unknown, best[i - 1][1] + len(text[i - 1].encode())
        best.append((high, count))
    return best[-1][1], best[-1][0]


def test_token_counts_are_those_of_all_paths(odd, empty, small, small_rows):
    counter = unigram_count.counter(tokenizer_path(PIECES))
    rows = [(i, t) for i, t, *_ in TEXTS if t != LONG]
    got = unigram_count.count_tokens(odd, tokenizer_path(PIECES)).collect()
    whole = [r for r in got if r["doc_id"] == 8]
    assert whole[0]["n_tokens"] == sum(n for n, _ in counter.count([LONG]))
    assert rows_by((r["doc_id"], r["n_tokens"]) for r in got if r["doc_id"] != 8) == rows_by((i, plain_count(counter, t or "")[0]) for i, t in rows)
    few = dict(small_rows[:25])
    found = {r["doc_id"]: (r["n_tokens"], r["score"]) for r in unigram_count.count_tokens(small, tokenizer_path(PIECES)).collect()}
    for doc_id, text in few.items():
        assert found[doc_id] == plain_count(counter, text or ""), doc_id
    assert unigram_count.count_tokens(empty, tokenizer_path(PIECES)).collect() == []


def thue_morse(n: int, one: str, other: str) -> str:
    return "".join(other if bin(k).count("1") % 2 else one for k in range(n))


def test_words_that_polynomial_hashes_confuse(spark, words, bytes_of):
    """Hashes modulo 2^64 give such words the same number; here they are told apart by their bytes."""
    texts = [f"{thue_morse(4096, 'a', 'b')} {thue_morse(4096, 'b', 'a')}", thue_morse(4096, "b", "a"), "x" * 16 + " " + "x" * 17, "a\0 a \0a a\0\0"]
    own = byte_bpe.codec(tokenizer_path(RANKS))
    ids, counts = own.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [bytes_of(t) for t in texts]
    table = token_files.WordCodes(tokenizer_path(WORDS), 1)
    ids, counts = table.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [words(t) for t in texts]


def test_added_tokens_are_the_librarys(words):
    texts = ["a <|startoftext|> b", "plain", "<|endoftext|>", "A<|ENDOFTEXT|>b <| c", "", "x<|endoftext|><|endoftext|> y\n<|startoftext", "it's É<|endoftext|>É"]
    table = token_files.WordCodes(tokenizer_path(WORDS), 1)
    ids, counts = table.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [words(t) for t in texts]
    assert 49406 in words(texts[0]) and 49407 in words(texts[2])


def test_token_files_with_few_places_for_words(small_rows, words, monkeypatch):
    monkeypatch.setattr(token_files, "PLACES", 64)
    monkeypatch.setattr(token_files, "HELD_IDS", 300)
    table = token_files.WordCodes(tokenizer_path(WORDS), 1)
    for _, text in small_rows[:60]:
        assert table.encode([text or ""])[0].tolist() == words(text)


def _long_texts(n: int, letters: int) -> list[str]:
    draw = np.random.default_rng(4)
    return [" ".join("".join(w) for w in draw.choice(list("abcdefghijklmnop"), size=(5, letters))) for _ in range(n)]


def test_long_words_keep_the_word_table_small(words, monkeypatch):
    """Distinct words of 4,000 letters: keys and ids stay within their bytes, and the ids are right."""
    monkeypatch.setattr(token_files, "HELD_IDS", 60_000)
    table = token_files.WordCodes(tokenizer_path(WORDS), 1)
    table.places.most_long = 100_000
    for text in _long_texts(30, 4_000):
        ids = table.encode([text, "some words of a text"])[0]
        assert ids.tolist() == words(text) + words("some words of a text")
        assert table.places.long_bytes == sum(map(len, table.places.long)) + span_hash.LONG_ENTRY * len(table.places.long) <= 100_000
        assert len(table.flat) <= 60_000 + len(ids)


def test_long_pieces_keep_the_piece_table_small(bytes_of, monkeypatch):
    monkeypatch.setattr(byte_bpe, "HELD_IDS", 10_000)
    own = byte_bpe.Codec(tokenizer_path(RANKS))
    own.places.most_long = 20_000
    for text in _long_texts(20, 800):
        ids = own.encode([text])[0]
        assert ids.tolist() == bytes_of(text)
        assert own.places.long_bytes <= 20_000 and len(own.flat) <= 10_000 + len(ids)


def test_short_words_that_fill_the_table_begin_it_anew(words, bytes_of, monkeypatch):
    monkeypatch.setattr(token_files, "HELD_IDS", 200)
    monkeypatch.setattr(byte_bpe, "HELD_IDS", 200)
    table, own = token_files.WordCodes(tokenizer_path(WORDS), 1), byte_bpe.Codec(tokenizer_path(RANKS))
    for k in range(40):
        text = " ".join(f"q{k}x{j}" for j in range(20))
        assert table.encode([text])[0].tolist() == words(text) and own.encode([text])[0].tolist() == bytes_of(text)
        assert len(table.flat) < 600 and len(own.flat) < 600


def test_texts_without_spaces_keep_few_chunks(monkeypatch):
    monkeypatch.setattr(unigram_count, "CACHED_BYTES", 50_000)
    counter = unigram_count.Counter(tokenizer_path(PIECES))
    draw = np.random.default_rng(2)
    for n in [3_000] * 20 + [40_000, 10, 3_000]:
        text = "".join(map(chr, draw.integers(0x4E00, 0x4E80, size=n))) + " ab" * 3
        if n < 5_000:
            assert next(counter.count([text])) == plain_count(counter, text)
        else:
            next(counter.count([text]))
        size = sum(unigram_count.CHUNK_BYTES + unigram_count.CHARACTER_BYTES * len(x) for x in counter.known)
        assert counter.held == size <= 50_000


def test_token_counts_are_the_unigram_librarys(small_rows):
    """The same pieces and scores in the tokenizers library's own unigram model; a small vocabulary with ties as well."""
    from tokenizers import Tokenizer, models

    def library(pieces):
        pieces = [("<unk>", min(s for _, s in pieces)), *pieces]
        own = Tokenizer(models.Unigram(pieces, 0, False))
        return lambda text: len(own.encode(text, add_special_tokens=False).ids)

    counter = unigram_count.counter(tokenizer_path(PIECES))
    known = {c for p in counter.pieces for c in p if len(p) == 1}
    count = library(list(counter.pieces.items()))
    for _, text in small_rows[:60]:
        text = "".join(c for c in (text or "") if c in known or c == " ")
        marked = "▁" + text.replace(" ", "▁") if text else ""
        assert next(counter.count([text]))[0] == count(marked)
    few = object.__new__(unigram_count.Counter)
    few.pieces = {"a": -2.0, "b": -2.0, "ab": -4.0, "ba": -4.0, "aba": -6.0, "▁": -3.0, "▁a": -5.0}
    few.byte_fallback, few.unknown, few.known = False, -16.0, {}
    few.automaton = __import__("ahocorasick").Automaton()
    for piece, score in few.pieces.items():
        few.automaton.add_word(piece, (len(piece), score))
    few.automaton.make_automaton()
    count, draw = library(list(few.pieces.items())), np.random.default_rng(9)
    for n in range(1, 200):
        text = "".join(draw.choice(list("ab "), size=int(n % 12) + 1))
        assert next(few.count([text]))[0] == count("▁" + text.replace(" ", "▁")), text
