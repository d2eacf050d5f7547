"""Corrections and suggestions against plain code over all pairs of small tables."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.functions import scores
from wordloom.operators import edit_join, search, suggest

MAX = scores.MAX_FREQUENCY


def budget(word: str) -> int:
    return 0 if len(word) < 2 else 100 if len(word) < 10 else 200


def plain_osa(a: bytes, b: bytes, cheap=None) -> int:
    """The whole table of optimal string alignment."""
    d = {(i, 0): 100 * i for i in range(len(a) + 1)} | {(0, j): 100 * j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            change = 0 if a[i - 1] == b[j - 1] else (cheap or {}).get((i - 1, b[j - 1]), 100)
            d[i, j] = min(d[i - 1, j] + 100, d[i, j - 1] + 100, d[i - 1, j - 1] + change)
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 100)
    return d[len(a), len(b)]


@pytest.fixture(scope="module")
def words():
    """A lexicon and slips of its words with up to three edits, long and short, with accents."""
    draw = np.random.default_rng(8)
    letters = list("abcdeé'")
    lexicon = sorted({"".join(draw.choice(letters, size=int(n))) for n in draw.integers(1, 14, 150)})
    typed = []
    for word in lexicon:
        own = list(word)
        for _ in range(int(draw.integers(0, 4))):
            at, kind = int(draw.integers(0, len(own))) if own else 0, draw.integers(4)
            if kind == 0:
                own.insert(at, str(draw.choice(letters)))
            elif own and kind == 1:
                own[at] = str(draw.choice(letters))
            elif own and kind == 2:
                del own[at]
            elif at + 1 < len(own):
                own[at], own[at + 1] = own[at + 1], own[at]
        typed.append("".join(own))
    freqs = {w: int(f) for w, f in zip(lexicon, draw.integers(1, MAX, len(lexicon)))}
    return freqs, sorted({*typed, "", "x"})


def test_corrections_are_those_of_all_pairs(spark, words):
    freqs, typed = words
    lexicon = spark.createDataFrame(list(freqs.items()), "key string, freq int")
    queries = spark.createDataFrame([(w,) for w in typed], "query string")
    got = sorted((r["query"], r["key"], r["cost"]) for r in search.corrections(queries, lexicon).collect())
    want = sorted((q, k, c) for q in typed for k in freqs if q != k and abs(len(q.encode()) - len(k.encode())) <= 2 and (c := plain_osa(q.encode(), k.encode())) <= budget(q))
    assert got == want and {c for *_, c in want} == {100, 200}
    best = {}
    for q, k, c in want:
        if q not in freqs:
            score = freqs[k] - c * scores.EDIT_PENALTY // 100
            if score > scores.AUTOCORRECT_MARGIN:
                best[q] = max(best.get(q, (score, k)), (score, k))
    fixed = search.autocorrect(queries, lexicon, id_column="query").collect()
    assert {r["query"]: (r["score"], r["correction"]) for r in fixed} == best and best


def plain_suggest(query, freqs, follows, own, affixes, touches, limit=3):
    """One query's candidates by loops over everything; ASCII only."""
    typed, key = query, query.lower()
    cheap = {}
    if touches and len(touches) <= len(key):
        for k, keys in enumerate(touches):
            for base, p in keys:
                if p >= 0.05:
                    cheap[len(key) - len(touches) + k, ord(base)] = 60 + round((1 - p) * 40)
    entries = []
    for word, freq in freqs.items():
        cost = 0 if word.startswith(key) else plain_osa(key.encode(), word.encode(), cheap)
        if cost <= budget(key):
            entries.append((freq - cost * scores.EDIT_PENALTY // 100, word, freq, cost))
    entries = sorted(entries, key=lambda e: (-e[0], e[1]))[: 4 * limit]
    shape = lambda w: w.upper() if typed.isupper() and len(typed) > 1 else w[:1].upper() + w[1:] if typed[:1].isupper() else w
    ranked = [(f + own.get(w, (0, 0))[0] + follows.get(w, 0) - c * scores.EDIT_PENALTY // 100, shape(w), w, "correction" if c else "prediction") for _, w, f, c in entries]
    learnt = sorted(((w, x) for w, (x, _) in own.items() if w.startswith(key)), key=lambda e: (-e[1], e[0]))[:limit]
    found = [(w, x, shape(w)) for w, x in learnt]
    if typed != key:
        found += [(w, x, w) for w, x in sorted(((w, x) for w, (x, _) in own.items() if w.startswith(typed)), key=lambda e: (-e[1], e[0]))[:limit] if w not in {f[0] for f in found}]
    ranked += [(x + freqs.get(w, 0) + follows.get(w, 0), text, w, "prediction") for w, x, text in found]
    for k in range(1, len(key)):
        if own.get(key[:k], (0, 0))[1] >= 2:
            ranked += [(own[key[:k]][0], shape(key[:k] + a), key[:k] + a, "prediction") for a in affixes if a.startswith(key[k:]) and key[:k] + a not in freqs]
    out = [(typed, "typed")]
    for _, text, _, kind in sorted(ranked, key=lambda e: (-e[0], e[1], e[3] != "prediction")):
        if len(out) <= limit and text not in {t for t, _ in out}:
            out.append((text, kind))
    return out


def test_suggestions_are_those_of_plain_loops(spark):
    draw = np.random.default_rng(21)
    letters = list("abcde")
    words = sorted({"".join(draw.choice(letters, size=int(n))) for n in draw.integers(2, 12, 120)})
    freqs = {w: int(f) for w, f in zip(words, draw.choice(MAX, len(words), replace=False))}
    follows = {w: int(x) for w, x in zip(draw.choice(words, 12, replace=False), draw.integers(1, 30_000, 12))}
    own = {"abba": (3 * 6553 + 1, 3), "Zed": (6553 + 2, 1), "dabc": (2 * 6553 + 3, 2), words[5]: (40_004, 4), "ab": (2 * 6553 + 5, 2)}
    affixes = ["ed", "eda", "ba"]
    queries = ["ab", "Ab", "AB", "a", "Ze", "abe", "dabce", "", words[3][:-1] + "e", *[w[:-2] for w in words[10:40] if len(w) > 3], *[w[1] + w[0] + w[2:] for w in words[40:60]], *[w[:3] + "a" + w[4:] for w in words if len(w) > 9][:12]]
    queries = sorted(set(queries))
    touches = {}
    for k, q in enumerate(queries):
        if k % 2:
            touches[q] = [[(c.lower(), 0.6), ("abcde"[(k + i) % 5], 0.3), ("z", 0.01)] for i, c in enumerate(q[-3:] if k % 4 == 1 else q)]
    rows = [(k, q, 1, "before", [[(b, p) for b, p in t] for t in touches[q]] if q in touches else None) for k, q in enumerate(queries)]
    asked = spark.createDataFrame(rows, "query_id bigint, query string, user_id bigint, previous string, touches array<array<struct<base:string,p:double>>>")
    lexicon = spark.createDataFrame(list(freqs.items()), "key string, freq int")
    bigrams = spark.createDataFrame([("before", w, x) for w, x in follows.items()], "left string, right string, weight int")
    personal = spark.createDataFrame([(1, w, x, n >= 2) for w, (x, n) in own.items()] + [(2, "abyss", 60_000, True)], "user_id bigint, word string, weight bigint, learned boolean")
    signs = spark.createDataFrame([("ab", 1, "*", 1), ("ab", 2, "!", 1), ("ab", 1, "+", 2), ("ab", 1, "-", 3), ("ab", 1, "/", 4), ("abe", 1, "?", 1)], "word string, grp int, text string, place int")
    got = {}
    for r in sorted(suggest.suggest(asked, lexicon, bigrams, personal, spark.createDataFrame([(a,) for a in affixes], "affix string"), signs).collect(), key=lambda r: (r["query_id"], r["place"])):
        got.setdefault(queries[r["query_id"]], []).append((r["text"], r["kind"]))
    for q in queries:
        want = plain_suggest(q, freqs, follows, own, affixes, touches.get(q)) if q else []
        if q.lower() == "ab":
            want += [(t, "conversion") for t in "*+-!"]
        if q == "abe":
            want.append(("?", "conversion"))
        assert got.get(q, []) == want, q
    assert suggest.suggest(asked.select("query_id", "query"), lexicon).count() > len(queries)
    assert suggest.suggest(asked.limit(0), lexicon, bigrams, personal).collect() == []


def test_suggestions_end_in_a_small_plan(spark, capsys):
    """As one plan, parts that are used often stood in it many times over, and its descriptions filled the driver."""
    asked = spark.createDataFrame([(1, "te", 1, "green")], "query_id bigint, query string, user_id bigint, previous string")
    lexicon, bigrams = spark.createDataFrame([("tea", 9)], "key string, freq int"), spark.createDataFrame([("green", "tea", 5)], "left string, right string, weight int")
    personal, affixes = spark.createDataFrame([(1, "ten", 3, True)], "user_id bigint, word string, weight bigint, learned boolean"), spark.createDataFrame([("ed",)], "affix string")
    out = suggest.suggest(asked, lexicon, bigrams, personal, affixes)
    assert [r["text"] for r in out.orderBy("place").collect()] == ["te", "tea", "ten"]
    capsys.readouterr()
    out.explain()
    assert capsys.readouterr().out.count("Exchange") <= 4


def test_shortcuts_come_before_corrections(spark):
    asked = spark.createDataFrame([(1, "omw", 5), (2, "teh", 5), (3, "omw", 6), (4, "teh", 6)], "query_id bigint, query string, user_id bigint")
    own = spark.createDataFrame([(5, "omw", "on my way"), (5, "teh", "Teh")], "user_id bigint, surface string, text string")
    fixed = spark.createDataFrame([(2, "the"), (4, "the")], "query_id bigint, correction string")
    got = {r["query_id"]: (r["text"], r["by"]) for r in suggest.shortcuts(asked, own, fixed).collect()}
    assert got == {1: ("on my way", "shortcut"), 2: ("Teh", "shortcut"), 3: ("omw", "typed"), 4: ("the", "correction")}


def slips(draw, word: bytes, edits: int, letters: bytes) -> bytes:
    own = bytearray(word)
    for _ in range(edits):
        at, kind = int(draw.integers(0, len(own) + 1)), draw.integers(4)
        if kind == 0:
            own.insert(at, int(draw.choice(list(letters))))
        elif at < len(own) and kind == 1:
            own[at] = int(draw.choice(list(letters)))
        elif at < len(own) and kind == 2:
            del own[at]
        elif at + 1 < len(own):
            own[at], own[at + 1] = own[at + 1], own[at]
    return bytes(own)


@pytest.mark.parametrize("k", [1, 2, 3])
def test_pairs_within_k_edits_all_meet(spark, k):
    """Few letters, so that segments, shifts and transpositions across boundaries coincide in every way."""
    draw = np.random.default_rng(k)
    keys = sorted({bytes(draw.choice(list(b"ab" if k < 3 else b"abc"), size=int(n))).decode() for n in draw.integers(k, 12, 60)} - {""})
    asked = sorted({slips(draw, x.encode(), int(draw.integers(1, k + 1)), b"abc").decode() for x in keys} - {""})
    left, right = spark.createDataFrame([(x,) for x in asked], "query string"), spark.createDataFrame([(x,) for x in keys], "key string")
    found = edit_join.join(left, right, "query", "key", [(k, F.lit(True), F.lit(100 * k))]).collect()
    want = sorted((q, x, c) for q in asked for x in keys if q != x and abs(len(q) - len(x)) <= k and (c := plain_osa(q.encode(), x.encode())) <= 100 * k)
    assert sorted((r["query"], r["key"], r["cost"]) for r in found) == want and want


def test_words_of_two_thousand_letters_are_corrected(spark):
    draw = np.random.default_rng(4)
    keys = [bytes(draw.choice(list(b"abcdefgh"), size=2_000)).decode() for _ in range(12)]
    typed = [slips(draw, x.encode(), 2, b"xyz").decode() for x in keys]
    lexicon, queries = spark.createDataFrame([(x, 5) for x in keys], "key string, freq int"), spark.createDataFrame([(x,) for x in typed], "query string")
    found = {(r["query"], r["key"]): r["cost"] for r in search.corrections(queries, lexicon).collect()}
    assert set(found) == set(zip(typed, keys)) - {(x, x) for x in keys} and set(found.values()) <= {100, 200}
    pieces = lexicon.select(F.max(F.size(edit_join.offered(F.col("key"), 2))), F.max(F.size(edit_join.offered(F.col("key"), 3)))).first()
    assert max(pieces) <= 16
