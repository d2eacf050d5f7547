"""Byte-level BPE: vectorised pre-tokenisation without regex, cached pair merging, and decoding by retained offsets.

Pre-tokenisation follows public_tokenizers.PATTERN. Every character is mapped to a class by an array over code points;
classes drive a small automaton whose state says what kind of token the last character is in. A character acts on
states as a function; the functions that arise form a small closed set (the automaton's transition monoid), so
composing them is a table look-up, which is associative: blocks are scanned side by side, then the blocks' functions
are scanned in log steps. Starts of tokens follow from the states before and after, with one character of look-ahead.

Pieces met before are found by their bytes (span_hash.Places), so no two are taken for one another. Nulls count as empty
texts, which have no ids; any text decodes to its own bytes. A text is encoded whole however long it is: one of more than
STEP characters is a step of its own. Repeated rows give repeated results, empty tables no rows; other columns are not
read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_steps
from .span_hash import Places

# Classes of characters. SDMT, EL, VE, AR, EE are the letters of contractions ('s 'd 'm 't 'll 've 're).
LETTER, SDMT, EL, VE, AR, EE, NUMBER, OTHER, QUOTE, SPACE, WHITE, RESET = range(12)
# States: what the last character belongs to. QUOTED: an apostrophe that starts a token; Q_*: a letter after it; DONE: a whole contraction.
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AT_SPACE, AT_WHITE, QUOTED, Q_L, Q_V, Q_R, DONE = range(11)
N_CLASSES, N_STATES, BLOCK = 12, 11, 128
#: Places for pieces that a worker remembers (a power of two), and ids held for them before unused ones are dropped.
PLACES, HELD_IDS = 1 << 20, 6_000_000
#: Characters that one step holds at most, unless a single text is longer.
STEP = 400_000
#: The characters with Unicode's White_Space property.
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def step(state: int, kind: int) -> int:
    """The automaton."""
    if kind in (RESET, NUMBER, SPACE, WHITE, OTHER):
        return {RESET: START, NUMBER: IN_NUMBERS, SPACE: AT_SPACE, WHITE: AT_WHITE, OTHER: IN_OTHERS}[kind]
    if kind == QUOTE:
        return IN_OTHERS if state in (IN_OTHERS, AT_SPACE, QUOTED) else QUOTED
    if state == QUOTED:
        return {SDMT: DONE, EL: Q_L, VE: Q_V, AR: Q_R}.get(kind, IN_LETTERS)
    return DONE if (state, kind) in ((Q_L, EL), (Q_V, EE), (Q_R, EE)) else IN_LETTERS


#: How a character starts a token: never, always, unless the next completes a contraction, if a non-white one follows.
NEVER, ALWAYS, UNLESS_DONE, BEFORE_TEXT = range(4)


def start_rule(state: int, kind: int) -> int:
    if kind == RESET:
        return NEVER
    if kind in (SPACE, WHITE):
        return BEFORE_TEXT if state in (AT_SPACE, AT_WHITE) else ALWAYS
    after = step(state, kind)
    if kind <= EE:
        if state == QUOTED:
            return NEVER if after == DONE else UNLESS_DONE if after in (Q_L, Q_V, Q_R) else ALWAYS
        return NEVER if state in (IN_LETTERS, AT_SPACE, Q_L, Q_V, Q_R) else ALWAYS
    if kind == NUMBER:
        return NEVER if state in (IN_NUMBERS, AT_SPACE) else ALWAYS
    return NEVER if state in (IN_OTHERS, AT_SPACE, QUOTED) else ALWAYS


class Splitter:
    """Class array over code points, the monoid's tables, and the scan."""

    def __init__(self):
        import regex

        points = [*range(0xD800), *range(0xE000, 0x110000)]
        every = "".join(map(chr, points))
        self.kind = np.full(0x110000, OTHER, dtype=np.uint8)
        for pattern, value in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER)):
            self.kind[[points[m.start()] for m in regex.finditer(pattern, every)]] = value
        self.kind[WHITE_SPACE] = WHITE
        for text, value in (("sdmt", SDMT), ("l", EL), ("v", VE), ("r", AR), ("e", EE), ("'", QUOTE), (" ", SPACE)):
            self.kind[[ord(c) for c in text]] = value
        acts = [tuple(step(s, c) for s in range(N_STATES)) for c in range(N_CLASSES)]
        found = {tuple(range(N_STATES)): 0}
        for f in (queue := [*found]):  # grows while it is read
            for act in acts:
                g = tuple(act[s] for s in f)
                if g not in found:
                    found[g] = len(found)
                    queue.append(g)
        self.apply = np.array(queue, dtype=np.uint8)
        self.then_class = np.array([[found[tuple(act[s] for s in f)] for act in acts] for f in queue], dtype=np.intp).ravel()
        self.product = np.array([[found[tuple(g[s] for s in f)] for g in queue] for f in queue], dtype=np.intp)
        self.rule = np.array([[start_rule(s, c) for c in range(N_CLASSES)] for s in range(N_STATES)], dtype=np.uint8).ravel()

    def states(self, kinds: np.ndarray) -> np.ndarray:
        """The state after each character."""
        blocks = -(-len(kinds) // BLOCK)
        grid = np.full(blocks * BLOCK, RESET, dtype=np.intp)
        grid[: len(kinds)] = kinds
        grid = np.ascontiguousarray(grid.reshape(blocks, BLOCK).T)
        at, f = np.empty((BLOCK, blocks), dtype=np.intp), np.zeros(blocks, dtype=np.intp)
        for j in range(BLOCK):
            f = self.then_class.take(f * N_CLASSES + grid[j])
            at[j] = f
        shift = 1
        while shift < blocks:  # each block's function after all before it
            f = np.concatenate([f[:shift], self.product[f[:-shift], f[shift:]]])
            shift *= 2
        before = np.concatenate([[START], self.apply[f[:-1], START]])
        return self.apply.ravel().take(at * N_STATES + before).T.ravel()[: len(kinds)]

    def starts(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
        """All texts in one string, each followed by a separator; the starts of tokens and separators in it; which are separators."""
        whole = "\n".join([*texts, ""])
        kinds = self.kind[np.frombuffer(whole.encode("utf-32-le"), dtype=np.uint32)]
        ends = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1) - 1
        kinds[ends] = RESET
        after = self.states(kinds)
        rule = self.rule.take(np.concatenate([[START], after[:-1]]).astype(np.intp) * N_CLASSES + kinds)
        done, text_next = np.append(after[1:] == DONE, False), np.append(kinds[1:] < SPACE, False)
        starts = (rule == ALWAYS) | (rule == UNLESS_DONE) & ~done | (rule == BEFORE_TEXT) & text_next
        starts[ends] = True
        at = np.flatnonzero(starts)
        return whole, at, kinds[at] == RESET


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the adjacent pair of lowest rank is joined first, the leftmost of equals."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end, previous = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(ranks[piece[i : i + 2]], i, i + 2) for i in range(n - 1) if piece[i : i + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if j <= i or j >= n or end[j] != stop or j == stop:
            continue  # one of the pair was joined meanwhile
        end[i], end[j] = stop, 0
        if stop < n:
            previous[stop] = i
            if (joined := piece[i : end[stop]]) in ranks:
                heapq.heappush(heap, (ranks[joined], i, end[stop]))
        if (p := previous[i]) >= 0 and (joined := piece[p:stop]) in ranks:
            heapq.heappush(heap, (ranks[joined], p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Codec:
    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.splitter = Splitter()
        size = max(self.ranks.values()) + 1
        self.token = [b""] * size
        for token, rank in self.ranks.items():
            self.token[rank] = token
        self.length = np.fromiter(map(len, self.token), dtype=np.int64, count=size)
        self.first = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(self.token), dtype=np.uint8)
        # Ids as decimals, each with a space after it.
        decimals = [b"%d " % k for k in range(size)]
        self.decimal_length = np.fromiter(map(len, decimals), dtype=np.int64, count=size)
        self.decimal_first = np.cumsum(self.decimal_length) - self.decimal_length
        self.decimals = np.frombuffer(b"".join(decimals), dtype=np.uint8)
        self.places = Places(PLACES)
        self.flat = np.empty(0, dtype=np.int32)  # the ids of code k: flat[at[k]:at[k + 1]]
        self.at = np.zeros(1, dtype=np.int64)

    def _forget(self) -> None:
        """Drops long pieces and the ids of pieces that have lost their place; all of them where more than half would stay."""
        self.places.forget_long()
        live = self.places.renumber()
        length = np.diff(self.at)[live]
        if length.sum() > HELD_IDS // 2:
            self.places.forget_all()
            live, length = live[:0], length[:0]
        stop = np.cumsum(length)
        self.flat = self.flat[np.repeat(self.at[live] - stop + length, length) + np.arange(stop[-1] if len(stop) else 0)]
        self.at = np.concatenate([[0], stop])

    def _learn(self, pieces: list[bytes]) -> np.ndarray:
        """Codes of new pieces."""
        merged = [merge(p, self.ranks) for p in pieces]
        first = len(self.at) - 1
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(merged), dtype=np.int32)])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(np.fromiter(map(len, merged), dtype=np.int64, count=len(merged)))])
        return first + np.arange(len(merged))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each text has."""
        if len(self.flat) > HELD_IDS:
            self._forget()
        whole, at, ends = self.splitter.starts(texts)
        blob = whole.encode()
        if len(blob) > len(whole):  # places of characters to places of bytes
            at = np.flatnonzero(np.frombuffer(blob, dtype=np.uint8) & 0xC0 != 0x80)[at]
        stops = np.append(at[1:], len(blob))
        codes = self.places.find(blob, at[~ends], stops[~ends], self._learn)
        length = np.zeros(len(at), dtype=np.int64)
        length[~ends] = own = self.at[codes + 1] - self.at[codes]
        stop = np.cumsum(own)
        ids = self.flat[np.repeat(self.at[codes] - stop + own, own) + np.arange(stop[-1] if len(stop) else 0)]
        return ids, np.diff(np.cumsum(length)[ends], prepend=0)

    def byte_ends(self, ids: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Where each id's bytes end within its own text."""
        total = np.concatenate([[0], np.cumsum(self.length[ids])])
        base = np.repeat(total[np.concatenate([[0], stops[:-1]]).astype(np.int64)], np.diff(stops, prepend=0)) if len(stops) else total[:0]
        return total[1:] - base

    def as_decimals(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids as decimals with a space after each, and where each one ends."""
        length = self.decimal_length[ids]
        ends = np.cumsum(length)
        return self.decimals[np.repeat(self.decimal_first[ids] - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)], ends

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> bytes:
        """One text's bytes; ends places each token in the output."""
        length = self.length[ids]
        if not len(ids):
            return b""
        return self.bytes[np.repeat(self.first[ids] - ends + length, length) + np.arange(ends[-1])].tobytes()


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _lists(values: np.ndarray, stops: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stops]).astype(np.int32)), pa.array(values.astype(np.int32)))


def encode(docs: DataFrame, ranks: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, ids, byte_ends): the ids of each text and where each one's bytes end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks)
        for part, texts in text_steps(batches, STEP):
            ids, counts = own.encode(texts)
            stops = np.cumsum(counts)
            yield pa.RecordBatch.from_arrays([part.column(1), _lists(ids, stops), _lists(own.byte_ends(ids, stops), stops)], names=[id_column, "ids", "byte_ends"])

    kind = dict(docs.dtypes)[id_column]
    return docs.select(text_column, id_column).mapInArrow(run, f"`{id_column}` {kind}, ids array<int>, byte_ends array<int>")


def _decoded(batches: Iterator[pa.RecordBatch], own: Codec) -> Iterator[tuple[object, np.ndarray, bytes]]:
    for batch in batches:
        ids, ends = (batch.column(k).values.to_numpy(zero_copy_only=False) for k in (1, 2))
        a, b = (batch.column(k).offsets.to_numpy().tolist() for k in (1, 2))
        for k in range(batch.num_rows):
            own_ids = ids[a[k] : a[k + 1]]
            yield batch.column(0)[k], own_ids, own.decode(own_ids, ends[b[k] : b[k + 1]].astype(np.int64))


def decode(coded: DataFrame, ranks: str, id_column: str = "doc_id") -> DataFrame:
    """(id, decoded): the bytes that encode()'s rows stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks)
        for batch in batches:
            rows = [x[2] for x in _decoded([batch], own)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=[id_column, "decoded"])

    kind = dict(coded.dtypes)[id_column]
    return coded.select(id_column, "ids", "byte_ends").mapInArrow(run, f"`{id_column}` {kind}, decoded binary")


def digests(coded: DataFrame, ranks: str, id_column: str = "doc_id") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of encode()'s rows, decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks)
        for batch in batches:
            n, of_ids, of_bytes = [], [], []
            for _, ids, decoded in _decoded([batch], own):
                n.append(len(ids))
                of_ids.append(hashlib.sha256(own.as_decimals(ids)[0][:-1]).hexdigest())
                of_bytes.append(hashlib.sha256(decoded).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], names=[id_column, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(coded.dtypes)[id_column]
    return coded.select(id_column, "ids", "byte_ends").mapInArrow(run, f"`{id_column}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def round_trip(docs: DataFrame, ranks: str, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """digests() of encode() in one pass: each step's ids are decoded where they were made. with_ids: `ids` and `byte_ends` as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks)
        for part, texts in text_steps(batches, STEP):
            ids, counts = own.encode(texts)
            ends = np.cumsum(own.length[ids])
            decoded, (decimals, decimal_ends) = own.decode(ids, ends), own.as_decimals(ids)
            last = np.cumsum(counts)
            views, of = (memoryview(decoded), memoryview(decimals)), []
            for view, where, less in zip(views, (ends, decimal_ends), (0, 1)):
                cuts = np.concatenate([[0], where])[last].tolist()
                of.append(pa.array([hashlib.sha256(view[a : max(a, b - less)]).hexdigest() for a, b in zip([0, *cuts], cuts)], pa.string()))
            more = [_lists(ids, last), _lists(own.byte_ends(ids, last), last)] if with_ids else []
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array(counts, pa.int64()), of[1], of[0], *more], names=[id_column, "n_tokens", "ids_sha256", "decoded_sha256", "ids", "byte_ends"][: 4 + len(more)])

    kind = dict(docs.dtypes)[id_column]
    return docs.select(text_column, id_column).mapInArrow(run, f"`{id_column}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, byte_ends array<int>" * with_ids)
