"""Token counts of a unigram model without its tokens: matches by Aho-Corasick, best path by dynamic programming.

An Aho-Corasick automaton over the vocabulary yields every piece that ends at a position, the longest first. For each
position the best score of a path to it is kept with that path's number of pieces, nothing else. Ties follow that
library: of paths with equal scores the one whose last piece starts first stays, since a later one replaces it only
with a higher score. A character that no piece of its own covers scores ten less than the worst piece and counts one
for each of its UTF-8 bytes.

White space stands before words as in the tokenizer: a mark for each space and one before the text. No piece goes on
from another character into a mark (checked when the vocabulary is read), so a best path is a path of best paths over
chunks of marks and word; a chunk is counted once and remembered. Scores that are whole numbers add up exactly.

The counts are the best segmentation of a unigram model over the vocabulary given, by the tie rule of the tokenizers
library's Unigram model. A file of another type than unigram has another segmentation of its own: for a BPE vocabulary,
whose scores are ranks of merges, these counts are not those of its own tokenizer, which joins pairs in order of rank.

Texts are counted whole, however long. Null and empty texts count 0 tokens; repeated rows and empty tables give as many rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_steps

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Bytes of chunks that a worker remembers between texts; beyond that it starts anew. What each chunk takes besides its characters, and what a character takes.
CACHED_BYTES, CHUNK_BYTES, CHARACTER_BYTES = 96 << 20, 250, 4
_CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Counter:
    held = 0  # bytes of the chunks in `known`

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        skip = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
        own = [k for k in range(model.get_piece_size()) if not any(f(k) for f in skip)]
        self.pieces = {model.id_to_piece(k): model.get_score(k) for k in own}
        self.byte_fallback = any(model.is_byte(k) for k in range(model.get_piece_size()))
        if any(MARK in p.lstrip(MARK) for p in self.pieces):
            raise ValueError("a piece holds a mark after another character")
        self.unknown = min(self.pieces.values()) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for piece, score in self.pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.known: dict[str, tuple[int, float]] = {}

    def chunk(self, text: str) -> tuple[int, float]:
        """(pieces, score) of the best path over text."""
        if (score := self.pieces.get(text)) is not None and len(text) == 1:
            return 1, score
        ends: list[list[tuple[int, float]]] = [[] for _ in text]
        for last, match in self.automaton.iter(text):
            ends[last].append(match)
        best, count = [0.0] * (len(text) + 1), [0] * (len(text) + 1)
        for i, matches in enumerate(ends, 1):
            high, pieces, single = float("-inf"), 0, False
            for length, score in sorted(matches, reverse=True):
                single |= length == 1
                if (s := best[i - length] + score) > high:
                    high, pieces = s, count[i - length] + 1
            if not single and (s := best[i - 1] + self.unknown) > high:
                high, pieces = s, count[i - 1] + (len(text[i - 1].encode()) if self.byte_fallback else 1)
            best[i], count[i] = high, pieces
        return count[-1], best[-1]

    def count(self, texts: list[str]) -> Iterator[tuple[int, float]]:
        for text in texts:
            chunks = _CHUNK.findall(MARK + text.replace(" ", MARK)) if text else []
            new = set(chunks).difference(self.known)
            more = CHUNK_BYTES * len(new) + CHARACTER_BYTES * sum(map(len, new))
            if self.held + more > CACHED_BYTES:
                self.known, self.held, new = {}, 0, set(chunks)
                more = CHUNK_BYTES * len(new) + CHARACTER_BYTES * sum(map(len, new))
            self.known.update(zip(new, map(self.chunk, new)))
            self.held += more
            got = list(map(self.known.__getitem__, chunks))
            if self.held > CACHED_BYTES:  # one text's own chunks
                self.known, self.held = {}, 0
            yield sum(n for n, _ in got), sum(s for _, s in got)


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, model: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_tokens, score) of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(model)
        for part, texts in text_steps(batches):
            n, score = zip(*own.count(texts))
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array(n, pa.int64()), pa.array(map(float, score), pa.float64())], names=[id_column, "n_tokens", "score"])

    kind = dict(docs.dtypes)[id_column]
    return docs.select(text_column, id_column).mapInArrow(run, f"`{id_column}` {kind}, n_tokens bigint, score double")
