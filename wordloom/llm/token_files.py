"""Token ids as Parquet: a list column with dictionary or delta encoding, small row groups and page indexes.

`write` encodes the texts with the tokenizers library and writes one file per shard, in ascending id order over the
files. A row holds its shard, its start within the shard, its length and its ids, so that metadata can be read without
the ids, and the ids of a few documents by their pages. `read_index` gives each document's start over all files.

Texts are cut at spaces and line feeds, which no match of the tokenizer's pattern holds; new words are encoded by the
library, many at a time, and found by their bytes from then on. Null and empty texts hold the end id only. Rows with a null id come first;
repeated ids stay in one shard, in the order of their ids' bytes. An empty table gives no rows; other columns are not
read. Strings of added tokens are those tokens, as the library has it by default; texts that hold one are encoded whole. A
text is encoded whole however long it is.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, scan_partitions, text_steps
from .span_hash import Places

#: Places for words that a worker remembers (a power of two), and ids held for them before unused ones are dropped.
PLACES, HELD_IDS = 1 << 21, 4_000_000
#: A word of one id that parts new words when many are encoded as one text.
PARTING = "\x01"
_MARKS = frozenset(",.!?:;")
INDEX_COLUMNS = ("doc_id", "shard", "start_in_shard", "n_tokens")


def _is_latin(text: str) -> bool:
    """Only characters of Latin-1: no composition, and one small letter for each large one."""
    if text.isascii():
        return True
    try:
        return bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


class WordCodes:
    """The library's ids for each word met, found by the word's bytes; a new word takes the place of another."""

    def __init__(self, path: str, end_id: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.added = sorted(x.content.lower() for x in self.tokenizer.get_added_tokens_decoder().values())
        self.sign = os.path.commonprefix(self.added)
        if self.sign != self.sign.upper():
            self.sign = ""  # has letters, which a text may hold in another case
        (self.parting,) = self.tokenizer.encode(PARTING, add_special_tokens=False).ids
        # The same merges without normalising and pattern, for words that need neither.
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        # The byte-level alphabet: bytes that print stand for themselves, others for the characters from 256 on.
        prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
        self.alphabet = {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - prints)) if b != 32}
        self.parting_byte = chr(self.alphabet[ord(PARTING)])
        self.places = Places(PLACES)
        self.flat = np.array([end_id], dtype=np.int32)  # code 0 stands for a document's end
        self.first, self.length = np.zeros(1, dtype=np.int32), np.ones(1, dtype=np.int32)

    def forget(self) -> None:
        """Drops long words and the ids of words that have lost their place; all of them where more than half would stay."""
        self.places.forget_long()
        live = self.places.renumber(keep_first=True)
        length = self.length[live]
        if length.sum() > HELD_IDS // 2:
            self.places.forget_all()
            live, length = live[:1], length[:1]
        stop = np.cumsum(length)
        self.flat = self.flat[np.repeat(self.first[live] - stop + length, length) + np.arange(stop[-1])]
        self.first, self.length = (stop - length).astype(np.int32), length

    def learn(self, new: list[str]) -> dict[str, int]:
        """Words of small Latin letters, with a mark after them or not, are whole matches of the pattern; others go the long way."""
        simple, other, odd = [], [], []
        for w in new:
            stem = w[:-1] if w[-1:] in _MARKS else w
            (simple if stem.isalpha() and stem.islower() and _is_latin(stem) else odd if PARTING in w else other).append(w)
        parted = [w if w[-1] not in _MARKS else f"{w[:-1]} {w[-1]}" for w in simple]
        known = [self._encode(self.merges, parted, True), self._encode(self.tokenizer, other)]
        more = [self.tokenizer.encode(w, add_special_tokens=False).ids for w in odd]
        flat = np.concatenate([known[0][0], known[1][0], np.array([i for x in more for i in x], dtype=np.int32)])
        length = np.concatenate([known[0][1], known[1][1], np.fromiter(map(len, more), dtype=np.int64, count=len(more))])
        known = {w: k for k, w in enumerate([*simple, *other, *odd], len(self.first))}
        self.first = np.concatenate([self.first, (len(self.flat) + np.cumsum(length) - length).astype(np.int32)])
        self.length, self.flat = np.concatenate([self.length, length.astype(np.int32)]), np.concatenate([self.flat, flat])
        return known

    def _encode(self, tokenizer, words: list[str], as_bytes: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each word has."""
        texts = [f" {PARTING} ".join([*words[k : k + 200], ""]) for k in range(0, len(words), 200)]
        if as_bytes:
            texts = [t.replace(PARTING, self.parting_byte) if t.isascii() else t.encode().decode("latin-1").translate(self.alphabet) for t in texts]
        ids = [np.array(x.ids, dtype=np.int32) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.concatenate([*ids, np.empty(0, dtype=np.int32)])
        part = ids == self.parting
        return ids[~part], np.diff(np.flatnonzero(part), prepend=-1) - 1

    def _codes(self, slices: list[bytes]) -> np.ndarray:
        """Codes of new words, each learnt once."""
        words = [x.decode() for x in slices]
        known = self.learn(words)
        return np.array([known[w] for w in words], dtype=np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each text has, its end included."""
        if max(len(self.flat), len(self.first)) > HELD_IDS:
            self.forget()
        held = [k for k, t in enumerate(texts) if any(x in t.lower() for x in self.added)] if any(self.sign in t for t in texts) else []
        if held:
            return self._with_added(texts, held)
        # The tokenizer ignores case; in Latin-1 that is one letter for another.
        raw = [(t.lower() if _is_latin(t) else t).encode() for t in texts]
        blob = b"\n".join([*raw, b""])
        data = np.frombuffer(blob, dtype=np.uint8)
        stops = np.flatnonzero((data == 32) | (data == 10))
        starts = np.concatenate([[0], stops[:-1] + 1])[: len(stops)]
        ends = np.cumsum(np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) + 1) - 1
        last = np.searchsorted(stops, ends) + 1
        real = stops > starts
        codes = np.zeros(len(stops), dtype=np.int64)
        codes[real] = self.places.find(blob, starts[real], stops[real], self._codes)
        length = np.where(real, self.length[codes], 0)
        # Each text's end follows its last word.
        codes, length = np.insert(codes, last, 0), np.insert(length, last, 1)
        stop = np.cumsum(length)
        ids = self.flat[np.repeat(self.first[codes] - stop + length, length) + np.arange(stop[-1] if len(stop) else 0)]
        return ids, np.diff(stop[last + np.arange(len(last))], prepend=0)


    def _with_added(self, texts: list[str], held: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """encode() where the texts at `held` have strings of added tokens, which the library finds before it parts words."""
        plain = [t for k, t in enumerate(texts) if k not in set(held)]
        ids, counts = self.encode(plain)
        parts = iter(np.split(ids, np.cumsum(counts)[:-1])) if plain else iter(())
        end = self.flat[:1]
        rows = [np.append(np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, dtype=np.int32), end) if k in set(held) else next(parts) for k, t in enumerate(texts)]
        return np.concatenate(rows).astype(np.int32), np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))


def _giving_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; what Arrow holds free is given back after each."""
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()


_codes: dict = {}


def word_codes(path: str, end_id: int) -> WordCodes:
    if (path, end_id) not in _codes:
        _codes[path, end_id] = WordCodes(path, end_id)
    return _codes[path, end_id]


def highest_id(path: str) -> int:
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values())


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, shards: int | None = None, row_group: int = 16 << 20, page: int = 64 << 10, id_column: str = "doc_id", text_column: str = "text") -> str:
    """Writes docs' ids under path. shards: by default as many as the scan has partitions."""
    shards = shards or scan_partitions(docs)
    cuts = docs.agg(F.percentile_approx(id_column, [k / shards for k in range(1, shards)] or [0.5], 10_000)).first()[0] or []
    packing = np.dtype("<u2" if max(end_id, highest_id(tokenizer)) < 1 << 16 else "<u4")
    bounds = np.array(sorted(set(cuts)) if shards > 1 else [], dtype=np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_codes(tokenizer, end_id)
        for part, texts in text_steps(_giving_back(batches)):
            ids, counts = table.encode(texts)
            raw = ids.astype(packing)
            stops = np.concatenate([[0], np.cumsum(counts)]) * packing.itemsize
            keys = part.column(1)
            shard = np.searchsorted(bounds, keys.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), side="right").astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(stops.astype(np.int32)), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([keys.cast(pa.int64()), pa.array(shard), packed], names=["doc_id", "shard", "packed"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for batch in _giving_back(batches):
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = part.column(2).to_pylist()
                counts = np.fromiter((len(x) // packing.itemsize for x in rows), dtype=np.int64, count=len(rows))
                stops = np.cumsum(counts)
                ids = np.frombuffer(b"".join(rows), dtype=packing).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stops]).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(done + stops - counts), pa.array(counts), lists], names=[*INDEX_COLUMNS, "ids"])
                done += int(stops[-1])

    coded = docs.select(text_column, F.col(id_column).cast("bigint")).mapInArrow(encode, "doc_id bigint, shard int, packed binary")
    dealt = coded.repartitionById(len(bounds) + 1, "shard").sortWithinPartitions("doc_id", "packed")
    rows = dealt.mapInArrow(unpack, "doc_id bigint, shard int, start_in_shard bigint, n_tokens bigint, ids array<int>")
    (
        rows.write.option("compression", "zstd")
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", "true")
        .option("parquet.block.size", row_group)
        .option("parquet.page.size", page)
        .parquet(path)
    )
    return path


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, shard, start, n_tokens) from the metadata columns alone."""
    rows = spark.read.parquet(path).select(*INDEX_COLUMNS)
    return _with_start(spark, path, rows)


def _with_start(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    # One row a shard, and there are as many shards as files: few enough to broadcast.
    sums = spark.read.parquet(path).groupBy("shard").agg(F.sum("n_tokens").alias("in_shard"))
    before = F.coalesce(F.sum("in_shard").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = sums.select(F.col("shard").alias("s"), before.alias("base"))
    rest = [c for c in rows.columns if c not in INDEX_COLUMNS]
    return rows.join(F.broadcast(base), F.col("shard") == F.col("s")).select("doc_id", "shard", (F.col("base") + F.col("start_in_shard")).alias("start"), "n_tokens", *rest)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, shard, start, n_tokens, ids)."""
    return _with_start(spark, path, spark.read.parquet(path).select(*INDEX_COLUMNS, "ids"))


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, shard, start, n_tokens, ids_crc32) of the ids read back, as little-endian 32-bit integers."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(4)
            raw = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            at = lists.offsets.to_numpy()
            view = memoryview(raw).cast("B")
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(crc, pa.int64())], names=[*INDEX_COLUMNS, "ids_crc32"])

    rows = spark.read.parquet(path).select(*INDEX_COLUMNS, "ids")
    return _with_start(spark, path, rows.mapInArrow(sums, "doc_id bigint, shard int, start_in_shard bigint, n_tokens bigint, ids_crc32 bigint"))


def write_new(docs: DataFrame, tokenizer: str, **options) -> str:
    """write() into a new folder below the shared one."""
    return write(docs, new_path(docs.sparkSession, "token-ids"), tokenizer, **options)
