"""Vector code compression: integer product codebooks trained by partial-distance search.

Each component x becomes the integer floor(scale * x). Vectors are cut into `parts` equal consecutive parts, and each part
position has a codebook, which starts as that part of the vectors with the smallest ids. A round gives every part its
nearest entry (squared Euclidean distance, ties to the lower index) and replaces entries by the floor of their parts'
mean; unused entries stay.

The search takes a codebook's dimensions in descending variance of its entries. Each row's first candidate is the entry
nearest in the first dimension, whose distance is completed at once; the other entries then add one dimension after
another, and a mask drops the rows whose sum so far strictly exceeds their best complete distance. Distances are exact
integers: 64-bit ones where they cannot overflow, Python's otherwise.

A round is one pass over the integer vectors, which are written once to the shared folder; tasks send sums by part, entry
and dimension, as many rows as the codebooks have numbers, so neither rows nor hot labels meet in one task.

Null vectors and those with null or non-finite components are dropped; no other row is. Components beyond 64 bits take the
nearest 64-bit value, errors beyond it its largest. Shorter vectors count as filled up with zeros to the longest one's
length, and that to a multiple of `parts`. Null ids are the largest; repeated ids all take part, and among equal ids the
smaller vector comes first. Fewer vectors than entries give as many entries. An empty table gives no rows. Columns other
than the id, the vector and the label are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Rows of one vectorised step.
STEP = 8_192
_LARGEST = 2**63 - 1


@dataclass
class Codebooks:
    """books[part][entry][position]; `entries` has fewer rows than asked for where there were fewer vectors."""

    books: np.ndarray

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for x in self.books.ravel()).encode()).hexdigest()


def integers(vector: str, scale: float) -> Column:
    """The vector as array<bigint>; floor gives the nearest 64-bit number where the result has more bits."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def kept(df: DataFrame, id_column: str, vector: str, label: str, scale: float) -> DataFrame:
    whole = F.col(vector).isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))
    return df.filter(whole).select(F.col(id_column).alias("id"), F.col(label).alias("label"), F.size(vector).alias("n"), integers(vector, scale).alias("v"))


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of `width` numbers, filled up with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), width), dtype=np.int64)
    rows = np.repeat(np.arange(len(column)), sizes)
    at = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[rows, at] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def nearest(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the nearest entry's index and exact squared distance, by partial sums."""
    n, width = rows.shape
    entries = len(book)
    if not n or not width:
        return np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    most = max(int(rows.max()), -int(rows.min()), int(book.max()), -int(book.min()))
    if width * 4 * most * most > _LARGEST:
        rows, book = rows.astype(object), book.astype(object)
    exact = book.astype(object)
    spread = entries * (exact * exact).sum(axis=0) - exact.sum(axis=0) ** 2
    order = sorted(range(width), key=lambda k: (-spread[k], k))
    first = order[0]
    best = np.argmin(np.abs(rows[:, first, None] - book[None, :, first]), axis=1)
    least = ((rows - book[best]) ** 2).sum(axis=1)
    for entry in range(entries):
        at = np.flatnonzero(best != entry)
        total = np.zeros(len(at), dtype=rows.dtype)
        for k in order:
            total = total + (rows[at, k] - book[entry, k]) ** 2
            stay = (total <= least[at]).astype(bool)
            if not stay.all():
                at, total = at[stay], total[stay]
            if not len(at):
                break
        if len(at):
            better = (total < least[at]).astype(bool) | (entry < best[at])  # the rest are equally far
            at, total = at[better], total[better]
            best[at], least[at] = entry, total
    return best, least


def _parts(rows: np.ndarray, books: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    width = books.shape[2]
    for part in range(len(books)):
        yield part, rows[:, part * width : (part + 1) * width]


def _next_books(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    parts, entries, width = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(books.shape, dtype=object), np.zeros((parts, entries), dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                rows = matrix(batch.column(0).slice(at, STEP), parts * width)
                for part, own in _parts(rows, books):
                    best, _ = nearest(own, books[part])
                    count[part] += np.bincount(best, minlength=entries)
                    near = np.zeros((entries, width), dtype=np.int64 if len(own) * max(1, int(np.abs(own.astype(object)).max(initial=0))) < _LARGEST else object)
                    np.add.at(near, best, own.astype(near.dtype))
                    total[part] += near
        p, e = np.nonzero(count)
        cells = np.array([(a, b, k) for a, b in zip(p.tolist(), e.tolist()) for k in range(width)], dtype=np.int32).reshape(-1, 3)
        numbers = [str(total[tuple(c)]) for c in cells]
        yield pa.RecordBatch.from_arrays([*map(pa.array, cells.T), pa.array(numbers, pa.string()), pa.array(count[cells[:, 0], cells[:, 1]])], names=["part", "entry", "position", "total", "n"])

    found = vectors.select("v").mapInArrow(sums, "part int, entry int, position int, total string, n bigint")
    # As many rows as the codebooks have numbers.
    found = found.groupBy("part", "entry", "position").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()
    after = books.copy()
    for row in found:
        after[row["part"], row["entry"], row["position"]] = int(row["total"]) // row["n"]
    return after


def fit(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> Codebooks | None:
    """vectors: of `kept`, staged. None where there are none."""
    longest = vectors.agg(F.max("n")).first()[0]
    if longest is None:
        return None
    width = -(-longest // parts)
    first = vectors.orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(entries).toArrow()["v"].combine_chunks()
    rows = matrix(first, parts * width)
    books = np.ascontiguousarray(rows.reshape(len(rows), parts, width).transpose(1, 0, 2))
    for _ in range(rounds):
        books = _next_books(vectors, books)
    return Codebooks(books)


def encode(vectors: DataFrame, model: Codebooks) -> DataFrame:
    """(id, label, code, error)."""
    books = model.books
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, STEP):
                batch = whole.slice(at, STEP)
                rows = matrix(batch.column(2), parts * width)
                codes, error = np.zeros((len(rows), parts), dtype=np.uint8), np.zeros(len(rows), dtype=object)
                for part, own in _parts(rows, books):
                    codes[:, part], far = nearest(own, books[part])
                    error += far.astype(object)
                text = [x.tobytes().hex() for x in codes]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([min(int(x), _LARGEST) for x in error], pa.int64())], names=["id", "label", "code", "error"])

    kinds = dict(vectors.dtypes)
    return vectors.select("id", "label", "v").mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, code string, error bigint")


def with_label_error(coded: DataFrame) -> DataFrame:
    """label_error: the sum of error over equal labels. coded: staged. The labels of over a thousandth of the rows, at most
    1,000, are broadcast; the others are joined by label, so that none fills a task."""
    sums = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"), F.count(F.lit(1)).alias("rows"))
    sums = staged(sums.select(F.col("label").alias("of_label"), F.least("total", F.lit(_LARGEST).cast("decimal(38,0)")).cast("bigint").alias("label_error"), "rows"), "label-errors")
    total = sums.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    hot, rest = sums.filter(F.col("rows") * 1000 > total), sums.filter(F.col("rows") * 1000 <= total)
    marked = coded.join(F.broadcast(hot.drop("rows").withColumn("hot", F.lit(True))), F.col("label").eqNullSafe(F.col("of_label")), "left").drop("of_label")
    columns = [*coded.columns, "label_error"]
    cold = marked.filter("hot is null").drop("label_error").join(rest, F.col("label").eqNullSafe(F.col("of_label"))).select(*columns)
    return marked.filter("hot").select(*columns).unionByName(cold)


def compress(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", scale: float = 4096, parts: int = 8, entries: int = 16, rounds: int = 6) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256)."""
    vectors = staged(kept(df, id_column, vector, label, scale), "vectors")
    model = fit(vectors, parts, entries, rounds)
    coded = encode(vectors, model) if model else vectors.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"))
    digest = model.digest() if model else ""
    return with_label_error(staged(coded, "codes")).select(F.col("id").alias(id_column), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
