"""Ranked lexical search by Block-Max WAND over an index of fixed-size compressed posting blocks.

Terms are the runs of ASCII letters, digits and all other characters above U+007F, with A-Z lower-cased. The index is a
table in the shared folder. Documents are gathered into segments of bounded text and distinct terms; within a segment
they are numbered in the order of their ids, and each term's postings are cut into blocks of 128. A row is one block:
its last document number and its maximum impact in the open, document numbers as differences and occurrences as two
byte strings of variable-length numbers. One more row a segment holds ids and length measures of its documents.

A posting's impact is (1000000000*tf) div (1000*tf + 8*m), where m is the document's length measure 10 + (90*n*N) div L;
a term's weight is floor(1000 * ln((2N+2) / (2df+1))), and a document's score the sum of weight x impact over the
query's terms, once each.

Queries are taken in blocks of bounded size against all segments. In a segment the block boundaries of a query's terms
cut the document numbers into intervals, over each of which every term has one block. Shallow pointer moves (a search
for each boundary among the last numbers of a term's blocks) give an interval's bound, the sum of weight x maximum
impact. Intervals are taken in descending bound. Those whose bound is below the k-th best score so far are skipped before
anything is decompressed; in the others document numbers are decompressed first, a document is a pivot if the bounds of
the terms that hold it still reach that score, and only blocks with pivots have their occurrences decompressed. A few
segments, chosen by a hash, are searched first: the k-th best score over them bounds the others from the start.

Null and empty texts have no terms and are never found; queries without terms, or whose terms are in no document, give no
rows. Equal scores go by ascending id, null ids last. Repeated rows are documents of their own. Rows of one query id are
one query, and so are those with a null id. Texts are taken whole: one longer than a segment is a segment. Empty tables
give no rows. Columns other than ids and texts are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import staged

BLOCK = 128
#: Bounds of a segment: bytes of text, distinct terms, documents.
SEGMENT_BYTES, SEGMENT_TERMS, SEGMENT_DOCS = 16_000_000, 400_000, 1_000_000
#: Terms that one block of queries holds at most, unless a single query has more.
QUERY_TERMS = 200_000
#: One segment in so many is searched before the others.
FIRST_OF = 16
_STEP = 1_000_000
#: Bytes of terms as they are or lower-cased, all others as spaces.
_TERM_BYTES = bytes(b + 32 if 65 <= b < 91 else b if 48 <= b < 58 or 97 <= b < 123 or b > 127 else 32 for b in range(256))
_IS_TERM = np.frombuffer(_TERM_BYTES, dtype=np.uint8) != 32


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TERM_BYTES).split()


def _steps(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of some bytes with their first column as bytes, null as empty."""
    texts = pa.compute.fill_null(batch.column(0).cast(pa.binary()), b"")
    sizes = np.cumsum(pa.compute.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at, done = 0, 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(sizes, done + _STEP, side="right")))
        yield batch.slice(at, end - at), texts.slice(at, end - at)
        at, done = end, int(sizes[end - 1])


def term_counts(texts: pa.Array) -> np.ndarray:
    """How many terms each text has, without cutting them out."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    inside = np.zeros(offsets[-1] - offsets[0] + 1, dtype=bool)
    if len(inside) > 1:
        inside[1:] = _IS_TERM[np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]]
    at = offsets - offsets[0]
    starts = inside[1:] & ~inside[:-1]
    full = at[:-1][at[:-1] < at[1:]]
    starts[full] = inside[1:][full]  # a text begins anew, whatever the one before ended with
    return np.diff(np.concatenate([[0], np.cumsum(starts)])[at])


@dataclass(frozen=True)
class Totals:
    """docs: documents with a term; terms: all their terms, with repeats."""

    docs: int
    terms: int

    def measure(self, n: np.ndarray) -> np.ndarray:
        if int(n.max(initial=0)) * 90 * self.docs >= 2**63:
            return np.array([10 + 90 * int(x) * self.docs // self.terms for x in n], dtype=np.int64)
        return 10 + 90 * n.astype(np.int64) * self.docs // max(1, self.terms)

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.docs + 2) / (2 * df + 1)))


def totals(docs: DataFrame, text_column: str = "text") -> Totals:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = every = 0
        for batch in batches:
            for _, texts in _steps(batch):
                n = term_counts(texts)
                full, every = full + int((n > 0).sum()), every + int(n.sum())
        yield pa.RecordBatch.from_pydict({"docs": [full], "terms": [every]})

    found = docs.select(text_column).mapInArrow(count, "docs bigint, terms bigint").agg(F.sum("docs"), F.sum("terms")).first()
    return Totals(found[0] or 0, found[1] or 0)


def put_numbers(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in groups of seven bits, the least first, a high bit where more follow; and the bytes of each."""
    n = np.ones(len(values), dtype=np.int64)
    for bits in range(7, 63, 7):
        more = values >> bits > 0
        if not more.any():
            break
        n += more
    ends = np.cumsum(n)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    for k in range(int(n.max(initial=0))):
        has = n > k
        out[(ends - n)[has] + k] = (values[has] >> 7 * k & 127) | np.where(n[has] > k + 1, 128, 0)
    return out, n


def get_numbers(raw: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << 7 * place, starts) if len(ends) else ends.astype(np.int64)


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


class _Segment:
    """The documents gathered for the next segment."""

    def __init__(self) -> None:
        self.places: dict[bytes, int] = {}
        self.codes: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.ids: list[pa.Array] = []
        self.bytes = self.docs = 0

    def add(self, ids: pa.Array, texts: pa.Array) -> None:
        found, sizes = [], []
        for text in texts.to_pylist():
            own = terms(text)
            sizes.append(len(own))
            found += own
        coded = pa.array(found, pa.binary()).dictionary_encode()
        places = np.fromiter((self.places.setdefault(t, len(self.places)) for t in coded.dictionary.to_pylist()), dtype=np.int64, count=len(coded.dictionary))
        self.codes.append(places[coded.indices.to_numpy()].astype(np.int32))
        self.sizes.append(np.array(sizes, dtype=np.int64))
        self.ids.append(ids)
        self.bytes += int(pa.compute.sum(pa.compute.binary_length(texts)).as_py() or 0)
        self.docs += len(ids)

    def full(self, most_bytes: int) -> bool:
        return self.bytes >= most_bytes or len(self.places) >= SEGMENT_TERMS or self.docs >= SEGMENT_DOCS

    def rows(self, number: int, whole: Totals, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        ids = pa.concat_arrays(self.ids)
        order = pa.compute.sort_indices(ids).to_numpy()
        sizes = np.concatenate(self.sizes)
        at = np.empty(len(order), dtype=np.int64)
        at[order] = np.arange(len(order))
        n = len(ids)
        key = np.concatenate(self.codes).astype(np.int64) * n + np.repeat(at, sizes)
        key.sort()
        new = np.flatnonzero(np.diff(key, prepend=-1))
        tf = np.diff(np.append(new, len(key)))
        term, doc = np.divmod(key[new], n)
        m = whole.measure(sizes[order])
        impact = impacts(tf, m[doc])
        first = np.flatnonzero(np.diff(term, prepend=-1))
        place = np.arange(len(term)) - np.repeat(first, np.diff(np.append(first, len(term))))
        starts = np.flatnonzero(place % BLOCK == 0)
        gaps = np.diff(doc, prepend=0)
        gaps[starts] = doc[starts]
        names = pa.array(self.places, pa.binary())
        kind = schema.field("ids").type
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.nulls(1, pa.binary()), *[pa.nulls(1, pa.int64())] * 3, *[pa.nulls(1, pa.binary())] * 2, pa.array([ids.take(pa.array(order))], kind), pa.array([m.tobytes()], pa.binary())], schema=schema)
        if not len(starts):
            return
        most, count = np.maximum.reduceat(impact, starts), np.diff(np.append(starts, len(doc)))
        packed = []
        for values in (gaps, tf):
            data, width = put_numbers(values)
            packed.append(_binary(data, np.add.reduceat(width, starts)))
        blocks = len(starts)
        columns = [pa.array(np.full(blocks, number)), names.take(pa.array(term[starts])), pa.array(doc[starts + count - 1]), pa.array(most), pa.array(count), *packed, pa.nulls(blocks, kind), pa.nulls(blocks, pa.binary())]
        yield from pa.Table.from_arrays(columns, schema=schema).to_batches(max_chunksize=20_000)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def build(docs: DataFrame, whole: Totals, id_column: str = "doc_id", text_column: str = "text", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The index, written to the shared folder: (segment, term, last, most, n, docs, tfs) a block; (segment, ids, measures) a segment."""
    kind = dict(docs.dtypes)[id_column]
    layout = f"segment bigint, term binary, last bigint, most bigint, n bigint, docs binary, tfs binary, ids array<{kind}>, measures binary"

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        own, schema = _Segment(), None
        for batch in batches:
            if schema is None:
                value = pa.field("element", batch.schema.field(1).type)
                plain = [("segment", pa.int64()), ("term", pa.binary()), ("last", pa.int64()), ("most", pa.int64()), ("n", pa.int64()), ("docs", pa.binary()), ("tfs", pa.binary())]
                schema = pa.schema([*plain, ("ids", pa.list_(value)), ("measures", pa.binary())])
            for part, texts in _steps(batch):
                own.add(part.column(1), texts)
                if own.full(segment_bytes):
                    yield from own.rows(number, whole, schema)
                    own, number = _Segment(), number + 1
        if own.docs:
            yield from own.rows(number, whole, schema)

    return staged(docs.select(text_column, id_column).mapInArrow(segments, layout), "blocks")


@dataclass
class Query:
    id: object
    terms: list[bytes]


def query_blocks(queries: DataFrame, id_column: str, text_column: str) -> Iterator[list[Query]]:
    """Queries with their distinct terms, in blocks of bounded size."""
    kind = dict(queries.dtypes)[id_column]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _steps(batch):
                own = [sorted(set(terms(t))) for t in texts.to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(own, pa.list_(pa.binary()))], names=["id", "terms"])

    rows = queries.select(text_column, id_column).mapInArrow(cut, f"id {kind}, terms array<binary>").select("id", F.explode("terms").alias("term"))
    block: list[Query] = []
    held = 0
    for row in rows.groupBy("id").agg(F.collect_set("term").alias("terms")).toLocalIterator():
        block.append(Query(row["id"], sorted(map(bytes, row["terms"]))))
        held += len(row["terms"])
        if held >= QUERY_TERMS:
            yield block
            block, held = [], 0
    if block:
        yield block


class Postings:
    """One segment's blocks of the queries' terms, in the order of terms and document numbers."""

    def __init__(self, table: pa.Table) -> None:
        heads = table.filter(pa.compute.is_null(table["term"]))
        self.ids = heads["ids"].combine_chunks().flatten() if heads.num_rows else None
        self.m = np.frombuffer(heads["measures"][0].as_py(), dtype=np.int64) if heads.num_rows else None
        table = table.filter(pa.compute.is_valid(table["term"])).sort_by([("term", "ascending"), ("last", "ascending")]).combine_chunks()
        names = table["term"].to_pylist()
        self.last, self.most, self.n = (table[c].to_numpy() for c in ("last", "most", "n"))
        self.docs, self.tfs = table["docs"].to_pylist(), table["tfs"].to_pylist()
        self.spans: dict[bytes, tuple[int, int]] = {}
        for k, name in enumerate(names):
            self.spans[name] = (self.spans[name][0] if name in self.spans else k, k + 1)

    def doc_numbers(self, blocks: np.ndarray) -> np.ndarray:
        gaps = get_numbers(np.frombuffer(b"".join([self.docs[b] for b in blocks]), dtype=np.uint8))
        n = self.n[blocks]
        starts = np.cumsum(n) - n
        sums = np.cumsum(gaps)
        return sums - np.repeat(sums[starts] - gaps[starts], n)

    def occurrences(self, blocks: np.ndarray) -> np.ndarray:
        return get_numbers(np.frombuffer(b"".join([self.tfs[b] for b in blocks]), dtype=np.uint8))

    def best(self, weighted: list[tuple[bytes, int]], k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and scores of the k best documents that score `floor` (over 0) or more; ties to the smaller number."""
        held = [(*self.spans[t], w) for t, w in weighted if w > 0 and t in self.spans]
        doc, score = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        if not held:
            return doc, score
        weight = np.zeros(len(self.last), dtype=np.int64)
        for start, end, w in held:
            weight[start:end] = w
        edges = np.unique(np.concatenate([self.last[start:end] for start, end, _ in held]))
        bound, at = np.zeros(len(edges), dtype=np.int64), np.full((len(held), len(edges)), -1, dtype=np.int64)
        for row, (start, end, w) in zip(at, held):
            block = start + np.searchsorted(self.last[start:end], edges)
            inside = block < end
            row[inside] = block[inside]
            bound[inside] += w * self.most[block[inside]]
        order = np.argsort(-bound, kind="stable")
        done, size = 0, 16
        while done < len(order):
            chosen = order[done : done + size]
            chosen = chosen[bound[chosen] >= floor]
            if not len(chosen):
                break
            done, size = done + size, size * 2
            wanted = np.zeros(len(edges), dtype=bool)
            wanted[chosen] = True
            blocks = np.unique(at[:, chosen])
            blocks = blocks[blocks >= 0]
            numbers = self.doc_numbers(blocks)
            of = np.repeat(blocks, self.n[blocks])
            inside = wanted[np.searchsorted(edges, numbers)]
            own, place = np.unique(numbers[inside], return_inverse=True)
            reach = np.zeros(len(own), dtype=np.int64)
            np.add.at(reach, place, (weight * self.most)[of[inside]])
            pivot = reach >= floor
            if not pivot.any():
                continue
            take = inside.copy()
            take[inside] = pivot[place]
            needed = np.unique(of[take])
            kept = take[np.isin(of, needed)]
            tf = self.occurrences(needed)[kept]
            exact = np.zeros(len(own), dtype=np.int64)
            np.add.at(exact, np.searchsorted(own, numbers[take]), weight[of[take]] * impacts(tf, self.m[numbers[take]]))
            good = pivot & (exact >= floor)
            doc, score = np.concatenate([doc, own[good]]), np.concatenate([score, exact[good]])
            top = np.lexsort((doc, -score))[:k]
            doc, score = doc[top], score[top]
            if len(doc) == k:
                floor = max(floor, int(score[-1]))
        return doc, score


def _search(hits: DataFrame, block: list[Query], weights: dict[bytes, int], floors: dict[int, int], k: int, id_kind: str) -> DataFrame:
    """(query: its place in the block, id, score): the best of each segment."""
    weighted = [[(t, weights[t]) for t in q.terms if t in weights] for q in block]

    def run(table: pa.Table) -> pa.Table:
        own = Postings(table)
        query, docs, scores = [], [], []
        for number, its in enumerate(weighted):
            doc, score = own.best(its, k, floors.get(number, 1))
            query.append(np.full(len(doc), number))
            docs.append(doc)
            scores.append(score)
        ids = own.ids.take(pa.array(np.concatenate(docs)))
        return pa.table({"query": pa.array(np.concatenate(query)), "id": ids, "score": pa.array(np.concatenate(scores))})

    return hits.groupBy("segment").applyInArrow(run, f"query bigint, id {id_kind}, score bigint")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(index: DataFrame, whole: Totals, queries: DataFrame, k: int = 10, query_id: str = "item_id", text_column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(query_id, rank, id_column, score). index: of `build`, with the same totals."""
    spark: SparkSession = index.sparkSession
    id_kind = index.schema["ids"].dataType.elementType.simpleString()
    found = []
    for block in query_blocks(queries, query_id, text_column):
        names = sorted({t for q in block for t in q.terms})
        # At most QUERY_TERMS terms and one query's: small enough to broadcast.
        wanted = F.broadcast(spark.createDataFrame([(bytearray(t),) for t in names], "term binary"))
        hits = staged(index.filter("term is not null").join(wanted, "term", "left_semi").select(*index.columns).unionByName(index.filter("term is null")), "hits")
        counts = hits.filter("term is not null").groupBy("term").agg(F.sum("n").alias("df")).collect()
        weights = {bytes(row["term"]): whole.weight(row["df"]) for row in counts}
        first = F.pmod(F.xxhash64("segment"), F.lit(FIRST_OF)) == 0
        start = staged(_ranked(_search(hits.filter(first), block, weights, {}, k, id_kind), k), "first-found")
        floors = {row["query"]: row["score"] for row in start.filter(F.col("rank") == k).collect()}
        both = _search(hits.filter(~first), block, weights, floors, k, id_kind).unionByName(start.drop("rank"))
        ids = spark.createDataFrame([(n, q.id) for n, q in enumerate(block)], StructType([StructField("query", LongType()), StructField("item", queries.schema[query_id].dataType)]))
        found.append(_ranked(both, k).join(F.broadcast(ids), "query").select(F.col("item").alias(query_id), "rank", F.col("id").alias(id_column), "score"))
    if not found:
        kinds = dict(queries.dtypes)
        return spark.createDataFrame([], f"`{query_id}` {kinds[query_id]}, rank int, `{id_column}` {id_kind}, score bigint")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
