"""Approximate nearest neighbours: a neighbour graph by NN-descent, and greedy search in it.

Nearness is the largest inner product. Vectors are held in 8 bits a component (scaled per vector) while the graph is
built and searched; results are scored again in double precision on the original vectors.

Equal vectors are one class, under their least id, so copies fill neither lists nor beams: what follows is done over
classes, and a query's nearest classes give their least ids at the end.

1. Start: vectors with the same signs on random directions meet in blocks of about `block` rows, in `tables` drawings;
   larger sets are split by a hash. Each keeps its `degree` nearest of its blocks. Those with fewer, as they met too few,
   then meet one another in the same way, and about `block` vectors drawn by a hash: every vector has a full list.
2. Each round of NN-descent joins neighbours of neighbours: every vector is sent to the centres it neighbours, in either
   direction, where all that meet are compared if the edge of one is new; what betters a vector's list goes back to it.
   A centre takes what arrives in runs of bounded length, so one with many neighbours costs no task more memory. Rounds
   end when no more than `settled` of all list entries are new, or after `most_rounds`.
3. A query starts from its own neighbours in the graph and drawn ones, and keeps a beam of the best. In each hop the beam's vectors not
   yet visited are joined with the graph, whose rows hold their neighbours' vectors; only better ones come back.
   It ends when no beam has anything left to visit, or after `hops` (a bound that no table met has come near).

All rows are indexed. Vectors that are null or zero, hold null or non-finite components, or have another length than
most (ties: the longest) take no part, neither as query nor as candidate. Ids that repeat count once, with the
least vector in byte order; null ids take no part. Ties go to the smaller id. Fewer candidates than asked for give all;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scan_partitions, staged

LISTS = "id bigint, ids binary, scores binary, flags binary"
#: Vectors that meet at a centre at a time.
MEETING = 160


@dataclass(frozen=True)
class Plan:
    degree: int = 40
    tables: int = 6
    block: int = 800
    most_rounds: int = 12
    settled: float = 0.05
    sent_back: int = 12
    beam: int = 128
    hops: int = 40
    seed: int = 7


def _length(rows: DataFrame) -> int:
    common = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), F.desc("d")).first()
    return common["d"] if common else 0


def _usable(rows: DataFrame, dim: int) -> DataFrame:
    """(id, raw): original vectors as little-endian doubles."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            fit = pa.compute.equal(pa.compute.list_value_length(lists), dim)
            batch = batch.filter(fit)
            flat = batch.column(1).flatten()
            x = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, dim)
            good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            x = x[good].astype("<f8")
            ids = batch.column(0).filter(pa.array(good))
            yield pa.RecordBatch.from_arrays([ids, pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "raw"])

    return rows.mapInArrow(clean, "id bigint, raw binary").groupBy("id").agg(F.min("raw").alias("raw"))


def _classes(usable: DataFrame, keep: int) -> DataFrame:
    """(id, raw, ids): equal vectors as one, under their least id; ids are the `keep` least, ascending."""
    order = Window.partitionBy("raw").orderBy("id")
    least = usable.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= keep)
    return least.groupBy("raw").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("id"), "raw", "ids")


def pack(x: np.ndarray) -> list[bytes]:
    """Each row as a scale and 8-bit components."""
    scale = (np.abs(x).max(axis=1, keepdims=True) / 127).astype("<f4")
    small = np.rint(x / scale).astype(np.int8)
    return [s.tobytes() + v.tobytes() for s, v in zip(scale, small)]


def unpack(rows: list[bytes], dim: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(-1, dim + 4)
    return raw[:, 4:].view(np.int8).astype(np.float32) * np.ascontiguousarray(raw[:, :4]).view("<f4")


def _flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    rows = column.to_pylist()
    width = np.dtype(kind).itemsize
    return np.frombuffer(b"".join(x or b"" for x in rows), dtype=kind), np.fromiter((len(x or b"") // width for x in rows), dtype=np.int64, count=len(rows))


def _whole_groups(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Batches of rows sorted by their first column, cut only between its values; with most, also after so many rows of one value."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        if not len(keys):
            continue
        last = int(np.searchsorted(keys, keys[-1]))
        if last or (held and held[-1].column(0)[-1].as_py() != keys[0]):
            if held and held[-1].column(0)[-1].as_py() != keys[0]:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            if last:
                yield pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks().to_batches()[0]
                held = []
        held.append(batch.slice(last))
        if most and sum(b.num_rows for b in held) > most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _lists(owner: np.ndarray, ids: np.ndarray, scores: np.ndarray, flags: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Packed rows of sorted owners."""
    if not len(owner):
        return
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    cuts = [*first.tolist(), len(owner)]
    cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array(owner[first]), cut(ids), cut(scores), cut(flags)], names=["id", "ids", "scores", "flags"])


def _top(owner: np.ndarray, ids: np.ndarray, scores: np.ndarray, flags: np.ndarray, keep: int) -> tuple[np.ndarray, ...]:
    """Each owner's `keep` best, a neighbour once; owners come out in order."""
    order = np.lexsort((flags, ids, owner))
    owner, ids, scores, flags = owner[order], ids[order], scores[order], flags[order]
    fresh = np.append(True, (owner[1:] != owner[:-1]) | (ids[1:] != ids[:-1]))[: len(owner)]
    owner, ids, scores, flags = owner[fresh], ids[fresh], scores[fresh], flags[fresh]
    order = np.lexsort((ids, -scores, owner))
    owner, ids, scores, flags = owner[order], ids[order], scores[order], flags[order]
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])[: len(owner)])
    rank = np.arange(len(owner)) - np.repeat(first, np.diff(np.append(first, len(owner))))
    top = rank < keep
    return owner[top], ids[top], scores[top], flags[top]


def _entries(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    ids, counts = _flat(batch.column(1), "<i8")
    return np.repeat(batch.column(0).to_numpy(), counts), ids, _flat(batch.column(2), "<f4")[0], _flat(batch.column(3), "i1")[0]


def _best(lists: DataFrame, keep: int, partitions: int) -> DataFrame:
    """One list for each id: its `keep` best of all, a neighbour once. Flags of repeated neighbours: the least, so that 0 (seen) stays. A vector that many others name costs no more memory than one that few do: only its best so far are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, ...] | None = None  # of the last id, which the next batch may go on with
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                own = _entries(batch.slice(at, 2_000))
                if held is not None:
                    own = tuple(np.concatenate(x) for x in zip(held, own))
                if not len(own[0]):
                    continue
                own = _top(*own, keep)
                last = int(np.searchsorted(own[0], own[0][-1]))
                yield from _lists(*(x[:last] for x in own))
                held = tuple(x[last:] for x in own)
        if held is not None:
            yield from _lists(*held)

    return lists.repartition(partitions, "id").sortWithinPartitions("id").mapInArrow(run, LISTS)


def _start(packed: DataFrame, dim: int, n: int, plan: Plan, partitions: int) -> DataFrame:
    bits = max(0, int(np.ceil(np.log2(max(1, n / plan.block)))))
    directions = np.random.default_rng(plan.seed).normal(size=(plan.tables, dim, bits)).astype(np.float32)

    def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unpack(batch.column(1).to_pylist(), dim)
            for k, way in enumerate(directions):
                code = ((x @ way) > 0) @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros(len(x), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64) * plan.tables + k), *batch.columns], names=["code", "id", "packed"])

    coded = packed.select("id", "packed").mapInArrow(signs, "code bigint, id bigint, packed binary")
    sizes = coded.groupBy("code").agg(F.ceil(F.count(F.lit(1)) / (2 * plan.block)).alias("parts"))
    dealt = coded.join(sizes, "code").select(F.xxhash64("code", F.pmod(F.xxhash64("id", "code"), "parts")).alias("box"), "id", "packed")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_groups(batches, 8 * plan.block):
            box, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x = unpack(batch.column(2).to_pylist(), dim)
            cuts = [*np.flatnonzero(np.append(True, box[1:] != box[:-1])).tolist(), len(box)]
            for a, b in zip(cuts, cuts[1:]):
                for at in range(a, b, 4 * plan.block):
                    own, vectors = ids[at : min(b, at + 4 * plan.block)], x[at : min(b, at + 4 * plan.block)]
                    if len(own) < 2:
                        continue
                    product = vectors @ vectors.T
                    np.fill_diagonal(product, -np.inf)
                    m = min(plan.degree, len(own) - 1)
                    top = np.argpartition(-product, m - 1, axis=1)[:, :m]
                    score = np.take_along_axis(product, top, axis=1).astype("<f4")
                    yield from _lists(np.repeat(own, m), own[top].ravel(), score.ravel(), np.ones(top.size, dtype=np.int8))

    met = dealt.repartition(partitions, "box").sortWithinPartitions("box").mapInArrow(meet, LISTS)
    return _best(met, plan.degree, partitions)


def _drawn(packed: DataFrame, wanted: DataFrame, dim: int, n: int, plan: Plan, partitions: int, salt: int) -> DataFrame:
    """For wanted's ids: the `degree` nearest of the vectors that a hash deals to the same box, about `block` of them."""
    box = F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(max(1, n // max(plan.block, 4 * plan.degree))))
    asked = wanted.select("id", F.lit(True).alias("asked"))
    dealt = packed.select(box.alias("box"), "id", "packed").join(asked.select(box.alias("box")).distinct(), "box", "left_semi").join(asked, "id", "left").select("box", "id", "packed", "asked")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_groups(batches, 8 * plan.block):
            boxes, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x = unpack(batch.column(2).to_pylist(), dim)
            asks = batch.column(3).is_valid().to_numpy(zero_copy_only=False)
            cuts = [*np.flatnonzero(np.append(True, boxes[1:] != boxes[:-1])).tolist(), len(boxes)]
            for a, b in zip(cuts, cuts[1:]):
                rows = np.flatnonzero(asks[a:b])
                m = min(plan.degree, b - a - 1)
                if m < 1:
                    continue
                for at in range(0, len(rows), plan.block):
                    own = rows[at : at + plan.block]
                    product = x[a:b][own] @ x[a:b].T
                    product[np.arange(len(own)), own] = -np.inf
                    top = np.argpartition(-product, m - 1, axis=1)[:, :m]
                    score = np.take_along_axis(product, top, axis=1).astype("<f4")
                    yield from _lists(np.repeat(ids[a:b][own], m), ids[a:b][top].ravel(), score.ravel(), np.ones(top.size, dtype=np.int8))

    return dealt.repartition(partitions, "box").sortWithinPartitions("box").mapInArrow(meet, LISTS)


def _completed(graph: DataFrame, packed: DataFrame, dim: int, n: int, plan: Plan, partitions: int) -> DataFrame:
    """graph, in which every vector has `degree` neighbours, or all others where there are fewer."""
    need = min(plan.degree, n - 1)
    for salt in range(9):
        short = staged(packed.join(graph.filter(F.octet_length("ids") >= 8 * need), "id", "left_anti") if need > 0 else packed.limit(0), "short")
        count = short.count()
        if not count:
            return graph
        mates = graph.unionByName(_start(short, dim, count, plan, partitions)) if not salt else graph
        graph = staged(_best(mates.unionByName(_drawn(packed, short, dim, n, plan, partitions, salt)), plan.degree, partitions), "graph")
    raise RuntimeError(f"{count} vectors have fewer than {need} neighbours")


def _both_ways(graph: DataFrame, plan: Plan, partitions: int) -> DataFrame:
    """Each vector's neighbours and the nearest that have it as theirs."""

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task hands on its best for each vector: what many name comes as one list a batch.
        for batch in batches:
            owner, ids, scores, flags = _entries(batch)
            yield from _lists(*_top(ids, owner, scores, flags, plan.degree))

    turned = _best(graph.mapInArrow(turn, LISTS), plan.degree, partitions)
    return _best(graph.unionByName(turned), 2 * plan.degree, partitions)


def _sent(graph: DataFrame, packed: DataFrame, plan: Plan, partitions: int) -> DataFrame:
    """(centre, member, flag, bound, packed), sorted by centre: every vector at all that it neighbours in either direction."""
    bound = graph.select("id", F.substring("scores", 4 * (plan.degree - 1) + 1, 4).alias("bound"))
    rows = _both_ways(graph, plan, partitions).join(packed.select("id", "packed"), "id").join(bound, "id", "left")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                ids, counts = _flat(batch.column(1), "<i8")
                flags = _flat(batch.column(3), "i1")[0]
                row = pa.array(np.repeat(np.arange(batch.num_rows), counts))
                last = np.array([np.frombuffer(x, dtype="<f4")[0] if x else -np.inf for x in batch.column(5).to_pylist()], dtype=np.float32)
                yield pa.RecordBatch.from_arrays([pa.array(ids), batch.column(0).take(row), pa.array(flags), pa.array(np.repeat(last, counts)), batch.column(4).take(row)], names=["centre", "member", "flag", "bound", "packed"])

    sent = rows.select("id", "ids", "scores", "flags", "packed", "bound").mapInArrow(send, "centre bigint, member bigint, flag tinyint, bound float, packed binary")
    return sent.repartition(partitions, "centre").sortWithinPartitions("centre")


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    centre = batch.column(0).to_numpy()
    cuts = [*np.flatnonzero(np.append(True, centre[1:] != centre[:-1])).tolist(), len(centre)]
    for a, b in zip(cuts, cuts[1:]):
        for at in range(a, b, MEETING):
            yield at, min(b, at + MEETING)


def _descend(graph: DataFrame, packed: DataFrame, dim: int, plan: Plan, partitions: int) -> DataFrame:
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_groups(batches, 50_000):
            member, flag, bound = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3))
            x = unpack(batch.column(4).to_pylist(), dim)
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for a, b in _runs(batch):
                new = flag[a:b] > 0
                if not new.any():
                    continue
                product = x[a:b] @ x[a:b].T
                product[~(new[:, None] | new)] = -np.inf
                product[(product < bound[a:b, None]) | (member[a:b, None] == member[a:b])] = -np.inf
                m = min(plan.sent_back, b - a - 1)
                if m < 1:
                    continue
                top = np.argpartition(-product, m - 1, axis=1)[:, :m]
                score = np.take_along_axis(product, top, axis=1)
                row, column = np.nonzero(score > -np.inf)
                found.append((member[a:b][row], member[a:b][top[row, column]], score[row, column]))
            if found:
                owner, ids, scores = (np.concatenate(c) for c in zip(*found))
                order = np.lexsort((ids, owner))
                owner, ids, scores = owner[order], ids[order], scores[order]
                fresh = np.append(True, (owner[1:] != owner[:-1]) | (ids[1:] != ids[:-1]))[: len(owner)]
                yield from _lists(owner[fresh], ids[fresh], scores[fresh].astype("<f4"), np.ones(int(fresh.sum()), dtype=np.int8))

    better = _sent(graph, packed, plan, partitions).mapInArrow(meet, LISTS)
    seen = graph.withColumn("flags", F.unhex(F.repeat(F.lit("00"), F.octet_length("flags"))))
    return _best(seen.unionByName(better), plan.degree, partitions)


def build_graph(packed: DataFrame, dim: int, n: int, plan: Plan, partitions: int, start: DataFrame | None = None) -> DataFrame:
    """The neighbour graph after as many rounds as it takes until few entries are new. start: other lists to begin with."""
    graph = _completed(staged(_start(packed, dim, n, plan, partitions), "graph") if start is None else start, packed, dim, n, plan, partitions)
    for _ in range(plan.most_rounds):
        graph = staged(_descend(graph, packed, dim, plan, partitions), "graph")
        share = graph.agg(F.sum(F.octet_length("flags")).alias("all"), F.sum(F.size(F.split(F.hex("flags"), "1")) - 1).alias("new")).first()
        if (share["new"] or 0) <= plan.settled * (share["all"] or 0):
            break
    return graph


def nearest(vectors: DataFrame, is_query: Callable[[str], object], k: int = 20, plan: Plan = Plan(), id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): for rows whose id meets is_query, the k nearest others found."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_column).cast("bigint").alias("id"), F.col(column).cast("array<double>").alias("v")).dropna()
    dim = _length(rows)
    schema = f"query_id bigint, rank int, `{id_column}` bigint, score double"
    if not dim:
        return spark.createDataFrame([], schema)
    if plan.beam < k or plan.degree < k:
        raise ValueError("degree and beam must not be less than k")
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * scan_partitions(vectors))

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype="<f8").reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pack(x), pa.binary())], names=["id", "raw", "ids", "packed"])

    base = staged(_classes(_usable(rows, dim), k + 1).mapInArrow(shrink, "id bigint, raw binary, ids array<bigint>, packed binary"), "vectors")
    packed, n = base.select("id", "packed"), base.count()
    asking = staged(_usable(rows.filter(is_query("id")), dim).withColumnRenamed("id", "query_id").join(base.select("id", "raw"), "raw").select("query_id", "id"), "asking")
    graph = build_graph(packed, dim, n, plan, partitions)

    # The graph with its neighbours' vectors: one row a vector, or more where many have it as a neighbour.
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_groups(batches, 50_000):
            centre, member, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(4).to_pylist()
            out = [(int(centre[a]), member[a:b].tobytes(), b"".join(rows[a:b])) for a, b in _runs(batch)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.binary(), pa.binary()))], names=["node", "members", "packs"])

    around = staged(_sent(graph, packed, plan, partitions).mapInArrow(gather, "node bigint, members binary, packs binary"), "around")
    queries = staged(packed.join(asking.select("id").distinct(), "id", "left_semi"), "queries")
    own = graph.join(queries.select("id"), "id", "left_semi").withColumn("flags", F.unhex(F.repeat(F.lit("01"), F.octet_length("flags"))))
    beams = staged(_best(own.unionByName(_drawn(packed, queries, dim, n, plan, partitions, -1)), plan.beam, partitions), "beams")

    def to_visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts = _flat(batch.column(1), "<i8")
            scores, flags = _flat(batch.column(2), "<f4")[0], _flat(batch.column(3), "i1")[0]
            row = np.repeat(np.arange(batch.num_rows), counts)
            stops = np.cumsum(counts)
            bound = np.where(counts < plan.beam, np.float32(-np.inf), scores[np.maximum(stops - 1, 0)] if len(scores) else np.float32(-np.inf)).astype(np.float32)
            go = flags > 0
            where = pa.array(row[go])
            yield pa.RecordBatch.from_arrays([pa.array(ids[go]), batch.column(0).take(where), pa.array(bound[row[go]]), batch.column(4).take(where)], names=["node", "query", "bound", "packed"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            query, bound = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            own = unpack(batch.column(2).to_pylist(), dim)
            found = []
            for q, low, x, members, packs in zip(query.tolist(), bound.tolist(), own, batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                ids = np.frombuffer(members, dtype="<i8")
                raw = np.frombuffer(packs, dtype=np.uint8).reshape(-1, dim + 4)
                score = raw[:, 4:].view(np.int8).astype(np.float32) @ x * np.ascontiguousarray(raw[:, :4]).view("<f4")[:, 0]
                good = (score >= low) & (ids != q)
                if good.any():
                    found.append((np.full(int(good.sum()), q), ids[good], score[good]))
            if found:
                owner, ids, scores = (np.concatenate(c) for c in zip(*found))
                order = np.lexsort((ids, owner))
                owner, ids, scores = owner[order], ids[order], scores[order]
                fresh = np.append(True, (owner[1:] != owner[:-1]) | (ids[1:] != ids[:-1]))[: len(owner)]
                yield from _lists(owner[fresh], ids[fresh], scores[fresh].astype("<f4"), np.ones(int(fresh.sum()), dtype=np.int8))

    for _ in range(plan.hops):
        front = beams.join(queries, "id").select("id", "ids", "scores", "flags", "packed").mapInArrow(to_visit, "node bigint, query bigint, bound float, packed binary")
        better = front.join(around, "node").select("query", "bound", "packed", "members", "packs").mapInArrow(visit, LISTS)
        visited = beams.withColumn("flags", F.unhex(F.repeat(F.lit("00"), F.octet_length("flags"))))
        beams = staged(_best(visited.unionByName(better), plan.beam, partitions), "beams")
        if beams.filter(F.contains("flags", F.unhex(F.lit("01")))).isEmpty():
            break

    full = beams.agg(F.count(F.lit(1)).alias("beams"), F.min(F.octet_length("ids")).alias("least")).first()
    if n > 1 and (full["beams"] != queries.count() or (full["beams"] and full["least"] < 8 * min(k, n - 1))):
        raise RuntimeError("a query has fewer candidates than asked for")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts = _flat(batch.column(1), "<i8")
            row = pa.array(np.repeat(np.arange(batch.num_rows), counts))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), pa.array(ids)], names=["query_id", "id"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype="<f8").reshape(-1, dim) for k in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((a * b).sum(axis=1))], names=["query_id", "id", "score"])

    # Classes in the order of score and least id: the members of more than k + 1 of them are not needed, nor more than k + 1 of each.
    pairs = beams.mapInArrow(spread, "query_id bigint, id bigint").unionByName(queries.select(F.col("id").alias("query_id"), "id"))
    scored = pairs.join(base.select("id", "raw"), "id").join(base.select(F.col("id").alias("query_id"), F.col("raw").alias("own")), "query_id")
    scored = scored.select("query_id", "id", "raw", "own").mapInArrow(score, "query_id bigint, id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    met = scored.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1).join(base.select("id", "ids"), "id")
    near = met.groupBy(F.col("query_id").alias("id")).agg(F.collect_list(F.transform("ids", lambda i: F.struct((-F.col("score")).alias("far"), i.alias("id")))).alias("near"))
    near = near.select("id", F.slice(F.array_sort(F.flatten("near")), 1, k + 1).alias("near"))
    found = asking.join(near, "id").select("query_id", F.posexplode(F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)).alias("place", "x"))
    return found.select("query_id", (F.col("place") + 1).alias("rank"), F.col("x.id").alias(id_column), (-F.col("x.far")).alias("score"))
