"""From readings to spellings: candidates, completions, and the cheapest path through a lattice.

A dictionary is (reading, surface, left_id, right_id, cost, dependent). A sentence's substrings meet readings as equal
strings, so the dictionary is joined and never held whole; each sentence's own entries then make its lattice, and the
lattices of many sentences are solved together, place by place, by least sums over the classes that arrive there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kana

# Cost of a character in no word, of a pair out of the matrix, the class of sentence ends, a learnt use.
UNKNOWN_COST = 3500
OUTSIDE_COST = 500
BOUNDARY = 0
LEARNT_BONUS = 400
# Spellings shown for a segment.
SEGMENT_SHOWN = 9
#: Characters and edges of sentences that a task solves together.
SOLVED_TOGETHER = 200_000


def deduplicate(entries: DataFrame) -> DataFrame:
    """The cheapest entry of each (reading, surface)."""
    order = Window.partitionBy("reading", "surface").orderBy("cost", "left_id", "right_id")
    return entries.withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")


def ranked_cost(cost: Column, learnt: Column) -> Column:
    return cost.cast("bigint") - LEARNT_BONUS * F.coalesce(learnt, F.lit(0))


def candidates(readings: DataFrame, entries: DataFrame, learnt: DataFrame | None = None) -> DataFrame:
    """(reading, surface, cost, place): a reading's spellings, the cheapest first, ties to the shorter in bytes."""
    met = readings.join(entries.select("reading", "surface", "cost"), "reading")
    uses = F.lit(None).cast("int")
    if learnt is not None:
        met = met.join(learnt.select("reading", "surface", "uses"), ["reading", "surface"], "left")
        uses = F.col("uses")
    met = met.withColumn("cost", ranked_cost(F.col("cost"), uses))
    order = Window.partitionBy("reading").orderBy("cost", F.octet_length("surface"), "surface")
    return met.withColumn("place", F.row_number().over(order)).select("reading", "surface", "cost", "place")


def completions(prefixes: DataFrame, entries: DataFrame, limit: int = 6) -> DataFrame:
    """(prefix, reading, cost, place): readings that begin with it, by their cheapest entry."""
    from .search import prefixes as cut

    least = entries.groupBy("reading").agg(F.min("cost").alias("cost"))
    asked = least.withColumn("prefix", F.explode(cut(F.col("reading")))).join(prefixes, "prefix")
    order = Window.partitionBy("prefix").orderBy("cost", "reading")
    return asked.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit).select("prefix", "reading", "cost", "place")


def predictions(prefixes: DataFrame, entries: DataFrame, limit: int = 6) -> DataFrame:
    """(prefix, reading, surface, place): the best spelling of each completion."""
    order = Window.partitionBy("reading").orderBy("cost", F.octet_length("surface"), "surface")
    best = entries.withColumn("n", F.row_number().over(order)).filter("n = 1").select("reading", "surface")
    return completions(prefixes, entries, limit).join(best, "reading").select("prefix", "reading", "surface", "place")


def connection_cost(pairs: DataFrame, matrix: DataFrame, rows: int, columns: int) -> DataFrame:
    """pairs (previous_right, next_left) with cost: 0 where the matrix has no cell, OUTSIDE_COST beyond it."""
    met = pairs.join(matrix.select(F.col("row").alias("previous_right"), F.col("col").alias("next_left"), F.col("cost").alias("cell")), ["previous_right", "next_left"], "left")
    inside = (F.col("previous_right") < rows) & (F.col("next_left") < columns)
    return met.withColumn("cost", F.when(inside, F.coalesce("cell", F.lit(0))).otherwise(OUTSIDE_COST)).drop("cell")


def spans_of(sentences: DataFrame, entries: DataFrame, id_column: str = "sentence_id") -> DataFrame:
    """(id, key, start, length, reading) of the substrings that some entry's reading may equal: their first two characters and their length are those of a reading. key is the digest of the sentence, start counts from 0."""
    n = F.char_length("reading")
    shapes = entries.filter(n > 0).groupBy(F.substring("reading", 1, 2).alias("head")).agg(F.collect_set(n).alias("lengths"))
    longest = entries.agg(F.coalesce(F.max(n), F.lit(0)).alias("longest"))
    # Two characters begin the readings of two and more, one character those of one.
    at = lambda i: F.transform(F.when(i < n, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))), lambda k: F.struct((i - 1).alias("start"), F.substring("reading", i, k).alias("head"), F.substring("reading", i, F.col("longest")).alias("rest")))
    places = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), at))
    headed = sentences.filter(n > 0).crossJoin(F.broadcast(longest)).select(id_column, F.md5("reading").alias("key"), F.explode(places).alias("s")).select(id_column, "key", "s.*")
    met = headed.join(shapes, "head").select(id_column, "key", "start", "rest", F.explode("lengths").alias("length"))
    return met.filter(F.col("length") <= F.char_length("rest")).select(id_column, "key", "start", "length", F.substring("rest", F.lit(1), F.col("length")).alias("reading"))


def _firsts(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The index of the least value of each run of equal keys, the first of equal ones."""
    order = np.lexsort((np.arange(len(keys)), values, keys))
    return order[np.concatenate([[True], np.diff(keys[order]) != 0])] if len(keys) else order


def _steps(sentence: np.ndarray, start: np.ndarray, end: np.ndarray, left: np.ndarray, right: np.ndarray, cost: np.ndarray, connect: np.ndarray | None, shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Cheapest paths of many sentences at once, a place of all of them at a time. Steps come in order of their start. Returns each step's step before it (-1: none) and each sentence's last step."""

    def joint(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.full(len(a), OUTSIDE_COST, dtype=np.int64)
        if connect is not None:
            inside = (a < shape[0]) & (b < shape[1])
            out[inside] = connect[a[inside], b[inside]]
        return out

    def reach(of: np.ndarray, onto: np.ndarray, arrived: np.ndarray, first: bool) -> tuple[np.ndarray, np.ndarray]:
        """For sentences and the classes they go on to: the least total over their arrivals, and the arrival (-1 at the beginning)."""
        if first:
            return joint(np.full(len(of), BOUNDARY), onto), np.full(len(of), -1)
        low, high = np.searchsorted(sentence[arrived], of), np.searchsorted(sentence[arrived], of, side="right")
        many = high - low
        which = np.repeat(np.arange(len(of)), many)
        met = arrived[np.arange(len(which)) + np.repeat(low - np.cumsum(many) + many, many)]
        sums = total[met] + joint(right[met], onto[which])
        best = _firsts(which, sums)
        return sums[best], met[best]

    classes = int(right.max()) - int(right.min()) + 1
    total, before = np.zeros(len(start), dtype=np.int64), np.full(len(start), -1, dtype=np.int64)
    cuts = np.searchsorted(start, np.arange(int(end.max()) + 2))
    by_end = np.argsort(end, kind="stable")
    end_cuts = np.searchsorted(end[by_end], np.arange(int(end.max()) + 2))
    last_place = np.zeros(int(sentence.max()) + 1, dtype=np.int64)
    np.maximum.at(last_place, sentence, end)
    last = np.full(len(last_place), -1, dtype=np.int64)
    for place in range(len(cuts) - 1):
        steps, arrived = np.arange(cuts[place], cuts[place + 1]), by_end[end_cuts[place] : end_cuts[place + 1]]
        if len(arrived):
            # One arrival a class: the cheapest, the earliest step of equal ones; classes in the order in which they were first reached.
            group = sentence[arrived] * classes + right[arrived] - int(right.min())
            _, seen = np.unique(group, return_index=True)
            kept = _firsts(group, total[arrived])
            arrived = arrived[kept[np.lexsort((seen, sentence[arrived[kept]]))]]
            over = np.unique(sentence[arrived])
            over = over[last_place[over] == place]
            if len(over):
                last[over] = reach(over, np.full(len(over), BOUNDARY), arrived, False)[1]
        if len(steps):
            pairs, back = np.unique(np.stack([sentence[steps], left[steps]]), axis=1, return_inverse=True)
            least, came = reach(pairs[0], pairs[1], arrived, place == 0)
            total[steps], before[steps] = least[back] + cost[steps], came[back]
    return before, last


def _solved(sentences: list[str], edges: pd.DataFrame, connect: np.ndarray | None, shape: tuple[int, int]) -> Iterator[tuple[int, int, str, str]]:
    """(sentence's number, segment, reading, surface). edges: at (a sentence's number), start, length, surface, left_id, right_id, cost, dependent."""
    lengths = np.array(list(map(len, sentences)))
    at = np.repeat(np.arange(len(sentences)), lengths)
    place = np.arange(len(at)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    alone = pd.DataFrame({"at": at, "start": place, "length": 1, "surface": list("".join(sentences)), "left_id": BOUNDARY, "right_id": BOUNDARY, "cost": UNKNOWN_COST, "dependent": False, "unknown": True})
    steps = pd.concat([edges.assign(unknown=False), alone], ignore_index=True).sort_values(["start", "at", "unknown", "length", "cost", "surface"], kind="stable", ignore_index=True)
    of, start, left, right, cost = (steps[c].to_numpy(dtype=np.int64) for c in ("at", "start", "left_id", "right_id", "cost"))
    end = start + steps["length"].to_numpy(dtype=np.int64)
    before, last = _steps(of, start, end, left, right, cost, connect, shape)
    surfaces, dependent, unknown = steps["surface"].tolist(), steps["dependent"].tolist(), steps["unknown"].tolist()
    for number, step in enumerate(last.tolist()):
        path = []
        while step >= 0:
            path.append(step)
            step = int(before[step])
        parts: list[list[str]] = []
        was_unknown = False
        for k in reversed(path):
            read = sentences[number][start[k] : end[k]]
            if parts and (dependent[k] or unknown[k] and was_unknown):
                parts[-1][0] += read
                parts[-1][1] += surfaces[k]
            else:
                parts.append([read, surfaces[k]])
            was_unknown = unknown[k]
        for segment, (read, surface) in enumerate(parts, 1):
            yield number, segment, read, surface


def convert(sentences: DataFrame, entries: DataFrame, matrix: DataFrame | None = None, shape: tuple[int, int] = (0, 0), id_column: str = "sentence_id", step: int = SOLVED_TOGETHER) -> DataFrame:
    """(id, segment, reading, surface) of sentences(id, reading), each different sentence of an id once. matrix: connection costs, of `shape` rows and columns, which bound it.

    Spans that may be readings meet the entries; a sentence's edges then lie together in a sorted partition, and each task solves runs of
    sentences of some `step` characters and edges at once. A longer sentence is a run of its own. Null and empty sentences give no rows.
    """
    sentences = sentences.select(id_column, "reading").filter(F.char_length("reading") > 0).distinct()
    connect = None
    if matrix is not None:
        # One cell a pair of classes: shape bounds it, and it travels once to an executor.
        cells = matrix.filter((F.col("row") < shape[0]) & (F.col("col") < shape[1])).select("row", "col", "cost").toPandas()
        grid = np.zeros(shape, dtype=np.int32)
        grid[cells["row"].to_numpy(), cells["col"].to_numpy()] = cells["cost"].to_numpy()
        connect = sentences.sparkSession.sparkContext.broadcast(grid)
    met = spans_of(sentences, entries, id_column).join(deduplicate(entries), "reading").drop("reading")
    kinds = {"start": "int", "length": "int", "surface": "string", "left_id": "int", "right_id": "int", "cost": "bigint", "dependent": "boolean"}
    # A sentence's own row, without a start, comes before its edges.
    own = sentences.select(id_column, F.md5("reading").alias("key"), F.col("reading").alias("sentence"), *[F.lit(None).cast(k).alias(c) for c, k in kinds.items()])
    rows = own.unionByName(met.select(id_column, "key", F.lit(None).cast("string").alias("sentence"), *[F.col(c).cast(k) for c, k in kinds.items()]))
    # Keys differ by id as well; null ids have keys of their own.
    rows = rows.withColumn("key", F.md5(F.concat_ws("/", F.coalesce(F.concat(F.lit("="), F.col(id_column).cast("string")), F.lit("")), "key")))
    sorted_rows = rows.repartition("key").sortWithinPartitions("key", F.col("start").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = None if connect is None else connect.value

        def result(run_of: pd.DataFrame) -> pa.RecordBatch:
            heads = run_of["start"].isna().to_numpy()
            number = np.cumsum(heads) - 1
            edges = run_of[~heads].assign(at=number[~heads])[["at", *kinds]]
            found = list(_solved(run_of.loc[heads, "sentence"].tolist(), edges.astype({"dependent": bool}), grid, shape))
            columns = list(zip(*found)) or [(), (), (), ()]
            ids = pa.Array.from_pandas(run_of.loc[heads, id_column], type=id_type).take(pa.array(columns[0], pa.int64()))
            return pa.RecordBatch.from_arrays([ids, pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.string())], names=[id_column, "segment", "reading", "surface"])

        id_type, held, size = None, [], 0
        for batch in batches:
            id_type = batch.schema.field(id_column).type
            frame = batch.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype(), pa.int16(): pd.Int16Dtype(), pa.int8(): pd.Int8Dtype()}.get)
            heads = np.flatnonzero(frame["start"].isna().to_numpy())
            # Characters and edges before each sentence of the batch: where a run is full, the next sentence begins another.
            grown = np.arange(len(frame)) + np.cumsum(frame["sentence"].str.len().fillna(0).to_numpy(dtype=np.int64))
            done, sent = 0, 0
            for k in heads.tolist():
                so_far = int(grown[k - 1]) if k else 0
                if size + so_far - sent >= step and (held or k > done):
                    yield result(pd.concat([*held, frame.iloc[done:k]], ignore_index=True))
                    held, size, done, sent = [], 0, k, so_far
            held.append(frame.iloc[done:])
            size += int(grown[-1]) - sent if len(frame) else 0
        if held and sum(map(len, held)):
            yield result(pd.concat(held, ignore_index=True))

    kind = dict(sentences.dtypes)[id_column]
    return sorted_rows.drop("key").mapInArrow(run, f"`{id_column}` {kind}, segment int, reading string, surface string")


def _placed(rows: DataFrame, text: str) -> DataFrame:
    """rows(reading, text, at): each text once, where it stands first, with its place."""
    first = rows.groupBy("reading", text).agg(F.min("at").alias("at"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("reading").orderBy("at", text)))


def segment_candidates(readings: DataFrame, entries: DataFrame, learnt: DataFrame | None = None) -> DataFrame:
    """(reading, surface, place): candidates, then the reading itself and in katakana where they are not among them; the first SEGMENT_SHOWN."""
    asked = readings.filter(F.char_length("reading") > 0).select("reading").distinct()
    known = candidates(asked, entries, learnt).select("reading", "surface", F.struct(F.lit(0).alias("step"), "place").alias("at"))
    step = lambda k, c: asked.select("reading", c.alias("surface"), F.struct(F.lit(k).alias("step"), F.lit(1).alias("place")).alias("at"))
    rows = known.unionByName(step(1, F.col("reading"))).unionByName(step(2, kana.to_katakana(F.col("reading"))))
    return _placed(rows, "surface").filter(F.col("place") <= SEGMENT_SHOWN).select("reading", "surface", "place")


def composing(readings: DataFrame, entries: DataFrame, matrix: DataFrame | None = None, shape: tuple[int, int] = (0, 0), limit: int = 6) -> DataFrame:
    """(reading, key, text, place) of readings still being typed: the reading, its whole conversion, then predictions, each text once; key is the reading that the text stands for."""
    asked = readings.filter(F.char_length("reading") > 0).select("reading").distinct()
    segments = convert(asked.select(F.col("reading").alias("sentence_id"), "reading"), entries, matrix, shape)
    whole = segments.groupBy(F.col("sentence_id").alias("reading")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment", "surface"))), lambda x: x.surface), "").alias("text"))
    at = lambda k, place, key: F.struct(F.lit(k).alias("step"), place.alias("place"), key.alias("key")).alias("at")
    one = F.lit(1)
    rows = asked.select("reading", F.col("reading").alias("text"), at(0, one, F.col("reading"))).unionByName(whole.select("reading", "text", at(1, one, F.col("reading"))))
    ahead = predictions(asked.select(F.col("reading").alias("prefix")), entries, limit)
    rows = rows.unionByName(ahead.select(F.col("prefix").alias("reading"), F.col("surface").alias("text"), at(2, F.col("place"), F.col("reading"))))
    return _placed(rows, "text").select("reading", F.col("at.key").alias("key"), "text", "place")
