"""Runs of taps on one key as a stream: keyed state with timers of event time.

Presses may come late and split over micro-batches. Each waits in its user's state until the watermark has passed it, so
presses are taken in the order of their times; a timer then ends a run when no other press followed in time. What waits
is bounded by the watermark's delay, and an open run is one row. Presses come and wait in chunks of one user, runs leave
in chunks, and a user has a timer for the first that waits and one for the open run: rows that pass between Spark and
Python and calls of state grow with users and chunks, not with presses.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: A run ends after so many milliseconds without another tap.
WITHIN = 700
#: Presses or runs in one row; presses that a task holds while it makes chunks of them.
CHUNK, HELD = 4096, 1 << 18
_PACKED = "user_id bigint, last_ms bigint, ms array<bigint>, seq array<bigint>, key array<string>"
_COLUMNS = ("run", "key", "taps", "first_ms", "last_ms")
_ENDED = "user_id bigint, run array<bigint>, key array<string>, taps array<bigint>, first_ms array<bigint>, last_ms array<bigint>"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(user_id, ms, seq, key) as rows of up to CHUNK presses of one user, with the latest time; the order of a user's presses stays."""

    def chunks(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        every = pa.Table.from_batches(held).combine_chunks()
        users = every.column("user_id").to_numpy()
        order = np.argsort(users, kind="stable")
        users = users[order]
        first = np.flatnonzero(np.append(True, users[1:] != users[:-1]))
        within = np.arange(len(users)) - np.repeat(first, np.diff(np.append(first, len(users))))
        starts = np.flatnonzero(within % CHUNK == 0)
        sorted_ = every.take(pa.array(order)).combine_chunks()
        offsets = pa.array(np.append(starts, len(users)), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, sorted_.column(c).chunk(0)) for c in ("ms", "seq", "key")]
        latest = np.maximum.reduceat(sorted_.column("ms").to_numpy(), starts)
        return pa.RecordBatch.from_arrays([pa.array(users[starts], pa.int64()), pa.array(latest, pa.int64()), *lists], names=["user_id", "last_ms", "ms", "seq", "key"])

    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= HELD:
            yield chunks(held)
            held, rows = [], 0
    if held:
        yield chunks(held)


class _Runs(StatefulProcessor):
    def __init__(self, within: int):
        self.within = within

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("chunks", "ms array<bigint>, seq array<bigint>, key array<string>")
        self.open = handle.getValueState("open", "run bigint, key string, taps bigint, first_ms bigint, last_ms bigint")

    def _wake(self, first_ms: int) -> None:
        """A timer fires when the watermark has reached its time: at that of a press nothing earlier can come."""
        self.handle.registerTimer(first_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        first = None
        for row in rows:
            kept = [k for k, ms in enumerate(row["ms"]) if ms > passed]
            if kept:
                ms, seq, tapped = ([row[c][k] for k in kept] for c in ("ms", "seq", "key"))
                first = min(ms) if first is None else min(first, min(ms))
                self.waiting.appendValue((ms, seq, tapped))
        if first is not None:
            self._wake(first)
        return iter(())

    def _due(self, passed: int) -> tuple[list[int], list[str]]:
        """Times and keys of the presses that the watermark has passed, in order; the others go on waiting."""
        ms, seq, codes, known = [], [], [], {}
        for chunk in self.waiting.get():
            ms.append(np.array(chunk[0], np.int64))
            seq.append(np.array(chunk[1], np.int64))
            codes.append(np.array([known.setdefault(k, len(known)) for k in chunk[2]], np.int32))
        if not ms:
            return [], []
        ms, seq, codes, names = np.concatenate(ms), np.concatenate(seq), np.concatenate(codes), list(known)
        late = np.flatnonzero(ms > passed)
        if len(late) == len(ms):
            return [], []
        self.waiting.clear()
        for at in range(0, len(late), CHUNK):
            own = late[at : at + CHUNK]
            self.waiting.appendValue((ms[own].tolist(), seq[own].tolist(), [names[c] for c in codes[own]]))
        if len(late):
            self._wake(int(ms[late].min()))
        due = np.flatnonzero(ms <= passed)
        due = due[np.lexsort((seq[due], ms[due]))]
        # Of presses of one time and number the last that came is the press.
        last = np.append((np.diff(ms[due]) != 0) | (np.diff(seq[due]) != 0), True)
        return ms[due[last]].tolist(), [names[c] for c in codes[due[last]]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        own = tuple(self.open.get()) if self.open.exists() else None
        before, run, ended = own, own[0] if own else 0, []
        for ms, tapped in zip(*self._due(passed)):
            if own and own[2] and own[1] == tapped and ms - own[4] <= self.within:
                own = (own[0], tapped, own[2] + 1, own[3], ms)
                continue
            if own and own[2]:
                ended.append(own)
            run += 1
            own = (run, tapped, 1, ms, ms)
        if own and own[2] and passed > own[4] + self.within:
            ended.append(own)
            own = (own[0], own[1], 0, own[3], own[4])  # the number of the last run stays
        if own != before:
            self.open.update(own)
            if own[2]:
                self.handle.registerTimer(own[4] + self.within + 1)
        for at in range(0, len(ended), CHUNK):
            yield Row(user_id=key[0], **dict(zip(_COLUMNS, map(list, zip(*ended[at : at + CHUNK])))))

    def close(self) -> None:
        pass


def tap_runs(presses: DataFrame, late: str = "10 seconds", within: int = WITHIN) -> DataFrame:
    """presses(user_id, key, ms, seq) in a stream: a row for each run once it has ended, as multitap_sessions numbers them by (ms, seq).

    Presses later than the watermark are dropped; null users, keys and times are no presses. Repeated (ms, seq) of a user
    are one press; a null seq comes first. State is kept in RocksDB, which this sets for the session."""
    presses.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    slim = presses.filter("user_id IS NOT NULL AND key IS NOT NULL AND ms IS NOT NULL").select(F.col("user_id").cast("bigint").alias("user_id"), F.col("ms").cast("bigint").alias("ms"), F.coalesce(F.col("seq").cast("bigint"), F.lit(-(1 << 63))).alias("seq"), "key")
    # A chunk's time is its latest press: the watermark is as with single presses, and only chunks that are late whole are dropped by it.
    packed = slim.mapInArrow(_packed, _PACKED).withColumn("ts", F.timestamp_millis("last_ms")).withWatermark("ts", late)
    ended = packed.groupBy("user_id").transformWithState(_Runs(within), _ENDED, "append", "EventTime")
    return ended.select("user_id", F.inline(F.arrays_zip(*_COLUMNS)))
