"""Structured Streaming over users' events: the learning store as keyed state, and counts in windows of event time.

A store holds a user's words with their counts and last uses on a logical clock, at most STORE_SIZE of them: beyond
that the word of the least (count, last use) goes, which may be the new one. State is one user's store, so its size has
a bound whatever the stream brings, and users are dealt over all tasks. A user's events of one micro-batch are brought
in order together, so the stream should bound a micro-batch (maxFilesPerTrigger or maxBytesPerTrigger of its source).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.scores import LEARNED_USES, RECENT_BONUS, RECENT_SPAN, USE_WEIGHT
from ..operators import stores

RECORD, FORGET = "record", "forget"
OUTPUT = "user_id bigint, word string, count bigint, last_used int, clock int, weight bigint, learned boolean"
CHOSEN = "user_id bigint, reading string, surface string, uses bigint"
_STATE = "clock int, words array<string>, counts array<bigint>, last array<int>"
_CHOICES = "readings array<string>, surfaces array<string>, uses array<bigint>"


def weight(count: int, age: int) -> int:
    return count * USE_WEIGHT + (RECENT_BONUS if age < RECENT_SPAN else 0)


def rows(store: stores.Words) -> list[tuple]:
    return [(w, c, last, store.clock, weight(c, store.clock - last), c >= LEARNED_USES) for w, (c, last) in store.words.items()]


def _ordered(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(batches).sort_values("seq", kind="stable")


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    store = stores.Words()
    if state.exists:
        clock, words, counts, last = state.get
        store = stores.Words(clock, {w: [c, x] for w, c, x in zip(words, counts, last)})
    events = _ordered(batches)
    for word, change in zip(events["word"], events["change"]):
        if word is not None:
            (store.forget if change == FORGET else store.record)(word)
    state.update((store.clock, list(store.words), [c for c, _ in store.words.values()], [x for _, x in store.words.values()]))
    names = ["word", "count", "last_used", "clock", "weight", "learned"]
    out = pd.DataFrame(rows(store), columns=names)
    out.insert(0, "user_id", key[0])
    yield out


def learned(events: DataFrame) -> DataFrame:
    """events(user_id, seq, word, change): each user's store after every micro-batch that brings them events."""
    slim = events.select("user_id", "seq", "word", "change")
    return slim.groupBy("user_id").applyInPandasWithState(_step, OUTPUT, _STATE, "update", GroupStateTimeout.NoTimeout)


def _choose(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    store = stores.Choices()
    if state.exists:
        store = stores.Choices({(r, s): n for r, s, n in zip(*state.get)})
    events = _ordered(batches)
    for reading, surface in zip(events["reading"], events["surface"]):
        store.record(reading or "", surface or "")
    held = list(store.counts.items())
    state.update(([r for (r, _), _ in held], [s for (_, s), _ in held], [n for _, n in held]))
    yield pd.DataFrame([(key[0], r, s, n) for (r, s), n in held], columns=["user_id", "reading", "surface", "uses"])


def chosen(events: DataFrame) -> DataFrame:
    """events(user_id, seq, reading, surface): each user's chosen spellings after every micro-batch that brings them some."""
    slim = events.select("user_id", "seq", "reading", "surface")
    return slim.groupBy("user_id").applyInPandasWithState(_choose, CHOSEN, _CHOICES, "update", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 hour", time: str = "ts", key: str = "word") -> DataFrame:
    """(start, key, events) in windows of event time; events later than the watermark are dropped and closed windows' state goes."""
    counted = events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count(F.lit(1)).alias("events"))
    return counted.select(F.col("w.start").alias("start"), key, "events")


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what there is and stops; rows with `batch`, the micro-batch that gave them, as Parquet under path."""

    def keep(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{path}/part={batch}")

    df.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
