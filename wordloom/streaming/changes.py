"""The learning store as a stream of changes: state by word, and only the words that an event changed come out.

A user's store is two map states: entries by their place in a heap ordered by (count, last use), and places by word. An
event reads and writes as many entries as the logarithm of the store's size, evictions included, and a micro-batch gives
rows in proportion to its events, not to the stores it meets.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import scores
from ..operators import stores
from .learning import FORGET
from .taps import PROVIDER

CHANGES = "user_id bigint, word string, count bigint, last_used int, clock int"


class _Kept:
    """A map state read where asked for, and written back at the end of a micro-batch."""

    def __init__(self, state, encode, decode):
        self.state, self.encode, self.decode = state, encode, decode
        self.seen: dict = {}
        self.touched: set = set()

    def get(self, key):
        if key not in self.seen:
            self.seen[key] = self.decode(self.state.getValue((key,))) if self.state.containsKey((key,)) else None
        return self.seen[key]

    __getitem__ = get

    def __setitem__(self, key, value) -> None:
        self.seen[key] = value
        self.touched.add(key)

    def pop(self, key):
        value = self.get(key)
        self[key] = None
        return value

    def flush(self) -> None:
        for key in self.touched:
            if self.seen[key] is not None:
                self.state.updateValue((key,), self.encode(self.seen[key]))
            elif self.state.containsKey((key,)):
                self.state.removeKey((key,))


class _Stores(StatefulProcessor):
    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.slots = handle.getMapState("slots", "slot int", "count bigint, last_used int, word string")
        self.places = handle.getMapState("places", "word string", "slot int")
        self.totals = handle.getValueState("totals", "clock int, held int")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        clock, held = tuple(self.totals.get()) if self.totals.exists() else (0, 0)
        slots = _Kept(self.slots, lambda e: (e[0][0], e[0][1], e[1]), lambda v: ((v[0], v[1]), v[2]))
        places = _Kept(self.places, lambda p: (p,), lambda v: v[0])
        store = stores.Words(clock, size=self.size, ranked=stores.Ranked(slots, places, held))
        changed = set()
        for row in sorted(rows, key=lambda r: r["seq"]):
            if not row["word"]:
                continue
            if row["change"] == FORGET:
                store.forget(row["word"])
            elif gone := store.record(row["word"]):
                changed.add(gone)
            changed.add(row["word"])
        slots.flush()
        places.flush()
        self.totals.update((store.clock, len(store.ranked)))
        for word in sorted(changed):
            count, last = store.ranked.rank(word) or (0, 0)
            yield Row(user_id=key[0], word=word, count=count, last_used=last, clock=store.clock)

    def close(self) -> None:
        pass


def learned_changes(events: DataFrame, size: int = stores.STORE_SIZE) -> DataFrame:
    """events(user_id, seq, word, change) in a stream: the words that each micro-batch changed, as they are after it; a count of 0 is a word that is held no more.

    Null users, null and empty words are no events; of words never met nothing is forgotten. State is kept in RocksDB, which
    this sets for the session."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    slim = events.filter("user_id IS NOT NULL").select(F.col("user_id").cast("bigint").alias("user_id"), "seq", "word", "change")
    return slim.groupBy("user_id").transformWithState(_Stores(size), CHANGES, "update", "None")


def current(changes: DataFrame, batch: str = "batch") -> DataFrame:
    """changes with their micro-batches -> what the stores hold: (user_id, word, count, last_used, clock, weight, learned)."""
    last = changes.groupBy("user_id", "word").agg(F.max_by(F.struct("count", "last_used"), batch).alias("x")).select("user_id", "word", "x.*").filter("count > 0")
    clocks = changes.groupBy("user_id").agg(F.max("clock").alias("clock"))
    held = last.join(clocks, "user_id")
    return held.withColumn("weight", scores.personal_weight(F.col("count"), F.col("clock") - F.col("last_used"))).withColumn("learned", F.col("count") >= scores.LEARNED_USES)
