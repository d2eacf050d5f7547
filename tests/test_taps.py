"""Streams with timers and map states: runs of taps against the batch form, changes of stores against the stores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from wordloom.operators import personal, stores
from wordloom.streaming import changes, learning, taps

SCHEMA = "user_id bigint, key string, ms bigint, seq bigint"


def test_streamed_runs_are_those_of_the_batch(spark, tmp_path):
    draw = np.random.default_rng(9)
    presses, ms = [], 1_000_000
    for seq in range(160):
        ms += int(draw.choice([80, 300, 700, 701, 1500, 9000], p=[0.3, 0.3, 0.1, 0.1, 0.1, 0.1]))
        presses.append((1 + seq % 3 % 2, "ab"[int(draw.integers(2))], ms, seq))
    # Order of arrival differs by up to five seconds from that of the presses.
    arrival = sorted(presses, key=lambda p: p[2] + int(draw.integers(0, 5000)))
    end = [(9, "z", ms + 60_000, 900)]
    batches = [arrival[:50], arrival[50:51], arrival[51:120], arrival[120:], end, [(9, "z", ms + 200_000, 901), (1, "b", 1_000_001, 902), (None, "a", ms, 903), (1, None, ms, 904)], [(9, "z", ms + 300_000, 905)]]
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        learning.run_available(taps.tap_runs(stream, "10 seconds"), str(tmp_path / "out"), str(tmp_path / "state"))
    got = sorted(tuple(r)[:6] for r in spark.read.parquet(str(tmp_path / "out")).select("user_id", "run", "key", "taps", "first_ms", "last_ms").filter("user_id < 9").collect())
    numbered = personal.multitap_sessions(spark.createDataFrame(presses, SCHEMA), order="seq")
    want = numbered.groupBy("user_id", "run", "key").agg(F.count("*").alias("taps"), F.min("ms"), F.max("ms"))
    assert got == sorted(map(tuple, want.collect())) and {x[3] for x in got} >= {1, 2}


def test_timers_grow_with_users_and_the_last_press_ends_a_run(spark, tmp_path):
    presses = [(user, "a", 1000 + 10 * k, k) for user in (1, 2) for k in range(taps.CHUNK + 5)]
    last = presses[-1][2]
    spark.createDataFrame([*presses, (1, "b", last + 20, None)], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    out = taps.tap_runs(stream, "0 seconds").writeStream.format("memory").queryName("ended_runs").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    out.awaitTermination()
    # The last press is at the watermark: nothing earlier can come, so it ends the run before it, as in the batch form.
    assert list(map(tuple, spark.table("ended_runs").collect())) == [(1, 1, "a", len(presses) // 2, 1000, last)]
    assert sum(op.customMetrics["numRegisteredTimers"] for step in out.recentProgress for op in step.stateOperators) <= 6


def test_changes_of_stores_add_up_to_the_stores(spark, tmp_path):
    """Evicting stores over three micro-batches; rows come in proportion to events."""
    events = [(u, k, f"w{(k * k * 7 + u) % (30 if u == 1 else 23)}" if k % 11 else "kept", "forget" if k % 13 == 5 else "record") for u in (1, 2) for k in range(240)]
    events += [(3, 0, "one", "record"), (3, 1, "one", "forget"), (3, 2, "never", "forget"), (3, 3, None, "record"), (3, 4, "", "record"), (None, 5, "x", "record")]
    want, batches = set(), [[e for e in events if e[1] < 100], [e for e in events if 100 <= e[1] < 103], [e for e in events if e[1] >= 103]]
    for rows in batches:
        spark.createDataFrame(rows, "user_id bigint, seq bigint, word string, change string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("user_id bigint, seq bigint, word string, change string").parquet(str(tmp_path / "in"))
        learning.run_available(changes.learned_changes(stream, size=9), str(tmp_path / "out"), str(tmp_path / "state"), "update")
    for user in (1, 2, 3):
        store = stores.Words(size=9)
        for _, _, word, change in sorted((e for e in events if e[0] == user and e[2]), key=lambda e: e[1]):
            (store.forget if change == "forget" else store.record)(word)
        want |= {(user, w, c, last, store.clock) for w, (c, last) in store.words.items()}
    out = spark.read.parquet(str(tmp_path / "out"))
    got = changes.current(out).collect()
    assert {tuple(r)[:5] for r in got} == want and len([r for r in got if r["user_id"] == 1]) == 9
    assert all(r["weight"] == learning.weight(r["count"], r["clock"] - r["last_used"]) for r in got)
    by_batch = [r["n"] for r in out.groupBy("batch").agg(F.count("*").alias("n")).orderBy("batch").collect()]
    assert by_batch[1] <= 2 * 3 * 2  # three events a user: each may change its word and one that goes


def test_the_heap_gives_the_least_after_any_changes():
    draw = np.random.default_rng(12)
    ranked, plain = stores.Ranked(), {}
    for step in range(4000):
        name, kind = int(draw.integers(60)), draw.integers(5)
        if kind < 3:
            plain[name] = (int(draw.integers(6)), step)
            ranked.set(name, plain[name])
        elif kind == 3 and name in plain:
            del plain[name]
            ranked.drop(name)
        elif plain:
            least = min(plain, key=plain.get)
            assert ranked.drop_least() == least
            del plain[least]
        assert len(ranked) == len(plain) == len(ranked.slots) == len(ranked.places) and ranked.rank(name) == plain.get(name)
