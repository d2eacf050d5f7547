"""The learning store as a stream: micro-batches in turn, forgetting, eviction; windows with late events."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordloom.operators import personal, stores
from wordloom.sources import tables
from wordloom.streaming import learning

SCHEMA = "user_id bigint, seq bigint, word string, change string, ts timestamp"


def feed(spark, folder, batches):
    for k, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, "user_id bigint, seq bigint, word string, change string, at bigint")
        frame.select("user_id", "seq", "word", "change", F.timestamp_seconds("at").alias("ts")).coalesce(1).write.mode("append").parquet(str(folder))
        yield k


def test_state_goes_on_over_batches(spark, tmp_path):
    a = [(1, k, w, "record", k) for k, w in enumerate(["hello", "hello", *[f"w{x}" for x in range(10)]])]
    b = [(1, 100, "w3", "forget", 100), (1, 101, None, "record", 101), (1, 102, "hello", "record", 102), (2, 1, "x", "record", 1)]
    for _ in feed(spark, tmp_path / "in", [a, b]):
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        learning.run_available(learning.learned(stream), str(tmp_path / "out"), str(tmp_path / "state"), "update")
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("batch").collect()
    first = {r["word"]: r for r in rows if r["user_id"] == 1 and r["batch"] == rows[0]["batch"]}
    assert (first["hello"]["weight"], first["hello"]["learned"]) == (2 * 6553, True)  # ten other uses since
    last = {r["word"]: r for r in rows if r["user_id"] == 1 and r["batch"] == rows[-1]["batch"]}
    assert (last["hello"]["count"], last["hello"]["weight"], last["hello"]["clock"]) == (3, 3 * 6553 + 16383, 13)
    assert "w3" not in last and len(last) == 10
    assert [r["word"] for r in rows if r["user_id"] == 2] == ["x"]


def test_the_least_used_goes_and_then_the_oldest():
    store = stores.Words()
    for word in ["kept", "kept", *[f"w{k}" for k in range(1100)]]:
        store.record(word)
    assert len(store.words) == stores.STORE_SIZE and store.words["kept"][0] == 2 and "w0" not in store.words
    store.forget("kept")
    store.forget("kept")
    store.forget("never met")
    assert "kept" not in store.words
    full = stores.Words(size=3)
    for word in ["a", "a", "b", "b", "c", "c", "new", ""]:
        full.record(word)
    assert sorted(full.words) == ["a", "b", "c"] and full.clock == 7  # the new word itself is the least used
    full = stores.Words(size=2)
    for word in ["a", "a", "b", "c"]:
        full.record(word)
    assert sorted(full.words) == ["a", "c"]  # of equals the one used longest ago, however recent the others


def plain_uses(events, size):
    out = []
    for user in {u for u, *_ in events if u is not None}:
        store = stores.Words(size=size)
        for _, word in sorted((s, w) for u, s, w in events if u == user and w):
            store.record(word)
        out += [(user, w, c, last, store.clock) for w, (c, last) in store.words.items()]
    return out


def test_batch_and_stream_evict_alike(spark, tmp_path, monkeypatch):
    events = [(u, k, f"w{(k * k * 7 + u) % (5 if u == 2 else 23)}") for u in (1, 2, 3) for k in range(200)] + [(1, 300, None), (None, 1, "x"), (2, 300, "")]
    frame = spark.createDataFrame(events, "user_id bigint, seq bigint, word string")
    got = personal.uses(frame, size=9).collect()
    assert sorted(map(tuple, got)) == sorted(plain_uses(events, 9)) and len(got) == 9 + 9 + len({w for u, _, w in events if u == 2 and w})
    assert personal.uses(frame.limit(0)).collect() == []
    # A stream over more words than a store holds, in three batches.
    many = [(1, k, f"w{k % 1300 if k % 3 else k % 700}", "record", k) for k in range(3000)]
    for _ in feed(spark, tmp_path / "in", [many[:1000], many[1000:2500], many[2500:]]):
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        learning.run_available(learning.learned(stream), str(tmp_path / "out"), str(tmp_path / "state"), "update")
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    last = max(r["batch"] for r in rows)
    streamed = sorted((r["user_id"], r["word"], r["count"], r["last_used"], r["clock"]) for r in rows if r["batch"] == last)
    whole = [(u, k, w) for u, k, w, *_ in many]
    assert streamed == sorted(plain_uses(whole, 1000)) and len(streamed) == 1000
    assert sorted(map(tuple, personal.uses(spark.createDataFrame(whole, "user_id bigint, seq bigint, word string")).collect())) == streamed


def test_chosen_spellings_evict_the_least_count(spark, tmp_path):
    events = [(1, k, f"r{k % 4}", f"s{k * k % 7}") for k in range(60)] + [(1, 90, "", "x"), (1, 91, "r", None)]
    store = stores.Choices(size=5)
    for _, _, r, s in events[:60]:
        store.record(r, s)
    frame = spark.createDataFrame(events, "user_id bigint, seq bigint, reading string, surface string")
    assert {(r["reading"], r["surface"]): r["uses"] for r in personal.conversion_uses(frame, size=5).collect()} == store.counts
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    learning.run_available(learning.chosen(stream), str(tmp_path / "out"), str(tmp_path / "state"), "update")
    got = {(r["reading"], r["surface"]): r["uses"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(r["reading"], r["surface"]): r["uses"] for r in personal.conversion_uses(frame).collect()}


def test_snapshots_hold_items_and_choices(spark):
    used = spark.createDataFrame([(1, "a", 2, 3, 4)], "user_id bigint, word string, count bigint, last_used int, clock int")
    items = spark.createDataFrame([(1, "g", "x", 2), (1, "h", "y", 1)], "user_id bigint, grp string, item string, place int")
    choices = spark.createDataFrame([(1, "r", "s", 5)], "user_id bigint, reading string, surface string, uses bigint")
    lines = tables.snapshot_lines(used, items, choices)
    assert [r["line"] for r in lines.orderBy("place").collect()] == ["4", "w\ta\t2\t3", "a\th\ty", "a\tg\tx", "c\tr\ts\t5"]
    assert tables.restore_snapshot(lines).collect() == used.collect()
    assert tables.restore_choices(lines).collect() == choices.collect()
    assert sorted((r["place"], r["grp"], r["item"]) for r in tables.restore_items(lines).collect()) == [(1, "h", "y"), (2, "g", "x")]


def test_late_events_are_dropped_after_the_watermark(spark, tmp_path):
    hour = 3600
    batches = [[(1, 1, "a", "record", 10 * hour), (1, 2, "a", "record", 10 * hour + 5)], [(1, 3, "a", "record", 20 * hour)], [(1, 4, "a", "record", 10 * hour + 9), (1, 5, "a", "record", 19 * hour + 1800)]]
    for _ in feed(spark, tmp_path / "in", batches):
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        learning.run_available(learning.windowed_counts(stream), str(tmp_path / "out"), str(tmp_path / "state"), "update")
    rows = spark.read.parquet(str(tmp_path / "out")).groupBy("start").agg(F.max_by("events", "batch").alias("n")).select(F.unix_seconds("start").alias("s"), "n").collect()
    assert {r["s"] // hour: r["n"] for r in rows} == {10: 2, 20: 1, 19: 1}
