"""Places, order statistics and closures against plain code, on constant columns, long chains and hubs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from wordloom.operators import conversion, evaluation, licences, ordering


def test_places_are_those_of_a_sort(spark):
    rows = [(k * 7919 % 1000, f"x{k}") for k in range(1000)]
    placed = ordering.numbered(spark.createDataFrame(rows, "a int, b string").repartition(7), ["a"]).collect()
    assert sorted((r["idx"], r["a"]) for r in placed) == list(enumerate(sorted(a for a, _ in rows)))
    assert ordering.numbered(spark.createDataFrame([], "a int"), ["a"]).collect() == []


def test_quantiles_are_exact_on_constant_and_distinct_values(spark):
    rows = spark.range(0, 20_000, 1, 8).select(F.when(F.col("id") % 2 == 0, "same").otherwise("all").alias("g"), F.when(F.col("id") % 2 == 0, 5.0).otherwise((F.col("id") * 7919 % 20_011).cast("double")).alias("v"))
    rows = rows.unionByName(spark.createDataFrame([("one", 3.5), ("none", None), ("one", None)], "g string, v double"))
    got = {r["g"]: (r["p50"], r["p99"], r["longest"]) for r in evaluation.latencies(rows, "g", "v").collect()}
    own = np.array([r["v"] for r in rows.filter("g = 'all'").collect()])
    assert got == {"same": (5.0, 5.0, 5.0), "one": (3.5, 3.5, 3.5), "none": (None, None, None), "all": (*np.quantile(own, [0.5, 0.99]), own.max())}
    # No task of the ranges holds more than a few times its share of a constant column.
    dealt = spark.range(0, 20_000, 1, 8).select(F.lit(1.0).alias("v"))
    tied = dealt.withColumn("t", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(4, "v", "t")
    assert max(r["count"] for r in tied.groupBy(F.spark_partition_id()).count().collect()) < 10_000
    assert evaluation.latency(rows.filter("g = 'one'"), "v").collect()[0].asDict() == {"p50": 3.5, "p99": 3.5, "longest": 3.5}


def test_closures_of_long_chains_hubs_and_cycles(spark):
    n = 3_000
    chain = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    roots = spark.createDataFrame([(0,), (n - 5,)], "root bigint")
    got = licences.closure(chain, roots).groupBy("root").agg(F.count("*"), F.max("node")).collect()
    assert sorted(map(tuple, got)) == [(0, n + 1, n), (n - 5, 6, n)]
    hub = spark.range(1, n).select(F.lit(0).cast("bigint").alias("src"), F.col("id").alias("dst"))
    both = hub.unionByName(hub.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    assert licences.closure(both, spark.createDataFrame([(7,)], "root bigint")).count() == n
    draw = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in draw.integers(0, 60, (75, 2))] + [(1, 2), (2, 3), (3, 1)]
    want = set()
    for root in (1, 5, 77):
        todo, met = [root], {root}
        while todo:
            at = todo.pop()
            more = {b for a, b in edges if a == at} - met
            met |= more
            todo += more
        want |= {(root, node) for node in met}
    found = licences.closure(spark.createDataFrame([*edges, (None, 3), (5, None)], "src bigint, dst bigint"), spark.createDataFrame([(1,), (5,), (77,)], "root bigint"))
    assert set(map(tuple, found.collect())) == want and found.count() == len(want)


def test_texts_are_numbered_by_their_first_package(spark):
    rows = [("b", "MIT"), ("a", "BSD"), ("c", "BSD"), ("d", None), ("a2", "Apache")]
    texts, packages = licences.catalogue(spark.createDataFrame(rows, "package string, text string"))
    assert sorted(map(tuple, texts.collect())) == [(0, "BSD"), (1, "Apache"), (2, "MIT")]
    assert sorted(map(tuple, packages.collect()), key=str) == [("a", 0), ("a2", 1), ("b", 2), ("c", 0), ("d", None)]


def test_sentences_of_one_id_are_converted_apart(spark):
    schema = "reading string, surface string, left_id int, right_id int, cost int, dependent boolean"
    entries = spark.createDataFrame([("にわ", "庭", 1, 1, 10, False), ("かな", "仮名", 1, 1, 10, False)], schema)
    sentences = spark.createDataFrame([(1, "にわ"), (1, "かなにわ"), (1, "にわ"), (None, "かな")], "sentence_id int, reading string")
    got = sorted((r["segment"], r["reading"], r["surface"]) for r in conversion.convert(sentences, entries).filter("sentence_id = 1").collect())
    assert got == [(1, "かな", "仮名"), (1, "にわ", "庭"), (2, "にわ", "庭")]
