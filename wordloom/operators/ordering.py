"""Places in a total order, and exact order statistics, without a task that holds all rows.

Rows are dealt to range partitions and sorted there; partitions count their rows, and a row's place is its partition's
offset plus its place inside. A value that fills many partitions' worth of rows still sorts there as numbers only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import staged


def numbered(df: DataFrame, order: Sequence[Column | str], name: str = "idx") -> DataFrame:
    """df with each row's place from 0 in the order. Ties take their places in any order, so give an order without them, or one whose tied rows are equal."""
    # Rows of one value are parted by a hash of where they come from, so that they do not meet in one task.
    tied = df.withColumn("__tie", F.xxhash64(F.monotonically_increasing_id()))
    dealt = tied.repartitionByRange(*order, "__tie").sortWithinPartitions(*order, "__tie").drop("__tie")
    # monotonically_increasing_id: the partition's number above 33 bits of the row's.
    kept = staged(dealt.withColumn("__at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("__at", 33).cast("int")
    counts = sorted(map(tuple, kept.groupBy(part.alias("part")).count().collect()))  # one a partition
    starts, total = {}, 0
    for number, n in counts:
        starts[number] = total
        total += n
    offsets = df.sparkSession.createDataFrame(sorted(starts.items()) or [(0, 0)], "__part int, __start bigint")
    placed = kept.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    return placed.withColumn(name, F.col("__start") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__part", "__start", "__at")


def quantiles(df: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(group, name.. of shares): exact quantiles, between two values in proportion; null values take no part, a group of nulls only has none."""
    rows = df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).filter("v IS NOT NULL")
    placed = staged(numbered(rows, ["g", "v"], "at"), "placed")
    whole = placed.groupBy("g").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    spots = F.array(*[F.struct(F.lit(name).alias("name"), (F.lit(share) * (F.col("n") - 1)).alias("spot")) for name, share in shares.items()])
    asked = whole.select("g", "first", F.explode(spots).alias("s")).select("g", "s.name", F.col("s.spot").alias("spot"), F.floor("s.spot").alias("low"), "first")
    ends = asked.select("g", "name", (F.col("spot") - F.col("low")).alias("share"), F.explode(F.array(F.struct((F.col("first") + F.col("low")).alias("at"), F.lit(0).alias("up")), F.struct((F.col("first") + F.ceil("spot")).alias("at"), F.lit(1).alias("up")))).alias("e"))
    met = ends.select("g", "name", "share", F.col("e.at").alias("at"), F.col("e.up").alias("up")).join(placed.select("at", "v"), "at")
    low, high = F.max(F.when(F.col("up") == 0, F.col("v"))), F.max(F.when(F.col("up") == 1, F.col("v")))
    found = met.groupBy("g", "name").agg((low + F.max("share") * (high - low)).alias("v"))
    return found.groupBy(F.col("g").alias(group)).agg(*[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in shares])
