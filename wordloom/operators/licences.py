"""Dependency closures and a catalogue of licence texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_folder, staged
from .ordering import numbered


#: Squared edges are kept while they are at most so many times the edges.
GROWTH = 4


def closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node): what roots(root) reach over edges(src, dst), themselves included; null ends of edges reach nothing.

    Edges are squared round by round: with pairs of 2^k steps at hand all that is reached at once goes 2^k steps further, so
    a chain closes in the logarithm of its length. Where squares grow, as about hubs, which make paths short, squaring
    stops, and rounds go on from what the last one added over all the powers that there are. Cycles end."""
    checkpoint_folder(edges.sparkSession)
    plain = edges.select("src", "dst").dropna().distinct().checkpoint()
    most = GROWTH * plain.count()
    seen = roots.select("root", F.col("root").alias("node")).distinct().checkpoint()

    def further(rows: DataFrame, power: DataFrame) -> DataFrame:
        return rows.join(power.select(F.col("src").alias("node"), "dst"), "node").select("root", F.col("dst").alias("node"))

    power, powers = plain, [plain]
    new = seen
    while True:
        # All that was seen goes the newest power's steps, what the last round added goes every other.
        step = further(seen if power is not None else new, powers[-1])
        for other in powers[:-1]:
            step = step.unionByName(further(new, other))
        new = step.distinct().join(seen, ["root", "node"], "left_anti").checkpoint()
        # What each round added has gone single steps in the next, so that nothing new means that all is reached.
        if new.isEmpty():
            return seen
        seen = seen.unionByName(new).checkpoint()
        if power is not None:
            ends = power.groupBy(F.col("dst").alias("src")).agg(F.count(F.lit(1)).alias("into")).join(power.groupBy("src").agg(F.count(F.lit(1)).alias("out")), "src")
            if 0 < (ends.agg(F.coalesce(F.sum(F.col("into") * F.col("out")), F.lit(0))).first()[0]) <= most:
                power = power.alias("a").join(power.alias("b"), F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst").distinct().checkpoint()
                powers.append(power)
            else:
                power = None


def catalogue(packages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """packages(package, text) -> texts(idx, text), distinct texts in order of the first package that has them; and (package, idx). Only digests are sorted."""
    given = packages.withColumn("digest", F.sha2("text", 256))
    first = given.filter(F.col("text").isNotNull()).groupBy("digest").agg(F.min("package").alias("first"), F.first("text").alias("text"))
    first = staged(first, "texts")
    places = staged(numbered(first.select("first", "digest"), ["first", "digest"]).select("digest", F.col("idx").cast("int").alias("idx")), "places")
    return first.join(places, "digest").select("idx", "text"), given.join(places, "digest", "left").select("package", "idx")


def enabled_dependencies(features: DataFrame, enabled: DataFrame) -> DataFrame:
    """(package, dependency): the optional dependencies that enabled(package, feature) bring in, over features(package, feature, entry).

    An entry is another feature, 'dep:name', 'name/feature', which brings name in, or 'name?/feature', which does not."""
    key, entry = F.struct("package", "feature"), F.col("entry")
    named = entry.startswith("dep:") | F.contains(entry, F.lit("/"))
    edges = features.filter(~named).select(key.alias("src"), F.struct("package", entry.alias("feature")).alias("dst"))
    reached = closure(edges, enabled.select(key.alias("root"))).select("node.*").distinct()
    brought = F.when(entry.startswith("dep:"), F.substring(entry, F.lit(5), F.char_length(entry))).otherwise(F.nullif(F.regexp_extract(entry, r"^([^/]*[^/?])/", 1), F.lit("")))
    return features.filter(named).join(reached, ["package", "feature"]).select("package", brought.alias("dependency")).dropna().distinct()
