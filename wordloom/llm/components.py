"""Connected components of a table of links, by rounds of joins (large star, small star).

In each round every vertex's larger neighbours are tied to the least vertex around it; then its smaller neighbours are.
The edges become stars around each component's least vertex. Minima are aggregated before they are joined back, so a
vertex with many links costs no task more than its share. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

MOST_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges(u, v), u > v."""
    around = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = around.join(least, "u")
    tied = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")) if large else joined.select("u", F.col("m").alias("v")).unionByName(joined.select(F.col("v").alias("u"), F.col("m").alias("v")))
    return tied.filter(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(u, component) for every vertex that is not its component's least; empty links give no rows."""
    edges = staged(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col("u") != F.col("v")).distinct(), "links")
    digest = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = digest(edges)
    for _ in range(MOST_ROUNDS):
        if not before[0]:
            break
        edges = staged(_star(_star(edges, True), False), "links")
        after = digest(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return edges.select("u", F.col("v").alias("component"))
