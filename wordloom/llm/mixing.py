"""Mixing sources to target weights over a tree of domains, languages and sources.

The budget of tokens goes down the tree: a node's budget is shared among its children by weight, and a child that
cannot use its share (its subtree holds fewer tokens, times the epochs allowed) leaves the rest to its siblings. A node
is given no more than its subtree can use, so a shortage reaches the ancestors' other children only when all siblings
are full. Shares are whole tokens: what rounding leaves goes to the largest remainders, ties to the smaller name.

Each leaf then spends its budget on epochs over its documents: whole epochs first, then a prefix of one more epoch. An
epoch's order is seeded: buckets of documents by a hash of seed, epoch and bucket, and documents within a bucket by a
hash of seed, epoch and document. The prefix is found from sums over buckets, so no task ever sorts a whole leaf, and
the document on the border gives only its first tokens.

Only DataFrame functions are used. Null labels form a leaf named '' of their own; null or empty texts hold no tokens and
are never chosen; a text counts whole, however long; nodes of weight 0 get nothing; an empty table gives no rows; repeated rows are ordered by id and then length. Columns that are not
asked for are not touched.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sharding import hex_number

#: A token here is a run of characters other than ASCII white space.
TOKEN = "[^ \\t\\n\\x0B\\f\\r]+"


@dataclass(frozen=True)
class Mixture:
    """weights: of a node by its path ('web/en') or by its name alone ('en'); others have default_weight."""

    levels: Sequence[str]
    weights: Mapping[str, int] = field(default_factory=dict)
    default_weight: int = 100
    budget_share: tuple[int, int] = (1, 1)
    max_epochs: int = 1
    seed: int = 42
    buckets: int = 256


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("bigint")


def _same(a: str, b: str, columns: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{c}") == F.col(f"{b}.{c}") for c in columns], F.lit(True))


def allocate(leaves: DataFrame, mix: Mixture) -> DataFrame:
    """leaves(levels.., tokens) with each leaf's whole-token budget."""
    weights = F.create_map(*[F.lit(x) for kv in mix.weights.items() for x in kv]) if mix.weights else None
    usable = leaves.withColumn("cap", F.col("tokens") * mix.max_epochs)
    up, down = mix.budget_share
    given = usable.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * up / down).cast("bigint").alias("wanted"), F.coalesce(F.sum("cap"), F.lit(0)).alias("all"))
    given = given.select(F.least("wanted", "all").alias("budget"))
    for depth in range(1, len(mix.levels) + 1):
        path, parent = list(mix.levels[:depth]), list(mix.levels[: depth - 1])
        name = F.col(path[-1])
        own = F.lit(None).cast("int") if weights is None else F.coalesce(F.try_element_at(weights, F.concat_ws("/", *path)), F.try_element_at(weights, name))
        nodes = usable.groupBy(*path).agg(F.sum("cap").alias("cap")).withColumn("w", F.coalesce(own, F.lit(mix.default_weight)).cast("bigint"))
        nodes = nodes.withColumn("cap", F.when(F.col("w") > 0, F.col("cap")).otherwise(0))
        nodes = nodes.alias("n").join(given.alias("g"), _same("n", "g", parent)).select("n.*", F.col("g.budget").alias("b"))
        group = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
        order = group.orderBy(F.when(F.col("w") > 0, F.col("cap") / F.col("w")).otherwise(-1), name)
        nodes = nodes.withColumns({"before": F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "after": F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))})
        nodes = nodes.withColumn("full", (F.col("b") - F.col("before")) * F.col("w") >= F.col("cap") * F.col("after"))
        nodes = nodes.withColumns({"left": F.col("b") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(group), F.lit(0)), "open": F.sum(F.when(~F.col("full"), F.col("w"))).over(group)})
        nodes = nodes.withColumns({"floor": F.when(F.col("full"), F.col("cap")).otherwise(F.expr("left * w div open")), "rest": F.when(F.col("full"), -1).otherwise(F.expr("left * w % open"))})
        nodes = nodes.withColumns({"spare": F.col("b") - F.sum("floor").over(group), "turn": F.row_number().over(group.orderBy(F.desc("rest"), name))})
        budget = F.col("floor") + F.when((F.col("turn") <= F.col("spare")) & (F.col("rest") > 0), 1).otherwise(0)
        given = nodes.select(*path, budget.alias("budget"))
    return usable.alias("n").join(given.alias("g"), _same("n", "g", mix.levels)).select("n.*", "g.budget").drop("cap")


def mix(docs: DataFrame, mixture: Mixture, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, levels.., n_tokens, full_epochs, partial_tokens, tokens_used) for every document of docs."""
    levels = list(mixture.levels)
    slim = docs.select(
        F.col(id_column).alias("id"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in levels],
        token_count(F.col(text_column)).alias("n_tokens"),
    )
    slim = slim.withColumn("bucket", hex_number(F.concat_ws("/", F.lit(str(mixture.seed)), F.col("id")), 1) % mixture.buckets)
    parts = slim.groupBy(*levels, "bucket").agg(F.sum("n_tokens").alias("in_bucket"))
    leaves = allocate(parts.groupBy(*levels).agg(F.sum("in_bucket").alias("tokens")), mixture)
    leaves = leaves.withColumns({"full_epochs": F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0), "rest": F.when(F.col("tokens") > 0, F.expr("budget % tokens")).otherwise(0)})
    epoch = F.concat_ws("/", F.lit(str(mixture.seed)), F.col("full_epochs"))
    order = Window.partitionBy(*levels).orderBy(F.md5(F.concat_ws("/", epoch, F.lit("b"), "bucket")), "bucket")
    parts = parts.alias("n").join(leaves.alias("g"), _same("n", "g", levels)).select("n.*", "g.full_epochs", "g.rest")
    parts = parts.withColumn("before", F.coalesce(F.sum("in_bucket").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    key = [*levels, "bucket"]
    out = slim.alias("n").join(parts.alias("g"), _same("n", "g", key)).select("n.*", "g.full_epochs", "g.rest", "g.before")
    within = Window.partitionBy(*key).orderBy(F.md5(F.concat_ws("/", epoch, F.lit("d"), "id")), "id", "n_tokens")
    start = F.col("before") + F.coalesce(F.sum("n_tokens").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    partial = F.greatest(F.lit(0).cast("bigint"), F.least(F.col("n_tokens"), F.col("rest") - start))
    out = out.withColumn("partial_tokens", partial)
    return out.select(F.col("id").alias(id_column), *levels, "n_tokens", "full_epochs", "partial_tokens", (F.col("n_tokens") * F.col("full_epochs") + F.col("partial_tokens")).alias("tokens_used"))
