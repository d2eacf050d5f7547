"""Annotations of words (emoji, symbols, emoticons): merged, capped, looked up, and shown in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Annotations of a group that a key keeps; of a group that a search shows, and of all groups that it gathers.
PER_GROUP = 3
PANEL_GROUP, PANEL_POOL = 128, 384


def merge(annotations: DataFrame, known: DataFrame) -> DataFrame:
    """(word, grp, text, place) of known(word) words: a text once a word, in its first group; at most PER_GROUP of a group."""
    rows = annotations.select("word", "grp", "text").distinct().join(known.select("word"), "word", "left_semi")
    once = rows.groupBy("word", "text").agg(F.min("grp").alias("grp"))
    place = F.row_number().over(Window.partitionBy("word", "grp").orderBy("text"))
    return once.withColumn("place", place).filter(F.col("place") <= PER_GROUP).select("word", "grp", "text", "place")


def lookup(queries: DataFrame, merged: DataFrame, query: str = "query") -> DataFrame:
    """queries with the annotations of exactly their word, by group."""
    return queries.join(merged.select(F.col("word").alias(query), "grp", "text", "place"), query)


def search(prefixes: DataFrame, merged: DataFrame, limit: int = 128) -> DataFrame:
    """(prefix, word, text, place): annotations of words that begin with it, in order of word, each text once."""
    from .search import prefixes as cut

    met = merged.withColumn("prefix", F.explode(cut(F.col("word")))).join(prefixes, "prefix")
    first = met.groupBy("prefix", "text").agg(F.min("word").alias("word"))
    place = F.row_number().over(Window.partitionBy("prefix").orderBy("word", "text"))
    return first.withColumn("place", place).filter(F.col("place") <= limit).select("prefix", "word", "text", "place")


def catalogue(items: DataFrame, categories: DataFrame) -> DataFrame:
    """(category, text, place): items(category, text, ord) by the categories' display order, then their own; a text once a category."""
    first = items.groupBy("category", "text").agg(F.min("ord").alias("ord"))
    place = F.row_number().over(Window.partitionBy("category").orderBy("ord", "text"))
    return first.join(categories, "category").withColumn("place", place).select("category", "display", "text", "place")


def panel(queries: DataFrame, merged: DataFrame, groups: DataFrame) -> DataFrame:
    """(query, section, grp, text, place) for each distinct query that is not empty: what search gathers first, by groups(grp, display) in their order."""
    asked = queries.filter(F.char_length("query") > 0).select(F.col("query").alias("prefix")).distinct()
    found = search(asked, merged, PANEL_POOL).withColumnRenamed("place", "gathered").join(merged.select("word", "text", "grp"), ["word", "text"])
    place = F.row_number().over(Window.partitionBy("prefix", "grp").orderBy("gathered"))
    shown = found.join(groups, "grp").withColumn("place", place).filter(F.col("place") <= PANEL_GROUP)
    return shown.select(F.col("prefix").alias("query"), F.col("display").cast("int").alias("section"), "grp", "text", "place")


def resting_panel(recents: DataFrame, sections: DataFrame) -> DataFrame:
    """(user_id, section, grp, text, place) where nothing is asked for: a user's recents(user_id, item, place) as section 0 without a group, then catalogue's sections. These are the same for all, so they come once, with a null user_id."""
    own = recents.select("user_id", F.lit(0).alias("section"), F.lit(None).cast("string").alias("grp"), F.col("item").alias("text"), "place")
    rest = sections.select(F.lit(None).cast("bigint").alias("user_id"), F.col("display").cast("int").alias("section"), F.col("category").alias("grp"), "text", "place")
    return own.unionByName(rest)
