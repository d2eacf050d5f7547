"""Counts of words and of adjacent pairs, by source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tokens


def tokenise(docs: DataFrame, text: str = "text", end: str = tokens.LINE_END, cased: bool = False, keys: Sequence[str] = ("source",)) -> DataFrame:
    """(keys.., words) for each line or sentence. Null texts give none."""
    pieces = docs.select(*keys, F.explode(tokens.pieces(F.col(text), end)).alias("piece"))
    return pieces.select(*keys, tokens.words_of(F.col("piece"), cased).alias("words"))


def tokenised(docs: DataFrame, text: str = "text", keys: Sequence[str] = ("source",)) -> DataFrame:
    """(keys.., words) for each line of texts that are words already: whatever stands between white space is one."""
    lines = docs.select(*keys, F.explode(tokens.pieces(F.col(text))).alias("line"))
    return lines.select(*keys, F.filter(F.split("line", tokens.WHITE_SPACE), lambda w: w != "").alias("words"))


def count_words(lines: DataFrame, keys: Sequence[str] = ("source",), minimum: int = 1) -> DataFrame:
    """(keys.., word, cnt), cnt at least minimum."""
    words = lines.select(*keys, F.explode("words").alias("word")).filter("word <> ''")
    counted = words.groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("cnt"))
    return counted.filter(F.col("cnt") >= minimum) if minimum > 1 else counted


def count_pairs(lines: DataFrame, keys: Sequence[str] = ("source",), minimum: int = 1, words: DataFrame | None = None) -> DataFrame:
    """(keys.., left, right, cnt); with words, only pairs of words that are in that count."""
    pairs = lines.select(*keys, F.inline(tokens.adjacent(F.col("words"))))
    counted = pairs.groupBy(*keys, "left", "right").agg(F.count(F.lit(1)).alias("cnt"))
    if minimum > 1:
        counted = counted.filter(F.col("cnt") >= minimum)
    if words is not None:
        for side in ("left", "right"):
            counted = counted.join(words.select(*keys, F.col("word").alias(side)), [*keys, side], "left_semi")
    return counted.select(*keys, "left", "right", "cnt")


def count_all(lines: DataFrame, keys: Sequence[str] = ("source",)) -> DataFrame:
    """(keys.., left, right, cnt): words, with no right, and pairs, counted in one pass and one shuffle."""
    w = F.col("words")
    words = F.transform(F.filter(w, lambda x: x != ""), lambda x: F.struct(x.alias("left"), F.lit(None).cast("string").alias("right")))
    return lines.select(*keys, F.inline(F.concat(words, tokens.adjacent(w)))).groupBy(*keys, "left", "right").agg(F.count(F.lit(1)).alias("cnt"))


def surviving(pairs: DataFrame, words: DataFrame, keys: Sequence[str] = ("source",)) -> DataFrame:
    """Pairs both of whose words are in words(keys.., word)."""
    for side in ("left", "right"):
        pairs = pairs.join(words.select(*keys, F.col("word").alias(side)), [*keys, side], "left_semi")
    return pairs.select(*keys, "left", "right", "cnt")


def with_previous(words: DataFrame, group: Sequence[str], order: Column) -> DataFrame:
    """Each word with the one before it in its group: the window form of adjacency."""
    from pyspark.sql import Window

    return words.withColumn("previous", F.lag("word").over(Window.partitionBy(*group).orderBy(order)))
