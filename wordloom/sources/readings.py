"""Reading dictionaries: (reading, surface, left_id, right_id, cost, dependent), word classes, connection costs, test sentences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import content, fields

#: Cost of a first single character and step to the next; the highest cost; the noun's class; the reach of a cell.
SINGLE_COST, SINGLE_STEP, MOST_COST, NOUN = 15_000, 10, 65_535, "名詞,一般"
CELL = (-32_768, 32_767)
ENTRY_MEMBER = r"(?!.*(?:^|/)test/).*(?:dictionary[0-9]{2}|suffix)\.txt"


def _within(number: Column, low: int, high: int) -> Column:
    """Clamped; null stays null."""
    return F.when(number.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), number)))


def word_classes(rows: DataFrame, dependent: Sequence[str]) -> DataFrame:
    """Lines 'id name,name,..': (class_id, dependent, noun); dependent where any of the names is one of those."""
    f = F.split("line", " ", 2)
    names = F.split(F.get(f, 1), ",")
    rows = rows.filter(F.size(f) == 2)
    tags = F.array(*map(F.lit, dependent)).cast("array<string>")
    return rows.select(F.get(f, 0).try_cast("int").alias("class_id"), F.arrays_overlap(names, tags).alias("dependent"), F.startswith(F.get(f, 1), F.lit(NOUN)).alias("noun")).filter(F.col("class_id").isNotNull())


def entries(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Lines of exactly five fields 'reading left right cost surface'; the left class says whether a word is dependent."""
    f = fields(F.col("line"))
    whole = lambda k: F.get(f, k).try_cast("int")
    cost = _within(whole(3), 0, MOST_COST)
    read = rows.filter(F.size(f) == 5).select(F.get(f, 0).alias("reading"), F.get(f, 4).alias("surface"), whole(1).alias("left_id"), whole(2).alias("right_id"), cost.alias("cost")).dropna()
    # A few thousand classes: one row for each id of the file.
    marks = classes.select(F.col("class_id").alias("left_id"), "dependent")
    return read.join(marks, "left_id", "left").select("reading", "surface", "left_id", "right_id", "cost", F.coalesce("dependent", F.lit(False)).alias("dependent"))


def single_characters(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Lines 'reading<TAB>characters': entries of one character each with the noun's class, dearer by place."""
    f = fields(F.col("line"))
    noun = classes.filter("noun").agg(F.min("class_id").alias("noun_id"))
    each = content(rows).filter(F.size(f) >= 2).select(F.get(f, 0).alias("reading"), F.posexplode(F.filter(F.split(F.get(f, 1), ""), lambda c: c != "")).alias("k", "surface"))
    cost = F.least(F.lit(MOST_COST), SINGLE_COST + SINGLE_STEP * F.col("k")).cast("int")
    return each.crossJoin(F.broadcast(noun)).select("reading", "surface", F.col("noun_id").alias("left_id"), F.col("noun_id").alias("right_id"), cost.alias("cost"), F.lit(False).alias("dependent"))


def connection_cells(rows: DataFrame) -> DataFrame:
    """(place, line) with the size n in the first line and n * n numbers after it: (row, col, cost) without zeros; lines that are no numbers keep their place."""
    n = rows.filter("place = 0").select(F.trim("line").try_cast("bigint").alias("n"))
    at = F.col("place") - 1
    cost = _within(F.trim("line").try_cast("int"), *CELL)
    cells = rows.filter("place > 0").crossJoin(F.broadcast(n)).filter(at < F.col("n") * F.col("n"))
    return cells.select(F.floor(at / F.col("n")).cast("int").alias("row"), (at % F.col("n")).cast("int").alias("col"), cost.alias("cost")).filter("cost <> 0")


def named_signs(rows: DataFrame, text_field: int, names_field: int, group: str) -> DataFrame:
    """(place, line) with a header: (word, grp, text) for each of a sign's readings that is not the sign itself."""
    f = fields(F.col("line"))
    read = rows.filter("place > 0").select(F.get(f, text_field).alias("text"), F.explode(F.split(F.get(f, names_field), r"[ ,、]+")).alias("word"))
    return read.filter("word <> '' AND text <> '' AND word <> text").select("word", F.lit(group).alias("grp"), "text").distinct()


def test_sentences(rows: DataFrame) -> DataFrame:
    """Lines 'status reading expected ..': (reading, expected), both not empty."""
    f = fields(F.col("line"))
    return rows.filter(~F.startswith("line", F.lit("#"))).select(F.get(f, 1).alias("reading"), F.get(f, 2).alias("expected")).filter("reading <> '' AND expected <> ''")
