"""Measures of look-ups, and typing errors to measure them with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import quantiles


def corrections(ranked: DataFrame) -> DataFrame:
    """One row over cases(case_id, intended, place or NULL, corrected): top1, top3, mrr, autocorrect."""
    p = F.col("place")
    share = lambda c: F.coalesce(F.avg(F.when(c, 1.0).otherwise(0.0)), F.lit(0.0))
    return ranked.agg(F.count(F.lit(1)).alias("cases"), share(p == 1).alias("top1"), share(p <= 3).alias("top3"), F.coalesce(F.avg(F.coalesce(1.0 / p, F.lit(0.0))), F.lit(0.0)).alias("mrr"), share(F.coalesce("corrected", F.lit(False))).alias("autocorrect"))


def false_corrections(typed: DataFrame) -> DataFrame:
    """One row over words(word, committed): the share that was changed."""
    return typed.agg(F.count(F.lit(1)).alias("words"), F.avg(F.when(F.col("committed") != F.col("word"), 1.0).otherwise(0.0)).alias("false_rate"))


def keystroke_savings(shown: DataFrame, words: DataFrame) -> DataFrame:
    """One row: words(word); shown(prefix, word): words among the first three for a prefix. Taps: the shortest such prefix before the last letter and one, else all letters and one."""
    n = F.char_length("word")
    hit = shown.withColumn("k", F.char_length("prefix")).filter(F.col("k") < n).groupBy("word").agg(F.min("k").alias("k"))
    used = words.join(hit, "word", "left").withColumn("used", F.coalesce(F.col("k") + 1, n + 1))
    return used.agg(F.count(F.lit(1)).alias("words"), F.avg(1 - F.col("used") / (n + 1)).alias("savings"))


def latencies(samples: DataFrame, group: str, column: str) -> DataFrame:
    """(group, p50, p99, longest), exact, however many rows a group or a value has; null samples take no part. Null groups are left out."""
    longest = samples.filter(F.col(group).isNotNull()).groupBy(group).agg(F.max(column).alias("longest"))
    return longest.join(quantiles(samples, group, column, {"p50": 0.5, "p99": 0.99}), group, "left").select(group, "p50", "p99", "longest")


def latency(samples: DataFrame, column: str) -> DataFrame:
    """Exact p50, p99 and maximum."""
    return latencies(samples.select(F.lit(0).alias("__all"), column), "__all", column).drop("__all")


def conversions(results: DataFrame) -> DataFrame:
    """One row over results(expected, got): whole sentences right, and the mean share of a case's characters in its longest common subsequence. A null `got` counts as empty."""
    from ..functions.typing import lcs_length

    got = F.coalesce("got", F.lit(""))
    share = lcs_length(got, F.col("expected")) / F.greatest(F.char_length("expected"), F.lit(1))
    return results.agg(F.avg(F.when(F.col("expected") == got, 1.0).otherwise(0.0)).alias("sentences"), F.avg(share).alias("characters"))


def reachable(cases: DataFrame, segments: DataFrame, offered: DataFrame) -> DataFrame:
    """One row over cases(sentence_id, expected): the mean share of a case's segments(sentence_id, segment, reading) with a spelling of offered(reading, surface) that stands in `expected`; 0 for a case without segments. Ids are distinct."""
    asked = segments.select("sentence_id", "segment", "reading").join(cases.select("sentence_id", "expected"), "sentence_id")
    met = asked.join(offered.select("reading", "surface"), "reading", "left").groupBy("sentence_id", "segment").agg(F.coalesce(F.max(F.contains("expected", "surface")), F.lit(False)).alias("found"))
    shares = met.groupBy("sentence_id").agg(F.avg(F.col("found").cast("int")).alias("share"))
    return cases.join(shares, "sentence_id", "left").agg(F.coalesce(F.avg(F.coalesce("share", F.lit(0.0))), F.lit(0.0)).alias("reachable"))


def synthesise(words: DataFrame, neighbours: DataFrame, per_word: int = 5, seed: int = 42, tries: int = 8) -> DataFrame:
    """(word, case_no, typed): slips of each word, drawn by a hash of seed, word and case: a neighbouring key, a swap, a lost or a doubled-up letter.

    neighbours(base, near) are a layout's, a few hundred rows at most. Unlike one running random stream, a case depends on
    its own word alone, so words may be dealt to any number of tasks. Cases that no try changes are left out.
    """
    near = {r["base"]: sorted(r["nears"]) for r in neighbours.groupBy("base").agg(F.collect_list("near").alias("nears")).collect()}
    table = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for kv in near.items() for x in kv])
    tried = words.select("word", F.explode(F.sequence(F.lit(0), F.lit(per_word - 1))).alias("case_no")).withColumn("try_no", F.explode(F.sequence(F.lit(0), F.lit(tries - 1))))
    draw = lambda what, bound: F.pmod(F.xxhash64(F.lit(f"{seed}/{what}"), "word", "case_no", "try_no"), bound)
    n = F.char_length("word")
    tried = tried.filter(n > 0).withColumns({"kind": draw("kind", F.lit(4)), "at": (draw("at", n) + 1).cast("int")})
    letter = lambda i: F.substring("word", i, F.lit(1))
    head, tail = F.substring("word", F.lit(1), F.col("at") - 1), F.substring("word", F.col("at") + 1, n)
    nears = F.try_element_at(table, letter(F.col("at")))
    other = F.get(nears, draw("near", F.greatest(F.size(nears), F.lit(1))).cast("int"))
    swapped = F.concat(head, letter(F.col("at") + 1), letter(F.col("at")), F.substring("word", F.col("at") + 2, n))
    typed = F.when(F.col("kind") == 0, F.concat(head, other, tail)).when((F.col("kind") == 1) & (F.col("at") < n), swapped).when((F.col("kind") == 2) & (n >= 3), F.concat(head, tail)).when(F.col("kind") == 3, F.concat(head, letter(F.col("at")), other, tail))
    made = tried.withColumn("typed", typed).filter(F.col("typed").isNotNull() & (F.col("typed") != F.col("word")))
    return made.groupBy("word", "case_no").agg(F.min_by("typed", "try_no").alias("typed"))
