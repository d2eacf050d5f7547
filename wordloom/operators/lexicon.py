"""From signals of many sources to a lexicon: merge, admit, score, cut, report.

Inputs are one DataFrame a kind of signal: sources(source, role, weight), attested(source, word, rank),
observed(source, word, cnt), stems(stem), affixes(affix). Words are gathered once: one aggregation by word yields its
rank, its weighted counts and its evidence, and everything after reads that.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores, tokens

INVENTORY, FREQUENCY, DISCOVERY = "inventory", "frequency", "discovery"
#: Words below the budget that the report shows.
ABSENT_SAMPLE = 2000


@dataclass(frozen=True)
class Admission:
    minimum_count: int
    minimum_sources: int = 1
    maximum: int = 10_000


@dataclass(frozen=True)
class Rules:
    max_words: int = 100_000
    minimum_length: int = 2
    character_set: str | None = None
    accept_inflections: bool = False
    admission: Admission | None = None


@dataclass(frozen=True)
class LanguageModelRules:
    max_bigrams: int = 50_000
    minimum_count: int = 3


def merge_inventory(sources: DataFrame, attested: DataFrame) -> DataFrame:
    """(word, rank): weighted ranks of words that inventories vouch for."""
    own = attested.join(sources.filter(F.col("role") == INVENTORY), "source")
    return own.groupBy("word").agg(F.sum(F.col("rank") * F.col("weight")).alias("rank"))


def gather(sources: DataFrame, attested: DataFrame, observed: DataFrame) -> DataFrame:
    """(word, in_inventory, rank, count, d_count, d_observations, d_sources) of each word."""
    small = sources  # one row a source, of which there may be as many as hosts: Spark sees whether to broadcast them
    vouched = attested.join(small, "source").filter(F.col("role") == INVENTORY)
    vouched = vouched.select("word", (F.col("rank") * F.col("weight")).alias("rank"), F.lit(True).alias("vouched"), F.lit(0.0).alias("weighted"), F.lit(0).cast("bigint").alias("cnt"), F.lit(False).alias("discovered"))
    counted = observed.join(small, "source").filter(F.col("role") != INVENTORY)
    counted = counted.select("word", F.lit(0.0).alias("rank"), F.lit(False).alias("vouched"), (F.col("cnt") * F.col("weight")).alias("weighted"), "cnt", (F.col("role") == DISCOVERY).alias("discovered"))
    found = lambda c: F.sum(F.when(F.col("discovered"), F.col(c)).otherwise(0))
    return vouched.unionByName(counted).groupBy("word").agg(
        F.max("vouched").alias("in_inventory"),
        F.sum("rank").alias("rank"),
        F.sum("weighted").alias("count"),
        found("weighted").alias("d_count"),
        found("cnt").alias("d_observations"),
        F.count_if("discovered").alias("d_sources"),
    )


def classify(gathered: DataFrame, rules: Rules, stems: DataFrame | None = None) -> DataFrame:
    """gathered with `known` (enters at once), `accepted` (an inflection) and `candidate` (may be admitted)."""
    # Whether any inventory vouches for a word: one row.
    any_inventory = gathered.agg(F.coalesce(F.max("in_inventory"), F.lit(False)).alias("has_inventory"))
    out = gathered.crossJoin(F.broadcast(any_inventory))
    if rules.accept_inflections and stems is not None:
        from ..functions.hangul import grown_from

        grown = grown_from(gathered.filter(~F.col("in_inventory")).select("word"), stems).withColumn("grew", F.lit(True))
        out = out.join(grown, "word", "left").withColumn("accepted", F.col("has_inventory") & ~F.col("in_inventory") & F.coalesce("grew", F.lit(False)) & (F.col("count") > 0)).drop("grew")
    else:
        out = out.withColumn("accepted", F.lit(False))
    out = out.withColumn("known", F.col("in_inventory") | ~F.col("has_inventory") | F.col("accepted"))
    return out.withColumn("candidate", ~F.col("known") & (F.col("d_sources") > 0))


def candidates(classified: DataFrame) -> DataFrame:
    return classified.filter("candidate").select("word", F.col("d_count").alias("count"), F.col("d_observations").alias("observations"), F.col("d_sources").alias("sources"))


def admit(found: DataFrame, rules: Rules, affixes: DataFrame | None = None) -> DataFrame:
    """(word, count, observations, sources) of the candidates admitted, those with most observations first."""
    admission = rules.admission
    if admission is None:
        return found.limit(0)
    w = F.col("word")
    fit = found.filter((F.col("observations") >= admission.minimum_count) & (F.col("sources") >= admission.minimum_sources) & (tokens.char_count(w) >= rules.minimum_length) & tokens.accepts(w, rules.character_set))
    if affixes is not None:
        fit = fit.join(affixes.select(F.col("affix").alias("word")), "word", "left_anti")
    return fit.orderBy(F.desc("observations"), "word").limit(admission.maximum)


def accumulate(classified: DataFrame, promoted: DataFrame) -> DataFrame:
    """(word, rank, count) of all that may be in the lexicon."""
    known = classified.filter("known").select("word", "rank", "count")
    return known.unionByName(promoted.select("word", F.lit(0.0).alias("rank"), "count"))


def rank_words(accumulated: DataFrame, rules: Rules) -> DataFrame:
    """(word, score) of words that the filter lets pass."""
    w = F.col("word")
    kept = accumulated.filter((tokens.char_count(w) >= rules.minimum_length) & tokens.accepts(w, rules.character_set))
    return kept.select("word", (F.col("rank") + scores.logarithmic(F.col("count"))).alias("score"))


def cut(ranked: DataFrame, rules: Rules) -> DataFrame:
    """(word, score, freq) of the max_words best."""
    best = ranked.orderBy(F.desc("score"), "word").limit(rules.max_words)
    highest = ranked.agg(F.max("score").alias("highest"))
    return best.crossJoin(F.broadcast(highest)).select("word", "score", scores.quantise(F.col("score"), F.col("highest")).alias("freq"))


def absent(ranked: DataFrame, rules: Rules, sample: int = ABSENT_SAMPLE) -> DataFrame:
    """The next words below the budget, in order; rows fetched are bounded by both limits."""
    order = Window.orderBy(F.desc("score"), "word")
    top = ranked.orderBy(F.desc("score"), "word").limit(rules.max_words + sample)
    return top.withColumn("place", F.row_number().over(order)).filter(F.col("place") > rules.max_words).select("word", "score", "place")


def report(classified: DataFrame, accumulated: DataFrame, ranked: DataFrame, promoted: DataFrame, rules: Rules) -> DataFrame:
    """One row of counters."""
    a = classified.agg(F.count_if("in_inventory").alias("inventory_size"), F.count_if("accepted").alias("accepted_inflections"), F.count_if("candidate").alias("candidates"))
    b = accumulated.agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.col("count") > 0).alias("observed_in_corpus"))
    c = ranked.agg(F.count(F.lit(1)).alias("passed"))
    d = promoted.agg(F.count(F.lit(1)).alias("promoted"))
    return a.crossJoin(b).crossJoin(c).crossJoin(d).select(
        "inventory_size",
        "observed_in_corpus",
        (F.col("entries") - F.col("passed")).alias("dropped_by_filter"),
        F.greatest(F.col("passed") - rules.max_words, F.lit(0)).alias("dropped_by_budget"),
        "accepted_inflections",
        "promoted",
        (F.col("candidates") - F.col("promoted")).alias("rejected_candidates"),
    )


def contributions(sources: DataFrame, attested: DataFrame, observed: DataFrame, lexicon: DataFrame, promoted: DataFrame) -> DataFrame:
    """(source, in_lexicon, unique_to_source, promoted). A source that both vouches for a word and counts it gives it twice."""
    given = attested.select("source", "word").unionAll(observed.select("source", "word")).join(lexicon.select("word"), "word", "left_semi")
    given = given.withColumn("givers", F.count(F.lit(1)).over(Window.partitionBy("word")))
    given = given.join(promoted.select("word", F.lit(True).alias("new")), "word", "left")
    counted = given.groupBy("source").agg(F.count(F.lit(1)).alias("in_lexicon"), F.count_if(F.col("givers") == 1).alias("unique_to_source"), F.count_if(F.coalesce("new", F.lit(False))).alias("promoted"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return sources.select("source").join(counted, "source", "left").select("source", zero("in_lexicon"), zero("unique_to_source"), zero("promoted"))


def bigram_lift(sources: DataFrame, observed: DataFrame, pairs: DataFrame, lexicon: DataFrame, rules: LanguageModelRules) -> DataFrame:
    """(left, right, lift, cnt): weighted pointwise mutual information, over sources, where it is positive."""
    total = pairs.groupBy("source").agg(F.sum("cnt").alias("total"))
    enough = pairs.filter(F.col("cnt") >= rules.minimum_count)
    for side in ("left", "right"):
        enough = enough.join(lexicon.select(F.col("word").alias(side)), side, "left_semi")
        enough = enough.join(observed.select("source", F.col("word").alias(side), F.col("cnt").alias(f"{side}_cnt")), ["source", side])
    lift = F.ln(F.col("cnt") * F.col("total").cast("double") / (F.col("left_cnt").cast("double") * F.col("right_cnt")))
    lifted = enough.join(total, "source").join(sources.select("source", "weight"), "source").withColumn("lift", lift).filter("lift > 0")
    return lifted.groupBy("left", "right").agg(F.sum(F.col("lift") * F.col("weight")).alias("lift"), F.sum("cnt").alias("cnt"))


def bigram_budget(lifted: DataFrame, rules: LanguageModelRules) -> DataFrame:
    """(left, right, weight) of the most counted pairs."""
    best = lifted.orderBy(F.desc("cnt"), F.desc("lift"), "left", "right").limit(rules.max_bigrams)
    highest = best.agg(F.greatest(F.max("lift"), F.lit(1.0)).alias("highest"))
    weight = F.greatest(F.floor(scores.quantise(F.col("lift"), F.col("highest")) / 2).cast("int"), F.lit(1))
    return best.crossJoin(F.broadcast(highest)).select("left", "right", weight.alias("weight"))


def bigram_report(pairs: DataFrame, observed: DataFrame, lexicon: DataFrame, rules: LanguageModelRules) -> DataFrame:
    """observed, dropped_outside_lexicon, dropped_without_lift over all sources."""
    total = pairs.groupBy("source").agg(F.sum("cnt").alias("total"))
    rows = pairs.filter(F.col("cnt") >= rules.minimum_count)
    for side in ("left", "right"):
        rows = rows.join(lexicon.select(F.col("word").alias(side), F.lit(True).alias(f"{side}_in")), side, "left")
        rows = rows.join(observed.select("source", F.col("word").alias(side), F.col("cnt").alias(f"{side}_cnt")), ["source", side], "left")
    inside = F.col("left_in").isNotNull() & F.col("right_in").isNotNull() & F.col("left_cnt").isNotNull() & F.col("right_cnt").isNotNull()
    flat = F.col("cnt") * F.col("total").cast("double") <= F.col("left_cnt").cast("double") * F.col("right_cnt")
    return rows.join(total, "source").agg(F.count(F.lit(1)).alias("observed"), F.count_if(~inside).alias("dropped_outside_lexicon"), F.count_if(inside & flat).alias("dropped_without_lift"))


def first_of(tables: list[DataFrame], key: str, value: str) -> DataFrame:
    """(key, value): the first of the tables, in order, that has a value for the key gives it."""
    rows = tables[0].select(key, value, F.lit(0).alias("n"))
    for n, more in enumerate(tables[1:], 1):
        rows = rows.unionByName(more.select(key, value, F.lit(n).alias("n")))
    return rows.filter(F.col(value).isNotNull()).groupBy(key).agg(F.min_by(value, "n").alias(value))
