"""Look-ups in a lexicon: exact, by prefix, by edit distance, with context and a user's own words.

A lexicon is (key, freq); a bigram model (left, right, weight). Queries are a DataFrame with an id each, so a look-up is
a join: prefixes of keys meet queries as equal strings, and corrections meet on segments of keys (`edit_join`), which
finds every key within the budget without comparing all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores
from . import edit_join

POOL = 12
SHOWN = 3
FOLLOWERS = 32


def lookup(queries: DataFrame, lexicon: DataFrame, key: str = "key") -> DataFrame:
    """queries with the frequency of their key, 0 where the lexicon has none."""
    return queries.join(lexicon.select(F.col("key").alias(key), "freq"), key, "left").withColumn("freq", F.coalesce("freq", F.lit(0)))


def prefixes(key: Column, proper: bool = False) -> Column:
    n = F.char_length(key) - (1 if proper else 0)
    return F.when(n < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(key, F.lit(1), i)))


def complete(queries: DataFrame, lexicon: DataFrame, limit: int = SHOWN, query: str = "query") -> DataFrame:
    """(.., key, freq, place): the most frequent keys that begin with the query, ties in order of key."""
    extended = lexicon.select("key", "freq", F.explode(prefixes(F.col("key"))).alias("prefix"))
    best = Window.partitionBy("prefix").orderBy(F.desc("freq"), "key")
    # Only prefixes that are asked for are ranked.
    asked = extended.join(queries.select(F.col(query).alias("prefix")).distinct(), "prefix", "left_semi")
    top = asked.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= limit)
    return queries.join(top, F.col(query) == F.col("prefix")).drop("prefix")


def corrections(queries: DataFrame, lexicon: DataFrame, query: str = "query", near: str | None = None) -> DataFrame:
    """(.., key, freq, cost): keys whose edit cost is within the query's budget and not 0. near: a column of the queries with cheaper substitutions, as JSON of (at, base, cost); the larger budget then holds up to three edits."""
    budget = scores.edit_budget(F.col(query))
    by = [query] if near is None else [query, near]
    small, large = budget == scores.EDIT, budget > scores.EDIT
    budgets = [(1, small, budget), (2 if near is None else 3, large, budget)]
    costed = edit_join.join(queries.filter(budget > 0).select(*by).distinct(), lexicon.select("key", "freq").distinct(), query, "key", budgets, near).select(*by, "key", "freq", "cost")
    if near is None:
        return queries.join(costed, query)
    same = (F.col(f"q.{query}") == F.col(f"c.{query}")) & F.equal_null(F.col(f"q.{near}"), F.col(f"c.{near}"))
    return queries.alias("q").join(costed.alias("c"), same).select("q.*", "c.key", "c.freq", "c.cost")


def search(queries: DataFrame, lexicon: DataFrame, limit: int = POOL, query: str = "query", id_column: str = "query_id", corrected=None) -> DataFrame:
    """(.., key, freq, cost, score, place): completions at no cost and corrections, the best by score, ties by key. corrected: another corrections()."""
    done = complete(queries, lexicon, limit, query).drop("place").withColumn("cost", F.lit(0))
    fixed = (corrected or corrections)(queries, lexicon, query)
    kept = done.unionByName(fixed.select(*done.columns))
    cheapest = kept.groupBy(*queries.columns, "key", "freq").agg(F.min("cost").alias("cost"))
    zero = F.lit(0)
    scored = cheapest.withColumn("score", scores.combine(F.col("freq"), zero, zero, F.col("cost")))
    order = Window.partitionBy(id_column).orderBy(F.desc("score"), "key")
    return scored.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)


def committed(typed: DataFrame, corrected: DataFrame, shortcuts: DataFrame, query: str = "query", user: str = "user_id") -> DataFrame:
    """typed with `text`: the user's own shortcut for exactly what was typed, else its correction, else what was typed.

    shortcuts(user, shortcut, expansion), one row a user and shortcut; corrected(query, key), one row a query."""
    own = shortcuts.select(user, F.col("shortcut").alias(query), "expansion")
    met = typed.join(own, [user, query], "left").join(corrected.select(query, F.col("key").alias("__key")), query, "left")
    return met.withColumn("text", F.coalesce("expansion", "__key", query)).select(*typed.columns, "text")


def followers(bigrams: DataFrame, limit: int = FOLLOWERS) -> DataFrame:
    """(left, right, weight, place): each word's strongest followers."""
    order = Window.partitionBy("left").orderBy(F.desc("weight"), "right")
    return bigrams.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)


def predict_next(contexts: DataFrame, bigrams: DataFrame, lexicon: DataFrame, personal: DataFrame | None = None, limit: int = SHOWN, word: str = "left") -> DataFrame:
    """(.., right, score, place): what follows a word, by frequency, own use and context."""
    near = contexts.select(word).distinct().join(followers(bigrams).select(F.col("left").alias(word), "right", "weight"), word)
    near = near.join(lexicon.select(F.col("key").alias("right"), "freq"), "right", "left")
    own = F.lit(0)
    if personal is not None:
        near = near.join(personal.select(F.col("word").alias("right"), F.col("weight").alias("personal")), "right", "left")
        own = F.coalesce("personal", F.lit(0))
    near = near.withColumn("score", F.coalesce("freq", F.lit(0)).cast("bigint") + own + F.col("weight"))
    order = Window.partitionBy(word).orderBy(F.desc("score"), "right")
    top = near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
    return contexts.join(top.select(word, "right", "score", "place"), word)


def rerank(candidates: DataFrame, personal: DataFrame | None = None, bigrams: DataFrame | None = None, id_column: str = "query_id", previous: str = "previous", user: str = "user_id", limit: int = SHOWN) -> DataFrame:
    """candidates (key, freq, cost) with the score that a user's uses (user, word, weight) and the word before add."""
    out = candidates
    if personal is not None:
        out = out.join(personal.select(user, F.col("word").alias("key"), F.col("weight").alias("personal")), [user, "key"], "left")
    if bigrams is not None:
        near = followers(bigrams).select(F.col("left").alias(previous), F.col("right").alias("key"), F.col("weight").alias("context"))
        out = out.join(near, [previous, "key"], "left")
    value = lambda c: F.coalesce(c, F.lit(0)) if c in out.columns else F.lit(0)
    out = out.withColumn("score", scores.combine(F.col("freq"), value("personal"), value("context"), F.col("cost")))
    order = Window.partitionBy(id_column).orderBy(F.desc("score"), "key")
    return out.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)


def autocorrect(queries: DataFrame, lexicon: DataFrame, learned: DataFrame | None = None, query: str = "query", id_column: str = "query_id") -> DataFrame:
    """(.., correction, score): typed words that are in no lexicon and not learned, where the best correction leads by the margin. Ties: the greater key."""
    unknown = queries.join(lexicon.select(F.col("key").alias(query)), query, "left_anti")
    own = F.lit(0)
    if learned is not None:
        unknown = unknown.join(learned.filter(F.col("count") >= scores.LEARNED_USES).select(F.col("word").alias(query)), query, "left_anti")
        unknown = unknown.join(learned.select(F.col("word").alias(query), F.col("weight").alias("own")), query, "left")
        own = F.coalesce("own", F.lit(0))
    zero = F.lit(0)
    found = corrections(unknown, lexicon, query).withColumn("score", scores.combine(F.col("freq"), zero, zero, F.col("cost")))
    best = found.withColumn("place", F.row_number().over(Window.partitionBy(id_column).orderBy(F.desc("score"), F.desc("key")))).filter("place = 1")
    return best.filter(F.col("score") - own > scores.AUTOCORRECT_MARGIN).select(id_column, query, F.col("key").alias("correction"), "score")


def learned_prefixes(words: DataFrame, learned: DataFrame, word: str = "word") -> DataFrame:
    """(.., prefix): proper prefixes of a word that are learned words."""
    cut = words.withColumn("prefix", F.explode(prefixes(F.col(word), proper=True)))
    return cut.join(learned.select(F.col("word").alias("prefix")), "prefix", "left_semi")


def affix_combinations(queries: DataFrame, learned: DataFrame, affixes: DataFrame, lexicon: DataFrame, query: str = "query", limit: int | None = SHOWN, by: tuple[str, ...] = ()) -> DataFrame:
    """(.., key, score, place): a learned word that the query goes on from, with the affixes that do, unless the lexicon has it. by: columns of both, such as the user, that must be equal."""
    stems = queries.withColumn("stem", F.explode(prefixes(F.col(query), proper=True)))
    known = stems.join(learned.select(*by, F.col("word").alias("stem"), "weight"), [*by, "stem"])
    rest = F.substring(query, F.char_length("stem") + 1, F.char_length(query))
    tails = affixes.select("affix", F.explode(prefixes(F.col("affix"))).alias("tail"))
    joined = known.withColumn("tail", rest).join(tails, "tail").withColumn("key", F.concat("stem", "affix"))
    new = joined.join(lexicon.select("key"), "key", "left_anti").groupBy(*queries.columns, "key").agg(F.max("weight").alias("score"))
    if limit is None:
        return new
    order = Window.partitionBy(*queries.columns).orderBy(F.desc("score"), "key")
    return new.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
