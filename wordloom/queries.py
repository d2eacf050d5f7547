"""Queries over the driver's tables for the library's own operators, and DuckDB SQL with the same rows."""

from __future__ import annotations

import dataclasses
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import encoding, hangul, kana, layouts, scores, tokens, typing
from .operators import annotations, conversion, counting, evaluation, lexicon, licences, personal, search, suggest, touch
from .session import checkpoint_folder, staged
from .sources import build, markup, tables, words
from .streaming import changes, learning, taps

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

RULES = lexicon.Rules(minimum_length=2, character_set=None, admission=lexicon.Admission(minimum_count=20, minimum_sources=3))
LM_RULES = lexicon.LanguageModelRules(minimum_count=3)
MINIMUM_COUNT = 2


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- Signals of the driver's tables: benchmark is an inventory, documents' sources count.

_WORD = r"regexp_extract({x}, '^[^\p{{L}}''\p{{N}}\x{{FFFD}}]*([\p{{L}}'']+)[^\p{{L}}''\p{{N}}\x{{FFFD}}]*$', 1)"


def _words(piece: str, cased: bool) -> str:
    word = _WORD.format(x="c")
    word = f"CASE WHEN regexp_matches({word}, '^\\p{{Lu}}') THEN '' ELSE {word} END" if cased else word
    return f"list_transform(list_filter(regexp_split_to_array({piece}, '\\s+'), lambda c: c <> ''), lambda c: {word})"


def _lines(keys: str, src: str, cased: bool, end: str = "\\n") -> str:
    return f"SELECT {keys}, {_words('piece', cased)} AS words FROM (SELECT {keys}, unnest(regexp_split_to_array(text, '{end}')) AS piece FROM {src})"


_LINES = _lines("source", "documents", True)
_LEX = f"""
lines AS MATERIALIZED ({_LINES}),
observed AS MATERIALIZED (SELECT source, word, count(*) AS cnt FROM (SELECT source, unnest(words) AS word FROM lines) WHERE word <> '' GROUP BY ALL HAVING count(*) >= {MINIMUM_COUNT}),
allpairs AS (SELECT source, words[i] AS l, words[i + 1] AS r, count(*) AS cnt FROM (SELECT source, words, unnest(range(1, len(words))) AS i FROM lines) WHERE words[i] <> '' AND words[i + 1] <> '' GROUP BY ALL),
pairs AS (SELECT p.* FROM allpairs p JOIN observed a ON a.source = p.source AND a.word = p.l JOIN observed b ON b.source = p.source AND b.word = p.r),
inv AS (SELECT word, count(*) AS cnt FROM (SELECT unnest(words) AS word FROM ({_lines("item_id", "benchmark", True)})) WHERE word <> '' GROUP BY word),
attested AS (SELECT 'benchmark' AS source, word, cnt / (SELECT max(cnt) FROM inv) AS rank FROM inv),
sources AS (SELECT 'benchmark' AS source, 'inventory' AS role, 1.0::DOUBLE AS weight UNION ALL
  SELECT DISTINCT source, CASE WHEN regexp_extract(source, '([0-9]+)$', 1)::INT % 2 = 0 THEN 'frequency' ELSE 'discovery' END, CASE WHEN regexp_extract(source, '([0-9]+)$', 1)::INT % 2 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE FROM documents),
gathered AS MATERIALIZED (SELECT word, bool_or(v) AS in_inventory, sum(rank) AS rank, sum(weighted) AS cnt, sum(CASE WHEN d THEN weighted ELSE 0 END) AS d_cnt, CAST(sum(CASE WHEN d THEN c ELSE 0 END) AS BIGINT) AS d_obs, count(*) FILTER (d) AS d_sources FROM (
  SELECT word, rank * weight AS rank, true AS v, 0.0::DOUBLE AS weighted, 0 AS c, false AS d FROM attested JOIN sources USING (source) WHERE role = 'inventory'
  UNION ALL SELECT word, 0.0, false, cnt * weight, cnt, role = 'discovery' FROM observed JOIN sources USING (source) WHERE role <> 'inventory') GROUP BY word),
cand AS (SELECT word, d_cnt AS cnt, d_obs, d_sources FROM gathered WHERE NOT in_inventory AND d_sources > 0),
promoted AS (SELECT * FROM cand WHERE d_obs >= 20 AND d_sources >= 3 AND length(word) >= 2 ORDER BY d_obs DESC, word LIMIT 10000),
acc AS (SELECT word, rank, cnt FROM gathered WHERE in_inventory UNION ALL SELECT word, 0.0, cnt FROM promoted),
ranked AS MATERIALIZED (SELECT word, rank + CASE WHEN cnt > 0 THEN ln(1 + cnt) ELSE 0 END AS score FROM acc WHERE length(word) >= 2),
lex AS MATERIALIZED (SELECT word, score, {{quant}} AS freq FROM (SELECT word, score, (SELECT max(score) FROM ranked) AS hi FROM ranked ORDER BY score DESC, word LIMIT 100000)),
totals AS (SELECT source, sum(cnt) AS total FROM pairs GROUP BY source),
lifts AS (SELECT p.l, p.r, p.cnt, s.weight, ln(p.cnt * t.total::DOUBLE / (a.cnt::DOUBLE * b.cnt)) AS lift FROM pairs p JOIN totals t USING (source) JOIN sources s USING (source)
  JOIN observed a ON a.source = p.source AND a.word = p.l JOIN observed b ON b.source = p.source AND b.word = p.r
  WHERE p.cnt >= 3 AND p.l IN (SELECT word FROM lex) AND p.r IN (SELECT word FROM lex)),
lifted AS MATERIALIZED (SELECT l, r, sum(lift * weight) AS lift, CAST(sum(cnt) AS BIGINT) AS cnt FROM lifts WHERE lift > 0 GROUP BY l, r),
bi AS MATERIALIZED (SELECT l, r, greatest({{quant2}} // 2, 1) AS weight FROM (SELECT *, greatest(max(lift) OVER (), 1.0) AS hi FROM (SELECT * FROM lifted ORDER BY cnt DESC, lift DESC, l, r LIMIT 50000))),
fol AS (SELECT l, r, weight FROM (SELECT *, row_number() OVER (PARTITION BY l ORDER BY weight DESC, r) AS place FROM bi) WHERE place <= 32)
"""


def _quant(x: str) -> str:
    return f"CAST(greatest(1, least(65535, ((1 + CAST(round(greatest(0, least(1, {x} / hi)) * 65534) AS BIGINT) + 128) // 256) * 256)) AS INT)"


LEX = _LEX.replace("{quant}", _quant("score")).replace("{quant2}", _quant("lift"))


def signals(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The sources' signals: the texts are read once, and what later steps share is written once."""
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    counted = staged(counting.count_all(counting.tokenise(docs, cased=True)), "counts")
    observed = counted.filter(F.col("right").isNull() & (F.col("cnt") >= MINIMUM_COUNT)).select("source", F.col("left").alias("word"), "cnt")
    pairs = staged(counting.surviving(counted.filter(F.col("right").isNotNull()), observed), "pairs")
    inventory = staged(counting.count_words(counting.tokenise(bench, cased=True, keys=()), keys=()), "inventory")
    most = inventory.agg(F.max("cnt").alias("most"))
    attested = inventory.crossJoin(F.broadcast(most)).select(F.lit("benchmark").alias("source"), "word", (F.col("cnt") / F.col("most")).alias("rank"))
    even = F.regexp_extract("source", "([0-9]+)$", 1).try_cast("int") % 2 == 0
    sources = docs.select("source").distinct().select("source", F.when(even, lexicon.FREQUENCY).otherwise(lexicon.DISCOVERY).alias("role"), F.when(even, 1.0).otherwise(0.5).alias("weight"))
    sources = sources.unionByName(spark.range(1).select(F.lit("benchmark").alias("source"), F.lit(lexicon.INVENTORY).alias("role"), F.lit(1.0).alias("weight")))
    return {"sources": sources, "attested": attested, "observed": observed, "pairs": pairs}


def lexicon_of(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    s = signals(spark, sf_dir)
    s["classified"] = lexicon.classify(staged(lexicon.gather(s["sources"], s["attested"], s["observed"]), "gathered"), RULES)
    s["promoted"] = staged(lexicon.admit(lexicon.candidates(s["classified"]), RULES), "promoted")
    s["accumulated"] = lexicon.accumulate(s["classified"], s["promoted"])
    s["ranked"] = lexicon.rank_words(s["accumulated"], RULES)
    s["lexicon"] = staged(lexicon.cut(s["ranked"], RULES), "lexicon")
    return s


def model_of(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    s = lexicon_of(spark, sf_dir)
    s["lifted"] = staged(lexicon.bigram_lift(s["sources"], s["observed"], s["pairs"], s["lexicon"], LM_RULES), "lifted")
    s["bigrams"] = staged(lexicon.bigram_budget(s["lifted"], LM_RULES), "bigrams")
    s["keys"] = s["lexicon"].select(F.col("word").alias("key"), "freq")
    return s


# --- Counting

@query(f"SELECT source, word, count(*) AS cnt FROM (SELECT source, unnest(words) AS word FROM ({_lines('source', 'documents', False)})) WHERE word <> '' GROUP BY ALL")
def token_unigrams(spark, sf_dir):
    return counting.count_words(counting.tokenise(table(spark, sf_dir, "documents")))


@query(f"SELECT lang, words[i] AS \"left\", words[i + 1] AS \"right\", count(*) AS cnt FROM (SELECT lang, words, unnest(range(1, len(words))) AS i FROM ({_lines('lang', 'documents', False)})) WHERE words[i] <> '' AND words[i + 1] <> '' GROUP BY ALL HAVING count(*) >= 2")
def adjacent_bigrams(spark, sf_dir):
    return counting.count_pairs(counting.tokenise(table(spark, sf_dir, "documents"), keys=("lang",)), ("lang",), 2)


@query(f"SELECT lang, word, count(*) AS cnt FROM (SELECT lang, unnest(words) AS word FROM ({_lines('lang', 'documents', True)})) WHERE word <> '' GROUP BY ALL HAVING count(*) >= 2")
def cased_unigrams(spark, sf_dir):
    return counting.count_words(counting.tokenise(table(spark, sf_dir, "documents"), cased=True, keys=("lang",)), ("lang",), 2)


@query(f"SELECT role, words[i] AS \"left\", words[i + 1] AS \"right\", count(*) AS cnt FROM (SELECT role, words, unnest(range(1, len(words))) AS i FROM ({_lines('role', 'conversations', False, '[.!?\\n]')})) WHERE words[i] <> '' AND words[i + 1] <> '' GROUP BY ALL")
def sentence_split_bigrams(spark, sf_dir):
    return counting.count_pairs(counting.tokenise(table(spark, sf_dir, "conversations"), end=tokens.SENTENCE_END, keys=("role",)), ("role",))


@query(f"WITH {LEX} SELECT source, l AS \"left\", r AS \"right\", cnt FROM pairs")
def surviving_pairs(spark, sf_dir):
    return signals(spark, sf_dir)["pairs"]


# --- Lexicon

@query(f"WITH {LEX} SELECT word, round(rank, 9) AS rank FROM gathered WHERE in_inventory")
def inventory_merge(spark, sf_dir):
    s = signals(spark, sf_dir)
    return lexicon.merge_inventory(s["sources"], s["attested"]).select("word", F.round("rank", 9).alias("rank"))


@query(f"WITH {LEX} SELECT word, cnt AS count FROM gathered WHERE in_inventory AND cnt > 0")
def frequency_boost(spark, sf_dir):
    s = signals(spark, sf_dir)
    return lexicon.gather(s["sources"], s["attested"], s["observed"]).filter("in_inventory AND count > 0").select("word", "count")


@query(f"WITH {LEX} SELECT word, cnt AS count, d_obs AS observations, d_sources AS sources FROM cand")
def discovery_candidates(spark, sf_dir):
    return lexicon.candidates(lexicon_of(spark, sf_dir)["classified"])


@query(f"WITH {LEX} SELECT word, cnt AS count, d_obs AS observations, d_sources AS sources FROM promoted")
def admission_promoted(spark, sf_dir):
    return lexicon_of(spark, sf_dir)["promoted"]


@query(f"WITH {LEX} SELECT word, round(score, 6) AS score FROM ranked")
def lexicon_scores(spark, sf_dir):
    return lexicon_of(spark, sf_dir)["ranked"].select("word", F.round("score", 6).alias("score"))


@query(f"WITH {LEX} SELECT word, round(score, 6) AS score, freq FROM lex")
def lexicon_budget_cut(spark, sf_dir):
    return lexicon_of(spark, sf_dir)["lexicon"].select("word", F.round("score", 6).alias("score"), "freq")


@query(f"WITH {LEX} SELECT word, CAST(place AS INT) AS place FROM (SELECT word, row_number() OVER (ORDER BY score DESC, word) AS place FROM ranked) WHERE place > 100000 AND place <= 102000")
def lexicon_absent(spark, sf_dir):
    return lexicon.absent(lexicon_of(spark, sf_dir)["ranked"], RULES).select("word", "place")


@query(f"""WITH {LEX} SELECT (SELECT count(*) FROM gathered WHERE in_inventory) AS inventory_size, (SELECT count(*) FROM acc WHERE cnt > 0) AS observed_in_corpus,
(SELECT count(*) FROM acc) - (SELECT count(*) FROM ranked) AS dropped_by_filter, greatest((SELECT count(*) FROM ranked) - 100000, 0) AS dropped_by_budget, CAST(0 AS BIGINT) AS accepted_inflections,
(SELECT count(*) FROM promoted) AS promoted, (SELECT count(*) FROM cand) - (SELECT count(*) FROM promoted) AS rejected_candidates""")
def normalize_report(spark, sf_dir):
    s = lexicon_of(spark, sf_dir)
    return lexicon.report(s["classified"], s["accumulated"], s["ranked"], s["promoted"], RULES)


@query(f"""WITH {LEX}, given AS (SELECT *, count(*) OVER (PARTITION BY word) AS givers FROM (SELECT source, word FROM attested UNION ALL SELECT source, word FROM observed) WHERE word IN (SELECT word FROM lex))
SELECT s.source, count(g.word) AS in_lexicon, count(*) FILTER (givers = 1) AS unique_to_source, count(*) FILTER (g.word IN (SELECT word FROM promoted)) AS promoted FROM sources s LEFT JOIN given g USING (source) GROUP BY s.source""")
def source_contributions(spark, sf_dir):
    s = lexicon_of(spark, sf_dir)
    return lexicon.contributions(s["sources"], s["attested"], s["observed"], s["lexicon"], s["promoted"])


@query(f"WITH {LEX} SELECT l AS \"left\", r AS \"right\", round(lift, 6) AS lift, cnt FROM lifted")
def bigram_lift(spark, sf_dir):
    return model_of(spark, sf_dir)["lifted"].withColumn("lift", F.round("lift", 6))


@query(f"WITH {LEX} SELECT l AS \"left\", r AS \"right\", CAST(weight AS INT) AS weight FROM bi")
def bigram_budget(spark, sf_dir):
    return model_of(spark, sf_dir)["bigrams"]


@query(f"""WITH {LEX} SELECT count(*) AS observed, count(*) FILTER (p.l NOT IN (SELECT word FROM lex) OR p.r NOT IN (SELECT word FROM lex)) AS dropped_outside_lexicon,
count(*) FILTER (p.l IN (SELECT word FROM lex) AND p.r IN (SELECT word FROM lex) AND p.cnt * t.total::DOUBLE <= a.cnt::DOUBLE * b.cnt) AS dropped_without_lift
FROM pairs p JOIN totals t USING (source) JOIN observed a ON a.source = p.source AND a.word = p.l JOIN observed b ON b.source = p.source AND b.word = p.r WHERE p.cnt >= 3""")
def bigram_report(spark, sf_dir):
    s = lexicon_of(spark, sf_dir)
    return lexicon.bigram_report(s["pairs"], s["observed"], s["lexicon"], LM_RULES)


# --- Packs from recipes: texts by language and the benchmark's words, as files that a recipe names.

_LANGUAGES = {"en": "lang0", "de": "lang1", "fr": "lang2", "es": "lang3"}
_FILED = f"""documents AS (SELECT CASE lang {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _LANGUAGES.items())} ELSE 'lang5' END AS source, text FROM main.documents),
{LEX}""".replace("cnt / (SELECT max(cnt) FROM inv) AS rank", "0.5 AS rank")
_RECIPE = """[pack]
language = "all"
pack_version = 3
[build.lexicon]
max_words = 100000
minimum_word_length = 2
[build.lexicon.admission]
minimum_count = 20
minimum_sources = 3
[build.language_model]
minimum_count = 3
"""


def _recipe_files(spark: SparkSession, sf_dir: str, home: str) -> None:
    docs = table(spark, sf_dir, "documents")
    names = F.create_map(*[F.lit(x) for kv in _LANGUAGES.items() for x in kv])
    lines = docs.select(F.coalesce(F.try_element_at(names, F.col("lang")), F.lit("lang5")).alias("source"), F.explode(F.split(F.translate("text", "\t\r", "  "), "\n")).alias("line"))
    lines.select("source", F.concat(F.lit("0\t-\t"), "line").alias("value")).write.partitionBy("source").text(f"{home}/files")
    counting.count_words(counting.tokenise(table(spark, sf_dir, "benchmark"), cased=True, keys=()), keys=()).select(F.concat_ws("\t", "word", "cnt").alias("value")).write.text(f"{home}/files/benchmark")
    tables.write_text(spark, f"{home}/all/recipe.toml", _RECIPE)
    tables.write_text(spark, f"{home}/all/sources/00.toml", f'[[sources]]\nname = "benchmark"\nformat = "word_list"\nrole = "inventory"\npath = "{home}/files/benchmark"\n')


def _add_source(spark: SparkSession, home: str, name: str) -> None:
    role, weight = ("discovery", 0.5) if int(name[-1]) % 2 else ("frequency", 1.0)
    tables.write_text(spark, f"{home}/all/sources/{name}.toml", f'[[sources]]\nname = "{name}"\nformat = "sentences"\nrole = "{role}"\nweight = {weight}\nrequired = false\nminimum_count = {MINIMUM_COUNT}\npath = "{home}/files/source={name}"\n')


@query(f"""WITH {_FILED} SELECT 'lexicon' AS section, word AS key, NULL AS other, CAST(freq AS INT) AS value FROM lex UNION ALL SELECT 'bigram', l, r, CAST(weight AS INT) FROM bi""")
def recipe_pack(spark, sf_dir):
    """Built without one source, then with it: the second build reads that source only."""
    home = f"{checkpoint_folder(spark)}/recipe-{uuid.uuid4().hex}"
    _recipe_files(spark, sf_dir, home)
    for name in sorted({*_LANGUAGES.values(), "lang5"} - {"lang1"}):
        _add_source(spark, home, name)
    build.build(spark, f"{home}/all", f"{home}/out")
    _add_source(spark, home, "lang1")
    again = build.build(spark, f"{home}/all", f"{home}/out")
    if set(again.counted) - {"lang1"}:
        raise AssertionError(f"sources that did not change were read again: {again.counted}")
    pack = tables.read_pack(spark, f"{home}/out/packs/all")
    lex = pack["lexicon"].select(F.lit("lexicon").alias("section"), "key", F.lit(None).cast("string").alias("other"), F.col("freq").alias("value"))
    return lex if "bigram" not in pack else lex.unionByName(pack["bigram"].select(F.lit("bigram").alias("section"), F.col("left").alias("key"), F.col("right").alias("other"), F.col("weight").alias("value")))


# --- Look-ups

_NEXT = """nxt AS (SELECT l, r, coalesce(freq, 0) + f.weight AS score FROM fol f LEFT JOIN lex ON lex.word = f.r),
top3 AS (SELECT l, r, score, row_number() OVER (PARTITION BY l ORDER BY score DESC, r) AS place FROM nxt)"""


@query(f"WITH {LEX}, {_NEXT} SELECT l AS \"left\", r AS \"right\", CAST(score AS BIGINT) AS score, CAST(place AS INT) AS place FROM top3 WHERE place <= 3")
def next_word_prediction(spark, sf_dir):
    s = model_of(spark, sf_dir)
    return search.predict_next(s["bigrams"].select("left").distinct(), s["bigrams"], s["keys"]).select("left", "right", F.col("score").cast("bigint").alias("score"), "place")


@query(f"WITH {LEX} SELECT l AS \"left\", r AS \"right\", CAST(weight AS INT) AS weight FROM fol")
def context_weights(spark, sf_dir):
    return search.followers(model_of(spark, sf_dir)["bigrams"]).drop("place")


@query(f"WITH {LEX}, p AS (SELECT word, freq, substr(word, 1, k) AS q FROM (SELECT word, freq, unnest(range(1, length(word) + 1)) AS k FROM lex)) SELECT q AS query, word AS key, freq, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY freq DESC, word) AS place FROM p) WHERE place <= 3")
def prefix_completion(spark, sf_dir):
    keys = lexicon_of(spark, sf_dir)["lexicon"].select(F.col("word").alias("key"), "freq")
    return search.complete(keys.select(F.explode(search.prefixes(F.col("key"))).alias("query")).distinct(), keys)


@query(f"WITH {LEX}, w AS (SELECT DISTINCT word FROM observed) SELECT w.word AS key, coalesce(lex.freq, 0) AS freq FROM w LEFT JOIN lex USING (word)")
def exact_lookup(spark, sf_dir):
    s = lexicon_of(spark, sf_dir)
    return search.lookup(s["observed"].select(F.col("word").alias("key")).distinct(), s["lexicon"].select(F.col("word").alias("key"), "freq"))


def _typed(s: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Every observed word as typed, and the whole lexicon."""
    return s["observed"].select(F.col("word").alias("query")).distinct(), s["lexicon"].select(F.col("word").alias("key"), "freq")


# Optimal string alignment over bytes. Where Damerau and Levenshtein's distance is one, so is the alignment's; pairs at two
# are aligned row by row over pairs of hex digits, a row's chain of insertions being a running minimum.
_OSA = """typed AS MATERIALIZED (SELECT DISTINCT word AS query, CASE WHEN length(word) < 2 THEN 0 WHEN length(word) < 10 THEN 1 ELSE 2 END AS most FROM observed),
close AS MATERIALIZED (SELECT query, word AS key, freq, damerau_levenshtein(query, word) AS d, most FROM typed JOIN lex ON query <> word AND abs(strlen(query) - strlen(word)) <= most WHERE most > 0 AND damerau_levenshtein(query, word) <= most),
step(query, key, a, b, i, now, older) AS (
  SELECT query, key, hex(query), hex(key), CAST(0 AS BIGINT), range(0, strlen(key) + 1), range(0, strlen(key) + 1) FROM close WHERE d = 2
  UNION ALL
  SELECT query, key, a, b, i, list_transform(range(1, len(now) + 1), lambda j: j + list_min(list_transform(range(1, j + 1), lambda l: fresh[l] - l))), now FROM (
    SELECT query, key, a, b, i + 1 AS i, now, list_transform(range(0, len(now)), lambda j: CASE WHEN j = 0 THEN i + 1 ELSE least(now[j + 1] + 1, now[j] + CASE WHEN substr(a, 2 * i + 1, 2) = substr(b, 2 * j - 1, 2) THEN 0 ELSE 1 END,
      CASE WHEN i > 0 AND j > 1 AND substr(a, 2 * i + 1, 2) = substr(b, 2 * j - 3, 2) AND substr(a, 2 * i - 1, 2) = substr(b, 2 * j - 1, 2) THEN older[j - 1] + 1 ELSE 99 END) END) AS fresh
    FROM step WHERE i < strlen(query))),
fixes AS MATERIALIZED (SELECT query, key, freq, CAST(100 * d AS INT) AS cost FROM close WHERE d = 1
  UNION ALL SELECT c.query, c.key, c.freq, 200 FROM close c JOIN step s ON s.query = c.query AND s.key = c.key AND s.i = strlen(c.query) WHERE s.now[-1] <= 2)"""


@query(f"WITH RECURSIVE {LEX}, {_OSA} SELECT query, key, freq, cost FROM fixes")
def osa_corrections(spark, sf_dir):
    typed, keys = _typed(lexicon_of(spark, sf_dir))
    return search.corrections(typed, keys)


@query(f"""WITH RECURSIVE {LEX}, {_OSA} SELECT query, correction, score FROM (SELECT query, key AS correction, CAST(freq AS BIGINT) - cost * {scores.EDIT_PENALTY} // 100 AS score,
row_number() OVER (PARTITION BY query ORDER BY CAST(freq AS BIGINT) - cost * {scores.EDIT_PENALTY} // 100 DESC, key DESC) AS place FROM fixes WHERE query NOT IN (SELECT word FROM lex)) WHERE place = 1 AND score > {scores.AUTOCORRECT_MARGIN}""")
def autocorrect(spark, sf_dir):
    typed, keys = _typed(lexicon_of(spark, sf_dir))
    return search.autocorrect(typed, keys, id_column="query").select("query", "correction", F.col("score").cast("bigint").alias("score"))


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of conversations in order: (user_id, seq, previous, word)."""
    words = F.posexplode(F.filter(F.split("text", tokens.WHITE_SPACE), lambda c: c != ""))
    said = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("user_id"), "turn", words.alias("at", "chunk"))
    said = said.select("user_id", (F.col("turn").cast("bigint") * 1_000_000 + F.col("at")).alias("seq"), tokens.word_of(F.col("chunk")).alias("word"))
    return counting.with_previous(said, ["user_id"], F.col("seq")).filter("word <> ''")


@query()
def suggestions(spark, sf_dir):
    """What half-typed words of conversations may become: lexicon, context, the speaker's own words and their touches."""
    s = model_of(spark, sf_dir)
    said = staged(_said(spark, sf_dir), "said")
    half = F.left("word", F.ceil(F.char_length("word") / 2 + 1).cast("int"))
    asked = said.filter(F.char_length("word") >= 4).select("user_id", F.nullif("previous", F.lit("")).alias("previous"), half.alias("query")).distinct()
    asked = asked.withColumn("query_id", F.xxhash64("user_id", "previous", "query"))
    near = F.create_map(*[F.lit(x) for rows in layouts.ROWS["qwerty"] for a, b in zip(rows, rows[1:]) for x in (a, b)])
    touch_of = lambda c: F.filter(F.array(F.struct(c.alias("base"), F.lit(0.7).alias("p")), F.struct(F.try_element_at(near, F.lower(c)).alias("base"), F.lit(0.25).alias("p"))), lambda k: k["base"].isNotNull())
    asked = asked.withColumn("touches", F.transform(F.filter(F.split("query", ""), lambda c: c != ""), touch_of))
    own = staged(personal.weights(personal.uses(said)), "own")
    affixes = spark.createDataFrame([("ing",), ("ed",), ("er",), ("th",)], "affix string")
    return suggest.suggest(asked, s["keys"], s["bigrams"], own, affixes)


# --- A user's own words; users and words are those of events

_USES = """ev AS (SELECT user_id, event_type AS word, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS tick FROM events),
us AS (SELECT user_id, word, count(*) AS cnt, max(tick) AS last_used FROM ev WHERE word IS NOT NULL GROUP BY ALL),
uw AS (SELECT *, max(last_used) OVER (PARTITION BY user_id) AS clock FROM us)"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("word"), F.col("event_id").alias("seq"), "ts", "value")


@query(f"WITH {_USES} SELECT user_id, word, cnt AS count, CAST(last_used AS INT) AS last_used, CAST(clock AS INT) AS clock, cnt * 6553 + CASE WHEN clock - last_used < 10 THEN 16383 ELSE 0 END AS weight, cnt >= 2 AS learned FROM uw")
def personal_weights(spark, sf_dir):
    return personal.weights(personal.uses(_events(spark, sf_dir)))


@query("SELECT user_id, item, last, CAST(place AS INT) AS place FROM (SELECT user_id, item, last, row_number() OVER (PARTITION BY user_id ORDER BY last DESC, item) AS place FROM (SELECT user_id, event_type AS item, max(event_id) AS last FROM events GROUP BY ALL)) WHERE place <= 24")
def recent_items(spark, sf_dir):
    return personal.recent(_events(spark, sf_dir))


@query(f"WITH {_USES} SELECT u.user_id, u.words, i.items FROM (SELECT user_id, count(*) AS words FROM us GROUP BY 1) u JOIN (SELECT user_id, least(count(DISTINCT event_type), 24) AS items FROM events GROUP BY 1) i USING (user_id)")
def learning_summary(spark, sf_dir):
    ev = _events(spark, sf_dir)
    return personal.summary(personal.uses(ev), personal.recent(ev))


@query("""WITH p AS (SELECT user_id, event_id AS seq, event_type AS key, epoch_us(ts) // 1000 AS ms FROM events),
s AS (SELECT *, CASE WHEN lag(key) OVER w = key AND ms - lag(ms) OVER w <= 3600000 THEN 0 ELSE 1 END AS st FROM p WINDOW w AS (PARTITION BY user_id ORDER BY seq)),
r AS (SELECT *, CAST(sum(st) OVER (PARTITION BY user_id ORDER BY seq) AS BIGINT) AS run FROM s)
SELECT user_id, seq, key, ms, run, CAST(row_number() OVER (PARTITION BY user_id, run ORDER BY seq) AS INT) AS tap FROM r""")
def multitap_sessions(spark, sf_dir):
    presses = _events(spark, sf_dir).select("user_id", "seq", F.col("word").alias("key"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return personal.multitap_sessions(presses, within=3_600_000)


@query("""WITH m AS (SELECT user_id AS session, event_id AS seq, value AS x FROM events WHERE value IS NOT NULL),
r AS (SELECT *, CAST(trunc((x - first_value(x) OVER (PARTITION BY session ORDER BY seq)) / 5.0) AS BIGINT) AS reached FROM m)
SELECT session, seq, reached, reached - coalesce(lag(reached) OVER (PARTITION BY session ORDER BY seq), 0) AS emitted FROM r""")
def cursor_drag(spark, sf_dir):
    moves = _events(spark, sf_dir).filter("value IS NOT NULL").select(F.col("user_id").alias("session"), "seq", F.col("value").alias("x"))
    return personal.drag_steps(moves).drop("x")


# --- Keys and touches; touches are events' values folded into the unit square

_KEYS = "k0(layout, \"row\", idx, base, width) AS (VALUES " + ", ".join(f"('{n}', {r}, {i}, '{c}', 0.1::DOUBLE)" for n, own in layouts.ROWS.items() for r, keys in enumerate(own) for i, c in enumerate(keys)) + """),
keys AS (SELECT layout, "row", idx, base, (1 - sum(width) OVER (PARTITION BY layout, "row")) / 2 + coalesce(sum(width) OVER (PARTITION BY layout, "row" ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x,
  "row"::DOUBLE / (max("row") OVER (PARTITION BY layout) + 1) AS y, width AS w, 1.0::DOUBLE / (max("row") OVER (PARTITION BY layout) + 1) AS h FROM k0)"""
_TOUCH = "t AS (SELECT event_id AS touch_id, (event_id * 7919 % 1200) / 1000.0::DOUBLE - 0.1 AS tx, (event_id * 104729 % 1297) / 997.0::DOUBLE - 0.15 AS ty FROM events)"
# Off the keyboard the nearest row counts, and in a row the key with the nearest centre.
_HIT = """hits AS (SELECT touch_id, tx, ty, base, row_number() OVER (PARTITION BY touch_id ORDER BY CASE WHEN tx >= x AND tx < x + w THEN -1 ELSE abs(x + w / 2 - tx) END, idx) AS n
  FROM t JOIN keys ON layout = 'qwerty' AND "row" = (SELECT coalesce(max(CASE WHEN y <= ty THEN "row" END), 0) FROM (SELECT DISTINCT "row", y FROM keys WHERE layout = 'qwerty')))"""


def _keys(spark: SparkSession) -> DataFrame:
    return touch.bounds(layouts.key_rows(spark))


def _touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(e.alias("touch_id"), (e * 7919 % 1200 / 1000.0 - 0.1).alias("tx"), (e * 104729 % 1297 / 997.0 - 0.15).alias("ty"))


@query(f"WITH {_KEYS} SELECT layout, \"row\", idx, base, round(x, 6) AS x, round(y, 6) AS y, w, round(h, 6) AS h FROM keys")
def key_bounds(spark, sf_dir):
    return _keys(spark).select("layout", "row", "idx", "base", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "w", F.round("h", 6).alias("h"))


@query(f"WITH {_KEYS}, {_TOUCH}, {_HIT} SELECT touch_id, base FROM hits WHERE n = 1")
def hit_test(spark, sf_dir):
    return touch.hit(_touches(spark, sf_dir), _keys(spark).filter("layout = 'qwerty'")).select("touch_id", "base")


@query(f"""WITH {_KEYS}, {_TOUCH}, {_HIT}, g AS (SELECT t.touch_id, k."row", k.idx, k.base, k.base = hits.base AS pressed, exp(-(pow((t.tx - (x + w / 2)) / w, 2) + pow((t.ty - (y + h / 2)) / h, 2)) / 0.5) AS g
  FROM t JOIN hits ON hits.touch_id = t.touch_id AND n = 1 CROSS JOIN keys k WHERE k.layout = 'qwerty' AND regexp_matches(k.base, '^\\p{{L}}') = regexp_matches(hits.base, '^\\p{{L}}')),
p AS (SELECT *, g / sum(g) OVER (PARTITION BY touch_id) AS p FROM g),
o AS (SELECT *, row_number() OVER (PARTITION BY touch_id ORDER BY pressed DESC, p DESC, base) AS place FROM p WHERE pressed OR p >= 0.02)
SELECT touch_id, base, round(p, 4) AS p, CAST(place AS INT) AS place FROM o WHERE place <= 4""")
def touch_signal(spark, sf_dir):
    return touch.likelihoods(_touches(spark, sf_dir), _keys(spark).filter("layout = 'qwerty'")).select("touch_id", "base", F.round("p", 4).alias("p"), "place")


@query(f"""WITH {_KEYS} SELECT a.layout, a.base, b.base AS near FROM keys a JOIN keys b ON a.layout = b.layout AND a.base <> b.base
AND pow((a.x + a.w / 2 - b.x - b.w / 2) / 0.12, 2) + pow((a.y + a.h / 2 - b.y - b.h / 2) / 0.27, 2) <= 1""")
def key_adjacency(spark, sf_dir):
    return touch.neighbours(_keys(spark)).drop("d2")


# --- Annotations: parts' names are words, their brands texts

_ANN = """w AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, CAST(p_size % 3 + 1 AS INT) AS grp, p_brand || '/' || p_size % 7 AS text FROM part),
known AS (SELECT word FROM w GROUP BY word HAVING count(*) >= 2),
once AS (SELECT word, text, min(grp) AS grp FROM w WHERE word IN (SELECT word FROM known) GROUP BY ALL),
merged AS (SELECT * FROM (SELECT word, grp, text, CAST(row_number() OVER (PARTITION BY word, grp ORDER BY text) AS INT) AS place FROM once) WHERE place <= 3)"""


def _part_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"), (F.col("p_size") % 3 + 1).cast("int").alias("grp"), F.concat("p_brand", F.lit("/"), F.col("p_size") % 7).alias("text"))


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _part_words(spark, sf_dir)
    return annotations.merge(w, w.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2"))


@query(f"WITH {_ANN} SELECT * FROM merged")
def annotation_topk(spark, sf_dir):
    return _merged(spark, sf_dir)


@query(f"WITH {_ANN} SELECT prefix, word, text, place FROM (SELECT prefix, word, text, CAST(row_number() OVER (PARTITION BY prefix ORDER BY word, text) AS INT) AS place FROM (SELECT prefix, text, min(word) AS word FROM (SELECT DISTINCT substr(word, 1, 1) AS prefix FROM merged) JOIN merged ON starts_with(word, prefix) GROUP BY ALL)) WHERE place <= 128")
def annotation_search(spark, sf_dir):
    m = _merged(spark, sf_dir)
    return annotations.search(m.select(F.left("word", F.lit(1)).alias("prefix")).distinct(), m)


@query("""SELECT category, CAST(display AS INT) AS display, text, CAST(row_number() OVER (PARTITION BY category ORDER BY ord, text) AS INT) AS place FROM
(SELECT p_type AS category, p_brand AS text, min(p_partkey) AS ord FROM part GROUP BY ALL) JOIN (SELECT category, row_number() OVER (ORDER BY category DESC) AS display FROM (SELECT DISTINCT p_type AS category FROM part)) USING (category)""")
def catalog_order(spark, sf_dir):
    from pyspark.sql import Window

    p = table(spark, sf_dir, "part")
    shown = p.select(F.col("p_type").alias("category")).distinct().withColumn("display", F.row_number().over(Window.orderBy(F.desc("category"))))
    return annotations.catalogue(p.select(F.col("p_type").alias("category"), F.col("p_brand").alias("text"), F.col("p_partkey").alias("ord")), shown)


@query(f"""WITH {_ANN}, first AS (SELECT prefix, text, min(word) AS word FROM (SELECT DISTINCT substr(word, 1, 2) AS prefix FROM merged) JOIN merged ON starts_with(word, prefix) GROUP BY ALL),
pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY word, text) AS n FROM first) WHERE n <= 384),
disp AS (SELECT grp, row_number() OVER (ORDER BY grp DESC) AS display FROM (SELECT DISTINCT grp FROM merged))
SELECT * FROM (SELECT prefix AS query, CAST(display AS INT) AS section, grp, text, CAST(row_number() OVER (PARTITION BY prefix, grp ORDER BY n) AS INT) AS place FROM pool JOIN merged USING (word, text) JOIN disp USING (grp)) WHERE place <= 128""")
def annotation_panel(spark, sf_dir):
    from pyspark.sql import Window

    m = _merged(spark, sf_dir)
    groups = m.select("grp").distinct().withColumn("display", F.row_number().over(Window.orderBy(F.desc("grp"))))
    return annotations.panel(m.select(F.left("word", F.lit(2)).alias("query")), m, groups)


@query("""SELECT CAST(n_regionkey AS BIGINT) AS user_id, 0 AS section, CAST(NULL AS VARCHAR) AS grp, n_name AS text, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey DESC) AS INT) AS place FROM nation
UNION ALL SELECT NULL, CAST(display AS INT), category, text, CAST(row_number() OVER (PARTITION BY category ORDER BY ord, text) AS INT) FROM
(SELECT p_type AS category, p_brand AS text, min(p_partkey) AS ord FROM part GROUP BY ALL) JOIN (SELECT category, row_number() OVER (ORDER BY category DESC) AS display FROM (SELECT DISTINCT p_type AS category FROM part)) USING (category)""")
def resting_panel(spark, sf_dir):
    chosen = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("bigint").alias("user_id"), F.col("n_name").alias("word"), F.col("n_nationkey").alias("seq"))
    return annotations.resting_panel(personal.recent(chosen), catalog_order(spark, sf_dir))


# --- Conversion: readings are the words of parts' names, spellings carry the type

_DICT = """d0 AS (SELECT unnest(string_split(p_name, ' ')) AS reading, upper(p_brand) AS surface, CAST(p_size % 4 AS INT) AS left_id, CAST(p_size % 3 AS INT) AS right_id, CAST(100 * p_size + p_partkey % 97 AS INT) AS cost FROM part),
dict AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY reading, surface ORDER BY cost, left_id, right_id) AS n FROM d0) WHERE n = 1)"""


def _dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.explode(F.split("p_name", " ")).alias("reading"), F.upper("p_brand").alias("surface"), (F.col("p_size") % 4).cast("int").alias("left_id"), (F.col("p_size") % 3).cast("int").alias("right_id"),
        (100 * F.col("p_size") + F.col("p_partkey") % 97).cast("int").alias("cost"), (F.col("p_size") % 11 == 0).alias("dependent"),
    )


@query(f"WITH {_DICT} SELECT reading, surface, CAST(cost AS BIGINT) AS cost, CAST(row_number() OVER (PARTITION BY reading ORDER BY cost, strlen(surface), surface) AS INT) AS place FROM dict")
def conversion_candidates(spark, sf_dir):
    d = conversion.deduplicate(_dictionary(spark, sf_dir))
    return conversion.candidates(d.select("reading").distinct(), d)


@query(f"WITH {_DICT}, least AS (SELECT reading, min(cost) AS cost FROM dict GROUP BY 1) SELECT * FROM (SELECT prefix, reading, cost, CAST(row_number() OVER (PARTITION BY prefix ORDER BY cost, reading) AS INT) AS place FROM (SELECT DISTINCT substr(reading, 1, 1) AS prefix FROM least) JOIN least ON starts_with(reading, prefix)) WHERE place <= 6")
def conversion_completions(spark, sf_dir):
    d = conversion.deduplicate(_dictionary(spark, sf_dir))
    return conversion.completions(d.select(F.left("reading", F.lit(1)).alias("prefix")).distinct(), d)


@query("""SELECT a AS previous_right, b AS next_left, CAST(CASE WHEN a < 40 AND b < 40 THEN CASE WHEN (a * 7 + b) % 5 = 0 THEN 0 ELSE (a * 31 + b * 17) % 900 - 300 END ELSE 500 END AS INT) AS cost
FROM (SELECT DISTINCT CAST(p_size AS INT) AS a FROM part) CROSS JOIN (SELECT DISTINCT CAST(p_size AS INT) AS b FROM part)""")
def connection_costs(spark, sf_dir):
    ids = table(spark, sf_dir, "part").select(F.col("p_size").cast("int").alias("a")).distinct()
    cells = spark.range(1600).select((F.col("id") / 40).cast("int").alias("row"), (F.col("id") % 40).cast("int").alias("col"))
    cells = cells.filter((F.col("row") * 7 + F.col("col")) % 5 != 0).withColumn("cost", ((F.col("row") * 31 + F.col("col") * 17) % 900 - 300).cast("int"))
    # Fifty ids by fifty: the pairs asked for.
    pairs = ids.select(F.col("a").alias("previous_right")).crossJoin(F.broadcast(ids.select(F.col("a").alias("next_left"))))
    return conversion.connection_cost(pairs, cells, 40, 40)


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sentence_id"), F.replace("p_name", F.lit(" "), F.lit("")).alias("reading"))


def _cells(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r, c, (r * 31 + c * 17) % 900 - 300) for r in range(3) for c in range(4) if r + c], "row int, col int, cost int")


@query()
def lattice_conversion(spark, sf_dir):
    return conversion.convert(_sentences(spark, sf_dir), _dictionary(spark, sf_dir), _cells(spark), (3, 4))


@query(f"""WITH {_DICT}, s AS (SELECT p_partkey AS sentence_id, replace(p_name, ' ', '') AS reading FROM part),
shapes AS (SELECT DISTINCT substr(reading, 1, 2) AS head, length(reading) AS n FROM dict),
cut AS (SELECT sentence_id, reading, unnest(range(1, length(reading) + 1)) AS i FROM s)
SELECT sentence_id, CAST(i - 1 AS INT) AS start, CAST(n AS INT) AS length, substr(reading, i, n) AS reading FROM cut JOIN shapes ON substr(reading, i, least(n, 2)) = head AND i + n - 1 <= length(reading)""")
def lattice_spans(spark, sf_dir):
    return conversion.spans_of(_sentences(spark, sf_dir), _dictionary(spark, sf_dir)).drop("key")


@query()
def conversion_measures(spark, sf_dir):
    """Names without their spaces, converted; expected is the part's own brand for each word, whatever is cheaper."""
    d = staged(conversion.deduplicate(_dictionary(spark, sf_dir)), "entries")
    own = F.repeat(F.upper("p_brand"), F.size(F.split("p_name", " ")))
    cases = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sentence_id"), own.alias("expected"))
    segments = staged(conversion.convert(_sentences(spark, sf_dir), d, _cells(spark), (3, 4)), "segments")
    got = segments.groupBy("sentence_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment", "surface"))), lambda x: x.surface), "").alias("got"))
    measured = evaluation.conversions(cases.join(got, "sentence_id", "left"))
    reached = evaluation.reachable(cases, segments, conversion.segment_candidates(segments, d))
    one = lambda df, c: df.select(F.lit(c).alias("measure"), F.round(c, 6).alias("value"))
    return one(measured, "sentences").unionByName(one(measured, "characters")).unionByName(one(reached, "reachable"))


# --- Measures: words typed with two letters swapped

_AUTO = f"""auto AS (SELECT query, key AS correction FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY CAST(freq AS BIGINT) - cost * {scores.EDIT_PENALTY} // 100 DESC, key DESC) AS place, CAST(freq AS BIGINT) - cost * {scores.EDIT_PENALTY} // 100 AS score
  FROM fixes WHERE query NOT IN (SELECT word FROM lex)) WHERE place = 1 AND score > {scores.AUTOCORRECT_MARGIN})"""
_CASES = f"""cases AS (SELECT word AS intended, substr(word, 1, 1) || substr(word, 3, 1) || substr(word, 2, 1) || substr(word, 4) AS query FROM lex WHERE length(word) >= 3 AND substr(word, 2, 1) <> substr(word, 3, 1)),
{_OSA.replace("length(word)", "length(query)").replace("DISTINCT word AS query", "DISTINCT query").replace("FROM observed", "FROM cases")}, {_AUTO},
done AS (SELECT query, key, freq, 0 AS cost FROM (SELECT query, word AS key, freq, row_number() OVER (PARTITION BY query ORDER BY freq DESC, word) AS n FROM typed JOIN lex ON starts_with(word, query)) WHERE n <= {search.POOL}),
every AS (SELECT query, key, freq, min(cost) AS cost FROM (SELECT * FROM done UNION ALL SELECT * FROM fixes) GROUP BY ALL),
shown AS (SELECT query, key, row_number() OVER (PARTITION BY query ORDER BY CAST(freq AS BIGINT) - cost * {scores.EDIT_PENALTY} // 100 DESC, key) AS place FROM every)"""


@query(f"""WITH RECURSIVE {LEX}, {_CASES} SELECT count(*) AS cases, round(avg(CASE WHEN place = 1 THEN 1.0 ELSE 0 END), 6) AS top1, round(avg(CASE WHEN place <= 3 THEN 1.0 ELSE 0 END), 6) AS top3,
round(avg(coalesce(1.0::DOUBLE / place, 0)), 6) AS mrr, round(avg(CASE WHEN correction = intended THEN 1.0 ELSE 0 END), 6) AS autocorrect
FROM cases LEFT JOIN (SELECT * FROM shown WHERE place <= {search.POOL}) s ON s.query = cases.query AND s.key = intended LEFT JOIN auto ON auto.query = cases.query""")
def mrr_report(spark, sf_dir):
    _, keys = _typed(s := lexicon_of(spark, sf_dir))
    w = F.col("word")
    part = lambda i: F.substring(w, F.lit(i), F.lit(1))
    cases = s["lexicon"].filter((F.char_length(w) >= 3) & (part(2) != part(3))).select(w.alias("intended"), F.concat(part(1), part(3), part(2), F.substring(w, F.lit(4), F.char_length(w))).alias("query"))
    cases = staged(cases.withColumn("query_id", F.concat_ws("/", "query", "intended")), "cases")
    found = search.search(cases, keys).filter("key = intended").select("query_id", "place")
    fixed = search.autocorrect(cases, keys).select("query_id", "correction")
    ranked = cases.join(found, "query_id", "left").join(fixed, "query_id", "left").withColumn("corrected", F.col("correction") == F.col("intended"))
    return evaluation.corrections(ranked).select("cases", *[F.round(c, 6).alias(c) for c in ("top1", "top3", "mrr", "autocorrect")])


@query(f"""WITH {LEX}, pre AS (SELECT word, freq, k, substr(word, 1, k) AS prefix FROM (SELECT word, freq, unnest(range(1, length(word) + 1)) AS k FROM lex)),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY freq DESC, word) AS place FROM pre) WHERE place <= 3),
hit AS (SELECT word, min(k) AS k FROM top WHERE k < length(word) GROUP BY word)
SELECT count(*) AS words, round(avg(1 - coalesce(k + 1, length(word) + 1) / (length(word) + 1)), 6) AS savings FROM lex LEFT JOIN hit USING (word)""")
def keystroke_savings(spark, sf_dir):
    keys = lexicon_of(spark, sf_dir)["lexicon"].select(F.col("word").alias("key"), "freq")
    asked = keys.select(F.explode(search.prefixes(F.col("key"))).alias("query")).distinct()
    shown = search.complete(asked, keys).select(F.col("query").alias("prefix"), F.col("key").alias("word"))
    return evaluation.keystroke_savings(shown, keys.select(F.col("key").alias("word"))).select("words", F.round("savings", 6).alias("savings"))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.99), 6) AS p99, round(max(value), 6) AS longest FROM events GROUP BY 1")
def latency_percentiles(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return evaluation.latencies(e, "event_type", "value").select("event_type", *[F.round(c, 6).alias(c) for c in ("p50", "p99", "longest")])


@query()
def synthetic_slips(spark, sf_dir):
    words = lexicon_of(spark, sf_dir)["lexicon"].select("word")
    near = touch.neighbours(_keys(spark).filter("layout = 'qwerty'")).select("base", "near")
    return evaluation.synthesise(words, near)


# --- Closures, digests, keys, policy

@query("""WITH RECURSIVE e AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 1),
r(root, node) AS (SELECT p_partkey, p_partkey FROM part WHERE p_size = 7 UNION SELECT r.root, e.dst FROM r JOIN e ON e.src = r.node) SELECT root, node FROM r""")
def dependency_closure(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    edges = p.filter("p_partkey > 1").select(F.col("p_partkey").alias("src"), F.expr("p_partkey div 2").alias("dst"))
    return licences.closure(edges, p.filter("p_size = 7").select(F.col("p_partkey").alias("root")))


@query("SELECT page_id, sha256(html) AS digest, CAST(strlen(html) AS INT) AS bytes FROM pages")
def source_hash(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2("html", 256).alias("digest"), F.octet_length("html").alias("bytes"))


_TYPED_ROWS = "(SELECT conv_id, turn, text FROM conversations)"


@query(f"""SELECT conv_id, turn, coalesce(regexp_matches(text, '^[ \t]*$|\n[ \t]*$') OR regexp_matches(text, '[.!?…。？][ \t]+$'), true) AS sentence_start,
coalesce(NOT regexp_matches(text, '[\\p{{L}}\\p{{N}}]$'), true) AS word_start FROM {_TYPED_ROWS}""")
def sentence_starts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", typing.sentence_start(F.col("text")).alias("sentence_start"), typing.word_start(F.col("text")).alias("word_start"))


_CASED = "list_distinct(list_filter(regexp_split_to_array(text, '[^A-Za-z]+'), lambda x: x <> ''))"


@query(f"""SELECT word, count(*) AS docs, CASE WHEN regexp_full_match(word, '[a-z]+') THEN 'lower' WHEN regexp_full_match(word, '[A-Z][a-z]*') THEN 'initial' WHEN regexp_full_match(word, '[A-Z]+') THEN 'upper' ELSE 'mixed' END AS casing, lower(word) AS folded
FROM (SELECT unnest({_CASED}) AS word FROM documents) GROUP BY word""")
def folded_words(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(F.split("text", "[^A-Za-z]+"))).alias("word")).filter("word <> ''")
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("docs"))
    return counted.select("word", "docs", typing.casing(F.col("word")).alias("casing"), typing.fold(F.col("word")).alias("folded"))


def _syllables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A syllable for each part: fixed by its key."""
    code = F.lpad(F.hex(F.lit(0xAC00) + F.col("p_partkey") * 37 % 11172), 4, "0")
    return table(spark, sf_dir, "part").select("p_partkey", F.decode(F.unhex(code), "UTF-16BE").alias("word"))


@query("SELECT p_partkey, chr(CAST(44032 + p_partkey * 37 % 11172 AS INT)) AS word, (p_partkey * 37 % 11172) % 28 <> 0 AS has_final FROM part")
def final_consonants(spark, sf_dir):
    return _syllables(spark, sf_dir).withColumn("has_final", hangul.final_consonant(F.col("word")))


@query("SELECT p_partkey, chr(CAST(44032 + p_partkey * 37 % 11172 AS INT)) AS word, chr(CAST(44032 + p_partkey * 37 % 11172 AS INT)) AS back FROM part")
def jamo_round_trip(spark, sf_dir):
    return _syllables(spark, sf_dir).withColumn("back", hangul.decode(hangul.encode(F.col("word"))))


@query("SELECT event_id, CAST(greatest(1, least(65535, ((1 + CAST(round(greatest(0, least(1, value / hi)) * 65534) AS BIGINT) + 128) // 256) * 256)) AS INT) AS freq FROM (SELECT event_id, value, max(value) OVER () AS hi FROM events) WHERE value IS NOT NULL")
def quantised_scores(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("value IS NOT NULL")
    return e.crossJoin(F.broadcast(e.agg(F.max("value").alias("hi")))).select("event_id", scores.quantise(F.col("value"), F.col("hi")).alias("freq"))


@query(f"WITH {LEX} SELECT DISTINCT word, prefix FROM (SELECT word, substr(word, 1, k) AS prefix FROM (SELECT word, unnest(range(1, length(word))) AS k FROM (SELECT DISTINCT word FROM observed))) WHERE prefix IN (SELECT word FROM lex)")
def learned_prefixes(spark, sf_dir):
    s = lexicon_of(spark, sf_dir)
    return search.learned_prefixes(s["observed"].select("word").distinct(), s["lexicon"].select("word")).select("word", "prefix").distinct()


@query(f"""WITH {LEX}, af(affix) AS (VALUES ('ing'), ('ed'), ('er'), ('th')),
q AS (SELECT query, substr(query, 1, k) AS stem, substr(query, k + 1) AS tail FROM (SELECT query, unnest(range(1, length(query))) AS k FROM (SELECT DISTINCT word AS query FROM observed))),
c AS (SELECT q.query, q.stem || af.affix AS key, max(lex.freq) AS score FROM q JOIN lex ON lex.word = q.stem JOIN af ON starts_with(af.affix, q.tail) WHERE q.stem || af.affix NOT IN (SELECT word FROM lex) GROUP BY ALL)
SELECT query, key, score, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS place FROM c) WHERE place <= 3""")
def affix_combinations(spark, sf_dir):
    s = lexicon_of(spark, sf_dir)
    asked = s["observed"].select(F.col("word").alias("query")).distinct()
    affixes = spark.createDataFrame([("ing",), ("ed",), ("er",), ("th",)], "affix string")
    return search.affix_combinations(asked, s["lexicon"].select("word", F.col("freq").alias("weight")), affixes, s["lexicon"].select(F.col("word").alias("key")))


@query(f"""WITH {LEX}, c AS (SELECT fol.l AS previous, lex.word AS key, lex.freq + fol.weight AS score FROM fol JOIN lex ON lex.word = fol.r)
SELECT previous, key, CAST(score AS BIGINT) AS score, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY previous ORDER BY score DESC, key) AS place FROM c) WHERE place <= 3""")
def rerank_context(spark, sf_dir):
    """Each context's own candidates: what may follow it."""
    s = model_of(spark, sf_dir)
    near = search.followers(s["bigrams"]).select(F.col("left").alias("previous"), F.col("right").alias("key"))
    cands = near.join(s["keys"], "key").withColumn("cost", F.lit(0))
    return search.rerank(cands, None, s["bigrams"], id_column="previous").select("previous", "key", F.col("score").cast("bigint").alias("score"), "place")


@query(f"""WITH {_DICT}, r AS (SELECT reading, surface, 0 AS step, row_number() OVER (PARTITION BY reading ORDER BY cost, strlen(surface), surface) AS n FROM dict UNION ALL SELECT DISTINCT reading, reading, 1, 1 FROM dict),
o AS (SELECT reading, surface, min([step, n]) AS first FROM r GROUP BY ALL)
SELECT * FROM (SELECT reading, surface, CAST(row_number() OVER (PARTITION BY reading ORDER BY first, surface) AS INT) AS place FROM o) WHERE place <= 9""")
def segment_candidates(spark, sf_dir):
    d = conversion.deduplicate(_dictionary(spark, sf_dir))
    return conversion.segment_candidates(d.select("reading"), d)


_CHOICES = "ch AS (SELECT CAST(p_size AS BIGINT) AS user_id, split_part(p_name, ' ', 1) AS reading, upper(p_brand) AS surface, p_partkey AS seq FROM part)"


def _choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen spellings: a part's size is the user, its name's first word the reading, its brand the spelling."""
    return table(spark, sf_dir, "part").select(F.col("p_size").cast("bigint").alias("user_id"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("reading"), F.upper("p_brand").alias("surface"), F.col("p_partkey").alias("seq"))


@query(f"WITH {_CHOICES} SELECT user_id, reading, surface, count(*) AS uses FROM ch GROUP BY ALL")
def conversion_learning(spark, sf_dir):
    return personal.conversion_uses(_choices(spark, sf_dir))


@query(f"""WITH {_DICT}, {_CHOICES}, u AS (SELECT reading, surface, count(*) AS uses FROM ch WHERE user_id = 7 GROUP BY ALL), d AS (SELECT reading, surface, cost - 400 * coalesce(uses, 0) AS cost FROM dict LEFT JOIN u USING (reading, surface))
SELECT reading, surface, CAST(cost AS BIGINT) AS cost, CAST(row_number() OVER (PARTITION BY reading ORDER BY cost, strlen(surface), surface) AS INT) AS place FROM d""")
def conversion_candidates_learnt(spark, sf_dir):
    """Candidates for one user, number 7, whose choices are cheaper."""
    d = conversion.deduplicate(_dictionary(spark, sf_dir))
    own = personal.conversion_uses(_choices(spark, sf_dir)).filter("user_id = 7")
    return conversion.candidates(d.select("reading").distinct(), d, own)


@query("SELECT CAST(n_regionkey AS BIGINT) AS user_id, n_name AS language, n_nationkey AS place, coalesce(lead(n_name) OVER w, first_value(n_name) OVER w) AS following FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey)")
def language_rotation(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("bigint").alias("user_id"), F.col("n_name").alias("language"), F.col("n_nationkey").alias("place"))
    return personal.rotation(n)


@query("SELECT p_brand AS name, arg_min(v, n) AS value FROM (SELECT p_brand, CASE WHEN p_size % 3 = n THEN p_type END AS v, n FROM (SELECT p_brand, p_type, p_size FROM part WHERE p_partkey IN (SELECT min(p_partkey) FROM part GROUP BY p_brand)), (VALUES (0), (1), (2)) t(n)) WHERE v IS NOT NULL GROUP BY p_brand")
def first_non_null(spark, sf_dir):
    """Of three tables in order the first that has a value for the name."""
    p = table(spark, sf_dir, "part")
    one = p.groupBy("p_brand").agg(F.min_by(F.struct("p_type", "p_size"), "p_partkey").alias("x")).select(F.col("p_brand").alias("name"), "x.*")
    return lexicon.first_of([one.select("name", F.when(F.col("p_size") % 3 == n, F.col("p_type")).alias("value")) for n in range(3)], "name", "value")


# --- Sources and sinks: pages' texts, parts' names as phrases, packs, catalogues, snapshots

_HTML = r"regexp_replace(html, '<(script|style)\b.*?</(script|style)>|<!--.*?-->', ' ', 'gis')"
_ENTITIES = "replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&amp;', '&')"
_TEXT = "trim(regexp_replace(" + _ENTITIES.format(x=f"regexp_replace({_HTML}, '<[^>]*>', ' ', 'g')") + r", '[ \t\r\n]+', ' ', 'g'))"


@query(f"SELECT page_id, {_TEXT} AS text FROM pages")
def page_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", markup.html_text(F.col("html")).alias("text"))


def _phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a word list: parts' names as phrases, with counts."""
    phrase = F.replace("p_name", F.lit(" "), F.lit("^"))
    return table(spark, sf_dir, "part").select(F.concat_ws("\t", phrase, F.col("p_size") % 5 + 1).alias("line"))


@query("SELECT word, CAST(sum(n) AS BIGINT) AS cnt FROM (SELECT p_size % 5 + 1 AS n, unnest(string_split(p_name, ' ')) AS word FROM part) WHERE word <> '' GROUP BY word")
def word_list_counts(spark, sf_dir):
    return words.word_list(_phrases(spark, sf_dir), 0.5)["observed"]


@query("SELECT DISTINCT word, 0.5::DOUBLE AS rank FROM (SELECT unnest(list_append(string_split(p_name, ' '), replace(p_name, ' ', ''))) AS word FROM part) WHERE word <> ''")
def word_list_spellings(spark, sf_dir):
    return words.word_list(_phrases(spark, sf_dir), 0.5)["attested"]


@query(f"WITH {LEX} SELECT 'lexicon' AS section, count(*) AS row_count FROM lex UNION ALL SELECT 'bigram', count(*) FROM bi")
def pack_manifest(spark, sf_dir):
    s = model_of(spark, sf_dir)
    folder = f"{checkpoint_folder(spark)}/pack-{uuid.uuid4().hex}"
    return tables.write_pack(spark, {"lexicon": s["keys"], "bigram": s["bigrams"]}, folder, {"language": "all"}).select("section", "row_count")


@query("SELECT s_suppkey AS name, s_acctbal AS value, 'old' AS version FROM supplier WHERE s_suppkey % 3 <> 0 UNION ALL SELECT s_suppkey, s_acctbal + 1, 'new' FROM supplier WHERE s_suppkey % 3 = 0")
def catalogue_upsert(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("name"), F.col("s_acctbal").alias("value"))
    return tables.upsert(s.withColumn("version", F.lit("old")), s.filter("name % 3 = 0").select("name", (F.col("value") + 1).alias("value"), F.lit("new").alias("version")))


@query("""SELECT name, state, version, CASE WHEN state = 'not installed' THEN archive END AS size, newer FROM (SELECT n_name AS name, n_nationkey * 10 AS archive,
CASE WHEN n_nationkey % 3 = 0 THEN 'installed' WHEN n_nationkey % 3 = 1 AND (n_nationkey % 5 = 4 OR n_nationkey % 7 <= n_regionkey) THEN 'bundled' WHEN n_nationkey % 5 <> 4 THEN 'not installed' ELSE 'unavailable' END AS state,
CAST(CASE WHEN n_nationkey % 3 = 0 OR n_nationkey % 3 = 1 AND (n_nationkey % 5 = 4 OR n_nationkey % 7 <= n_regionkey) THEN n_regionkey END AS INT) AS version,
n_nationkey % 3 = 0 AND n_nationkey % 5 <> 4 AND n_nationkey % 7 > n_regionkey AS newer FROM nation)""")
def pack_states(spark, sf_dir):
    """Nations as languages: some installed, some bundled, four in five in the catalogue."""
    n = table(spark, sf_dir, "nation").withColumn("name", F.col("n_name")).withColumn("packVersion", F.col("n_regionkey").cast("int"))
    key = F.col("n_nationkey")
    offered = n.filter(key % 5 != 4).select("name", (key % 7).cast("int").alias("packVersion"), (key * 10).cast("bigint").alias("archiveSize"))
    return tables.pack_states(n, n.filter(key % 3 == 0), n.filter(key % 3 == 1), offered)


@query("SELECT r_name AS pack, string_agg(n_name || ' ' || n_nationkey || ' free > ' || r_name, chr(10) ORDER BY n_name) AS notice FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def notice_documents(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return tables.notices(n.select(F.col("r_name").alias("pack"), F.col("n_name").alias("source"), F.col("n_nationkey").cast("string").alias("version"), F.lit("free").alias("license"), F.col("r_name").alias("attribution")))


@query(f"WITH {_USES} SELECT user_id, word, cnt AS count, CAST(last_used AS INT) AS last_used, CAST(clock AS INT) AS clock FROM uw")
def snapshot_round_trip(spark, sf_dir):
    return tables.restore_snapshot(tables.snapshot_lines(personal.uses(_events(spark, sf_dir))))


# --- Streams over events' files


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A pattern, since a stream's plain path must be a folder and the table may be one file.
    given = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("maxFilesPerTrigger", 16).parquet(f"{sf_dir}/events.parque[t]")
    return given.select("user_id", F.col("event_id").alias("seq"), F.col("event_type").alias("word"), F.lit(learning.RECORD).alias("change"), F.col("ts").cast("timestamp").alias("ts"))


def _streamed(spark: SparkSession, df: DataFrame, mode: str) -> DataFrame:
    folder = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    learning.run_available(df, f"{folder}/rows", f"{folder}/state", mode)
    return spark.read.parquet(f"{folder}/rows")


@query(f"WITH {_USES} SELECT user_id, word, cnt AS count, CAST(last_used AS INT) AS last_used, CAST(clock AS INT) AS clock, cnt * 6553 + CASE WHEN clock - last_used < 10 THEN 16383 ELSE 0 END AS weight, cnt >= 2 AS learned FROM uw")
def stream_learning(spark, sf_dir):
    rows = _streamed(spark, learning.learned(_event_stream(spark, sf_dir)), "update")
    latest = rows.groupBy("user_id").agg(F.max("batch").alias("batch"))
    return rows.join(latest, ["user_id", "batch"], "left_semi").select("user_id", "word", "count", "last_used", "clock", "weight", "learned")


@query(f"WITH {_USES} SELECT user_id, word, cnt AS count, CAST(last_used AS INT) AS last_used, CAST(clock AS INT) AS clock, cnt * 6553 + CASE WHEN clock - last_used < 10 THEN 16383 ELSE 0 END AS weight, cnt >= 2 AS learned FROM uw")
def stream_changes(spark, sf_dir):
    return changes.current(_streamed(spark, changes.learned_changes(_event_stream(spark, sf_dir)), "update"))


@query("""WITH p AS (SELECT user_id, event_id AS seq, event_type AS key, epoch_us(ts) // 1000 AS ms FROM events),
s AS (SELECT *, CASE WHEN lag(key) OVER w = key AND ms - lag(ms) OVER w <= 3600000 THEN 0 ELSE 1 END AS st FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ms, seq)),
r AS (SELECT *, CAST(sum(st) OVER (PARTITION BY user_id ORDER BY ms, seq) AS BIGINT) AS run FROM s),
g AS (SELECT user_id, run, key, count(*) AS taps, min(ms) AS first_ms, max(ms) AS last_ms FROM r GROUP BY ALL)
SELECT * FROM g WHERE run < (SELECT max(run) FROM g o WHERE o.user_id = g.user_id) OR last_ms + 3600000 < (SELECT max(ms) FROM p)""")
def stream_tap_runs(spark, sf_dir):
    """The runs that have ended by the last event's time."""
    presses = _event_stream(spark, sf_dir).select("user_id", F.col("word").alias("key"), F.unix_millis("ts").alias("ms"), "seq")
    return _streamed(spark, taps.tap_runs(presses, "0 seconds", within=3_600_000), "append").drop("batch", "part")


@query("SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) // 1000000 AS start, event_type AS word, count(*) AS events FROM events GROUP BY ALL")
def stream_windowed_counts(spark, sf_dir):
    rows = _streamed(spark, learning.windowed_counts(_event_stream(spark, sf_dir)), "update")
    latest = rows.groupBy("start", "word").agg(F.max_by("events", "batch").alias("events"))
    return latest.select(F.unix_seconds("start").alias("start"), "word", "events")


# --- Scripts and keys

_KANA = "(SELECT p_partkey, chr(CAST(12353 + p_partkey * 7 % 86 AS INT)) AS h, chr(CAST(12449 + p_partkey * 7 % 86 AS INT)) AS k FROM part)"


def _kana(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hiragana and its katakana for each part: fixed by its key."""
    at = lambda base: F.decode(F.unhex(F.lpad(F.hex(F.lit(base) + F.col("p_partkey") * 7 % 86), 4, "0")), "UTF-16BE")
    return table(spark, sf_dir, "part").select("p_partkey", at(0x3041).alias("h"), at(0x30A1).alias("k"))


@query(f"""WITH ring(r) AS (SELECT unnest(string_split('あぁ いぃ うぅゔ えぇ おぉ やゃ ゆゅ よょ わゎ つっづ かが きぎ くぐ けげ こご さざ しじ すず せぜ そぞ ただ ちぢ てで とど はばぱ ひびぴ ふぶぷ へべぺ ほぼぽ', ' '))),
step AS (SELECT substr(r, i, 1) AS h, substr(r, i % length(r) + 1, 1) AS following FROM (SELECT r, unnest(range(1, length(r) + 1)) AS i FROM ring))
SELECT p_partkey, h || h AS key, k AS shown, following FROM {_KANA} LEFT JOIN step USING (h)""")
def kana_forms(spark, sf_dir):
    """One script for keys, katakana for showing, and the next form."""
    c = _kana(spark, sf_dir)
    return c.select("p_partkey", encoding.encode(F.concat("h", "k"), "kana").alias("key"), kana.to_katakana(F.col("h")).alias("shown"), kana.next_form(F.col("h")).alias("following"))


_ROMAJI = "'k', 'g', 's', 'z', 't', 'd', 'n', 'h', 'b', 'p', 'm', 'r'"


@query(f"""WITH t AS (SELECT p_partkey, p_partkey % 12 AS c, p_partkey // 12 % 5 AS v, p_partkey // 60 % 3 AS form FROM part),
u AS (SELECT *, substr('かきくけこがぎぐげごさしすせそざじずぜぞたちつてとだぢづでどなにぬねのはひふへほばびぶべぼぱぴぷぺぽまみむめもらりるれろ', c * 5 + v + 1, 1) AS one FROM t)
SELECT p_partkey, CASE form WHEN 0 THEN one WHEN 1 THEN CASE WHEN c = 6 THEN 'ん' || substr('あいうえお', v + 1, 1) ELSE 'っ' || one END ELSE one || 'ん' END AS kana FROM u""")
def romaji_typed(spark, sf_dir):
    """A syllable for each part, as it is, after a doubled consonant (a doubled n stands for itself and leaves the vowel), or before an n at the end."""
    p = F.col("p_partkey")
    consonant = F.get(F.expr(f"array({_ROMAJI})"), (p % 12).cast("int"))
    one = F.concat(consonant, F.substring(F.lit("aiueo"), (F.expr("p_partkey div 12") % 5 + 1).cast("int"), F.lit(1)))
    form = F.expr("p_partkey div 60") % 3
    typed = F.when(form == 0, one).when(form == 1, F.concat(consonant, one)).otherwise(F.concat(one, F.lit("n")))
    return table(spark, sf_dir, "part").select("p_partkey", kana.romaji_to_kana(typed).alias("kana"))


@query("""SELECT word, regexp_full_match(word, '[a-z'']*') AS latin, regexp_full_match(word, '[가-힣]*') AS hangul, regexp_full_match(word, '[ぁ-ゖァ-ヶーゝゞ]*') AS kana
FROM (SELECT DISTINCT word FROM (SELECT unnest(words) AS word FROM (""" + _lines("source", "documents", False) + """)) WHERE word <> ''
UNION SELECT chr(CAST(44032 + p_partkey * 37 % 11172 AS INT)) FROM part UNION SELECT chr(CAST(12449 + p_partkey * 7 % 86 AS INT)) FROM part)""")
def character_sets(spark, sf_dir):
    """Which character sets take the words of documents, and the parts' syllables and kana."""
    seen = counting.tokenise(table(spark, sf_dir, "documents"), keys=()).select(F.explode("words").alias("word")).filter("word <> ''")
    every = seen.unionByName(_syllables(spark, sf_dir).select("word")).unionByName(_kana(spark, sf_dir).select(F.col("k").alias("word"))).distinct()
    held = {"latin": "latin-lowercase", "hangul": "hangul-syllables", "kana": "kana"}
    return every.select("word", *[tokens.accepts(F.col("word"), s).alias(n) for n, s in held.items()])


@query("""SELECT c, count(*) AS n, CASE WHEN c <> 'ß' AND length(upper(c)) = 1 THEN upper(c) ELSE c END AS capital, CASE WHEN strlen(lower(replace(c, '’', ''''))) = 1 THEN lower(replace(c, '’', '''')) END AS key
FROM (SELECT unnest(regexp_extract_all(text, '(?s).')) AS c FROM documents) GROUP BY c""")
def key_characters(spark, sf_dir):
    """Every character of documents: how often, its capital, and its key of one byte. The capital of ß has two characters, so it stays; DuckDB makes it ẞ."""
    seen = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("((?s).)"), F.lit(1))).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    return seen.select("c", "n", typing.upper_one(F.col("c")).alias("capital"), encoding.key_byte(F.col("c"), "utf8").alias("key"))


@query("""WITH t AS (SELECT conv_id, turn, substr(text, 1, 1 + CAST((conv_id * 7 + turn * 3) % 40 AS INT)) AS before FROM conversations)
SELECT conv_id, turn, before, CASE WHEN regexp_matches(before, '[\\p{L}\\p{N})\\]}”’]$') THEN '”' ELSE '“' END AS double, CASE WHEN regexp_matches(before, '[\\p{L}\\p{N})\\]}”’]$') THEN '’' ELSE '‘' END AS single,
regexp_matches(before || '-', '(^|[^-])-$') AS dash, CASE WHEN regexp_matches(before || ' ', '[\\p{L}\\p{N}] $') THEN before || '. ' END AS stopped FROM t""")
def smart_punctuation(spark, sf_dir):
    """What a quote, a second hyphen and a second space make after the beginning of each turn."""
    cut = F.substring("text", F.lit(1), (1 + (F.col("conv_id") * 7 + F.col("turn") * 3) % 40).cast("int"))
    t, b = table(spark, sf_dir, "conversations").select("conv_id", "turn", cut.alias("before")), F.col("before")
    quotes = [typing.smart_quote(F.lit(q), b).alias(n) for q, n in (('"', "double"), ("'", "single"))]
    return t.select("conv_id", "turn", "before", *quotes, typing.em_dash(F.lit("-"), F.concat(b, F.lit("-"))).alias("dash"), typing.double_space_period(F.concat(b, F.lit(" "))).alias("stopped"))


@query("""SELECT n_nationkey, coalesce(CASE WHEN n_nationkey % 3 = 0 THEN n_name END, CASE WHEN n_regionkey % 2 = 0 THEN r_name END, 'none') AS value,
n_nationkey % 3 = 0 AND n_regionkey % 2 = 0 AND n_nationkey % 5 <> 0 AS assisted FROM nation JOIN region ON n_regionkey = r_regionkey""")
def layered_settings(spark, sf_dir):
    """Nations as languages and regions as what they share: a setting's value, and whether all three gates are open."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    own, common = F.col("n_nationkey") % 3 == 0, F.col("n_regionkey") % 2 == 0
    return n.select("n_nationkey", typing.layered(F.when(own, F.col("n_name")), F.when(common, F.col("r_name")), F.lit("none")).alias("value"), typing.assistance(own, common, F.col("n_nationkey") % 5 != 0).alias("assisted"))


@query("SELECT source, word, count(*) AS cnt FROM (SELECT source, unnest(regexp_split_to_array(text, '\\s+')) AS word FROM documents) WHERE word <> '' GROUP BY ALL")
def tokenised_counts(spark, sf_dir):
    return counting.count_words(counting.tokenised(table(spark, sf_dir, "documents")))


# --- Particles, inflections, affixes

_PARTICLES = ", ".join(f"('{a}', '{b}')" for a, b in hangul.PARTICLES)
_NOUNS = "nouns AS (SELECT DISTINCT chr(CAST(44032 + p_partkey * 37 % 11172 AS INT)) || chr(CAST(44032 + p_partkey * 41 % 11172 AS INT)) AS word, p_size AS cost, (p_partkey * 41 % 11172) % 28 <> 0 AS ends FROM part)"


@query(f"""WITH particle(c, v) AS (VALUES {_PARTICLES}), {_NOUNS}, best AS (SELECT * FROM nouns ORDER BY cost, word LIMIT 1000)
SELECT word, CAST(min(cost) AS INT) AS cost FROM (SELECT word || CASE WHEN ends THEN c ELSE v END AS word, cost + 200 AS cost FROM best, particle) WHERE word NOT IN (SELECT word FROM nouns) GROUP BY word
UNION ALL SELECT word || s, NULL FROM best, (VALUES ('하'), ('되')) t(s)""")
def particle_expansion(spark, sf_dir):
    """The thousand cheapest of two-syllable nouns with their particles, at a cost, and as verb stems, at none."""
    at = lambda by: F.decode(F.unhex(F.lpad(F.hex(F.lit(0xAC00) + F.col("p_partkey") * by % 11172), 4, "0")), "UTF-16BE")
    nouns = table(spark, sf_dir, "part").select(F.concat(at(37), at(41)).alias("word"), F.col("p_size").alias("cost"))
    best = hangul.commonest(nouns, 1000)
    return hangul.expand_particles(best, nouns).unionByName(hangul.derived_stems(best).withColumn("cost", F.lit(None).cast("int")))


@query(f"WITH {LEX} SELECT word, cnt AS count FROM gathered WHERE NOT in_inventory AND cnt > 0 AND EXISTS (SELECT 1 FROM (SELECT unnest(list_transform(range(1, length(word)), lambda k: substr(word, 1, k))) AS p) WHERE p IN (SELECT word FROM inv))")
def inflections_accepted(spark, sf_dir):
    """Words that the inventory lacks but goes on to: its words serve as stems."""
    s = signals(spark, sf_dir)
    rules = dataclasses.replace(RULES, accept_inflections=True)
    gathered = staged(lexicon.gather(s["sources"], s["attested"], s["observed"]), "gathered")
    return lexicon.classify(gathered, rules, s["attested"].select(F.col("word").alias("stem"))).filter("accepted").select("word", "count")


@query(f"WITH {LEX} SELECT word, cnt AS count, d_obs AS observations, d_sources AS sources FROM cand WHERE d_obs >= 20 AND d_sources >= 3 AND length(word) >= 2 AND word NOT IN (SELECT DISTINCT lower(substr(p_name, 1, 2)) FROM part UNION VALUES ('ing'), ('ed'), ('er'), ('th')) ORDER BY d_obs DESC, word LIMIT 10000")
def admission_without_affixes(spark, sf_dir):
    """Candidates admitted, but for affixes: the parts' first two letters and four more."""
    s = lexicon_of(spark, sf_dir)
    affixes = table(spark, sf_dir, "part").select(F.lower(F.substring("p_name", 1, 2)).alias("affix"))
    affixes = affixes.unionByName(spark.createDataFrame([("ing",), ("ed",), ("er",), ("th",)], "affix string")).distinct()
    return lexicon.admit(lexicon.candidates(s["classified"]), RULES, affixes)


@query(f"WITH {LEX}, every AS (SELECT word, sum(cnt * weight) AS cnt FROM observed JOIN sources USING (source) WHERE role <> 'inventory' GROUP BY word) SELECT word, round(ln(1 + cnt), 6) AS score FROM every WHERE length(word) >= 2")
def lexicon_without_inventory(spark, sf_dir):
    """Where no source vouches for words, every counted one enters."""
    s = signals(spark, sf_dir)
    classified = lexicon.classify(staged(lexicon.gather(s["sources"], s["attested"].limit(0), s["observed"]), "gathered"), RULES)
    ranked = lexicon.rank_words(lexicon.accumulate(classified, lexicon.admit(lexicon.candidates(classified), RULES)), RULES)
    return ranked.select("word", F.round("score", 6).alias("score"))


# --- Measures, catalogues, look-ups

@query(f"WITH RECURSIVE {LEX}, {_OSA}, {_AUTO} SELECT count(*) AS words, avg(CASE WHEN correction IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0 END) AS false_rate FROM (SELECT query FROM typed) t LEFT JOIN auto USING (query)")
def false_corrections(spark, sf_dir):
    """The share of words as their writers meant them, known or not, that autocorrect would change."""
    typed, keys = _typed(lexicon_of(spark, sf_dir))
    typed = staged(typed, "typed")
    fixed = search.autocorrect(typed, keys, id_column="query").select("query", "correction")
    return evaluation.false_corrections(typed.join(fixed, "query", "left").select(F.col("query").alias("word"), F.coalesce("correction", "query").alias("committed")))


@query("WITH f AS (SELECT p_type AS text, min(p_name || '/' || p_partkey) AS first FROM part GROUP BY p_type), t AS (SELECT text, CAST(row_number() OVER (ORDER BY first) - 1 AS INT) AS idx FROM f) SELECT p_name || '/' || p_partkey AS package, idx FROM part JOIN t ON text = p_type")
def licence_catalogue(spark, sf_dir):
    """Parts as packages and their types as licence texts."""
    packages = table(spark, sf_dir, "part").select(F.concat_ws("/", "p_name", "p_partkey").alias("package"), F.col("p_type").alias("text"))
    return licences.catalogue(packages)[1]


@query(f"WITH {_ANN} SELECT s_name AS query, word, grp, text, place FROM (SELECT DISTINCT p_brand AS s_name FROM part UNION SELECT DISTINCT word FROM merged) q JOIN merged ON merged.word = q.s_name")
def annotation_lookup(spark, sf_dir):
    merged = staged(_merged(spark, sf_dir), "merged")
    asked = table(spark, sf_dir, "part").select(F.col("p_brand").alias("query")).unionByName(merged.select(F.col("word").alias("query"))).distinct()
    return annotations.lookup(asked, merged).withColumn("word", F.col("query"))


@query(f"""WITH {_DICT}, least AS (SELECT reading, min(cost) AS cost FROM dict GROUP BY 1), best AS (SELECT reading, surface FROM (SELECT *, row_number() OVER (PARTITION BY reading ORDER BY cost, strlen(surface), surface) AS n FROM dict) WHERE n = 1)
SELECT prefix, reading, surface, place FROM (SELECT prefix, reading, CAST(row_number() OVER (PARTITION BY prefix ORDER BY cost, reading) AS INT) AS place FROM (SELECT DISTINCT substr(reading, 1, 1) AS prefix FROM least) JOIN least ON starts_with(reading, prefix)) JOIN best USING (reading) WHERE place <= 6""")
def conversion_predictions(spark, sf_dir):
    entries = _dictionary(spark, sf_dir)
    return conversion.predictions(entries.select(F.substring("reading", 1, 1).alias("prefix")).distinct(), entries)


@query("""WITH t AS (SELECT user_id, event_id, event_type AS query FROM events), own AS (SELECT CAST(c_custkey AS BIGINT) AS user_id, k, c_name AS expansion FROM customer, (VALUES ('click'), ('view')) v(k) WHERE c_custkey % 2 = 0)
SELECT t.user_id, event_id, query, coalesce(expansion, CASE WHEN query IN ('click', 'error') THEN upper(query) END, query) AS text FROM t LEFT JOIN own ON own.user_id = t.user_id AND k = query""")
def shortcuts_committed(spark, sf_dir):
    """Event types as typed: a user's shortcut comes before the correction, and that before what was typed."""
    typed = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("query"))
    own = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").cast("bigint").alias("user_id"), F.explode(F.array(F.lit("click"), F.lit("view"))).alias("shortcut"), F.col("c_name").alias("expansion"))
    corrected = spark.createDataFrame([("click", "CLICK"), ("error", "ERROR")], "query string, key string")
    return search.committed(typed, corrected, own)


@query("""WITH RECURSIVE f AS (SELECT p_brand AS package, 'f' || p_size % 8 AS feature, CASE p_partkey % 4 WHEN 0 THEN 'dep:' || p_name WHEN 1 THEN 'f' || (p_partkey // 4) % 8 WHEN 2 THEN p_type || '/x' ELSE p_type || '?/x' END AS entry FROM part),
r(package, feature) AS (SELECT DISTINCT p_brand, 'f0' FROM part UNION SELECT r.package, f.entry FROM r JOIN f USING (package, feature) WHERE NOT starts_with(f.entry, 'dep:') AND NOT contains(f.entry, '/'))
SELECT DISTINCT package, CASE WHEN starts_with(entry, 'dep:') THEN substr(entry, 5) ELSE split_part(entry, '/', 1) END AS dependency FROM f JOIN r USING (package, feature) WHERE starts_with(entry, 'dep:') OR (contains(entry, '/') AND NOT contains(entry, '?/'))""")
def feature_dependencies(spark, sf_dir):
    """Brands as packages, whose parts are entries of eight features; the first is enabled."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey") % 4
    goes_on = F.concat(F.lit("f"), F.expr("p_partkey div 4") % 8)
    entry = F.when(k == 0, F.concat(F.lit("dep:"), "p_name")).when(k == 1, goes_on).when(k == 2, F.concat("p_type", F.lit("/x"))).otherwise(F.concat("p_type", F.lit("?/x")))
    features = p.select(F.col("p_brand").alias("package"), F.concat(F.lit("f"), F.col("p_size") % 8).alias("feature"), entry.alias("entry"))
    return licences.enabled_dependencies(features, p.select(F.col("p_brand").alias("package"), F.lit("f0").alias("feature")).distinct())
