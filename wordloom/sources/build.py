"""A language's pack from its recipe; what did not change since an earlier build is read from the store, not made again.

The store is a graph of Parquet tables named by what they were made from. Digests of sources are kept by their files'
names, sizes and times of change, so an unchanged source is not even opened. A source's signals have its digest, format
and settings as name. Over them stands a binary tree of summable partial aggregates by word (`gather`'s sums): a leaf is
one source with its role and weight, a node the sum of two, named by its children. A changed source is counted anew, and
with it only the nodes on its way to the root, as many as the logarithm of the number of sources.

From the root follow the recipe's rules: admission, scores, budget, word pairs, and the pack with its sections, audit
tables, catalogue row and notice.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import encoding
from ..operators import annotations, lexicon
from ..session import staged
from . import archives, recipes, tables

SUMS = "word string, inventories bigint, rank double, count double, d_count double, d_observations bigint, d_sources bigint"
CATALOGUE_FORMAT = 1
#: Sources that are read at a time.
SIDE_BY_SIDE = 8


@dataclass(frozen=True)
class Built:
    """counted: sources whose files were read; merged: nodes made; kept: tables taken from the store."""

    manifest: DataFrame
    report: DataFrame
    counted: tuple[str, ...]
    merged: int
    kept: int


def _key(*parts) -> str:
    return hashlib.sha256(json.dumps([*parts, tables.PARSER_VERSION], sort_keys=True).encode()).hexdigest()[:32]


class Store:
    """Tables by name; one counts as there when its last file, _SUCCESS, is."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.made: list[str] = []
        self.kept: list[str] = []

    def table(self, name: str, schema: str, make) -> DataFrame:
        """make() gives a DataFrame; null where there is nothing to keep."""
        path = f"{self.folder}/{name}"
        if tables.exists(self.spark, f"{path}/_SUCCESS"):
            self.kept.append(name)
        else:
            make().write.mode("overwrite").parquet(path)
            self.made.append(name)
        return self.spark.read.schema(schema).parquet(path)

    def digest(self, path: str) -> str:
        """The digest of a source's files, from the store where names, sizes and times are as they were."""
        stamp = _key(tables.stamps(self.spark, path))
        rows = self.table(f"digests/{stamp}", "digest string", lambda: self.spark.createDataFrame([(archives.digest(self.spark, path),)], "digest string"))
        return rows.first()["digest"]

    def signals(self, source: recipes.Source, language: str) -> tuple[str, dict[str, DataFrame], bool] | None:
        """The name and the signals of a source, and whether they were made; None where it is missing and need not be there."""
        if not archives.found(self.spark, source.path):
            if source.required:
                raise FileNotFoundError(source.path)
            return None
        key = _key(self.digest(source.path), source.format, dict(source.settings), language)
        done = f"{self.folder}/signals/{key}/kinds"
        fresh = not tables.exists(self.spark, f"{done}/_SUCCESS")
        if fresh:
            given = recipes.FORMATS[source.format](self.spark, source.path, source.settings)
            for kind, df in given.items():
                df.select(*recipes.columns_of(kind)).write.mode("overwrite").parquet(f"{self.folder}/signals/{key}/{kind}")
            self.spark.createDataFrame([(kind,) for kind in sorted(given)], "kind string").write.mode("overwrite").parquet(done)
            self.made.append(f"signals/{key}")
        else:
            self.kept.append(f"signals/{key}")
        kinds = [r["kind"] for r in self.spark.read.schema("kind string").parquet(done).collect()]  # a few
        by_kind = {kind: self.spark.read.schema(recipes.schema_of(kind)).parquet(f"{self.folder}/signals/{key}/{kind}") for kind in kinds}
        return key, by_kind, fresh


def leaf(source: recipes.Source, signals: Mapping[str, DataFrame]) -> DataFrame | None:
    """One source's sums by word: ranks where it is an inventory, weighted counts where it is not."""
    zero, none = F.lit(0).cast("bigint"), F.lit(0.0)
    weight = F.lit(float(source.weight))
    if source.role == lexicon.INVENTORY:
        if "attested" not in signals:
            return None
        rows = signals["attested"].groupBy("word").agg(F.sum(F.col("rank") * weight).alias("rank"))
        return rows.select("word", F.lit(1).cast("bigint").alias("inventories"), "rank", none.alias("count"), none.alias("d_count"), zero.alias("d_observations"), zero.alias("d_sources"))
    if "observed" not in signals:
        return None
    found = F.lit(source.role == lexicon.DISCOVERY)
    weighted = F.col("cnt") * weight
    return signals["observed"].select("word", zero.alias("inventories"), none.alias("rank"), weighted.alias("count"), F.when(found, weighted).otherwise(0.0).alias("d_count"), F.when(found, F.col("cnt")).otherwise(0).cast("bigint").alias("d_observations"), F.when(found, 1).otherwise(0).cast("bigint").alias("d_sources"))


def _sum(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("word").agg(*[F.sum(c).alias(c) for c in a.columns if c != "word"])


def merge(store: Store, leaves: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """The root of the tree over (name, sums): halves to the left and right, level by level."""

    def node(low: int, high: int) -> tuple[str, DataFrame]:
        if high - low == 1:
            return leaves[low]
        middle = (low + high) // 2
        (a, left), (b, right) = node(low, middle), node(middle, high)
        name = f"merged/{_key(a, b)}"
        return name, store.table(name, SUMS, lambda: _sum(left, right))

    if not leaves:
        return store.spark.createDataFrame([], SUMS)
    return node(0, len(leaves))[1]


def gathered(root: DataFrame) -> DataFrame:
    """As lexicon.gather gives it."""
    return root.select("word", (F.col("inventories") > 0).alias("in_inventory"), "rank", "count", "d_count", "d_observations", "d_sources")


def rules_of(build: Mapping) -> tuple[lexicon.Rules, lexicon.LanguageModelRules, str]:
    """Of a recipe's [build]: the lexicon's rules, the word pairs' rules, the keys' encoding. Unknown names are errors."""
    given, pairs = dict(build.get("lexicon", {})), dict(build.get("language_model", {}))
    keys = given.pop("encoding", "utf8")
    if keys not in encoding.ENCODINGS:
        raise ValueError(f"unknown encoding {keys!r}: one of {encoding.ENCODINGS}")
    admission = given.pop("admission", None)
    if "minimum_word_length" in given:
        given["minimum_length"] = given.pop("minimum_word_length")
    return lexicon.Rules(**given, admission=lexicon.Admission(**admission) if admission else None), lexicon.LanguageModelRules(**pairs), keys


def _keyed(df: DataFrame, columns: Mapping[str, str], how: str) -> DataFrame:
    """df with each word of columns as its key; rows without one go."""
    for word, key in columns.items():
        df = df.withColumn(key, encoding.encode(F.col(word), how)).filter(F.col(key).isNotNull() & (F.col(key) != ""))
    return df


def sections(signals: Mapping[str, DataFrame], words: DataFrame, pairs: DataFrame, keys: str) -> dict[str, DataFrame]:
    """words(word, freq), pairs(left, right, weight) and what sources add: annotations of words, emoji in order, readings and their connections."""
    out = {"lexicon": tables.deduplicate(_keyed(words, {"word": "key"}, keys).select("key", "freq"))}
    out["bigram"] = _keyed(pairs, {"left": "left_key", "right": "right_key"}, keys).groupBy("left_key", "right_key").agg(F.max("weight").alias("weight")).select(F.col("left_key").alias("left"), F.col("right_key").alias("right"), "weight")
    known = words.select("word").unionByName(signals["entries"].select(F.col("reading").alias("word"))).distinct()
    out["annotation"] = _keyed(annotations.merge(signals["annotations"], known), {"word": "key"}, keys).select("key", "grp", "text", "place")
    # Emoji in the order that a source of orders gives, else in that of the words that name them; other groups by their words.
    ordered = signals["emoji_order"].groupBy("category", "text").agg(F.min("place").alias("place")).select(F.lit("emoji").alias("grp"), "category", "text", "place")
    is_emoji = F.col("grp") == "emoji"
    named = signals["annotations"].groupBy("grp", "text").agg(F.min("word").alias("word")).join(F.broadcast(ordered.agg((F.count(F.lit(1)) > 0).alias("has_order"))), how="cross").filter(~(is_emoji & F.col("has_order")))
    named = named.select("grp", F.lit(None).cast("string").alias("category"), "text", F.xxhash64("word").alias("place"))
    out["catalogue"] = ordered.withColumn("place", F.col("place").cast("bigint")).unionByName(named)
    out["entries"] = signals["entries"].select("reading", "surface", "left_id", "right_id", "cost", "dependent")
    out["connection"] = signals["connection"].select("row", "col", "cost")
    return out


def build(spark: SparkSession, folder: str, output: str, store_folder: str | None = None) -> Built:
    """The pack of the language in `folder`, written to output/packs/NAME; store_folder is output/store unless given.

    Audit tables go to output/build/NAME, the catalogue to output/packs/catalogue.json and the notice to output/NOTICE."""
    output = output.rstrip("/")
    recipe = recipes.load(spark, folder)
    rules, pair_rules, keys = rules_of(recipe.build)
    language = str(recipe.pack.get("language", recipe.name))
    store = Store(spark, store_folder or f"{output}/store")
    leaves, used, counted = [], [], []
    kinds: dict[str, list[DataFrame]] = {kind: [spark.createDataFrame([], schema)] for kind, schema in recipes.SIGNALS.items()}
    # Sources do not see each other: their jobs run side by side.
    with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
        read = list(pool.map(inheritable_thread_target(spark)(lambda source: store.signals(source, language)), recipe.sources))
    for source, got in zip(recipe.sources, read):
        if got is None:
            continue
        key, signals, fresh = got
        if fresh:
            counted.append(source.name)
        used.append(source)
        for kind, df in signals.items():
            kinds[kind].append(df.select(F.lit(source.name).alias("source"), *recipes.columns_of(kind)))
        if (own := leaf(source, signals)) is not None:
            leaves.append((f"leaf/{_key(key, source.role, source.weight)}", own))
    every = {}
    for kind, dfs in kinds.items():
        every[kind] = dfs[0]
        for df in dfs[1:]:
            every[kind] = every[kind].unionByName(df)
    if not used:
        raise ValueError(f"none of the sources of {folder} is there")
    sources = spark.createDataFrame([(s.name, s.role, float(s.weight)) for s in used], "source string, role string, weight double")

    root = gathered(merge(store, leaves))
    classified = lexicon.classify(root, rules, every["stems"].select("stem") if rules.accept_inflections else None)
    affixes = every["affixes"].select("affix").distinct()
    promoted = staged(lexicon.admit(lexicon.candidates(classified), rules, affixes), "promoted")
    accumulated = lexicon.accumulate(classified, promoted)
    ranked = staged(lexicon.rank_words(accumulated, rules), "ranked")
    words = staged(lexicon.cut(ranked, rules), "words")
    lifted = lexicon.bigram_lift(sources, every["observed"], every["pairs"], words, pair_rules)
    pairs = staged(lexicon.bigram_budget(lifted, pair_rules), "word-pairs")

    report = staged(lexicon.report(classified, accumulated, ranked, promoted, rules), "report")
    given = lexicon.contributions(sources, every["attested"].select("source", "word"), every["observed"].select("source", "word"), words, promoted)
    tables.write_audit({"words": words, "absent": lexicon.absent(ranked, rules), "promoted": promoted, "sources": given, "report": report}, f"{output}/build/{recipe.name}")
    # A language has a few dozen affixes.
    metadata = {k: str(v) for k, v in recipe.pack.items() if not isinstance(v, Mapping)} | {"language": language, "encoding": keys, "affixes": "\n".join(sorted(r["affix"] for r in affixes.collect()))}
    home = f"{output}/packs/{recipe.name}"
    manifest = tables.write_pack(spark, sections(every, words, pairs, keys), home, metadata)
    entry = {"name": recipe.name, "language": language, "packVersion": int(recipe.pack.get("pack_version", 1)), "archiveSize": sum(size for _, size in archives.files(spark, home)), "archiveDigest": archives.digest(spark, home)}
    publish(spark, f"{output}/packs/catalogue.json", entry)
    lines = [(recipe.name, s.name, *(str(s.notice.get(k)) if k in s.notice else None for k in ("version", "license", "attribution"))) for s in used]
    notice = tables.notices(spark.createDataFrame(lines, "pack string, source string, version string, license string, attribution string"))
    tables.write_text(spark, f"{output}/NOTICE/{recipe.name}.txt", notice.first()["notice"] + "\n")
    merged = sum(name.startswith("merged/") for name in store.made)
    return Built(manifest, report, tuple(counted), merged, len(store.kept))


def publish(spark: SparkSession, path: str, entry: Mapping) -> None:
    """A JSON catalogue {formatVersion, packs} with the entry in place of one of its name, in order of names."""
    packs = []
    if tables.exists(spark, path):
        # One row a language.
        found = json.loads(spark.read.text(path, wholetext=True).first()["value"])
        if found["formatVersion"] > CATALOGUE_FORMAT:
            raise ValueError(f"catalogue format {found['formatVersion']}")
        packs = [p for p in found["packs"] if p["name"] != entry["name"]]
    tables.write_text(spark, path, json.dumps({"formatVersion": CATALOGUE_FORMAT, "packs": sorted([*packs, dict(entry)], key=lambda p: p["name"])}, ensure_ascii=False, indent=1))
