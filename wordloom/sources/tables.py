"""Sinks and caches: signals kept by what they were made from, packs of Parquet sections with digests, catalogues, notices, snapshots."""

from __future__ import annotations

import hashlib
import json
import logging
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import archives

PARSER_VERSION = 1
SECTIONS = ("lexicon", "bigram", "annotation", "catalogue", "entries", "connection")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark's file systems hold the path."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def stamps(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, bytes, time of change) of a path's files."""
    return archives.found(spark, path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, whole, in place of one that is there."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(hadoop, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def optional(spark: SparkSession, path: str, read: Callable[[str], DataFrame], required: bool = False) -> DataFrame | None:
    """What read gives, or None where the path is missing and need not be there."""
    if exists(spark, path):
        return read(path)
    if required:
        raise FileNotFoundError(path)
    return None


def digest(spark: SparkSession, path: str) -> str:
    """SHA-256 over a path's files by their contents, each file's ranges hashed by their own tasks."""
    return archives.digest(spark, path)


def cached(spark: SparkSession, folder: str, key: Mapping, make: Callable[[], DataFrame], fresh: bool = False) -> DataFrame:
    """make()'s rows as Parquet under a name from key (source digest, settings, language) and PARSER_VERSION; a table that is not finished, or one of whose files has no whole footer, is made again."""
    name = hashlib.sha256(json.dumps([dict(key), PARSER_VERSION], sort_keys=True).encode()).hexdigest()[:32]
    path = f"{folder.rstrip('/')}/{name}"
    if not fresh and exists(spark, f"{path}/_SUCCESS"):
        try:
            # Merging schemas reads every file's footer, in tasks.
            return spark.read.option("mergeSchema", True).parquet(path)
        except Exception as damage:  # Spark's errors of reading have no common class in Python
            logging.getLogger(__name__).warning("%s is made again: %s", path, damage)
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_audit(tables: Mapping[str, DataFrame], folder: str) -> None:
    """Each table as tab-separated text with a header: words, absent, promoted, sources."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(f"{folder}/{name}")


def write_pack(spark: SparkSession, sections: Mapping[str, DataFrame], folder: str, metadata: Mapping[str, str]) -> DataFrame:
    """Sections with rows, each a Parquet table, and a manifest (section, row_count, digest) written after them."""
    unknown = set(sections) - set(SECTIONS)
    if unknown:
        raise ValueError(f"unknown sections: {sorted(unknown)}")
    manifest = []
    for name in SECTIONS:
        if (df := sections.get(name)) is None:
            continue
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        if count := spark.read.schema(df.schema).parquet(f"{folder}/{name}").count():
            manifest.append((name, count, digest(spark, f"{folder}/{name}")))
    if not manifest:
        raise ValueError("a pack needs a section with rows")
    spark.createDataFrame(sorted(metadata.items()), "key string, value string").write.mode("overwrite").parquet(f"{folder}/metadata")
    spark.createDataFrame(manifest, "section string, row_count bigint, digest string").write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def read_pack(spark: SparkSession, folder: str, verify: bool = True) -> dict[str, DataFrame]:
    """A pack's sections; with verify each must have its manifest's digest."""
    out = {}
    for row in spark.read.parquet(f"{folder}/manifest").collect():  # six rows at most
        if verify and digest(spark, f"{folder}/{row['section']}") != row["digest"]:
            raise ValueError(f"section {row['section']} is not what the manifest says")
        out[row["section"]] = spark.read.parquet(f"{folder}/{row['section']}")
    return out


def install_pack(spark: SparkSession, archive: str, destination: str, expected: str) -> DataFrame:
    """The pack in archive, whose files' digest is to be `expected`, put in destination; returns its manifest.

    Each section is held against the pack's manifest, the sections are written beside destination, and that copy takes
    destination's name when it is whole: until then the pack that was there stays as it was."""
    if (found := digest(spark, archive)) != expected:
        raise ValueError(f"{archive} has digest {found}, not {expected}")
    sections = read_pack(spark, archive)
    metadata = {r["key"]: r["value"] for r in spark.read.parquet(f"{archive}/metadata").collect()}  # a few dozen
    destination = destination.rstrip("/")
    write_pack(spark, sections, f"{destination}.installing", metadata)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(destination).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.delete(path(f"{destination}.replaced"), True)
    if exists(spark, destination) and not files.rename(path(destination), path(f"{destination}.replaced")):
        raise OSError(f"{destination} could not be replaced")
    if not files.rename(path(f"{destination}.installing"), path(destination)):
        raise OSError(f"{destination} could not be written")
    files.delete(path(f"{destination}.replaced"), True)
    return spark.read.parquet(f"{destination}/manifest")


def deduplicate(lexicon: DataFrame) -> DataFrame:
    """(key, freq): a key's highest."""
    return lexicon.groupBy("key").agg(F.max("freq").alias("freq"))


def upsert(catalogue: DataFrame, rows: DataFrame, name: str = "name") -> DataFrame:
    """catalogue with rows in place of its rows of the same names, in order of name."""
    return catalogue.join(rows.select(name).distinct(), name, "left_anti").select(*catalogue.columns).unionByName(rows.select(*catalogue.columns)).orderBy(name)


def read_catalogue(spark: SparkSession, path: str, supported: int) -> DataFrame:
    """(name, packVersion, archiveSize) of a JSON catalogue {formatVersion, packs}; a format later than `supported` is an error."""
    schema = "formatVersion int, packs array<struct<name:string,packVersion:int,archiveSize:bigint>>"
    read = spark.read.schema(schema).option("multiLine", True).json(path)
    refused = F.raise_error(F.concat(F.lit("catalogue format "), F.coalesce(F.col("formatVersion").cast("string"), F.lit("unknown")))).cast("boolean")
    return read.filter(F.when(F.col("formatVersion") <= supported, True).otherwise(refused)).select(F.inline("packs"))


def pack_states(languages: DataFrame, installed: DataFrame, bundled: DataFrame, catalogue: DataFrame | None = None) -> DataFrame:
    """(name, state, version, size, newer) of languages(name): installed(name, packVersion), with newer where the catalogue has a later version; else bundled unless that has one; else to be loaded; else unavailable. Without a catalogue, what is nowhere may still be loaded, at an unknown size of 0."""
    known = languages.select("name").distinct().join(installed.select("name", F.col("packVersion").alias("own")), "name", "left").join(bundled.select("name", F.col("packVersion").alias("inside")), "name", "left")
    if catalogue is None:
        met = known.select("*", F.lit(0).alias("offered"), F.lit(0).cast("bigint").alias("archiveSize"), F.lit(True).alias("listed"))
    else:
        offers = catalogue.select("name", F.col("packVersion").alias("offered"), "archiveSize", F.lit(True).alias("listed"))
        met = known.join(offers, "name", "left").withColumn("offered", F.coalesce("offered", F.lit(0))).withColumn("listed", F.coalesce("listed", F.lit(False)))
    here, inside = F.col("own").isNotNull(), F.col("inside").isNotNull() & (F.col("offered") <= F.col("inside"))
    state = F.when(here, "installed").when(inside, "bundled").when(F.col("listed"), "not installed").otherwise("unavailable")
    size = F.when(state == "not installed", F.col("archiveSize"))
    return met.select("name", state.alias("state"), F.when(here, F.col("own")).when(inside, F.col("inside")).alias("version"), size.alias("size"), (here & (F.col("offered") > F.coalesce("own", F.lit(0)))).alias("newer"))


def write_snapshots(lines: DataFrame, folder: str) -> None:
    """lines(language, user_id, place, line) by language: a language's rows take the place of those there, other languages' stay."""
    lines.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("language").parquet(folder)


def read_snapshots(spark: SparkSession, folder: str, language: str) -> DataFrame:
    """One language's (user_id, place, line); empty where nothing was written."""
    schema = "user_id bigint, place int, line string, language string"
    rows = spark.read.schema(schema).parquet(folder) if exists(spark, folder) else spark.createDataFrame([], schema)
    return rows.filter(F.col("language") == language).drop("language")


def notices(sources: DataFrame) -> DataFrame:
    """sources(pack, source, version, license, attribution): (pack, notice), one line for each source, in order."""
    line = F.concat_ws(" ", "source", "version", "license", F.concat(F.lit("> "), F.col("attribution")))
    # A pack has a few dozen sources.
    return sources.groupBy("pack").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source", line.alias("line")))), lambda x: x.line), "\n").alias("notice"))


def snapshot_lines(used: DataFrame, items: DataFrame | None = None, choices: DataFrame | None = None) -> DataFrame:
    """used(user_id, word, count, last_used, clock): (user_id, place, line), the clock first, then 'w<TAB>word<TAB>count<TAB>last_used', 'a<TAB>group<TAB>text' of items(user_id, grp, item, place), latest first, and 'c<TAB>reading<TAB>surface<TAB>uses' of choices."""
    rows = used.select("user_id", F.lit("1").alias("part"), F.col("word").alias("by"), F.concat_ws("\t", F.lit("w"), "word", "count", "last_used").alias("line"))
    if items is not None:
        rows = rows.unionByName(items.select("user_id", F.lit("2").alias("part"), F.lpad(F.col("place").cast("string"), 9, "0").alias("by"), F.concat_ws("\t", F.lit("a"), "grp", "item").alias("line")))
    if choices is not None:
        rows = rows.unionByName(choices.select("user_id", F.lit("3").alias("part"), F.concat_ws("\t", "reading", "surface").alias("by"), F.concat_ws("\t", F.lit("c"), "reading", "surface", "uses").alias("line")))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("part", "by"))
    clocks = used.groupBy("user_id").agg(F.max("clock").cast("string").alias("line")).select("user_id", F.lit(0).alias("place"), "line")
    return clocks.unionByName(rows.select("user_id", place.alias("place"), "line"))


def restore_choices(lines: DataFrame) -> DataFrame:
    """The chosen spellings in snapshot_lines: (user_id, reading, surface, uses)."""
    f: Column = F.split("line", "\t")
    return lines.filter((F.size(f) == 4) & (F.get(f, 0) == "c")).select("user_id", F.get(f, 1).alias("reading"), F.get(f, 2).alias("surface"), F.get(f, 3).try_cast("bigint").alias("uses")).dropna()


def restore_items(lines: DataFrame) -> DataFrame:
    """The recent items in snapshot_lines: (user_id, grp, item, place)."""
    f: Column = F.split("line", "\t")
    found = lines.filter((F.size(f) == 3) & (F.get(f, 0) == "a")).select("user_id", F.get(f, 1).alias("grp"), F.get(f, 2).alias("item"), F.col("place").alias("at"))
    return found.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy("at"))).drop("at")


def restore_snapshot(lines: DataFrame) -> DataFrame:
    """snapshot_lines back to (user_id, word, count, last_used, clock); lines of no known form are skipped."""
    f: Column = F.split("line", "\t")
    whole = lambda k, kind: F.get(f, k).try_cast(kind)
    words = lines.filter((F.size(f) == 4) & (F.get(f, 0) == "w")).select("user_id", F.get(f, 1).alias("word"), whole(2, "bigint").alias("count"), whole(3, "int").alias("last_used")).dropna()
    clocks = lines.filter(F.col("place") == 0).select("user_id", F.col("line").try_cast("int").alias("clock")).dropna()
    return words.join(clocks, "user_id").select("user_id", "word", "count", "last_used", "clock")
