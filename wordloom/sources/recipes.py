"""Recipes: which sources a language's lexicon is made from, and their readers by format name.

A language's folder holds recipe.toml and, in sources/, files whose [[sources]] each give a name, a format, a path, a role, a
weight, and the format's own settings. Sources keep the order of their files' names and of their places in them.
"""

from __future__ import annotations

import tomllib
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hangul, tokens
from . import markup, readings, text, words
from .tables import exists, optional

SIGNALS = {
    "attested": "source string, word string, rank double",
    "observed": "source string, word string, cnt bigint",
    "pairs": "source string, left string, right string, cnt bigint",
    "annotations": "source string, word string, grp string, text string",
    "stems": "source string, stem string",
    "affixes": "source string, affix string",
    "emoji_order": "source string, category string, text string, place bigint",
    "entries": "source string, reading string, surface string, left_id int, right_id int, cost int, dependent boolean",
    "connection": "source string, row int, col int, cost int",
    "tests": "source string, reading string, expected string",
}
MINIMUM_COUNT = 1
ROLES = ("inventory", "frequency", "discovery")




def columns_of(kind: str) -> list[str]:
    """A signal's columns without the source."""
    return [c.split()[0] for c in SIGNALS[kind].split(", ")[1:]]


def schema_of(kind: str) -> str:
    return SIGNALS[kind].split(", ", 1)[1]


@dataclass(frozen=True)
class Source:
    """settings: the format's own. notice: version, license, attribution and the like, which change no signal."""

    name: str
    format: str
    path: str
    role: str
    weight: float = 1.0
    required: bool = True
    settings: Mapping = field(default_factory=dict)
    notice: Mapping = field(default_factory=dict)


@dataclass(frozen=True)
class Recipe:
    name: str
    build: Mapping
    sources: tuple[Source, ...]
    pack: Mapping = field(default_factory=dict)


Reader = Callable[[SparkSession, str, Mapping], Mapping[str, DataFrame]]
FORMATS: dict[str, Reader] = {}


def reader(name: str) -> Callable[[Reader], Reader]:
    """Registers a reader: (spark, path, settings) -> some of SIGNALS without their source."""

    def keep(f: Reader) -> Reader:
        FORMATS[name] = f
        return f

    return keep


def _counted(texts: DataFrame, settings: Mapping, pair_minimum: int = 1, end: str = tokens.LINE_END) -> Mapping[str, DataFrame]:
    return words.counted(texts, settings.get("cased", True), settings.get("minimum_count", MINIMUM_COUNT), settings.get("pair_minimum", pair_minimum), end)


@reader("word_list")
def _word_list(spark, path, settings):
    return words.word_list(text.lines(spark, path), settings.get("rank", 0.5), settings.get("minimum_count", MINIMUM_COUNT))


@reader("sized_word_lists")
def _sized_word_lists(spark, path, settings):
    rows = text.archive_lines(spark, path, encoding=settings.get("encoding", "UTF-8"))
    return {"attested": words.sized_word_lists(rows, settings["dialects"], settings["categories"], settings["maximum_size"])}


@reader("sentences")
def _sentences(spark, path, settings):
    return _counted(words.sentences(text.lines(spark, path)), settings)


@reader("encyclopaedia")
def _encyclopaedia(spark, path, settings):
    # Running text: neighbours within a sentence, and pairs met once are mostly chance.
    return _counted(markup.encyclopaedia(spark, path), {"cased": False} | dict(settings), 2, tokens.SENTENCE_END)


@reader("corpus_json")
def _corpus_json(spark, path, settings):
    return _counted(markup.corpus_forms(spark, path), {"cased": False} | dict(settings), end=tokens.SENTENCE_END)


@reader("headwords")
def _headwords(spark, path, settings):
    rows = markup.headwords(spark, path, settings["sense_types"], settings["word_units"], settings.get("excluded_parts_of_speech", ()))
    return words.word_list(rows.select(F.col("phrase").alias("line")), settings.get("rank", 0.5))


@reader("morpheme_dictionary")
def _morpheme_dictionary(spark, path, settings):
    file = F.regexp_extract("member", r"([^/]*)$", 1)
    kinds = F.lit(None).cast("string")
    for kind, key in (("inflection", "inflection_files"), ("stem", "verb_stem_files"), ("plain", "files")):
        kinds = F.when(file.isin(*settings.get(key, ())), kind).otherwise(kinds)
    found = words.morpheme_dictionary(text.archive_lines(spark, path), kinds, settings.get("particle_expansion_nouns", 0))
    affixes = spark.createDataFrame([(p,) for p in hangul.particle_forms()], "affix string")
    return {"attested": found["attested"], "stems": found["stems"].select(F.col("word").alias("stem")), "affixes": affixes}


@reader("emoji_names")
def _emoji_names(spark, path, settings):
    return {"annotations": markup.emoji_names(text.lines(spark, path))}


@reader("annotation_list")
def _annotation_list(spark, path, settings):
    return {"annotations": words.annotation_list(text.lines(spark, path), settings["group"])}


@reader("emoji_order")
def _emoji_order(spark, path, settings):
    rows = text.lines(spark, path).select("path", F.lit("").alias("member"), F.monotonically_increasing_id().alias("place"), "line")
    return {"emoji_order": markup.emoji_catalogue(rows, settings["categories"])}


@reader("reading_dictionary")
def _reading_dictionary(spark, path, settings):
    """An archive of reading dictionaries; the names of its members are settings."""
    member = lambda key, default: text.archive_lines(spark, path, settings.get(key, default))
    classes = readings.word_classes(member("class_member", r"(?:.*/)?id\.def"), settings.get("dependent_tags", ()))
    found = readings.entries(member("entry_members", readings.ENTRY_MEMBER), classes).unionByName(readings.single_characters(member("single_member", r"(?:.*/)?single_kanji\.tsv"), classes))
    return {"entries": found, "connection": readings.connection_cells(member("connection_member", r"(?:.*/)?connection_single_column\.txt"))}


@reader("conversion_tests")
def _conversion_tests(spark, path, settings):
    return {"tests": readings.test_sentences(text.lines(spark, path))}


def _toml(spark: SparkSession, pattern: str) -> list[tuple[str, dict]]:
    """(path, content) of small configuration files in order of their paths."""
    rows = spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value").collect()
    return [(r["path"], tomllib.loads(r["value"])) for r in sorted(rows, key=lambda r: r["path"])]


def _source(given: Mapping, base: str) -> Source:
    own = {k: given[k] for k in ("name", "format", "role", "weight", "required") if k in given}
    notice = {k: given[k] for k in ("version", "license", "attribution", "url", "sha256") if k in given}
    if own.get("format") not in FORMATS:
        raise ValueError(f"source {own.get('name')!r}: format {own.get('format')!r} is none of {sorted(FORMATS)}")
    if own.get("role") not in ROLES:
        raise ValueError(f"source {own.get('name')!r}: role {own.get('role')!r} is none of {ROLES}")
    path = given["path"] if given["path"].startswith("/") or "://" in given["path"] else f"{base}/{given['path']}"
    return Source(path=path, settings={k: v for k, v in given.items() if k not in own and k not in notice and k != "path"}, notice=notice, **own)


def languages(spark: SparkSession, folder: str, names: Sequence[str] = ()) -> list[str]:
    """The language folders of the given names, each of which must have a recipe; without names all that have one, in order."""
    if names:
        found = [f"{folder.rstrip('/')}/{name}" for name in names]
        for one in found:
            if not exists(spark, f"{one}/recipe.toml"):
                raise FileNotFoundError(f"{one}/recipe.toml")
        return found
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/*/recipe.toml")
    met = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or ()
    if not (found := sorted(s.getPath().getParent().toString() for s in met)):
        raise FileNotFoundError(f"no recipe in {folder}")
    return found


def load(spark: SparkSession, folder: str) -> Recipe:
    """A language's recipe; sources' paths that are not whole are taken from the folder of the file that names them."""
    folder = folder.rstrip("/")
    ((_, main),) = _toml(spark, f"{folder}/recipe.toml")
    sources = []
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/sources/*.toml")
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path):
        for file, content in _toml(spark, f"{folder}/sources/*.toml"):
            sources += [_source(given, file.rsplit("/", 1)[0]) for given in content.get("sources", [])]
    if not sources:
        raise ValueError(f"{folder} has no sources")
    return Recipe(folder.rsplit("/", 1)[-1], main.get("build", {}), tuple(sources), main.get("pack", {}))


def read(spark: SparkSession, recipe: Recipe) -> dict[str, DataFrame]:
    """The signals of a recipe's sources, each with its name as `source`, and sources(source, role, weight).

    A source that need not be there and is missing gives nothing."""
    found: dict[str, list[DataFrame]] = {name: [spark.createDataFrame([], schema)] for name, schema in SIGNALS.items()}
    kept = []
    for s in recipe.sources:
        got = optional(spark, s.path, lambda path, s=s: FORMATS[s.format](spark, path, s.settings), s.required)
        if got is None:
            continue
        kept.append((s.name, s.role, float(s.weight)))
        for name, df in got.items():
            columns = found[name][0].columns
            found[name].append(df.withColumn("source", F.lit(s.name)).select(*columns))
    out = {name: reduce(DataFrame.unionByName, dfs[1:] or dfs) for name, dfs in found.items()}
    return out | {"sources": spark.createDataFrame(kept, "source string, role string, weight double")}
