"""Dumps and dictionaries in XML and JSON, read by Spark's readers: encyclopaedia pages, corpora, emoji names, headwords."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import tokens
from . import archives
from .text import unescape
from .words import running_header

#: Stands where markup was dropped: no word goes on over it, and its neighbours are no pair.
LOST = "�"
#: Name spaces of media and categories.
DROPPED_SPACES = ("파일", "File", "분류", "Category", "Image")
EMOJI, SYMBOL = "emoji", "symbol"


def _wikitext_pattern():
    import regex

    def nested(name: str, opening: str, closing: str) -> str:
        return rf"(?P<{name}>{opening}(?:(?&{name})|(?!{opening}|{closing}).)*+(?:{closing}|\Z))"

    spans = [nested("braces", r"\{\{", r"\}\}"), nested("table", r"\{\|", r"\|\}")]
    spans += [nested(f"space{k}", rf"\[\[{name}:", r"\]\]") for k, name in enumerate(DROPPED_SPACES)]
    spans += [r"<ref.*?(?:</ref>|\Z)", r"<!--.*?(?:-->|\Z)"]
    return regex.compile(rf"(?P<heading>(?<![^\n])==[^\n]*)|(?P<dropped>{'|'.join(spans)})|\[\[(?P<link>.*?)\]\]", regex.DOTALL)


@F.pandas_udf(StringType())
def strip_wikitext(text: pd.Series) -> pd.Series:
    """The running text: templates, tables, media, references and comments give LOST, headings two line feeds, links their shown text.

    What is not closed runs to the end of the text."""
    pattern = _wikitext_pattern()

    def plain(found) -> str:
        if found["heading"] is not None:
            return "\n\n"
        return LOST if found["dropped"] is not None else found["link"].rsplit("|", 1)[-1]

    return text.map(lambda t: None if t is None else pattern.sub(plain, t))


def encyclopaedia(spark: SparkSession, path: str) -> DataFrame:
    """(title, text) of a dump's articles: pages of name space 0 that redirect nowhere. Compressed dumps are read as they are."""
    schema = "title string, ns int, redirect struct<_title:string>, revision struct<text:struct<_VALUE:string>>"
    pages = spark.read.format("xml").option("rowTag", "page").schema(schema).load(path)
    body = F.col("revision.text._VALUE")
    return pages.filter((F.col("ns") == 0) & F.col("redirect").isNull() & body.isNotNull()).select("title", strip_wikitext(body).alias("text"))


#: The arrays whose objects are sentences.
SENTENCE_ARRAYS = ("paragraph", "sentence", "utterance")


def _forms(text: str) -> list[str]:
    """`form` of the objects directly in sentence arrays, wherever those stand, in order."""
    out, waiting = [], [(json.loads(text), False)]
    while waiting:
        value, is_sentence = waiting.pop()
        if isinstance(value, dict):
            if is_sentence and isinstance(value.get("form"), str):
                out.append(value["form"])
            waiting += [(child, name in SENTENCE_ARRAYS) for name, child in reversed(value.items())]
        elif isinstance(value, list):
            waiting += [(child, is_sentence) for child in reversed(value)]
    return out


@F.pandas_udf(ArrayType(StringType()))
def _sentence_forms(text: pd.Series) -> pd.Series:
    return text.map(_forms)


def corpus_forms(spark: SparkSession, path: str) -> DataFrame:
    """(text): `form` of paragraphs, sentences and utterances at any depth of JSON documents, plain or in zips; forms of their morphemes are not read. A document that is no JSON is an error."""
    if path.endswith(".zip"):
        documents = archives.members(spark, path, "text", r".*\.json")
    else:
        documents = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"))
    return documents.select(F.explode(_sentence_forms(F.col("text"))).alias("text"))


def group_of(text: Column) -> Column:
    """Emoji or symbol, by selectors, joiners and the first code point's block."""
    first = F.conv(F.hex(F.encode(F.left(text, F.lit(1)), "UTF-32")), 16, 10).cast("bigint")
    block = first.between(0x1F000, 0x1FAFF) | first.between(0x2600, 0x27BF) | first.between(0x2B00, 0x2BFF)
    return F.when(text.rlike("[️‍]") | block, EMOJI).otherwise(SYMBOL)


def emoji_names(rows: DataFrame) -> DataFrame:
    """Lines of `<annotation cp="X">word | word</annotation>`: (word, grp, text); names of several words are dropped."""
    pattern = r'<annotation cp="([^"]+)"[^>]*>([^<]*)</annotation>'
    named = rows.filter(F.col("line").rlike(pattern)).select(unescape(F.regexp_extract("line", pattern, 1)).alias("text"), F.explode(F.split(unescape(F.regexp_extract("line", pattern, 2)), r"\|")).alias("word"))
    named = named.select(F.trim("word").alias("word"), group_of(F.col("text")).alias("grp"), "text")
    return named.filter((F.col("word") != "") & ~F.col("word").rlike(tokens.WHITE_SPACE)).distinct()


def emoji_catalogue(rows: DataFrame, categories: dict[str, str]) -> DataFrame:
    """(path, member, place, line) of an emoji test file: (category, text, place) of fully qualified ones; unknown groups are dropped."""
    header = F.nullif(F.regexp_extract("line", r"^# group: (.*)$", 1), F.lit(""))
    named = F.create_map(*[F.lit(x) for kv in categories.items() for x in kv])
    marked = rows.withColumn("category", F.try_element_at(named, running_header(rows, header)))
    line = r"^[^#;]+; fully-qualified\s*# (\S+)"
    return marked.filter(F.col("line").rlike(line) & F.col("category").isNotNull()).select("category", F.regexp_extract("line", line, 1).alias("text"), "place")


_ITEM = "wordInfo struct<word:string,word_unit:string>, senseInfo struct<type:string,pos:string>"


def headwords(spark: SparkSession, path: str, senses: Sequence[str], units: Sequence[str], excluded: Sequence[str] = ()) -> DataFrame:
    """(phrase) of an open dictionary's items of the wanted senses and units, from XML files, plain or in zips; words of related items are not read."""
    if path.endswith(".zip"):
        records = archives.members(spark, path, "records", r".*\.xml", tag="item")
        items = records.select(F.from_xml("record", f"struct<{_ITEM.replace('wordInfo ', 'wordInfo: ').replace('senseInfo ', 'senseInfo: ')}>").alias("item")).select("item.*")
    else:
        items = spark.read.format("xml").option("rowTag", "item").schema(_ITEM).load(path)
    kept = F.col("senseInfo.type").isin(*senses) & F.col("wordInfo.word_unit").isin(*units) & ~F.coalesce(F.col("senseInfo.pos").isin(*excluded), F.lit(False))
    return items.filter(kept).select(F.trim(F.col("wordInfo.word")).alias("phrase"))


def html_text(html: Column) -> Column:
    """Text of a web page: scripts, styles and comments dropped, tags turned to spaces, entities unescaped."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(unescape(F.regexp_replace(bare, r"<[^>]*>", " ")), r"[ \t\r\n]+", " "))
