"""A corpus from raw documents: quality, language, near copies, mixture, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each one's result as Parquet in the shared
folder and reads it again for the next. All but the last return the columns of documents.

Defined results: null and empty texts score as any text does in the first stage, and have no language, so the second
stage drops them. Rows with a null id are kept by the third stage (they can name no group) and dropped by the fourth,
which orders by id. Rows that repeat an id share its fate. An empty table stays empty. Further columns are carried
through to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm import byte_bpe, language_id, mixing, ngram_join, pu_quality
from wordloom.llm.common import staged
from wordloom.llm.queries import domain_of, quality_model, table, tokenizer_path

#: Nine tenths of the tokens at hand, each document once: the stage before has just taken out copies.
MIXTURE = mixing.Mixture(
    levels=("domain", "lang", "source"),
    weights={"domain0": 300, "domain1": 300, "domain2": 200, "domain3": 200, "en": 500, "de": 200, "fr": 200, "es": 100},
    budget_share=(9, 10),
    max_epochs=1,
)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier rejects."""
    return pu_quality.keep(docs, quality_model(docs, table(spark, sf_dir, "labels")))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those where no language has half of the words."""
    return language_id.keep(docs, language_id.fit(docs, language_id.remainder(F.col("doc_id"), 3) != 1))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of near copies."""
    linked = ngram_join.linked_components(docs, words=5, pct=80)
    extra = linked.filter(F.col("doc_id") != F.col("component_id")).select("doc_id")
    return docs.join(extra, "doc_id", "left_anti").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the target weights draw, those on a leaf's border whole."""
    drawn = mixing.mix(docs.select("doc_id", "text", "lang", "source", domain_of(F.col("source")).alias("domain")), MIXTURE)
    return docs.join(drawn.filter("tokens_used > 0").select("doc_id"), "doc_id", "left_semi").select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes: (doc_id, n_tokens, ids_sha256, decoded_sha256, ids, byte_ends). The ids and where each one's bytes end are what the pipeline is for."""
    return byte_bpe.round_trip(docs, tokenizer_path("byte_bpe_50k.tiktoken"), with_ids=True)


STAGES = [
    ("quality classifier", quality),
    ("language ID", language),
    ("n-gram Jaccard join", near_copies),
    ("mixing sources to target weights", mixture),
    ("byte-level BPE encoding and decoding", token_ids),
]

#: The classifiers are fitted by iteration, which SQL does not express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = staged(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
