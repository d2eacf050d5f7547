"""The thin queries opN_<name> over the driver's tables, with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import block_max, byte_bpe, language_id, mixing, ngram_join, nn_descent, pitman_yor, pu_quality, sharding, token_files, transport_stream, unigram_count, vector_codes
from .common import staged

SHARDS = [f"shard-{k:03d}" for k in range(64)]
TABLE_SIZE = 4099
#: Target weights; domains are an invented first level over the sources' numbers.
MIXTURE = mixing.Mixture(
    levels=("domain", "lang", "source"),
    weights={"domain0": 400, "domain1": 300, "domain2": 200, "domain3": 100, "en": 500, "de": 200, "fr": 200, "es": 100, "src0": 50, "domain2/es": 300},
    max_epochs=3,
)


def tokenizer_path(name: str) -> str:
    """A public vocabulary's place; the folder may be set by PUBLIC_TOKENIZERS."""
    if folder := os.environ.get("PUBLIC_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def domain_of(source: Column) -> Column:
    return F.concat(F.lit("domain"), F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(source, "([0-9]{1,9})$", 1), F.lit("")), F.lit("999999999")).cast("bigint") % 4, F.lit(0)))


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("domain", domain_of(F.col("source")))
    return mixing.mix(docs, MIXTURE)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.write_new(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)
    return token_files.read_checksums(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked_components(table(spark, sf_dir, "documents"), words=5, pct=80)


def op4_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs, language_id.remainder(F.col("doc_id"), 3) != 1)
    held_out = F.coalesce(language_id.remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    return language_id.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram_count.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"))


def op7_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport_stream.read_media(staged(transport_stream.with_media(table(spark, sf_dir, "documents")), "media"))


def op8_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.nearest(table(spark, sf_dir, "embeddings"), lambda c: F.col(c) % 20 == 0, k=20)


def op9_lookup_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return sharding.place(docs, "doc_id", sharding.lookup_table(spark, SHARDS, TABLE_SIZE), TABLE_SIZE)


def quality_model(docs: DataFrame, labels: DataFrame) -> pu_quality.Model:
    train = language_id.remainder(F.col("doc_id"), 5) != 0
    return pu_quality.fit(docs, labels.filter((F.col("quality") == 1) & train).select("doc_id"), train)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_model(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(language_id.remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    return pu_quality.predict(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op11_partial_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"), scale=4096, parts=8, entries=16, rounds=6)


def op12_block_max_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    whole = block_max.totals(docs)
    return block_max.search(block_max.build(docs, whole), whole, table(spark, sf_dir, "benchmark"), k=10)


def op13_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = language_id.remainder(F.col("doc_id"), 7)
    return pitman_yor.learn_and_score(table(spark, sf_dir, "documents"), train=rest != 2, held_out=rest == 2)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_source_mixing, op2_token_files, op3_ngram_jaccard, op4_language_mixture, op5_token_counts, op6_byte_bpe, op7_transport_streams, op8_nn_descent, op9_lookup_sharding, op10_quality, op11_partial_distance, op12_block_max_wand, op13_pitman_yor)}
