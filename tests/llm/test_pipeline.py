"""The pipeline: its stages in order, against brute force, and over odd tables."""

from __future__ import annotations

import base64
import hashlib
import itertools

import corpus_pipeline
import public_tokenizers
import pytest
import tiktoken
from llm_rows import SMALL, rows_by
from pyspark.sql import functions as F
from test_joins import plain_components

from wordloom.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage was given and gave."""
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        given = docs
        docs = corpus_pipeline.staged(stage(spark, docs, SMALL), f"test-{k}")
        out.append((name, given, docs))
    return out


def test_all_but_the_last_keep_the_columns(stages):
    assert [name for name, *_ in stages] == ["quality classifier", "language ID", "n-gram Jaccard join", "mixing sources to target weights", "byte-level BPE encoding and decoding"]
    for _, given, found in stages[:-1]:
        assert found.columns == given.columns and found.exceptAll(given).isEmpty() and 0 < found.count() <= given.count()
    assert stages[-1][2].columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "byte_ends"]


def test_one_of_each_group_stays(stages):
    _, given, found = stages[2]
    groups = plain_components([(r["doc_id"], r["text"]) for r in given.collect()])
    assert rows_by(found.select("doc_id").collect()) == rows_by((d,) for d, _, c in groups if d == c)


def test_texts_come_back(stages):
    _, given, found = stages[-1]
    texts = {r["doc_id"]: r["text"] for r in given.collect()}
    want = rows_by((k, hashlib.sha256(t.encode()).hexdigest()) for k, t in texts.items())
    assert rows_by(found.select("doc_id", "decoded_sha256").collect()) == want
    with open(tokenizer_path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    pieces = {v: k for k, v in ranks.items()}
    for r in found.collect():
        assert r["ids"] == library.encode_ordinary(texts[r["doc_id"]]) and r["n_tokens"] == len(r["ids"])
        assert r["byte_ends"] == list(itertools.accumulate(len(pieces[i]) for i in r["ids"]))


def test_run_is_the_stages_in_turn(spark, stages):
    assert rows_by(corpus_pipeline.run(spark, SMALL).collect()) == rows_by(stages[-1][2].collect())


def test_stages_take_odd_and_empty_tables(spark, odd, empty):
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            found = stage(spark, docs, SMALL)
            rows = found.collect()
            assert len(rows) <= docs.count(), name
            if stage is not corpus_pipeline.token_ids:
                assert found.columns == docs.columns
            if stage is corpus_pipeline.near_copies and rows:
                ids = [r["doc_id"] for r in rows]
                assert 1 in ids and 2 not in ids and 3 not in ids and {4, 5, 6, None} <= set(ids) and ids.count(9) == 2


def test_most_clean_documents_stay(spark, stages):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").filter("quality = 1").select("doc_id")
    _, given, found = stages[0]
    good = given.join(labels, "doc_id", "left_semi")
    assert found.join(labels, "doc_id", "left_semi").count() >= 0.9 * good.count()
    letters = stages[1][1].filter(F.col("text").rlike("[A-Za-z]{3}"))
    assert stages[1][2].count() >= 0.9 * letters.count()
