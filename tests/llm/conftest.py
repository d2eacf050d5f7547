"""Fixtures over llm_rows."""

from __future__ import annotations

import pytest
from llm_rows import SMALL, TEXTS, frame


@pytest.fixture(scope="session")
def odd(spark):
    return frame(spark, TEXTS)


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet").cache()


@pytest.fixture(scope="session")
def small_rows(small):
    return [(r["doc_id"], r["text"]) for r in small.select("doc_id", "text").collect()]
