"""Every query of the library against its DuckDB SQL; the entry points without the llm subpackage."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest
from compare import differences, oracle

from wordloom import queries as own

SMALL = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def con():
    return oracle(SMALL)


@pytest.mark.parametrize("name", sorted(own.ORACLE))
def test_rows_are_those_of_sql(spark, con, name):
    assert differences(spark, con, own.QUERIES[name], own.ORACLE[name], SMALL) == ""


@pytest.mark.parametrize("name", sorted(set(own.QUERIES) - set(own.ORACLE)))
def test_other_queries_have_rows(spark, name):
    assert own.QUERIES[name](spark, SMALL).count() > 0


def test_the_rest_works_without_the_llm_subpackage(tmp_path):
    """A copy without corpus_pipeline.py and wordloom/llm still has its other queries."""
    import shutil

    shutil.copytree(ROOT / "wordloom", tmp_path / "wordloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.own_queries.QUERIES), 'pipeline' in e.queries())"
    found = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True, timeout=120)
    assert found.stdout.split() == ["True", "False"], found.stderr
