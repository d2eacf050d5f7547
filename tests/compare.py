"""Rows of a Spark query against those of its DuckDB SQL: python tests/compare.py SF_DIR [NAME...] prints what differs."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def differences(spark, con: duckdb.DuckDBPyConnection, query, sql: str, sf_dir: str) -> str:
    """Empty where both give the same columns and rows."""
    found = query(spark, sf_dir)
    got = rows_of(found.columns, found.collect())
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(found.columns):
        return f"columns {sorted(found.columns)} against {sorted(names)}"
    want = rows_of(names, result.fetchall())
    if got == want:
        return ""
    more, less = got - want, want - got
    return f"{sum(got.values())} rows against {sum(want.values())}; only in Spark {list(more)[:3]} ({sum(more.values())}), only in SQL {list(less)[:3]} ({sum(less.values())})"


def main() -> None:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir, names = sys.argv[1], sys.argv[2:]
    con, queries, sqls = oracle(sf_dir), entry.queries(), entry.oracle_sql()
    for name in names or queries:
        began = time.time()
        try:
            said = differences(spark, con, queries[name], sqls[name], sf_dir) if name in sqls else f"no SQL, {queries[name](spark, sf_dir).count()} rows"
        except Exception as e:  # noqa: BLE001 - the next query is still of interest
            said = f"FAILED {type(e).__name__}: {str(e)[:600]}"
        print(f"{name:28} {time.time() - began:6.1f}s {said or 'same'}", flush=True)


if __name__ == "__main__":
    main()
