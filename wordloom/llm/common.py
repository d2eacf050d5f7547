"""What several operators of this subpackage need: the shared folder, staged tables, batches of texts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from pathlib import Path

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession

#: Characters of text that one vectorised step holds at most, unless a single text is longer.
STEP_CHARS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where that is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = Path(tempfile.gettempdir()) / "checkpoints"
        base.mkdir(parents=True, exist_ok=True)
        found = f"file://{tempfile.mkdtemp(dir=base)}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """df written once as Parquet in the shared folder and read again: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)  # an empty table may have no files to tell its columns


def scan_partitions(df: DataFrame) -> int:
    """Partitions that Spark plans for df's scan: a measure of the input's size that needs no pass over it."""
    return max(1, df.rdd.getNumPartitions())


def text_steps(batches: Iterator[pa.RecordBatch], limit: int = STEP_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with their texts (first column; null as empty) of about `limit` bytes each."""
    for batch in batches:
        column = batch.column(0)
        at, n = 0, batch.num_rows
        sizes = pa.compute.binary_length(column).fill_null(0).to_pylist()
        while at < n:
            end, total = at, 0
            while end < n and (end == at or total + sizes[end] <= limit):
                total += sizes[end]
                end += 1
            part = batch.slice(at, end - at)
            yield part, [t or "" for t in part.column(0).to_pylist()]
            at = end
