"""What the text operators share: Arrow batches, byte columns, staged tables."""

from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from drayage.sources.staging import stage

#: Rows of one Arrow batch.  A batch holds whole texts, so this bounds a worker's memory.
BATCH_ROWS = 1000
#: Bytes of text that a worker turns into arrays at once.
CHUNK_BYTES = 1 << 20

__all__ = ["BATCH_ROWS", "CHUNK_BYTES", "chunks", "map_batches", "read", "stage", "text_bytes"]


def read(spark: SparkSession, directory: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{table}.parquet")


def text_bytes(column) -> "F.Column":
    """The text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("binary")


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow with batches of BATCH_ROWS rows at most; workers find this package where the driver does."""
    spark = df.sparkSession
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    return df.mapInArrow(fn, schema)


def chunks(sizes: list[int], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows whose sizes sum to the limit or, for a single large row, exceed it."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)
