"""Small helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.scratch import BATCH_BYTES, READ_ROWS, kept_folders, scratch_dir, setting
from ..sources.scratch import clear as clear_stored
from ..sources.scratch import written as stored

__all__ = ["BATCH_BYTES", "READ_ROWS", "clear_stored", "gathered", "kept_folders", "map_rows", "scratch_dir", "setting", "slices", "stored", "table", "texts"]

#: Rows of an Arrow batch that Python works on at once.
SLICE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gathered(df: DataFrame, each: int = 4) -> DataFrame:
    """A small result of a shuffle in at most ``each`` partitions for a core, so that its table has no more files than these."""
    return df.coalesce(each * df.sparkSession.sparkContext.defaultParallelism)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into slices of few rows, so that what Python makes of one stays small."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Applies ``fn`` to each slice of the Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield fn(batch)

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]
