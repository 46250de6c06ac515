"""Tables between jobs, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one of our own only where none is named and driver and executors are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="tallybook-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


#: Whether Spark deletes a job's shuffle files when it ends, not only when the driver collects its garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Bytes of a batch that goes between Spark and Python.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Rows that a task has of a Parquet table at a time.
READ_ROWS = "spark.sql.parquet.columnarReaderBatchSize"

_setting = threading.Lock()
#: For each setting that is set for a while: what it was, and how many are within.
_before: dict[str, tuple[str | None, int]] = {}


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """Within it, the session has this setting; the last of several threads that leave it gives the former one back."""
    with _setting:
        before, within = _before.get(key) or (spark.conf.get(key, None), 0)
        _before[key] = before, within + 1
        spark.conf.set(key, value)
    try:
        yield
    finally:
        with _setting:
            before, within = _before.pop(key)
            if within > 1:
                _before[key] = before, within - 1
            elif before is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, before)


def shuffles_deleted(spark: SparkSession):
    """Within it, jobs delete their shuffle files when they end."""
    return setting(spark, SHUFFLES_GO, "true")


#: Folders of ``written`` that are still there.
kept_folders: list[str] = []


def written(df: DataFrame, **options: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage, survives lost executors, its size is known, and several jobs that read it see the same rows. ``options`` are the Parquet writer's."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/table-{uuid.uuid4().hex}"
    with shuffles_deleted(spark):
        df.write.options(**options).parquet(path)
    kept_folders.append(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables between the jobs of one call; what is left of them goes when it ends, whatever other threads write."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def written(self, df: DataFrame) -> DataFrame:
        path = f"{scratch_dir(self.spark)}/table-{uuid.uuid4().hex}"
        self.paths.append(path)
        with shuffles_deleted(self.spark):
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __exit__(self, *error) -> None:
        delete(self.spark, self.paths)


def table_or_none(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """The Parquet table at ``path``, None if there is none yet. With its schema, no file is opened to learn it."""
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None


def clear(spark: SparkSession, before: int = 0) -> None:
    """Deletes what ``written`` has left but for the first ``before`` folders. Only for results that are written elsewhere already: others still read it."""
    delete(spark, kept_folders[before:])
    del kept_folders[before:]


def delete(spark: SparkSession, paths: list[str], recursive: bool = True) -> None:
    """Deletes files, or folders with all they hold, wherever Spark reads them from."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, recursive)
