"""Expiry of a ledger: rows lie in folders by the day they expire on, so a sweep deletes whole folders and rewrites one at most."""

from __future__ import annotations

from datetime import datetime, timezone
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.envelope import unexpired
from ..sources.scratch import Scratch, delete

#: The folders' name; rows that never expire have one of their own.
DAY = "expires_on"


class Swept(NamedTuple):
    #: Folders that went as a whole, and the one that was written anew.
    deleted: int
    rewritten: int
    rows_removed: int
    #: Rows that were copied: those of the day of the sweep which stay.
    rows_copied: int


def by_expiry(rows: DataFrame) -> DataFrame:
    """Rows (expires_at and more) with the day they expire on, in UTC, as a text."""
    return rows.withColumn(DAY, F.date_format(F.to_utc_timestamp("expires_at", F.current_timezone()), "yyyy-MM-dd"))


def append_by_expiry(rows: DataFrame, path: str) -> None:
    """Appends rows (expires_at and more) in folders by the day they expire on."""
    by_expiry(rows).hint("rebalance", DAY).write.mode("append").partitionBy(DAY).parquet(path)


def sweep(spark: SparkSession, path: str, now: datetime) -> Swept:
    """Deletes what has expired from a table of ``append_by_expiry``. ``now`` needs a time zone.

    Folders of earlier days go without being read, but for their files' row counts; of the day of ``now`` the rows that stay are written elsewhere first, then
    in place of the folder. Rows that never expire lie apart and stay. One job writes such a table at a time.
    """
    if now.tzinfo is None:
        raise ValueError("now needs a time zone")
    today = now.astimezone(timezone.utc).strftime("%Y-%m-%d")
    table = spark.read.parquet(path)
    table = table.withColumn(DAY, F.col(DAY).cast("string"))
    due = table.where(F.col(DAY) <= today)
    # a row for each folder that goes; its name is taken from the files
    found = due.groupBy(DAY, F.regexp_extract("_metadata.file_path", f"/({DAY}=[^/]+)/", 1).alias("folder")).count().collect()
    old = [r for r in found if r[DAY] < today]
    deleted, removed, copied, rewritten = [r["folder"] for r in old], sum(r["count"] for r in old), 0, 0
    boundary = [r for r in found if r[DAY] == today]
    if boundary:
        with Scratch(spark) as scratch:
            own = table.where(F.col(DAY) == today)
            kept = scratch.written(own.where(unexpired(F.col("expires_at"), F.lit(now).cast("timestamp"))))
            whole, copied = sum(r["count"] for r in boundary), kept.count()
            removed += whole - copied
            if not copied:
                deleted += [r["folder"] for r in boundary]
            elif copied < whole:
                rewritten = 1
                kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(path)
            else:
                copied = 0
    delete(spark, [f"{path.rstrip('/')}/{name}" for name in set(deleted)])
    return Swept(len(set(deleted)), rewritten, removed, copied)
