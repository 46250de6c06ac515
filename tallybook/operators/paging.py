"""Tails, pages and windows over the append order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tail(lines: DataFrame, n: int) -> DataFrame:
    """The last n rows in append order; none for n <= 0. Filters come after."""
    return lines.orderBy(F.col("seq").desc()).limit(max(n, 0)).orderBy("seq")


def window_tail(lines: DataFrame, time: str, since: Column, until: Column, n: int) -> DataFrame:
    """The last n rows in append order with since <= time < until; rows without a time stay out."""
    return tail(lines.where((F.col(time) >= since) & (F.col(time) < until)), n)


def last_of_each(lines: DataFrame, key: str) -> DataFrame:
    """The last row of each key by append order; filters come after, so junk at the end gives nothing."""
    rest = [c for c in lines.columns if c != key]
    return lines.groupBy(key).agg(F.max_by(F.struct(*rest), "seq").alias("x")).select(key, *[F.col(f"x.{c}").alias(c) for c in rest])


def with_offsets(lines: DataFrame, key: str, width: str, block: int = 4096) -> DataFrame:
    """start_offset and next_offset of each line of a key, in order of its whole number ``seq``.

    Widths are summed in blocks of the order first; the few sums of a key's blocks give where each block begins.
    """
    own = lines.withColumn("__block", F.floor(F.col("seq") / block))
    sums = own.groupBy(key, "__block").agg(F.sum(width).alias("__bytes"))
    before = Window.partitionBy(key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(F.col(key).alias("__key"), F.col("__block").alias("__at"), F.coalesce(F.sum("__bytes").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy(key, "__block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    placed = own.join(bases, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__block") == F.col("__at")))
    placed = placed.withColumn("next_offset", F.col("__base") + F.sum(width).over(inside))
    return placed.withColumn("start_offset", F.col("next_offset") - F.col(width)).select(*lines.columns, "start_offset", "next_offset")


def pages(lines: DataFrame, key: str, cursor: int, n: int) -> DataFrame:
    """O2: a row for each key: items (the first n valid rows from start_offset ``cursor`` on), has_more, next_cursor.

    Rows that are not valid are passed over. With a further valid row the next cursor is its start, else the end of the
    last row, so that a stretch without a valid row is passed too; a key without rows there keeps its cursor.
    """
    ahead = lines.where(F.col("start_offset") >= cursor)
    rank = F.row_number().over(Window.partitionBy(key).orderBy("start_offset"))
    head = ahead.where("valid").withColumn("__rank", rank).where(F.col("__rank") <= n + 1)  # n + 1 rows of each key pass on
    rest = [c for c in lines.columns if c != key]
    listed = F.array_sort(F.collect_list(F.struct("__rank", F.struct(*rest).alias("row"))))
    found = head.groupBy(F.col(key).alias("__key")).agg(listed.alias("__rows"))
    ends = ahead.groupBy(key).agg(F.max("next_offset").alias("__end"))
    joined = lines.select(key).distinct().join(ends.withColumnRenamed(key, "__k"), F.col(key).eqNullSafe(F.col("__k")), "left").join(found, F.col(key).eqNullSafe(F.col("__key")), "left")
    rows = F.coalesce("__rows", F.array().cast(listed_type(lines, rest)))
    more = F.size(rows) > n
    next_cursor = F.when(more, F.try_element_at(rows, F.lit(n + 1))["row"]["start_offset"]).otherwise(F.coalesce("__end", F.lit(cursor).cast("long")))
    return joined.select(key, F.transform(F.slice(rows, 1, n), lambda x: x["row"]).alias("items"), more.alias("has_more"), next_cursor.alias("next_cursor"))


def listed_type(lines: DataFrame, names: list[str]) -> str:
    fields = ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in lines.select(*names).schema)
    return f"array<struct<__rank:int,row:struct<{fields}>>>"


def domains(lines: DataFrame, prefix: str = "") -> DataFrame:
    """The distinct domains with a literal prefix."""
    return lines.select("domain").distinct().where(F.col("domain").startswith(prefix)).orderBy("domain")


def line_statistics(lines: DataFrame, key: str) -> DataFrame:
    """For each key total, valid and invalid lines, complete bytes and the last time seen."""
    return lines.groupBy(key).agg(
        F.count("*").alias("total"), F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid"), F.max("next_offset").alias("bytes"), F.max(F.when(F.col("valid"), F.col("ts"))).alias("last_seen")
    )


def diagnostics(lines: DataFrame, key: str, n: int = 20) -> DataFrame:
    """A2: the first n invalid lines of each key by offset, and whether there are more."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy("start_offset"))
    first = lines.where(~F.col("valid")).select(key, "start_offset").withColumn("rank", rank).where(F.col("rank") <= n + 1)
    return first.groupBy(key).agg(F.slice(F.array_sort(F.collect_list("start_offset")), 1, n).alias("offsets"), (F.count("*") > n).alias("truncated"))


def latest(lines: DataFrame, key: str) -> DataFrame:
    """The last line of each key; one that is not valid is an error."""
    last = last_of_each(lines, key)
    bad = last.where(~F.col("valid")).select(key).take(1)
    if bad:
        raise ValueError(f"the last line of {bad[0][0]} is corrupt")
    return last
