"""The index of a ledger's identities: what an append compares its batch with, without reading the ledger.

Each append adds a generation of its own identities; generations of like size are merged, so there are few of them however many appends there
were. A generation is sorted by a hash of the identity and split into buckets, ranges of the hash, whose number grows with it; a large one
has a Bloom filter for each bucket. A small batch asks the filters first and then reads only the buckets that may hold one of its identities; a batch
that is not small against a generation reads it whole.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import Scratch

#: Identities of a bucket on average, at least half of it.
BUCKET_ROWS = 1 << 14
#: Generations from this size on have filters, and a batch asks them if it is so much smaller.
FILTERED, SMALLER = 1 << 17, 16
#: Bits of a filter for each identity and bits that one sets: some one in 10,000 that is not there passes.
BITS, PLACES = 20, 13
#: Generations that are kept before the small ones are merged; one joins if it is at most so much larger than those before it together.
MOST, LIKE = 8, 2
#: Buckets that are named to a scan; a batch with more candidates reads all.
NAMED = 4_096


def identity_hash(domain: str = "domain", event_id: str = "event_id") -> Column:
    return F.xxhash64(domain, event_id)


def depth_of(rows: int) -> int:
    """How many leading bits of the hash name a bucket."""
    return max(0, math.ceil(math.log2(max(1, rows) / BUCKET_ROWS)))


def bucket(depth: int, h: str = "h") -> Column:
    return F.shiftrightunsigned(h, 64 - depth).cast("int") if depth else F.lit(0)


def places(h: np.ndarray, bits: int) -> np.ndarray:
    """The bits that each hash sets in a filter of so many bits."""
    x = h.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    a, b = x >> np.uint64(32), (x & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    return (a[:, None] + np.arange(PLACES, dtype=np.uint64) * b[:, None]) % np.uint64(bits)


def filters(ids: DataFrame) -> DataFrame:
    """bucket, filter: a Bloom filter over the hashes of each bucket."""

    def run(table: pa.Table) -> pa.Table:
        h = table.column("h").to_numpy()
        bits = np.zeros(8 * math.ceil(BITS * len(h) / 8), bool)
        bits[places(h, len(bits)).ravel()] = True
        return pa.table({"bucket": table.column("bucket")[:1].cast(pa.int32()), "filter": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    return ids.select("bucket", "h").groupBy("bucket").applyInArrow(run, "bucket int, filter binary")


def passing(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """bucket, h of what the filters do not rule out. wanted: bucket, h."""

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        h = np.unique(asked.column("h").to_numpy()) if asked.num_rows else np.empty(0, np.int64)
        if not len(h) or not held.num_rows:
            return pa.table({"bucket": pa.array([], pa.int32()), "h": pa.array([], pa.int64())})
        bits = np.unpackbits(np.frombuffer(held.column("filter")[0].as_py(), np.uint8)).astype(bool)
        own = h[bits[places(h, len(bits))].all(axis=1)]
        return pa.table({"bucket": pa.array(np.full(len(own), asked.column("bucket")[0].as_py()), pa.int32()), "h": pa.array(own, pa.int64())})

    return wanted.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(run, "bucket int, h bigint")


def generation_path(path: str, name: str) -> str:
    return f"{path.rstrip('/')}/_index/{name}"


def identities_of(spark: SparkSession, path: str, generation: dict, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, bucket int").parquet(f"{generation_path(path, generation['name'])}/ids")


def looked_up(scratch: Scratch, path: str, generations: list[dict], wanted: DataFrame, n: int, schema: str) -> DataFrame:
    """domain, event_id, h, fp of the n wanted identities (domain, event_id, h) that the generations have, and of some others."""
    spark, out = scratch.spark, None
    for g in generations:
        own = identities_of(spark, path, g, schema)
        if g["filtered"] and n * SMALLER < g["rows"]:
            known = spark.read.parquet(f"{generation_path(path, g['name'])}/filters")
            left = scratch.written(passing(wanted.select(bucket(g["depth"]).alias("bucket"), "h"), known))
            named = [r["bucket"] for r in left.select("bucket").distinct().limit(NAMED + 1).collect()]
            if len(named) <= NAMED:
                own = own.where(F.col("bucket").isin(named) if named else F.lit(False))
        own = own.select("domain", "event_id", "h", "fp")
        out = own if out is None else out.unionByName(own)
    return wanted.sparkSession.createDataFrame([], schema).select("domain", "event_id", "h", "fp") if out is None else out


def add(scratch: Scratch, path: str, generations: list[dict], fresh: DataFrame, n: int, schema: str) -> tuple[list[dict], str]:
    """The generations with that of the n fresh identities (domain, event_id, fp, h), merged with small ones if there are many; and the name of the new one."""
    spark, name = scratch.spark, uuid.uuid4().hex
    kept, rows, own = sorted(generations, key=lambda g: g["rows"]), n, fresh.select("domain", "event_id", "fp", "h")
    if len(kept) >= MOST:
        while kept and (kept[0]["rows"] <= LIKE * rows or len(kept) >= MOST):
            g = kept.pop(0)
            own, rows = own.unionByName(identities_of(spark, path, g, schema).drop("bucket")), rows + g["rows"]
    depth, folder = depth_of(rows), generation_path(path, name)
    dealt = own.withColumn("bucket", bucket(depth))
    dealt = dealt.repartition("bucket") if depth else dealt.coalesce(1)  # a bucket's rows at most
    dealt.sortWithinPartitions("bucket", "h").write.partitionBy("bucket").parquet(f"{folder}/ids")
    own = {"name": name, "depth": depth, "rows": rows, "filtered": rows >= FILTERED}
    if own["filtered"]:
        filters(identities_of(spark, path, own, schema)).write.parquet(f"{folder}/filters")
    return [*kept, own], name


def batches_of(spark: SparkSession, path: str) -> Iterator[str]:
    """The generation folders that are there, named by a commit or not."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_index")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(folder):
        yield from (s.getPath().getName() for s in fs.listStatus(folder))
