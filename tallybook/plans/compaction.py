"""Compaction of imported source files into digest-bound bundles, and what can be rebuilt from these."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import unique
from ..sources import sinks
from ..sources.jsonl import files
from ..sources.scratch import Scratch, delete, table_or_none, written
from .folds import within_budget
from .reconcile import MOST_SENT, legacy_key, profiles, receipt_key, source_events, with_receipts

TERMINAL = ("agent.run.completed", "agent.run.blocked")
#: Sources and bytes of one run.
MAX_SOURCES, MAX_BYTES = 256, 64 * 1024 * 1024
SHARD = "outbox"
#: What names a bundle.
NAME = "manifest_sha256"


def first_sources(listed: DataFrame, n: int) -> DataFrame:
    """The first n sources by path, before any check, the others marked as deferred."""
    first = listed.orderBy("source").limit(n).select("source", F.lit(False).alias("deferred"))
    return listed.join(F.broadcast(first), "source", "left").withColumn("deferred", F.coalesce("deferred", F.lit(True)))


def reasons(own: DataFrame, confirmed: DataFrame, now: datetime, grace_seconds: int, max_bytes: int) -> DataFrame:
    """Source, bytes, reason: ``eligible`` or the first reason against moving a source into a bundle.

    own: source, bytes, valid, last_kind, modified, receipt, deferred. confirmed: source, confirmed. In order of path, sources are eligible as long as their bytes
    fit into ``max_bytes``; one that does not fit is passed over.
    """
    joined = own.join(confirmed.select("source", "confirmed"), "source", "left")
    waits = F.lit(now).cast("timestamp") < F.col("modified") + F.make_dt_interval(secs=F.lit(grace_seconds))
    reason = (
        F.when(F.col("deferred"), "source_bound")
        .when(~F.coalesce("valid", F.lit(False)), "invalid_source")
        .when(~F.coalesce(F.col("last_kind").isin(*TERMINAL), F.lit(False)), "nonterminal")
        .when(waits, "grace_pending")
        .when(~F.col("receipt").eqNullSafe("intact"), "receipt_invalid_or_missing")
        .when(~F.coalesce("confirmed", F.lit(False)), "ledger_unconfirmed")
        .otherwise("eligible")
    )
    judged = joined.select("source", "bytes", reason.alias("reason"))
    ranked = judged.where("reason = 'eligible'").select(F.lit(SHARD).alias("k"), F.col("source").alias("name"), "bytes")
    # at most as many rows as sources of one run
    numbered = ranked.withColumn("pos", F.row_number().over(Window.partitionBy("k").orderBy("name")))
    taken = within_budget(numbered, "k", max_bytes).join(numbered.select("pos", "name"), "pos").where("taken").select(F.col("name").alias("source"), F.lit(True).alias("taken"))
    out = judged.join(taken, "source", "left")
    return out.select("source", "bytes", F.when((F.col("reason") == "eligible") & F.col("taken").isNull(), "byte_bound").otherwise(F.col("reason")).alias("reason"))


def compact(
    spark: SparkSession, path: str, receipts: str, ledger: str, bundles: str, now: datetime, grace_seconds: int = 86_400, max_sources: int = MAX_SOURCES, max_bytes: int = MAX_BYTES,
    apply: bool = False, remove: bool = False, domain: str = "agent.ledger",
) -> DataFrame:
    """Source, bytes, reason of all source files; with ``apply`` the eligible ones become a bundle with a manifest, read back and compared, and the index of the archive is refreshed.

    The bundle is named by its content, so a repeated run publishes nothing twice. With ``remove`` the bundled files are deleted, after all of that. ``now`` needs a time zone.
    """
    if now.tzinfo is None:
        raise ValueError("now needs a time zone")
    if grace_seconds < 0 or max_sources < 1 or max_bytes < 1:
        raise ValueError("grace, sources and bytes have to be positive")
    listed = files(spark, path if "*" in path else f"{path.rstrip('/')}/*").select(F.col("path").alias("source"), "modified")
    listed = written(first_sources(listed, max_sources))
    chosen = [r["source"] for r in listed.where("not deferred").select("source").collect()]  # max_sources at most
    if not chosen:
        return spark.createDataFrame([], "source string, bytes bigint, reason string")
    events = source_events(spark, chosen)
    own, known = profiles(events), table_or_none(spark, receipts)
    own = own.withColumn("receipt", F.lit(None).cast("string")) if known is None else with_receipts(own, receipts_of(own, known, len(chosen)))
    placed = events.withColumn("domain", F.lit(domain))
    confirmed = unique.confirmed_sources(placed, unique.known_rows(spark, ledger, placed))
    out = written(reasons(listed.join(own, "source", "left"), confirmed, now, grace_seconds, max_bytes))
    if apply and out.where("reason = 'eligible'").take(1):
        eligible = out.where("reason = 'eligible'").select("source").join(own, "source").select(F.lit(SHARD).alias("shard"), "source", "bytes", "digest")
        publish(spark, eligible, events, bundles, max_bytes)
        if remove:
            delete(spark, [r["source"] for r in out.where("reason = 'eligible'").select("source").collect()])
    return out


def receipts_of(own: DataFrame, known: DataFrame, n: int) -> DataFrame:
    """The receipts under the keys of n sources: those of all others are not grouped, however many there are."""
    keys = own.select(F.explode(F.array(receipt_key(F.col("source"), F.col("digest")), legacy_key(F.col("source")))).alias("key"))
    return known.join(F.broadcast(keys) if n <= MOST_SENT else keys, "key", "left_semi")


def publish(spark: SparkSession, sources: DataFrame, events: DataFrame, bundles: str, max_bytes: int) -> str:
    """Writes one bundle of the sources' lines (max_bytes at most, so one file), its manifest and the index; the bundle's name. Raises if what is read back differs."""
    placed = written(sinks.bundle(sources, max_bytes, "shard"))
    manifest = sinks.manifests(placed, "shard")
    name = manifest.first()["manifest_sha256"]
    folder = f"{bundles.rstrip('/')}/{name}.bundle.jsonl"
    known = table_or_none(spark, f"{bundles.rstrip('/')}/manifests")
    if known is None or not known.where(F.col("manifest_sha256") == name).take(1):
        body = events.join(F.broadcast(placed.select("source", "start_offset")), "source").select("start_offset", "seq", "value")
        body.coalesce(1).sortWithinPartitions("start_offset", "seq").select("value").write.mode("overwrite").text(folder)
        found = sinks.intact(manifest, "shard", bundle_sources(spark, folder, placed.withColumn("bundle", F.lit(name))))
        if found.where("not intact").take(1):
            raise ValueError(f"{folder} reads back as something else")
        manifest.withColumn("path", F.lit(folder)).write.mode("append").parquet(f"{bundles.rstrip('/')}/manifests")
    refresh(spark, bundles)
    return name


def refresh(spark: SparkSession, bundles: str) -> bool:
    """The index of the archive from all manifests; whether it changed."""
    return sinks.refresh_index(sinks.archive_index(archive(spark, bundles), NAME), f"{bundles.rstrip('/')}/index")


#: Bytes of a bundle whose lines look for their source together.
CELL = 1 << 16


def bundle_events(spark: SparkSession, paths: str | list[str], placed: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The events of bundles' lines with their bundle and the source each belongs to (null: none), all bundles in one read. placed: bundle (digest of its manifest), source, start_offset, end_offset.

    Lines meet their sources by bundle and cell of bytes, so a bundle may have any number of sources.
    """
    own = source_events(spark, paths, None, True, scratch).withColumn("bundle", F.regexp_extract("source", r"([^/]+)\.bundle\.jsonl/[^/]+$", 1)).withColumn("cell", F.floor(F.col("seq") / CELL))
    cells = F.sequence(F.floor(F.col("start_offset") / CELL), F.floor((F.greatest("end_offset", F.col("start_offset") + 1) - 1) / CELL))
    spans = placed.select(F.col("bundle").alias("__bundle"), F.col("source").alias("__of"), F.col("start_offset").alias("__a"), F.col("end_offset").alias("__b"), F.explode(cells).alias("__cell"))
    within = (F.col("bundle") == F.col("__bundle")) & (F.col("cell") == F.col("__cell")) & (F.col("seq") >= F.col("__a")) & (F.col("seq") + F.col("width") <= F.col("__b"))
    return own.join(spans, within, "left").select("bundle", F.col("__of").alias("source"), (F.col("seq") - F.col("__a")).alias("seq"), "width", "event_id", "kind", "fp", "canonical", "errors", "value")


def bundle_sources(spark: SparkSession, folder: str, placed: DataFrame) -> DataFrame:
    """source, bytes, digest as a bundle's bytes give them."""
    return profiles(bundle_events(spark, folder, placed)).select("source", "bytes", "digest")


def archive(spark: SparkSession, bundles: str) -> DataFrame:
    """The manifests of all bundles, each once."""
    return spark.read.parquet(f"{bundles.rstrip('/')}/manifests").dropDuplicates(["manifest_sha256"])


def archive_faults(spark: SparkSession, bundles: str) -> DataFrame:
    """Source and fault of the archive's index against its manifests; a missing index lacks all sources."""
    manifest = archive(spark, bundles)
    index = table_or_none(spark, f"{bundles.rstrip('/')}/index")
    index = sinks.archive_index(manifest, NAME).limit(0) if index is None else index
    return sinks.index_faults(index, manifest, NAME)


def rebuild(spark: SparkSession, bundles: str, ledger: str, domain: str = "agent.ledger") -> tuple[int, int]:
    """Fills an empty ledger from all bundles, which are read once; refuses if the ledger has rows or a manifest, a bundle or the index has a fault. (written, skipped) as of an append."""
    table = table_or_none(spark, ledger)
    if table is not None and table.take(1):
        raise ValueError("the ledger is not empty")
    with Scratch(spark) as scratch:
        manifest = scratch.written(archive(spark, bundles))
        if sinks.intact(manifest, "shard").where("not intact").take(1):
            raise ValueError("a manifest is not intact")
        fault = archive_faults(spark, bundles).take(1)
        if fault:
            raise ValueError(f"the index has a fault: {fault[0]['source']} {fault[0]['fault']}")
        if not manifest.take(1):
            return 0, 0
        placed = manifest.select(F.col(NAME).alias("bundle"), F.explode("sources").alias("e")).select("bundle", "e.*")
        events = scratch.written(bundle_events(spark, f"{bundles.rstrip('/')}/*.bundle.jsonl", placed, scratch))
        found = profiles(events, "bundle", "source").select("bundle", "source", F.col("digest").alias("now"))
        other = found.join(placed, (found["bundle"] == placed["bundle"]) & found["source"].eqNullSafe(placed["source"]), "full_outer").where("not (now <=> digest)").select(F.coalesce(placed["bundle"], found["bundle"]))
        if bad := other.take(1):
            raise ValueError(f"the bundle {bad[0][0]} does not hold what its manifest says")
        return unique.append_unique(events.select(F.lit(domain).alias("domain"), "event_id", "fp", F.col("source").alias("group_pos"), F.col("seq").alias("row_pos"), F.col("canonical").alias("payload")), ledger)
