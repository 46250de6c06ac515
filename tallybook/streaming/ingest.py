"""Streams over the ledger: idempotent ingest, counters, state per repo."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.digests import fingerprint
from ..operators.unique import append
from ..plans.folds import hash_chain, step
from ..plans.reconcile import line_events
from ..sources.growing import GrowingLines
from ..sources.scratch import Scratch, table_or_none, written


def poll(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    """New Parquet files of a folder; the checkpoint is the cursor."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def ingest(stream: DataFrame, ledger: str, checkpoint: str, quarantine: str | None = None) -> StreamingQuery:
    """Appends each identity once, whatever is retried. stream: domain, event_id, payload, group_pos, row_pos.

    An event that diverges from the ledger stops the stream, or with ``quarantine`` goes to that folder, by batch, and the stream goes on.
    """

    def write(batch: DataFrame, number: int) -> None:
        append(batch.withColumn("fp", fingerprint(F.col("payload"))), ledger, f"{quarantine.rstrip('/')}/batch={number}" if quarantine else None)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counters(stream: DataFrame) -> DataFrame:
    """Running counts by domain and kind."""
    return stream.groupBy("domain", "kind").agg(F.count("*").alias("n"))


def states(reports: DataFrame) -> DataFrame:
    """W10 as a stream; a row for each repo whose state a batch changed. reports: repo, seq, status, generated (timestamp), received_at."""

    def run(key, batches, held):
        state = None
        if held.exists:
            status, at, sanitized = held.get
            state = {"status": status, "generated_at": pd.Timestamp(at), "sanitized": sanitized}
        rows = pd.concat(list(batches)).sort_values("seq")
        before = state
        for r in rows.itertuples():
            state = step(state, r.status, None if pd.isna(r.generated) else r.generated, r.received_at) or state
        if state and state != before:
            held.update((state["status"], state["generated_at"].to_pydatetime(), state["sanitized"]))
            yield pd.DataFrame([{"repo": key[0], **state}])

    return reports.groupBy("repo").applyInPandasWithState(
        run, "repo string, status string, generated_at timestamp, sanitized boolean", "status string, generated_at timestamp, sanitized boolean", "update", "NoTimeout"
    )


def chains(stream: DataFrame, key: str, state: str, checkpoint: str) -> StreamingQuery:
    """The hash chain of each key as its lines (key, seq, value) arrive; the table at ``state`` has (key, chain, records) of each batch that came to it.

    A batch that is run again after a failure starts from the chains before it, and its rows replace what it wrote.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = latest_chains(spark, key, state, number)
        own = written(batch.select(key, "seq", "value"))
        found = written(hash_chain(own, key, known.join(own.select(key).distinct(), key, "left_semi")))
        found.write.mode("overwrite").parquet(f"{state.rstrip('/')}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_chains(spark: SparkSession, key: str, state: str, before: int | None = None) -> DataFrame:
    """The chain and records of each key as of the last batch, or as of the one before a number."""
    table = table_or_none(spark, state)
    if table is None:
        return spark.createDataFrame([], f"{key} string, chain string, records bigint")
    if before is not None:
        table = table.where(F.col("batch") < before)
    return table.groupBy(key).agg(F.max_by(F.struct("chain", "records"), "batch").alias("s")).select(key, "s.chain", "s.records")


SOURCE_STATES = "source string, state string, events bigint, bytes bigint, error string"


def incremental_import(spark: SparkSession, folder: str, ledger: str, checkpoint: str, states: str, domain: str = "agent.ledger", quarantine: str | None = None) -> StreamingQuery:
    """Appends the events that source files have gained since the last call, of new files and of grown ones; only these bytes are read.

    The table at ``states`` gets a row for each source of a batch: ``added`` (its first events), ``grown``, or ``invalid`` with its first error. An invalid source's new
    events are not appended, nor are later ones; what a source had before stays. A batch that is run again after a failure replaces its rows and appends nothing twice.
    """
    spark.dataSource.register(GrowingLines)

    def write(batch: DataFrame, number: int) -> None:
        with Scratch(spark) as scratch:
            own = batch.where(F.trim("value") != "").select("source", F.col("start_offset").alias("seq"), "value", F.lit(False).alias("cut"))
            events = scratch.written(line_events(own))
            before = source_states(spark, states, number).select("source", F.col("state").alias("was"))
            first = F.min_by(F.try_element_at("errors", F.lit(1)), F.when(F.size("errors") > 0, F.col("seq")))
            found = events.groupBy("source").agg(F.count("*").alias("events"), F.max(F.col("seq") + F.octet_length("value") + 1).alias("bytes"), first.alias("error"))
            state = F.when(F.col("error").isNotNull() | F.col("was").eqNullSafe("invalid"), "invalid").when(F.col("was").isNull(), "added").otherwise("grown")
            judged = scratch.written(found.join(before, "source", "left").select("source", state.alias("state"), "events", "bytes", "error"))
            fit = events.join(judged.where("state <> 'invalid'").select("source"), "source", "left_semi")
            rows = fit.select(F.lit(domain).alias("domain"), "event_id", "fp", F.col("source").alias("group_pos"), F.col("seq").alias("row_pos"), F.col("canonical").alias("payload"))
            append(rows, ledger, f"{quarantine.rstrip('/')}/batch={number}" if quarantine else None)
            judged.write.mode("overwrite").parquet(f"{states.rstrip('/')}/batch={number}")

    stream = spark.readStream.format(GrowingLines.name()).load(folder)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def source_states(spark: SparkSession, states: str, before: int | None = None) -> DataFrame:
    """source, state, events (of all batches), bytes, error: the last state of each source; as of the batch before a number."""
    table = table_or_none(spark, states)
    if table is None:
        return spark.createDataFrame([], SOURCE_STATES)
    if before is not None:
        table = table.where(F.col("batch") < before)
    last = F.max_by(F.struct("state", "bytes", "error"), "batch").alias("s")
    return table.groupBy("source").agg(last, F.sum("events").alias("events")).select("source", "s.state", "events", "s.bytes", "s.error")


def validated(lines: DataFrame, key: str, state: str, contract: str, judge) -> DataFrame:
    """The lines with ``errors``; only those behind what an earlier call has judged under the same contract are judged by ``judge(lines)`` now.

    ``contract`` is a digest of the rules: another one judges all anew. lines: key, start_offset, next_offset and what the judge reads.
    """
    spark, path = lines.sparkSession, f"{state.rstrip('/')}/{contract}"
    known = table_or_none(spark, path)
    fresh = lines
    if known is not None:
        upto = known.groupBy(key).agg(F.max("next_offset").alias("__upto"))
        fresh = lines.join(upto, key, "left").where("__upto is null or start_offset >= __upto").drop("__upto")
    found = written(judge(fresh).select(key, "start_offset", "next_offset", "errors"))
    if found.take(1):
        found.write.mode("append").parquet(path)
    judged = found if known is None else known.select(found.columns).unionByName(found)
    return lines.join(judged.select(key, "start_offset", "errors"), [key, "start_offset"])
