"""Outbox files and their delivery, with progress receipts."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.texts import safe_part
from ..operators.contracts import with_agent_run_errors
from ..operators.envelope import with_domain
from ..operators.history import latest_by
from ..sources.growing import file_system
from ..sources.jsonl import lines, records
from ..sources.scratch import Scratch, delete, table_or_none, written
from ..sources.sinks import write_folders
from .folds import START, hash_chain

PROGRESS = "source string, bytes bigint, events bigint, chain string, at timestamp"


def append_outbox(events: DataFrame, path: str, refuse_all: bool = True) -> DataFrame:
    """Appends valid agent-run events (value: canonical JSON, seq: their order) to one folder for each producer and run, in one file in order of seq; returns value and errors of the others.

    If one is not valid it raises and appends nothing, or without ``refuse_all`` appends the valid ones.
    """
    order = ["seq"] if "seq" in events.columns else []
    own = written(with_agent_run_errors(records(events.select("value", *order)), "v").drop("v"))
    refused = own.where(F.size("errors") > 0).select("value", "errors")
    bad = refused.take(1) if refuse_all else []
    if bad:
        raise ValueError(f"not an event: {bad[0]['errors'][0]}")
    v = F.try_parse_json("value")
    text = lambda p: F.try_variant_get(v, p, "string")
    fit = own.where(F.size("errors") == 0)
    parts = fit.select("value", *order, safe_part(F.concat_ws("_", text("$.source.repo"), text("$.source.component"))).alias("producer"), safe_part(text("$.source.run_id")).alias("run"))
    # the lines of a run are one file of each append, so that their order is theirs; a part without a name has the one that Spark gives it
    of = lambda c: F.concat(F.lit(f"{c}="), F.coalesce(c, F.lit("__HIVE_DEFAULT_PARTITION__")))
    write_folders(parts.withColumn("folder", F.concat_ws("/", of("producer"), of("run"))), path, f"part-{uuid.uuid4().hex}.txt")
    return refused


def progress_folder(receipts: str) -> str:
    """Where a run that goes on, or died, keeps how far each source is, a file for each."""
    return f"{receipts.rstrip('/')}-progress"


def progress(spark: SparkSession, receipts: str) -> DataFrame:
    """source, bytes, events, chain: how far each source is delivered, by the receipts and by what a run that died had accepted."""
    known = [t for t in (table_or_none(spark, receipts, PROGRESS), json_or_none(spark, progress_folder(receipts), PROGRESS)) if t is not None]
    if not known:
        return spark.createDataFrame([], PROGRESS).drop("at")
    table = known[0] if len(known) == 1 else known[0].unionByName(known[1])
    return table.groupBy("source").agg(F.max_by(F.struct("bytes", "events", "chain"), F.struct("events", "at")).alias("p")).select("source", "p.*")


def json_or_none(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def outbox_lines(spark: SparkSession, path: str) -> DataFrame:
    """source, start_offset, next_offset, seq, value of all complete lines that are not blank."""
    own = lines(spark, path).where((F.trim("value") != "") & (F.col("next_offset") <= F.col("file_size")))
    return own.select(F.col("path").alias("source"), "start_offset", "next_offset", "seq", "value")


def status(own: DataFrame, receipts: DataFrame) -> DataFrame:
    """Source, events, bytes and whether all of it is delivered. own: lines of the outbox; receipts: their progress."""
    sizes = own.groupBy("source").agg(F.count("*").alias("events"), F.max("next_offset").alias("bytes"))
    joined = sizes.join(receipts.select("source", F.col("bytes").alias("done"), F.col("events").alias("sent")), "source", "left")
    return joined.select("source", "events", "bytes", F.coalesce((F.col("done") == F.col("bytes")) & (F.col("sent") == F.col("events")), F.lit(False)).alias("flushed"))


def delivered(own: DataFrame, receipts: DataFrame) -> DataFrame:
    """The sources whose receipt covers all bytes; they may be deleted."""
    return status(own, receipts).where("flushed").select("source")


def pending(own: DataFrame, receipts: DataFrame) -> DataFrame:
    """The events of the files that are not delivered whole: source, seq, event_id, kind, ts, repo, run_id."""
    waiting = own.join(status(own, receipts).where("not flushed").select("source"), "source", "left_semi")
    text = lambda p: F.try_variant_get("v", p, "string")
    return records(waiting).where("valid").select("source", "seq", text("$.event_id").alias("event_id"), text("$.kind").alias("kind"), F.try_to_timestamp(text("$.ts")).alias("ts"), text("$.subject.repo").alias("repo"), text("$.source.run_id").alias("run_id"))


def preview(own: DataFrame, receipts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files that wait, newest event of each repo, of each repo and run) of what is pending."""
    events = pending(own, receipts).where("repo is not null")
    return status(own, receipts).where("not flushed"), latest_by(events, ["repo"], ["ts"]), latest_by(events, ["repo", "run_id"], ["ts"])


class Progress:
    """How far the sources of a run are, as files that survive the task: one for each source, replaced by each accepted request."""

    def __init__(self, folder: str):
        self.files, self.folder = file_system(folder)

    def path(self, source: str) -> str:
        return f"{self.folder}/{hashlib.sha256(source.encode()).hexdigest()}.json"

    def read(self, source: str) -> dict | None:
        try:
            with self.files.open_input_stream(self.path(source)) as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return None

    def write(self, source: str, size: int, events: int, chain: bytes) -> None:
        row = {"source": source, "bytes": size, "events": events, "chain": chain.hex(), "at": datetime.now(timezone.utc).isoformat()}
        self.files.create_dir(self.folder, recursive=True)
        draft = f"{self.folder}/.{uuid.uuid4().hex}"
        with self.files.open_output_stream(draft) as f:
            f.write(json.dumps(row).encode())
        self.files.move(draft, self.path(source))


def deliver(spark: SparkSession, path: str, receipts: str, send: Callable[[list[str]], int], limit: int) -> DataFrame:
    """Sends what is pending of every source in order, in requests of at most ``limit`` bytes; source, events, state (done, failed, changed).

    One pass, whatever the number of requests: the lines of a source stream by a task, which packs them, sends each request when it is full and notes how far the source is before it
    goes on. A task that dies is run again and goes on behind the last noted request, as does the next call after a run that died; a request is sent again at most once. A source whose
    request is refused (a status outside of 200 to 299) waits for the next call; one whose delivered part is no longer the same is not sent. Notes lie beside the receipts on a
    file system that pyarrow reads, and become receipts at the end. ``send`` runs on the executors and gets the events of a request as JSON texts. One run at a time.
    """
    folder = progress_folder(receipts)
    with Scratch(spark) as scratch:
        own, known = scratch.written(outbox_lines(spark, path)), scratch.written(progress(spark, receipts))
        if own.where(F.octet_length("value") + 2 > limit).take(1):
            raise ValueError("an item does not fit into a request of its own")
        behind = own.join(known.select("source", F.col("bytes").alias("done")), "source").where(F.col("next_offset") <= F.col("done"))
        kept = hash_chain(behind.select("source", "seq", "value"), "source").select("source", F.col("chain").alias("now"), F.col("records").alias("n"))
        changed = scratch.written(known.join(kept, "source", "left").where("not (chain <=> now and events <=> n)").select("source"))
        rest = own.join(known.withColumnsRenamed({"bytes": "done", "events": "sent"}), "source", "left").where("done is null or start_offset >= done").join(changed, "source", "left_anti")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            notes, source, out = Progress(folder), None, []
            held, size, chain, events, done, refused = [], 2, b"", 0, 0, False

            def flush() -> None:
                nonlocal held, size, chain, events, done, refused
                if held and not refused:
                    try:
                        refused = not 200 <= send([v for v, _ in held]) < 300
                    except Exception:  # the sender's own errors are refusals
                        refused = True
                    if not refused:
                        for value, _ in held:
                            chain = hashlib.sha256(chain + value.encode()).digest()
                        events, done = events + len(held), held[-1][1]
                        notes.write(source, done, events, chain)
                held, size = [], 2

            for batch in batches:
                for name, value, end, old, sent in zip(*(batch.column(i).to_pylist() for i in range(5))):
                    if name != source:
                        flush()
                        if source is not None:
                            out.append((source, done, events, chain.hex(), refused))
                        source, refused = name, False
                        noted = notes.read(source) or {"bytes": 0, "events": sent or 0, "chain": old or START.hex()}
                        done, events, chain = noted["bytes"], noted["events"], bytes.fromhex(noted["chain"])
                    if refused or end <= done:
                        continue
                    n = len(value.encode())
                    if held and size + 1 + n > limit:
                        flush()
                    size += n + bool(held)
                    held.append((value, end))
            flush()
            if source is not None:
                out.append((source, done, events, chain.hex(), refused))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], ["source", "bytes", "events", "chain", "refused"])

        ordered = rest.repartition("source").sortWithinPartitions("source", "seq").select("source", "value", "next_offset", "chain", "sent")
        sent = scratch.written(ordered.mapInArrow(run, "source string, bytes bigint, events bigint, chain string, refused boolean"))
        notes = json_or_none(spark, folder, PROGRESS)  # also those of runs that died
        if notes is not None:
            notes.write.mode("append").parquet(receipts)
            delete(spark, [folder])
        state = F.when(F.col("changed"), "changed").when(F.col("refused"), "failed").otherwise("done")
        told = own.select("source").distinct().join(sent.select("source", "refused"), "source", "left").join(changed.withColumn("changed", F.lit(True)), "source", "left")
        return written(told.join(progress(spark, receipts).select("source", "events"), "source", "left").select("source", F.coalesce("events", F.lit(0).cast("long")).alias("events"), state.alias("state")))


def raw_append(items: DataFrame, domain: str, path: str) -> None:
    """K4: appends items (value: JSON objects) as they are, with this domain in place of their own."""
    items.select(with_domain(F.col("value"), F.lit(domain)).alias("value"), F.lit(domain).alias("domain")).write.mode("append").partitionBy("domain").text(path)
