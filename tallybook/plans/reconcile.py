"""Import of source files into a ledger, with receipts, as jobs over tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.digests import canonical_json, compact, content_id, fingerprint, fingerprint_of
from ..functions.values import member
from ..operators import unique
from ..operators.contracts import KINDS, plain_event, with_agent_run_errors
from ..operators.history import produced_by
from ..sources.jsonl import described_lines, files, lines, on_local_disk, records
from ..sources.scratch import Scratch, scratch_dir, table_or_none, written
from .folds import merkle, merkle_root

#: Bytes of a file whose lines are digested together.
BLOCK_BYTES = 1 << 18


EVENT = ["source", "seq", "width", "event_id", "kind", "fp", "canonical", "errors", "value", "profiled", "profile"]
PROFILE = "struct<bytes: bigint, n_events: bigint, event_ids: array<string>, last_kind: string, digest: string, valid: boolean>"
#: What a task tells of a line: whether its file is profiled, at one of its lines the profile, and whether the line is judged.
DESCRIBED = f"source string, seq bigint, width bigint, cut boolean, event_id string, kind string, fp binary, canonical string, errors array<string>, value string, profiled boolean, profile {PROFILE}, judged boolean"
#: Bytes of lines that go from a task's Python to Spark at once; files up to that size are profiled where they are read.
BATCH = 1 << 20


def described(producer: tuple[str, str] | None, texts: bool) -> Callable[[Iterator], Iterator[pa.RecordBatch]]:
    """Batches of DESCRIBED for the lines of files; blank ones are passed over, and of the others ``plain_event`` judges those it can. With ``texts`` the lines themselves come along in any case."""
    profile = pa.struct([("bytes", pa.int64()), ("n_events", pa.int64()), ("event_ids", pa.list_(pa.string())), ("last_kind", pa.string()), ("digest", pa.string()), ("valid", pa.bool_())])
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.binary(), pa.string(), pa.list_(pa.string()), pa.string(), pa.bool_(), profile, pa.bool_()]
    names = ["source", "seq", "width", "cut", "event_id", "kind", "fp", "canonical", "errors", "value", "profiled", "profile", "judged"]
    table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    def judged(value: str, cut: bool) -> tuple | None:
        """event_id, kind, fp, canonical, errors of a line, None if it is left to Spark."""
        found = plain_event(value)
        if not found:
            return None
        event, errors = found
        by = event.get("source")
        repo, component = (by.get("repo"), by.get("component")) if by.__class__ is dict else (None, None)
        event_id, kind = event.get("event_id"), event.get("kind")
        for x in (event_id, kind, repo, component):
            if x is not None and x.__class__ is not str:
                return None
        if cut:
            errors = ["cut off"]
        elif producer and not errors:
            errors = ["other producer"] if (repo, component) != producer else ["other kind"] if kind not in KINDS else []
        canonical = compact(event).encode()
        return event_id, kind, fingerprint_of(canonical), canonical, errors

    def profiled(rows: list[tuple]) -> dict:
        leaves = [(r[1], r[6].hex().upper()) for r in rows]
        ids = sorted(r[4] for r in rows if r[4] is not None)
        return {"bytes": sum(r[2] for r in rows), "n_events": len(rows), "event_ids": ids, "last_kind": rows[-1][5], "digest": merkle_root(leaves, BLOCK_BYTES), "valid": not any(r[8] for r in rows)}

    def run(found):
        rows, held = [], 0
        for source, end, there in found:
            first, small = len(rows), end <= BATCH
            for start, after, raw in there:
                value = raw.decode(errors="replace")
                if not value.strip(" "):
                    continue
                cut = after > end
                own = judged(value, cut)
                if own:
                    rows.append((source, start, after - start, cut, *own, value if texts else None, small, None, True))
                else:
                    rows.append((source, start, after - start, cut, None, None, None, None, None, value, False, None, False))
                    small = False
                held += after - start
                if held > BATCH and end > BATCH:
                    yield table(rows)
                    rows, held = [], 0
            if end <= BATCH and len(rows) > first:
                own = rows[first:]
                rows[first:] = [(*r[:10], small, None, r[12]) for r in own[:-1]] + [(*own[-1][:10], small, profiled(own) if small else None, own[-1][12])]
            if held > BATCH:
                yield table(rows)
                rows, held = [], 0
        if rows:
            yield table(rows)

    return run


def source_events(spark: SparkSession, path: str | list[str] | DataFrame, producer: tuple[str, str] | None = None, texts: bool = True, scratch: Scratch | None = None) -> DataFrame:
    """EVENT of each line of each source file, as a table; the files are those of a glob, of a list of names or of a listing (path, bytes). A cut-off last line is an error; so is (F12) an event that is not of ``producer`` (repo, component).

    The tasks read a line, judge it and write its canonical form in one pass, and profile the files they have whole; only lines that ``plain_event`` leaves to Spark go through its
    expressions. Without ``texts`` value is null but for these.
    """
    keep = scratch.written if scratch else written
    listed = path if isinstance(path, DataFrame) else files(spark, path, keep)
    first = listed.select("path").first()
    if first and not on_local_disk(spark, first["path"]):
        read = lines(spark, path if isinstance(path, str) else [r["path"] for r in listed.select("path").collect()]).where(F.trim("value") != "")
        own = read.select(F.col("path").alias("source"), "seq", (F.col("next_offset") - F.col("start_offset")).alias("width"), "value", (F.col("next_offset") > F.col("file_size")).alias("cut"))
        return keep(with_no_profile(line_events(own, producer)))
    own = keep(described_lines(spark, listed, described(tuple(producer) if producer else None, texts), DESCRIBED))
    events, odd = own.where("judged").select(EVENT), own.where("not judged")
    if odd.take(1):
        events = events.unionByName(keep(with_no_profile(line_events(odd.select("source", "seq", "width", "value", "cut"), producer))))
    return events


def with_no_profile(events: DataFrame) -> DataFrame:
    return events.withColumns({"profiled": F.lit(False), "profile": F.lit(None).cast(PROFILE)}).select(EVENT)


def line_events(own: DataFrame, producer: tuple[str, str] | None = None) -> DataFrame:
    """EVENT of lines by Spark's expressions alone: source, seq, value, cut (whether its end is missing), and width if it is there."""
    width = ["width"] if "width" in own.columns else []
    own = with_agent_run_errors(records(own), "v", "__errors").withColumn("canonical", canonical_json("value"))
    text = lambda p: member(F.col("v"), p, "string")
    own = own.withColumns({"kind": text("$.kind"), "source_repo": text("$.source.repo"), "source_component": text("$.source.component")})
    other = produced_by(*producer, KINDS) if producer else F.lit(None).cast("string")
    errors = F.when(~F.col("valid"), F.array(F.lit("not an object"))).when(F.col("cut"), F.array(F.lit("cut off"))).when(F.size("__errors") > 0, F.col("__errors")).when(other.isNotNull(), F.array(other))
    errors = errors.otherwise(F.array().cast("array<string>"))
    return own.select("source", "seq", *width, text("$.event_id").alias("event_id"), "kind", fingerprint(F.col("canonical")).alias("fp"), "canonical", errors.alias("errors"), "value")


def profiles(events: DataFrame, *keys: str) -> DataFrame:
    """Bytes, events, ids and last kind of each source, digest over its lines' fingerprints, and whether it is valid. ``keys`` in place of source.

    Lines are digested in blocks of BLOCK_BYTES, and these by their digests, level by level: the digest binds every line's place and does not depend on how a file is split. The ids
    of a source are one list, as its receipt has them. What the tasks have profiled as they read it is taken from there.
    """
    if not keys and "profile" in events.columns:
        told, rest = events.where("profile is not null").select("source", "profile.*"), events.where("not profiled")
        return told.unionByName(profiles(rest, "source")) if rest.take(1) else told
    keys = keys or ("source",)
    totals = events.groupBy(*keys).agg(
        F.sum("width").alias("bytes"), F.count("*").alias("n_events"), F.sort_array(F.collect_list("event_id")).alias("event_ids"), F.max_by("kind", "seq").alias("last_kind"), (F.max(F.size("errors")) == 0).alias("valid")
    )
    digests = merkle(events.select(*keys, "seq", F.hex("fp").alias("leaf")), list(keys), "leaf", BLOCK_BYTES)
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    return totals.join(digests.withColumnsRenamed({k: f"__{k}" for k in keys}), same, "left").select(*keys, "bytes", "n_events", "event_ids", "last_kind", "digest", "valid")


def receipt_key(source: Column, digest: Column) -> Column:
    """The key of a receipt, of path and content."""
    return F.sha2(F.to_json(F.struct(source.alias("source_path"), digest.alias("source_sha256"))), 256)


def legacy_key(source: Column) -> Column:
    """The former key, of the path alone."""
    return F.sha2(source, 256)


RECEIPT = ["bytes", "digest", "event_ids", "imported", "key", "n_events", "recorded_at", "skipped", "source"]


def signed(receipts: DataFrame) -> DataFrame:
    """K8: receipts with the digest of their own fields."""
    return receipts.withColumn("receipt_sha256", F.sha2(F.to_json(F.struct(*RECEIPT)), 256))


def event_list_receipt(events: DataFrame, imported: int, skipped: int) -> DataFrame:
    """K7: one row for an imported list of events (event_id, canonical): ids, counts, a digest of the batch and one of the receipt."""
    own = events.agg(*listed()).withColumns({"requested": F.size("event_ids"), "imported": F.lit(imported), "skipped": F.lit(skipped)})
    return with_receipt_digest(own)


def event_list_receipts(events: DataFrame, key: str) -> DataFrame:
    """K7: a receipt for the list of each key. events: key, event_id, canonical, new (whether it was imported)."""
    own = events.groupBy(key).agg(*listed(), F.count("*").alias("requested"), F.count_if("new").alias("imported")).withColumn("skipped", F.col("requested") - F.col("imported"))
    return with_receipt_digest(own)


def listed() -> list[Column]:
    """The sorted ids of a list of events, as its receipt names them, and the sorted digests of its content."""
    return [F.sort_array(F.collect_list("event_id")).alias("event_ids"), F.array_sort(F.collect_list(F.sha2("canonical", 256))).alias("content")]


def with_receipt_digest(own: DataFrame) -> DataFrame:
    own = own.withColumn("batch_sha256", F.sha2(F.concat_ws(",", "content"), 256)).drop("content")
    return own.withColumn("receipt_sha256", content_id(F.to_json(F.struct(*sorted(own.columns)))))


def with_receipts(own: DataFrame, receipts: DataFrame) -> DataFrame:
    """Profiles with ``receipt``: intact, broken or null (none). The receipt under the key of path and content counts; only where there is none, even a broken one, that under the path's key.

    A receipt is intact if every field fits the source, its counts add up and its digest is its own.
    """
    whole = receipts.withColumn("__own", F.sha2(F.to_json(F.struct(*RECEIPT)), 256) == F.col("receipt_sha256"))
    mine = whole.select(F.col("key").alias("__key"), F.struct("bytes", "digest", "event_ids", "imported", "n_events", "skipped", "source", "__own", "recorded_at").alias("r"))
    last = mine.groupBy("__key").agg(F.max_by("r", "r.recorded_at").alias("r"))
    keyed = own.withColumns({"__new": receipt_key(F.col("source"), F.col("digest")), "__old": legacy_key(F.col("source"))})
    joined = keyed.join(last.select(F.col("__key").alias("__new"), F.col("r").alias("__a")), "__new", "left").join(last.select(F.col("__key").alias("__old"), F.col("r").alias("__b")), "__old", "left")
    joined = joined.withColumn("__r", F.coalesce("__a", "__b"))
    r = lambda c: F.col(f"__r.{c}")
    fits = r("__own") & (r("source") == F.col("source")) & (r("bytes") == F.col("bytes")) & (r("digest") == F.col("digest")) & (r("event_ids") == F.col("event_ids")) & (r("n_events") == F.col("n_events"))
    fits &= (r("imported") >= 0) & (r("skipped") >= 0) & (r("imported") + r("skipped") == r("n_events"))
    state = F.when(F.col("__r").isNull(), F.lit(None).cast("string")).when(F.coalesce(fits, F.lit(False)), "intact").otherwise("broken")
    return joined.withColumn("receipt", state).select(*own.columns, "receipt")


SEEN = "source string, file_bytes bigint, modified timestamp, bytes bigint, n_events bigint, digest string, last_kind string, valid boolean, at timestamp"


#: New files that are named to a reading.
MOST_NAMED = 1 << 10
#: Files whose names are sent to all tasks; with more of them the events are joined by a shuffle.
MOST_SENT = 1 << 20


def import_sources(spark: SparkSession, path: str, ledger: str, receipts: str, domain: str = "agent.ledger", producer: tuple[str, str] | None = None, archived: DataFrame | None = None) -> DataFrame:
    """Imports the valid source files that no intact receipt covers; one row per source with its state.

    The listing comes first: a file whose path, size and time are those of its last reading is ``reused`` (or ``invalid`` still) without being read, so a run
    that finds no change reads no source, and one that finds a few reads these. Invalid sources become rows and stop nothing; a conflict with the
    ledger raises before anything is written. Importing again writes nothing. ``removed`` are sources read before that are no longer there; ``archived`` (source)
    are those that bundles hold. What was read of each file is kept beside the receipts. The ledger's identities are looked up once, in its index.
    """
    seen_path = f"{receipts.rstrip('/')}-seen"
    seen = table_or_none(spark, seen_path, SEEN)
    seen = spark.createDataFrame([], SEEN) if seen is None else seen
    fields = ("file_bytes", "modified", "bytes", "n_events", "digest", "last_kind", "valid")
    last = seen.groupBy("source").agg(F.max_by(F.struct(*fields), "at").alias("s"))
    with Scratch(spark) as scratch:
        listed = files(spark, path if "*" in path else f"{path.rstrip('/')}/*", scratch.written).select(F.col("path").alias("source"), F.col("bytes").alias("file_bytes"), "modified")
        # every file that is or was there
        joined = listed.join(last, "source", "full_outer").withColumns({"there": F.col("file_bytes").isNotNull(), "same": F.coalesce((F.col("s.file_bytes") == F.col("file_bytes")) & (F.col("s.modified") == F.col("modified")), F.lit(False))})
        joined = written(joined)
    totals = joined.agg(F.count_if("there").alias("n"), F.count_if(F.expr("there and not same")).alias("new")).first()
    state_of_old = F.when(~F.col("there"), "removed").when(F.col("s.valid"), "reused").otherwise("invalid")
    out = joined.where("same or not there").select("source", "s.n_events", "s.digest", "s.last_kind", state_of_old.alias("state"))
    if archived is not None:
        gone = archived.select("source", F.lit("removed").alias("state")).distinct()
        out = out.join(gone, ["source", "state"], "left_anti").select(out.columns)
    if not totals["new"]:
        return out
    with Scratch(spark) as scratch:
        # a listing, or the few new ones by name
        new = joined.where("there and not same").select(F.col("source").alias("path"), F.col("file_bytes").alias("bytes"))
        paths = [r["path"] for r in new.collect()] if totals["new"] <= MOST_NAMED and totals["new"] < totals["n"] else new
        events = source_events(spark, paths, producer, False, scratch)
        known = table_or_none(spark, receipts)
        own = profiles(events)
        own = own.withColumn("receipt", F.lit(None).cast("string")) if known is None else with_receipts(own, known)
        listing = joined.where("there").select("source", "file_bytes", "modified", F.col("s").isNotNull().alias("before"))
        state = F.when(~F.col("valid"), "invalid").when(F.col("receipt").eqNullSafe("intact"), "reused").when(F.col("before"), "changed").otherwise("added")
        sent = F.broadcast if totals["n"] <= MOST_SENT else lambda df: df
        judged = written(own.join(sent(listing), "source").withColumn("state", state))
        todo = judged.where("state in ('added', 'changed')")
        batch = events.join(sent(todo.select("source")), "source", "left_semi").select(F.lit(domain).alias("domain"), "event_id", "fp", F.col("source").alias("group_pos"), F.col("seq").alias("row_pos"), F.col("canonical").alias("payload"))
        imported = f"{scratch_dir(spark)}/imported-{uuid.uuid4().hex}"
        scratch.paths.append(imported)
        appended = unique.append(batch, ledger, groups=imported, dealt=True)
        firsts = spark.createDataFrame([], "source string, imported bigint") if not appended.written else spark.read.parquet(imported).select(F.col("group_pos").alias("source"), "imported")
        done = todo.join(sent(firsts), "source", "left").withColumns({"imported": F.coalesce("imported", F.lit(0).cast("long")), "recorded_at": F.current_timestamp(), "key": receipt_key(F.col("source"), F.col("digest"))})
        signed(done.withColumn("skipped", F.col("n_events") - F.col("imported")).select(*RECEIPT)).write.mode("append").parquet(receipts)
        judged.select("source", *fields, F.current_timestamp().alias("at")).write.mode("append").parquet(seen_path)
    return out.unionByName(judged.select("source", "n_events", "digest", "last_kind", "state"))


def import_totals(states: DataFrame) -> DataFrame:
    """Sources and events by state, over the rows of an import."""
    return states.groupBy("state").agg(F.count("*").alias("sources"), F.sum("n_events").alias("events"))
