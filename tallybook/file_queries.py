"""Registered queries that go through files and streams: the tables are written as the sources a job reads, and its results are compared with SQL over the tables."""

from __future__ import annotations

import hashlib
import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import digests, times
from .operators import closed, envelope, paging, unique, wrappers
from .plans import compaction, delivery, reconcile, retention
from .queries import ORACLE_SQL, QUERIES, payloads, query, unique_batch
from .sources import commits, jsonl, sinks
from .sources.bindings import ledger, spread, table
from .sources.growing import file_system
from .sources.scratch import scratch_dir, written
from .streaming import ingest

BLOCK = 4096


def folder(spark, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def part_of(name: str, path: str = "path"):
    """The value of a folder ``name=value`` in a path."""
    return F.regexp_extract(path, f"/{name}=([^/]+)/", 1)


def write_by_user(df: DataFrame, path: str, name: str = "user_id=") -> None:
    """A file for each user_id, ``<path>/<name><user_id>/part-0.txt``, of its lines (value, in order of seq if there is one)."""
    sinks.write_folders(df.withColumn("folder", F.concat(F.expr(name) if "(" in name else F.lit(name), "user_id")), path, "part-0.txt")


def lines_in_files(spark, sf_dir, blanks: bool = False) -> str:
    """The payloads of each domain in files of 4,096 numbers."""
    value = F.concat("payload", F.when(F.col("seq") % 10 == 0, F.lit("\n")).otherwise(F.lit(""))) if blanks else F.col("payload")
    own = payloads(spark, sf_dir).select("domain", F.floor(F.col("seq") / BLOCK).alias("block"), "seq", value.alias("value"))
    path = folder(spark, "lines")
    own.repartition("domain", "block").sortWithinPartitions("domain", "block", "seq").drop("seq").write.partitionBy("domain", "block").text(path)
    return path


@query(f", l AS (SELECT domain, seq // {BLOCK} AS block, payload, strlen(payload) + 1 AS width, sum(strlen(payload) + 1) OVER (PARTITION BY domain, seq // {BLOCK} ORDER BY seq) AS next_offset FROM payloads) SELECT domain, block, (next_offset - width)::BIGINT AS start_offset, next_offset::BIGINT AS next_offset, sha256(payload) AS digest FROM l")
def scanned_lines(spark, sf_dir):
    """S1, X1's scan: lines of files with their byte offsets."""
    own = jsonl.scan(spark, lines_in_files(spark, sf_dir))
    return own.select(part_of("domain").alias("domain"), part_of("block").cast("long").alias("block"), "start_offset", "next_offset", F.sha2("value", 256).alias("digest"))


@query("SELECT domain, seq // 4096 AS block, payload AS value FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY (seq // 4096)::VARCHAR || '/' DESC, seq DESC) AS n FROM payloads) WHERE n <= 40")
def tail_of_files(spark, sf_dir):
    """The last 40 lines of each domain's files, read from their end."""
    path, out = lines_in_files(spark, sf_dir), None
    for r in payloads(spark, sf_dir).select("domain").distinct().orderBy("domain").collect():  # a tail is of one domain
        own = jsonl.tail(spark, f"{path}/domain={r['domain']}/*/*.txt", 40, width=4096).select(part_of("domain").alias("domain"), part_of("block").cast("long").alias("block"), "value")
        out = own if out is None else out.unionByName(own)
    return out


@query("SELECT domain, count(*) AS n, count(DISTINCT payload) AS different FROM payloads GROUP BY domain")
def strict_batches(spark, sf_dir):
    """Blank lines are skipped, any other line has to be an object."""
    own = jsonl.strict_batch(spark, lines_in_files(spark, sf_dir, blanks=True))
    return own.groupBy(part_of("domain").alias("domain")).agg(F.count("*").alias("n"), F.countDistinct("value").alias("different"))


@query(f", s AS (SELECT domain, seq // {BLOCK} AS block, sum(strlen(payload) + 1)::BIGINT AS bytes FROM payloads GROUP BY ALL) SELECT domain, block, bytes, true AS same FROM s")
def stable_snapshots(spark, sf_dir):
    """The manifest of a snapshot, and that reading up to it gives the same lines."""
    path = lines_in_files(spark, sf_dir)
    first, sizes = jsonl.snapshot(spark, path)
    again, _ = jsonl.snapshot(spark, path, sizes=sizes)
    same = again.groupBy("path").agg(F.sum(F.xxhash64("value").cast("decimal(38,0)")).alias("a")).join(first.groupBy("path").agg(F.sum(F.xxhash64("value").cast("decimal(38,0)")).alias("b")), "path")
    return sizes.join(same, "path").select(part_of("domain").alias("domain"), part_of("block").cast("long").alias("block"), F.col("snapshot_bytes").alias("bytes"), (F.col("a") == F.col("b")).alias("same"))


def shaped_files(spark, sf_dir) -> str:
    """A file for each user: JSON lines, an array or an object of events."""
    own = payloads(spark, sf_dir).select("user_id", "seq", "payload")
    listed = own.where("user_id % 3 > 0").groupBy("user_id").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("seq", "payload"))), lambda x: x["payload"])).alias("all"))
    whole = listed.select("user_id", F.when(F.col("user_id") % 3 == 1, F.concat(F.lit("["), "all", F.lit("]"))).otherwise(F.concat(F.lit('{"events":['), "all", F.lit("]}"))).alias("value"))
    path = folder(spark, "shapes")
    write_by_user(own.where("user_id % 3 = 0").select("user_id", F.col("payload").alias("value")).unionByName(whole), path)
    return path


@query("SELECT user_id, count(*) AS n FROM ledger GROUP BY user_id")
def loaded_files(spark, sf_dir):
    """Records of files in three shapes."""
    own = jsonl.loaded(spark, shaped_files(spark, sf_dir), only_objects=True)
    return own.groupBy(part_of("user_id").cast("long").alias("user_id")).agg(F.count("*").alias("n"))


@query("SELECT user_id, count(*) AS n, sum(strlen(payload))::BIGINT AS bytes FROM payloads GROUP BY user_id")
def concatenated_values(spark, sf_dir):
    """Values that follow each other over several lines."""
    path = folder(spark, "stream")
    own = payloads(spark, sf_dir).select("user_id", F.regexp_replace("payload", ",", ",\n ").alias("value"))
    write_by_user(own, path)
    return jsonl.concatenated(spark, path).groupBy(part_of("user_id").cast("long").alias("user_id")).agg(F.count("*").alias("n"), F.sum(F.octet_length("value")).alias("bytes"))


@query("SELECT 'loose' AS kind, user_id % 7 AS producer, count(DISTINCT user_id) AS files, sum(strlen(payload) + 1)::BIGINT AS bytes FROM payloads GROUP BY ALL")
def outbox_inventory(spark, sf_dir):
    """What a glob over producers' outboxes finds, without reading it."""
    path = folder(spark, "root")
    write_by_user(payloads(spark, sf_dir).select("user_id", F.col("payload").alias("value")), path, "concat('producer=', user_id % 7, '/kind=outbox/user_id=')")
    found = jsonl.files(spark, f"{path}/*/kind=outbox/*/*.txt")
    return found.groupBy(F.lit("loose").alias("kind"), part_of("producer").cast("long").alias("producer")).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


@query("SELECT domain, event_id, seq % 20 AS group_pos FROM ledger")
def appended_ledger(spark, sf_dir):
    """K1-K3: all rows in a batch that is appended twice stand once; the index grows by a part of them first."""
    batch, known = unique_batch(spark, sf_dir)
    path = folder(spark, "ledger")
    for own in (batch.where("seq % 7 = 0 and group_pos < 100"), batch, batch):
        unique.append(own, path)
    return commits.committed(spark, path).select("domain", "event_id", "group_pos")


@query("SELECT domain, event_id, seq % 4 = 0 AS divergent FROM ledger")
def quarantined_events(spark, sf_dir):
    """Every fourth event of a second batch has another payload; these go to the quarantine, the ledger keeps what it has."""
    batch, _ = unique_batch(spark, sf_dir)
    path, odd = folder(spark, "ledger"), folder(spark, "odd")
    unique.append(batch, path)
    other = batch.where("group_pos < 100").withColumn("fp", F.when(F.col("seq") % 4 == 0, F.lit(b"other")).otherwise(F.col("fp")))
    unique.append(other, path, quarantine=odd)
    found = spark.read.parquet(odd).select(F.col("domain").alias("d"), F.col("event_id").alias("e"))
    kept = commits.committed(spark, path).select("domain", "event_id")
    return kept.join(found, (F.col("domain") == F.col("d")) & (F.col("event_id") == F.col("e")), "left").select("domain", "event_id", F.col("e").isNotNull().alias("divergent"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) AS n, 0 AS latest FROM ledger GROUP BY 1 UNION ALL SELECT strftime(max(ts), '%Y-%m-%d'), 1, 1 FROM ledger")
def metric_files(spark, sf_dir):
    """K5: files by date, and the newest, of two exports: that of the later dates keeps the files of the earlier ones."""
    path = folder(spark, "metrics")
    own = ledger(spark, sf_dir).select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("time_text"), F.col("event_id").alias("payload"), "seq")
    half = own.agg(F.substring(F.max("time_text"), 1, 8)).first()[0] + "15"
    for part in (F.col("time_text") < half, F.col("time_text") >= half):
        sinks.export_metrics(own.where(part), path)
    by_date = spark.read.json(f"{path}/by_date").groupBy(F.col("date").cast("string").alias("date")).agg(F.count("*").alias("n")).withColumn("latest", F.lit(0))
    return by_date.unionByName(spark.read.json(f"{path}/latest").groupBy(F.col("date").cast("string").alias("date")).agg(F.count("*").alias("n")).withColumn("latest", F.lit(1)))


@query("SELECT count(*) AS event_count, sum(strlen(payload) + 1)::BIGINT AS bytes, true AS bound FROM payloads WHERE repo = 'repo-7'")
def frozen_cohort(spark, sf_dir):
    """The receipt of a cohort, and that it is that of a second writing of the same rows."""
    whole = payloads(spark, sf_dir)
    own = whole.where("repo = 'repo-7'").select("event_id", "ts", "seq", F.col("payload").alias("value"))
    lines = whole.select("domain", "seq", F.col("payload").alias("value"))
    first, again = (sinks.freeze(own, folder(spark, "cohort"), {"repo": "repo-7"}, lines).first() for _ in range(2))
    bound = all(first[c] == again[c] for c in ("content_sha256", "snapshot_sha256", "query_sha256"))
    return spark.createDataFrame([(first["event_count"], first["bytes"], bound)], "event_count bigint, bytes bigint, bound boolean")


VALID_EVENT = """concat('{"schema_version":"agent-run-event.v0","event_id":"sha256:', sha2(event_id, 256), '","kind":"', element_at(array('agent.run.started', 'agent.run.completed', 'agent.run.blocked'), cast(seq % 3 + 1 as int)), '","ts":"', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
'","source":{"repo":"r","component":"c","run_id":"', run_id, '"},"subject":{"repo":"r"},"trust_tier":"observed","status":"active","caused_by":[],"evidence_refs":[],"data":{"operation":"', operation, '"', case when user_id % 10 = 3 then ',"more":1' else '' end, '}}')"""


def source_files(spark, sf_dir) -> str:
    """A file of events for each user; those of every tenth user break the contract."""
    path = folder(spark, "sources")
    own = spread(ledger(spark, sf_dir)).select("user_id", "seq", F.expr(VALID_EVENT).alias("value"))
    write_by_user(own, path)
    return path


@query("SELECT user_id, n AS n_events, state, run FROM (SELECT user_id, count(*) AS n FROM ledger GROUP BY user_id), (SELECT unnest([1, 2]) AS run), LATERAL (SELECT CASE WHEN user_id % 10 = 3 THEN 'invalid' WHEN run = 1 THEN 'added' ELSE 'reused' END AS state) x")
def import_states(spark, sf_dir):
    """The first import of all files, and a second one that reads none."""
    path, out = source_files(spark, sf_dir), None
    names = [folder(spark, x) for x in ("ledger", "receipts")]
    for run in (1, 2):
        states = reconcile.import_sources(spark, f"{path}/*/*.txt", *names).select(part_of("user_id", "source").cast("long").alias("user_id"), "n_events", "state", F.lit(run).alias("run"))
        states = spark.createDataFrame(states.toArrow())  # a row for each file, as of now
        out = states if out is None else out.unionByName(states)
    return out


@query("""SELECT user_id, count(*) AS n_events, sum(strlen(line) + 1)::BIGINT AS bytes, arg_max(kind, seq) AS last_kind, user_id % 10 <> 3 AS valid, array_to_string(list_sort(list(id)), ',') AS event_ids FROM (SELECT seq, user_id, 'sha256:' || sha256(event_id) AS id,
(['agent.run.started', 'agent.run.completed', 'agent.run.blocked'])[seq % 3 + 1] AS kind, '{"schema_version":"agent-run-event.v0","event_id":"sha256:' || sha256(event_id) || '","kind":"' || (['agent.run.started', 'agent.run.completed', 'agent.run.blocked'])[seq % 3 + 1] || '","ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ')
|| '","source":{"repo":"r","component":"c","run_id":"' || run_id || '"},"subject":{"repo":"r"},"trust_tier":"observed","status":"active","caused_by":[],"evidence_refs":[],"data":{"operation":"' || operation || '"' || CASE WHEN user_id % 10 = 3 THEN ',"more":1' ELSE '' END || '}}' AS line FROM ledger) GROUP BY user_id""")
def source_profiles(spark, sf_dir):
    """Bytes, ids, last kind and validity of each source file."""
    own = reconcile.profiles(reconcile.source_events(spark, f"{source_files(spark, sf_dir)}/*/*.txt"))
    return own.select(part_of("user_id", "source").cast("long").alias("user_id"), "n_events", "bytes", "last_kind", "valid", F.concat_ws(",", "event_ids").alias("event_ids"))


@query("""SELECT 'sha256:' || sha256(event_id) AS event_id FROM ledger JOIN (SELECT user_id FROM (SELECT user_id, arg_max(seq % 3, seq) AS last, row_number() OVER (ORDER BY user_id::VARCHAR || '/') AS n FROM ledger GROUP BY user_id) WHERE n <= 60 AND last > 0 AND user_id % 10 <> 3) USING (user_id)""")
def compacted_and_rebuilt(spark, sf_dir):
    """The first sixty files by path, those that are done and confirmed, as a bundle, and a ledger from it."""
    path = f"{source_files(spark, sf_dir)}/*/*.txt"
    own, receipts, bundles, again = (folder(spark, x) for x in ("ledger", "receipts", "bundles", "rebuilt"))
    reconcile.import_sources(spark, path, own, receipts)
    compaction.compact(spark, path, receipts, own, bundles, datetime(2100, 1, 1, tzinfo=timezone.utc), max_sources=60, apply=True)
    compaction.rebuild(spark, bundles, again)
    return spark.read.parquet(again).select("event_id")


@query("""SELECT run_id, event_ids, requested, imported, sha256(content) AS batch_sha256 FROM (SELECT run_id, array_to_string(list_sort(list(event_id)), ',') AS event_ids, count(*) AS requested, count_if(seq % 2 = 0)::BIGINT AS imported, array_to_string(list_sort(list(sha256(payload))), ',') AS content FROM payloads GROUP BY run_id)""")
def list_receipts(spark, sf_dir):
    """K7: the receipt of the list of each run's events, of which every other one is new."""
    own = payloads(spark, sf_dir).select("run_id", "event_id", F.col("payload").alias("canonical"), (F.col("seq") % 2 == 0).alias("new"))
    return reconcile.event_list_receipts(own, "run_id").select("run_id", F.concat_ws(",", "event_ids").alias("event_ids"), "requested", "imported", "batch_sha256")


def renamed(spark, path: str, target: str) -> None:
    """Files of folders ``user_id=<n>`` become ``<target>/<n>.jsonl``, in place of the ones that are there. The tasks move them."""
    files, place = file_system(target)
    files.create_dir(place, recursive=True)

    def run(batches):
        for batch in batches:
            for name, user in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                files, own = file_system(name)
                files.move(own, f"{file_system(target)[1]}/{user}.jsonl")
            yield batch.select([1])

    listed = jsonl.files(spark, f"{path}/*/*.txt").select("path", part_of("user_id").alias("u"))
    listed.mapInArrow(run, "u string").count()


@query("""SELECT user_id, CASE WHEN user_id % 10 = 3 THEN 'invalid' WHEN min(seq) < h AND max(seq) >= h THEN 'grown' ELSE 'added' END AS state, count(*) AS events, CASE WHEN user_id % 10 = 3 THEN 0 ELSE count(*) END AS appended
FROM ledger, (SELECT (max(seq) + 1) // 2 AS h FROM ledger) GROUP BY user_id, h""")
def streamed_import(spark, sf_dir):
    """Files of events by user that grow between two runs of the stream; the second one reads what came behind the first."""
    src, target, states, check = (folder(spark, x) for x in ("growing", "ledger", "states", "ck"))
    own = ledger(spark, sf_dir).select("user_id", "seq", F.expr(VALID_EVENT).alias("value"))
    half = (own.agg(F.max("seq")).first()[0] + 1) // 2
    for part in (own.where(F.col("seq") < half), own):
        path = folder(spark, "parts")
        write_by_user(part, path)
        renamed(spark, path, src)
        ingest.incremental_import(spark, src, target, check, states).awaitTermination()
    name = lambda c: F.regexp_extract(c, r"([0-9]+)\.jsonl$", 1).cast("long")
    there = commits.committed(spark, target).groupBy(name("group_pos").alias("u")).agg(F.count("*").alias("appended"))
    found = ingest.source_states(spark, states).select(name("source").alias("user_id"), "state", "events")
    return found.join(there, F.col("user_id") == F.col("u"), "left").select("user_id", "state", "events", F.coalesce("appended", F.lit(0).cast("long")).alias("appended"))


@query("""SELECT user_id, fault FROM (SELECT user_id, unnest(CASE WHEN user_id % 3 = 0 THEN ['not in the index'] WHEN user_id % 3 = 1 THEN ['twice'] ELSE ['not in its bundle', 'not in the index'] END) AS fault
FROM (SELECT user_id, arg_max(seq % 3, seq) AS last, row_number() OVER (ORDER BY user_id::VARCHAR || '/') AS n FROM ledger GROUP BY user_id) WHERE n <= 60 AND last > 0 AND user_id % 10 <> 3)""")
def archive_faults(spark, sf_dir):
    """An index that lacks sources, has some twice and others in a bundle that is not theirs."""
    path = f"{source_files(spark, sf_dir)}/*/*.txt"
    own, receipts, bundles = (folder(spark, x) for x in ("ledger", "receipts", "bundles"))
    reconcile.import_sources(spark, path, own, receipts)
    compaction.compact(spark, path, receipts, own, bundles, datetime(2100, 1, 1, tzinfo=timezone.utc), max_sources=60, apply=True)
    index = written(spark.read.parquet(f"{bundles}/index"))
    user = lambda c: part_of("user_id", c).cast("long")
    kind = user("source") % 3
    wrong = index.where(kind == 1).unionByName(index.where(kind == 1)).unionByName(index.where(kind == 2).withColumn(compaction.NAME, F.lit("another")))
    wrong.write.mode("overwrite").parquet(f"{bundles}/index")
    return compaction.archive_faults(spark, bundles).select(user("source").alias("user_id"), "fault").distinct()


def accepted(values: list[str]) -> int:
    return 200 if values else 400


@query("SELECT user_id, count(*) AS events, 'done' AS state FROM ledger GROUP BY user_id")
def delivered_sources(spark, sf_dir):
    """All files delivered in requests of 16 kB, with progress after each."""
    out = delivery.deliver(spark, f"{source_files(spark, sf_dir)}/*/*.txt", folder(spark, "progress"), accepted, 16_384)
    return out.select(part_of("user_id", "source").cast("long").alias("user_id"), "events", "state")


def in_two_parts(spark, df: DataFrame, name: str) -> tuple[str, str]:
    """The folder of a table written in two batches of files by ``seq``, and its schema."""
    path = folder(spark, name)
    half = df.agg(F.percentile_approx("seq", 0.5)).first()[0] or 0
    df.where(F.col("seq") <= half).write.mode("append").parquet(path)
    df.where(F.col("seq") > half).write.mode("append").parquet(path)
    return path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


@query("SELECT domain, event_id FROM ledger")
def streamed_ingest(spark, sf_dir):
    """Batches of files appended once, and once more under a new cursor."""
    own = payloads(spark, sf_dir).select("domain", "event_id", "seq", F.lit(0).alias("group_pos"), F.col("seq").alias("row_pos"), "payload")
    path, schema = in_two_parts(spark, own, "in")
    target = folder(spark, "ledger")
    for _ in range(2):
        ingest.ingest(ingest.poll(spark, path, schema).drop("seq"), target, folder(spark, "ck")).awaitTermination()
    return spark.read.parquet(target).select("domain", "event_id")


@query()
def streamed_states(spark, sf_dir):
    """The states of W10, kept from batch to batch."""
    own = ledger(spark, sf_dir).where("repo is not null")
    generated = F.expr("""case when seq % 9 = 0 then 'soon' when seq % 9 = 1 then date_format(ts + interval 1 hour, "yyyy-MM-dd'T'HH:mm:ss'Z'") else date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'") end""")
    status = F.expr("case when seq % 7 = 0 then 'MISSING' when value >= 40 then 'WARN' else 'OK' end")
    reports = own.select("repo", "seq", status.alias("status"), times.parse_iso(generated).alias("generated"), F.col("ts").alias("received_at"))
    path, target = folder(spark, "in"), folder(spark, "states")
    bounds = reports.agg(F.percentile_approx("seq", [0.33, 0.66])).first()[0] or [0, 0]
    check = folder(spark, "ck")
    for i, part in enumerate((F.col("seq") <= bounds[0], (F.col("seq") > bounds[0]) & (F.col("seq") <= bounds[1]), F.col("seq") > bounds[1])):
        reports.where(part).write.mode("append").parquet(path)
        stream = ingest.states(ingest.poll(spark, path, "repo string, seq bigint, status string, generated timestamp, received_at timestamp"))
        stream.writeStream.outputMode("update").foreachBatch(lambda b, n, i=i: b.withColumn("n", F.lit(i * 1000 + n)).write.mode("append").parquet(target)).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    last = F.max_by(F.struct("status", "generated_at", "sanitized"), "n").alias("s")
    return spark.read.parquet(target).groupBy("repo").agg(last).select("repo", "s.*")


@query()
def streamed_chains(spark, sf_dir):
    """W11's chains, carried on by each batch."""
    own = payloads(spark, sf_dir).select(F.concat("domain", F.lit("/"), F.col("user_id")).alias("k"), "seq", F.col("payload").alias("value"))
    path, state, check = folder(spark, "in"), folder(spark, "chains"), folder(spark, "ck")
    half = own.agg(F.percentile_approx("seq", 0.5)).first()[0] or 0
    for part in (F.col("seq") <= half, F.col("seq") > half):
        own.where(part).write.mode("append").parquet(path)
        ingest.chains(ingest.poll(spark, path, "k string, seq bigint, value string"), "k", state, check).awaitTermination()
    return ingest.latest_chains(spark, "k", state)


@query("SELECT domain, kind, count(*) AS n FROM ledger GROUP BY ALL")
def streamed_counters(spark, sf_dir):
    """Counts kept by a stream."""
    path, schema = in_two_parts(spark, ledger(spark, sf_dir).select("domain", "kind", "seq"), "in")
    target = folder(spark, "counts")
    stream = ingest.counters(ingest.poll(spark, path, schema, 1))
    stream.writeStream.outputMode("complete").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(target)).option("checkpointLocation", folder(spark, "ck")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(target)


@query("SELECT domain, seq, value > 5 AS valid FROM ledger")
def validity_reused(spark, sf_dir):
    """Half of the lines judged first, then only the others."""
    own = ledger(spark, sf_dir).select("domain", "seq", F.col("seq").alias("start_offset"), (F.col("seq") + 1).alias("next_offset"), "value")
    judge = lambda lines: lines.withColumn("errors", F.when(F.col("value") > 5, F.array().cast("array<string>")).otherwise(F.array(F.lit("low"))))
    state = folder(spark, "valid")
    half = own.agg(F.percentile_approx("seq", 0.5)).first()[0] or 0
    ingest.validated(own.where(F.col("seq") <= half), "domain", state, "rules-1", judge).count()
    found = ingest.validated(own, "domain", state, "rules-1", judge)
    return found.select("domain", "seq", (F.size("errors") == 0).alias("valid"))


def templated(spark, sf_dir, good: dict, variants: list[tuple[str, object]]) -> DataFrame:
    """seq, text: ``good`` as JSON for one row in n, for the others with one path set to another value (None: taken away)."""
    texts = [json.dumps(good)]
    for path, value in variants:
        out = json.loads(texts[0])
        at = out
        *front, last = path.split(".")
        for k in front:
            at = at[int(k)] if isinstance(at, list) else at[k]
        if value is None:
            del at[last]
        else:
            at[int(last) if isinstance(at, list) else last] = value
        texts.append(json.dumps(out))
    return spread(ledger(spark, sf_dir).select("seq")).select("seq", F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("seq") % len(texts) + 1).cast("int")).alias("text"))


def first_of(errors: list[str | None]) -> str:
    """SQL for the expected first error by seq."""
    return f"SELECT seq, ([{', '.join('NULL' if e is None else chr(39) + e + chr(39) for e in errors)}]::VARCHAR[])[seq % {len(errors)} + 1] AS first_error FROM ledger"


HISTORY = {
    "schema_version": "own.v1", "domain": "own", "event_id": "e", "kind": "deployment", "ts": "2026-01-01T00:00:00Z", "source": {"origin": "o", "repo": "r", "component": "c", "version": "1"}, "correlation_id": "c",
    "source_evidence": [{"authority": "a", "reference": "r", "sha256": "0" * 64}], "privacy": {"classification": "public", "contains_personal_data": False},
    "lifecycle": {"state": "active", "target_event_id": "", "authority_reference": "x"}, "authority": {"primary_truth": "elsewhere", "writeback_allowed": False}, "payload": {},
}
HISTORY_CASES = [("kind", "x", "$.kind: not allowed"), ("extra", 1, "$: unknown key"), ("source_evidence.0.sha256", "0", "$.source_evidence: not allowed"), ("authority.primary_truth", "ledger:x", "$.authority.primary_truth: not allowed"), ("privacy.contains_personal_data", "no", "$.privacy.contains_personal_data: not allowed"), ("correlation_id", None, "$.correlation_id: missing")]


@query(first_of([None, *[e for _, _, e in HISTORY_CASES]]))
def history_contract(spark, sf_dir):
    """C13."""
    own = templated(spark, sf_dir, HISTORY, [(p, v) for p, v, _ in HISTORY_CASES]).withColumn("v", F.try_parse_json(F.replace("text", F.lit('"target_event_id": ""'), F.lit('"target_event_id": null'))))
    found = closed.with_history_errors(own, "v", {"$.schema_version": "own.v1", "$.domain": "own"}, r"^ledger(?:$|[.:/])")
    return found.select("seq", F.try_element_at("errors", F.lit(1)).alias("first_error"))


@query(first_of([None, "$.status: missing", "$.event: not allowed", None]))
def outside_contract(spark, sf_dir):
    """Other keys are free."""
    own = templated(spark, sf_dir, {"event": "e", "status": "s"}, [("status", None), ("event", 5), ("more", 1)]).withColumn("v", F.try_parse_json("text"))
    return closed.with_outside_errors(own, "v").select("seq", F.try_element_at("errors", F.lit(1)).alias("first_error"))


SIGHTING = {"source_type": "health_endpoint", "observed_at": "2026-01-01T00:00:00Z", "authority_label": "observed_runtime", "provenance": {"uri": "u"}, "summary": "s"}
RUNTIME = {
    "schema_version": "runtime-lens-observation.v1", "event_id": "sha256:" + "0" * 64, "kind": "runtime.lens.observation", "ts": "2026-01-01T00:00:00Z", "source": {"repo": "r", "component": "c", "run_id": "n"}, "subject": {"system": "s", "repo": "r"},
    "code_evidence": {"authority_label": "snapshot", "snapshot": {"stem": "s", "repo": "r", "commit": "abcdef1", "manifest_sha256": "0" * 64}, "citations": [{"ref": "r", "source_file": "f", "line_start": 1, "line_end": 2, "content_sha256": "0" * 64}]},
    "runtime_evidence": [SIGHTING], "drift": {"status": "unknown", "basis": "none", "summary": "s"}, "authority": {"code_authority": "c", "runtime_authority": "r", "verdict_authority": "none"}, "boundary": {"forbidden": ["deploy", "write"]}, "non_claims": ["x", "y"],
}
RUNTIME_CASES = [("runtime_evidence.0", SIGHTING | {"provenance": {}}, "$.runtime_evidence: not allowed"), ("code_evidence.citations.0.line_end", 0, "$.code_evidence.citations: not allowed"), ("boundary.forbidden", ["deploy"], "$.boundary.forbidden: not allowed"), ("non_claims", ["y", "x"], None), ("drift.status", "odd", "$.drift.status: not allowed")]


@query(first_of([None, *[e for _, _, e in RUNTIME_CASES]]))
def runtime_contract(spark, sf_dir):
    """C16."""
    own = templated(spark, sf_dir, RUNTIME, [(p, v) for p, v, _ in RUNTIME_CASES]).withColumn("v", F.try_parse_json("text"))
    given = {"$.code_evidence.authority_label": "snapshot", "$.authority.code_authority": "c", "$.authority.runtime_authority": "r", "$.boundary.forbidden": ("deploy", "write"), "$.non_claims": ("x", "y")}
    return closed.with_runtime_errors(own, "v", given).select("seq", F.try_element_at("errors", F.lit(1)).alias("first_error"))


DAY = {"ts": "2026-01-01", "topics": [], "questions": [], "deltas": [], "source": "s", "metadata": {"generated_at": "2026-01-01T00:00:00Z"}}
DAY_CASES = [("ts", "2026-13-01", "ts: not a date"), ("topics", 1, "topics: not an array"), ("more", 1, "unknown key"), ("deltas", None, "deltas: missing")]


@query(first_of([None, *[e for _, _, e in DAY_CASES]]))
def day_contract(spark, sf_dir):
    """C11."""
    own = templated(spark, sf_dir, DAY, [(p, v) for p, v, _ in DAY_CASES])
    return own.select("seq", F.try_element_at(wrappers.day_errors(F.try_parse_json("text")), F.lit(1)).alias("first_error"))


@query("SELECT seq, (['', 'ts', 'kind,ts,source', 'source'])[seq % 4 + 1] AS missing, (['', 'summary too long', 'domain mismatch', ''])[seq % 4 + 1] AS errors FROM ledger")
def ingest_rules(spark, sf_dir):
    """The rules of plain domains, and of a strict client."""
    item = F.expr("case seq % 4 when 0 then '{\"kind\":1,\"ts\":1,\"source\":1}' when 1 then concat('{\"kind\":1,\"source\":1,\"summary\":\"', repeat('x', 501), '\"}') when 2 then '{\"domain\":\"other\"}' else '{\"kind\":1,\"ts\":1,\"domain\":\"app.own\"}' end")
    own = ledger(spark, sf_dir).select("seq", F.try_parse_json(item).alias("v"))
    return own.select("seq", F.concat_ws(",", wrappers.client_errors(F.col("v"))).alias("missing"), F.concat_ws(",", wrappers.ingest_errors(F.col("v"), F.lit("app.own"), {}, enforce_provenance=False)).alias("errors"))


@query("SELECT 'repo-' || (user_id % 50) AS repo, 'u' || max(seq) AS url FROM ledger WHERE seq % 4 <> 1 AND seq % 3 <> 0 GROUP BY ALL")
def enabled_sources(spark, sf_dir):
    """The last enabled entry of each repo; lists without a time are passed over."""
    text = F.expr("""concat('{"generated_at":"', case when seq % 4 = 1 then 'x' else '2026-01-01T00:00:00Z' end, '","sources":[{"repo":"repo-', user_id % 50, '","summary_url":"u', seq, '"', case when seq % 3 = 0 then ',"enabled":false' when seq % 3 = 1 then ',"enabled":true' else '' end, '},{"repo":5,"summary_url":"v"},7]}')""")
    return wrappers.source_list(ledger(spark, sf_dir).select("seq", F.try_parse_json(text).alias("v")))


@query("""SELECT seq, CASE seq % 3 WHEN 0 THEN '{"a":1}' WHEN 1 THEN '{"b":[2,"x"]}' END AS data, CASE WHEN seq % 3 < 2 THEN 'p' || seq END AS producer FROM ledger""")
def legacy_items(spark, sf_dir):
    """The former form made into the present one; inner data come first, else the payload without kind and version."""
    item = F.expr("""case seq % 3 when 0 then concat('{"id":"i","source":"p', seq, '","timestamp":"t","payload":{"kind":"k","version":1,"data":{"a":1}}}') when 1 then concat('{"id":"i","source":"p', seq, '","timestamp":"t","payload":{"kind":"k","version":1,"b":[2,"x"]}}') else '{"id":"i"}' end""")
    made = F.try_parse_json(wrappers.from_legacy(F.try_parse_json(item)))
    return ledger(spark, sf_dir).select("seq", F.to_json(F.try_variant_get(made, "$.data", "variant")).alias("data"), F.try_variant_get(made, "$.meta.producer", "string").alias("producer"))


@query("SELECT 's' || (doc_id % 60) AS path, CASE WHEN bool_or(doc_id % 2 = 0) THEN 'loose' ELSE 'bundle' END AS origin FROM documents GROUP BY ALL")
def source_generations(spark, sf_dir):
    """One row for each path and digest, the loose one first."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("s"), F.col("doc_id") % 60).alias("path"), "doc_id")
    side = lambda df, origin: df.select("path", F.sha2("path", 256).alias("sha256"), F.sha2("path", 512).alias("fp"), F.lit(origin).alias("origin")).distinct()
    return unique.merged_generations(side(docs.where("doc_id % 2 = 0"), "loose"), side(docs.where("doc_id % 2 = 1"), "bundle")).select("path", "origin")



KEY = b"a key of the test"
INNER, OUTER = (bytes(b ^ pad for b in KEY.ljust(64, b"\0")).hex() for pad in (0x36, 0x5C))


@query(f"SELECT seq, CASE WHEN seq % 5 = 0 THEN 'unknown' ELSE 'anon:' || left(sha256(unhex('{OUTER}') || unhex(sha256(unhex('{INNER}') || encode('10.0.0.' || user_id)))), 20) END AS who FROM ledger")
def pseudonyms(spark, sf_dir):
    """T21."""
    address = F.when(F.col("seq") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("10.0.0."), "user_id"))
    return ledger(spark, sf_dir).select("seq", digests.pseudonym(address, KEY).alias("who"))


@query("SELECT seq, kind FROM ledger WHERE ts + to_days(CASE WHEN kind LIKE 'debug.%' THEN 7 WHEN kind LIKE '%.temp' THEN 1 ELSE 30 END) > TIMESTAMP '2024-01-20 00:00:00'")
def swept_ledger(spark, sf_dir):
    """A ledger that two sweeps clear of what has expired by then."""
    own = ledger(spark, sf_dir).select("seq", "kind", times.expiry(F.col("ts"), envelope.ttl_days(F.col("kind"))).alias("expires_at"))
    path = folder(spark, "ledger")
    retention.append_by_expiry(own, path)
    for day in (12, 20):
        retention.sweep(spark, path, datetime(2024, 1, day, tzinfo=timezone.utc))
    return spark.read.parquet(path).select("seq", "kind")


@query("""SELECT 'r_c' AS producer, 'run-' || user_id AS run, count(*) AS n, sha256(string_agg('sha256:' || sha256(event_id), ',' ORDER BY seq)) AS in_order FROM ledger WHERE user_id % 10 <> 3 GROUP BY ALL
UNION ALL SELECT 'refused', 'run-' || user_id, count(*), NULL FROM ledger WHERE user_id % 10 = 3 GROUP BY ALL""")
def outbox_appended(spark, sf_dir):
    """Valid events in a folder for each producer and run, in order; the others refused."""
    path = folder(spark, "box")
    own = spread(ledger(spark, sf_dir)).withColumn("run_id", F.concat(F.lit("run-"), "user_id")).select("seq", F.expr(VALID_EVENT).alias("value"))
    refused = delivery.append_outbox(own, path, refuse_all=False)
    text = lambda p: F.try_variant_get(F.try_parse_json("value"), p, "string")
    lines = jsonl.lines(spark, f"{path}/*/*/*.txt").select(part_of("producer").alias("producer"), part_of("run").alias("run"), "path", "start_offset", text("$.event_id").alias("id"))
    in_order = F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("path", "start_offset", "id"))), lambda x: x["id"]))
    kept = lines.groupBy("producer", "run").agg(F.count("*").alias("n"), F.sha2(in_order, 256).alias("in_order"))
    left = refused.groupBy(F.lit("refused").alias("producer"), text("$.source.run_id").alias("run")).agg(F.count("*").alias("n")).withColumn("in_order", F.lit(None).cast("string"))
    return kept.unionByName(left)


@query("SELECT seq, 'app.forced' AS domain, json_extract_string(payload, '$.event') AS event FROM payloads")
def raw_appended(spark, sf_dir):
    """K4: lines appended as they are but for their domain."""
    path = folder(spark, "raw")
    item = F.concat(F.lit('{"seq":'), "seq", F.lit(',"domain":"x",'), F.substring("payload", 2, 10_000))
    delivery.raw_append(payloads(spark, sf_dir).select(item.alias("value")), "app.forced", path)
    v = F.try_parse_json("value")
    return spark.read.text(path).select(F.try_variant_get(v, "$.seq", "bigint").alias("seq"), F.try_variant_get(v, "$.domain", "string").alias("domain"), F.try_variant_get(v, "$.event", "string").alias("event"))


@query("SELECT run_id, 'sha256:' || sha256(arg_max(event_id, struct_pack(t, seq))) AS event_id, max(t) AS ts FROM (SELECT *, date_trunc('second', ts) AS t FROM ledger WHERE user_id % 3 <> 0) GROUP BY run_id")
def pending_preview(spark, sf_dir):
    """The newest event of each run in the files that are not delivered whole."""
    own = ledger(spark, sf_dir).select("user_id", "seq", F.expr(VALID_EVENT).alias("value")).withColumn("source", F.concat(F.lit("u"), "user_id"))
    placed = paging.with_offsets(own.withColumn("width", F.octet_length("value").cast("long") + 1), "source", "width")
    ends = placed.groupBy("source").agg(F.max("user_id").alias("u"), F.max("next_offset").alias("bytes"), F.count("*").alias("events")).where("u % 3 = 0")
    _, _, runs = delivery.preview(placed.select("source", "start_offset", "next_offset", "seq", "value"), ends.select("source", "bytes", "events"))
    return runs.select("run_id", "event_id", "ts")


def exported(payload: dict, late: bool = False, digest: str | None = None, ref: str = "r") -> str:
    """An export of a routing outcome as JSON, its digests right unless given."""
    dump = lambda x: json.dumps(x, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()
    whole = {"version": "operator.routing_outcome.v1", "decision_id": "d", "ts": "2026-01-01T00:00:00Z", "task_class": "coding", "route_used": "a:b", "outcome": "success", "resolved": True, "reward": 1.0, "metrics": {"completion_state": "completed", "friction_count": 0, "blocked_by_platform_filter": False, "manual_operator_needed": False}, "does_not_establish": ["x"]} | payload
    out = {
        "schema_version": "export.v1", "kind": "operator.routing_outcome.exported", "ts": "2026-01-01T00:00:05Z", "source": {"repo": "own/repo", "component": "c", "revision": "a" * 40, "run_id": "n"}, "payload_contract": PIN,
        "payload_sha256": digest or hashlib.sha256(dump(whole)).hexdigest(), "payload": whole, "freshness": {"observed_at": "2026-01-01T00:00:09Z" if late else "2026-01-01T00:00:00Z", "exported_at": "2026-01-01T00:00:05Z", "consumer_must_recompute": True},
        "evidence_refs": [{"kind": "k", "ref": ref, "sha256": "0" * 64}], "non_claims": ["a", "b"],
        "boundary": {"transport_authority": "t", "payload_authority": "p", "routing_authority": "none", "raw_logs_included": False, "secrets_included": False, "auto_apply_permitted": False},
    }
    return json.dumps(out | {"event_id": "sha256:" + hashlib.sha256(dump(out)).hexdigest()})


PIN = {"owner": "o", "source_repository": "o", "source_revision": "b" * 40, "source_path": "p", "sha256": "c" * 64}
EXPORTS = [(exported({}), None), (exported({"reward": 2}), "$.payload.reward: not allowed"), (exported({}, late=True), "$.freshness.exported_at: before observed_at"), (exported({}, digest="0" * 64), "$.payload_sha256: not the payload''s"), (exported({}, ref="/home/me"), "$.evidence_refs[0].ref: private path")]


@query(first_of([e for _, e in EXPORTS]))
def export_contract(spark, sf_dir):
    """Contracts, pinned values, digests over canonical JSON, times, nothing that must not leave."""
    own = spread(ledger(spark, sf_dir).select("seq")).select("seq", F.element_at(F.array(*[F.lit(t) for t, _ in EXPORTS]), (F.col("seq") % len(EXPORTS) + 1).cast("int")).alias("text"))
    given = {f"$.payload_contract.{k}": v for k, v in PIN.items()} | {"$.schema_version": "export.v1", "$.source.repo": "own/repo", "$.boundary.transport_authority": "t", "$.boundary.payload_authority": "p", "$.non_claims": ("a", "b")}
    return closed.with_export_errors(own, "text", "seq", given).select("seq", F.try_element_at("errors", F.lit(1)).alias("first_error"))


# The streams give what the batches give.
ORACLE_SQL["streamed_states"], ORACLE_SQL["streamed_chains"] = ORACLE_SQL["reported_states"], ORACLE_SQL["hash_chains"]
__all__ = ["ORACLE_SQL", "QUERIES"]
