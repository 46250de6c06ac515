"""Registered queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import digests, texts, times, values
from .operators import contracts, envelope, history, paging, unique, wrappers
from .plans import compaction, delivery, folds, reconcile
from .sources import sinks
from .sources.bindings import ledger, payload_json, spread, table
from .sources.jsonl import snapshots

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

LEDGER = """ledger AS (
  SELECT event_id AS seq, 'e' || event_id AS event_id, ts, 'app.' || event_type AS domain,
    CASE event_type WHEN 'signup' THEN 'agent.run.started' WHEN 'purchase' THEN 'agent.run.completed' WHEN 'error' THEN 'agent.run.blocked' WHEN 'view' THEN 'debug.view' ELSE 'click.temp' END AS kind,
    'run-' || user_id || '-' || strftime(ts, '%Y%m%d') AS run_id,
    CASE WHEN user_id % 10 = 0 THEN 'host' END AS scope,
    CASE WHEN user_id % 10 = 0 THEN 'host-' || user_id END AS host,
    CASE WHEN user_id % 10 <> 0 THEN 'repo-' || (user_id % 20) END AS repo,
    (['implement', 'review', 'merge', 'deploy', 'runtime_verify', 'recovery', 'other'])[event_id % 7 + 1] AS operation,
    (['coding', 'review', 'merge', 'deploy', 'runtime_verify', 'recovery', 'maintenance', 'diagnostic', 'other'])[event_id % 9 + 1] AS task_class,
    'k' || json_extract_string(props, '$.k') AS blocker_code,
    CASE WHEN value > 40 THEN 'completed' WHEN value > 20 THEN '' END AS outcome,
    CASE WHEN value > 10 THEN 'completed' ELSE 'blocked' END AS result,
    value, user_id
  FROM events
), payloads AS (
  SELECT *, '{"' || CASE WHEN seq % 3 = 0 THEN 'kind' WHEN seq % 3 = 1 THEN 'type' ELSE 'label' END || '":"' || CASE WHEN seq % 11 = 0 THEN '' ELSE kind END || '"'
    || CASE WHEN seq % 5 <> 0 THEN ',"ts":null' ELSE '' END || CASE WHEN seq % 7 <> 0 THEN ',"source":{"repo":"r","component":""}' ELSE '' END
    || CASE WHEN seq % 2 = 0 THEN ',"event_id":7' ELSE '' END || CASE WHEN seq % 4 = 0 THEN ',"data":{}' ELSE '' END || ',"event":"fallback"}' AS payload
  FROM ledger
)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH RECURSIVE {LEDGER},{sql.removeprefix(', RECURSIVE')}" if sql.startswith(", RECURSIVE") else f"WITH {LEDGER}{sql}" if sql.startswith(",") else f"WITH {LEDGER}\n{sql}"
        return f

    return add


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger(spark, sf_dir).withColumn("payload", payload_json())


SINCE = "2024-01-10 12:00:00"
UNTIL = "2024-01-12 00:00:00"
SUMMARY_SQL = """SELECT dimension, value, count(*) AS n FROM (
  SELECT 'kind' AS dimension, kind AS value FROM ledger UNION ALL SELECT 'repo', coalesce(repo, 'unknown') FROM ledger UNION ALL SELECT 'host', host FROM ledger WHERE scope = 'host'
  UNION ALL SELECT 'target', CASE WHEN scope = 'host' THEN 'host:' || host ELSE 'repository:' || repo END FROM ledger UNION ALL SELECT 'operation', operation FROM ledger
  UNION ALL SELECT 'task_class', task_class FROM ledger UNION ALL SELECT 'blocker', coalesce(blocker_code, 'unspecified') FROM ledger WHERE kind = 'agent.run.blocked') GROUP BY ALL"""


@query("SELECT event_id, ts, kind, run_id, operation, task_class FROM ledger WHERE scope IS DISTINCT FROM 'host' AND repo = 'repo-7' ORDER BY ts DESC, event_id DESC, seq LIMIT 50")
def history_newest_first(spark, sf_dir):
    """F1, F2, O1, P15."""
    return history.newest(history.filtered(ledger(spark, sf_dir), repo="repo-7"), 50).select("event_id", "ts", "kind", "run_id", "operation", "task_class")


@query(f"SELECT event_id, host, operation, task_class, coalesce(nullif(outcome, ''), result) AS outcome FROM ledger WHERE scope = 'host' AND host = 'host-20' AND coalesce(nullif(outcome, ''), result) = 'completed' AND ts >= TIMESTAMP '{SINCE}'")
def history_host_outcome_since(spark, sf_dir):
    """F1-F4."""
    own = history.filtered(ledger(spark, sf_dir), host="host-20", outcome="completed", since=F.lit(SINCE).cast("timestamp"))
    return own.select("event_id", "host", "operation", "task_class", F.coalesce(history.blank_to_null(F.col("outcome")), "result").alias("outcome"))


@query("""SELECT op AS operation, task_class, count(*) AS n FROM (SELECT *, coalesce(nullif(CASE WHEN seq % 7 = 6 THEN '' ELSE operation END, ''), CASE WHEN seq % 2 = 0 THEN 'merge' END) AS op FROM ledger) WHERE op = 'merge' GROUP BY ALL""")
def history_operation_class(spark, sf_dir):
    """An event's own operation, else its subject's; the class is its own only."""
    own = ledger(spark, sf_dir).withColumns({"operation": F.expr("case when seq % 7 = 6 then '' else operation end"), "subject_operation": F.expr("case when seq % 2 = 0 then 'merge' end")})
    own = own.withColumn("operation", history.operation())
    return history.filtered(own, operation="merge").groupBy("operation", "task_class").agg(F.count("*").alias("n"))


@query(SUMMARY_SQL)
def operator_summary(spark, sf_dir):
    """A1."""
    return history.summary(ledger(spark, sf_dir))


@query("SELECT seq, CASE WHEN scope = 'host' THEN 'host' ELSE 'repository' END AS target_scope, coalesce(host, repo) AS target FROM ledger")
def event_targets(spark, sf_dir):
    """P14."""
    on_host = F.col("scope").eqNullSafe("host")
    return ledger(spark, sf_dir).select("seq", F.when(on_host, "host").otherwise("repository").alias("target_scope"), F.when(on_host, F.col("host")).otherwise(F.col("repo")).alias("target"))


@query("SELECT repo, arg_max(struct_pack(event_id, ts, kind), struct_pack(ts, seq)).event_id AS event_id, max(ts) AS ts FROM ledger WHERE repo IS NOT NULL GROUP BY repo")
def latest_per_repo(spark, sf_dir):
    """W1, O6; host events have no repository and go to quarantine."""
    return history.latest_by(ledger(spark, sf_dir).where("repo is not null").select("repo", "seq", "event_id", "ts"), ["repo"], ["ts"]).select("repo", "event_id", "ts")


@query("SELECT repo, run_id, event_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY repo, run_id ORDER BY ts DESC, seq DESC) AS r FROM ledger WHERE repo IS NOT NULL) WHERE r = 1")
def latest_per_run(spark, sf_dir):
    """W2."""
    own = ledger(spark, sf_dir).where("repo is not null").select("repo", "run_id", "seq", "event_id", "kind", "ts")
    return history.latest_by(own, ["repo", "run_id"], ["ts"]).select("repo", "run_id", "event_id", "kind")


@query("SELECT domain, seq, event_id FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY seq DESC) AS r FROM ledger) WHERE r = 1")
def last_line_per_domain(spark, sf_dir):
    """S4, W3, O5."""
    return paging.last_of_each(ledger(spark, sf_dir).select("domain", "seq", "event_id"), "domain")


@query("SELECT seq, event_id, domain FROM ledger ORDER BY seq DESC LIMIT 40")
def tail_lines(spark, sf_dir):
    """S3, O4."""
    return paging.tail(ledger(spark, sf_dir).select("seq", "event_id", "domain"), 40)


@query("SELECT seq, event_id FROM (SELECT * FROM ledger ORDER BY seq DESC LIMIT 40) WHERE value > 10")
def tail_then_filter(spark, sf_dir):
    """The limit comes before the filter."""
    return paging.tail(ledger(spark, sf_dir), 40).where("value > 10").select("seq", "event_id")


@query(f"SELECT seq, ts, domain FROM ledger WHERE ts >= TIMESTAMP '{SINCE}' AND ts < TIMESTAMP '{UNTIL}' ORDER BY seq DESC LIMIT 100")
def tail_window(spark, sf_dir):
    """F5, F6, O3."""
    return paging.window_tail(ledger(spark, sf_dir).select("seq", "ts", "domain"), "ts", F.lit(SINCE).cast("timestamp"), F.lit(UNTIL).cast("timestamp"), 100)


@query("SELECT DISTINCT domain FROM ledger WHERE starts_with(domain, 'app.')")
def list_domains(spark, sf_dir):
    """S5."""
    return paging.domains(ledger(spark, sf_dir), "app.")


@query("SELECT seq, event_id, value FROM ledger WHERE domain = 'app.signup'")
def domain_dump(spark, sf_dir):
    """S15."""
    return ledger(spark, sf_dir).where("domain = 'app.signup'").select("seq", "event_id", "value")


LINES_SQL = """l AS (SELECT domain, seq, event_id, ts, value > 5 AS valid, strlen(payload) + 1 AS width, sum(strlen(payload) + 1) OVER (PARTITION BY domain ORDER BY seq) AS next_offset FROM payloads)"""


def offset_lines(spark, sf_dir):
    """The lines of every domain with byte offsets."""
    own = payloads(spark, sf_dir).withColumn("width", F.octet_length("payload").cast("long") + 1).select("domain", "seq", "event_id", "ts", (F.col("value") > 5).alias("valid"), "width")
    return paging.with_offsets(own, "domain", "width")


@query(f", {LINES_SQL} SELECT domain, seq, (next_offset - width)::BIGINT AS start_offset, next_offset::BIGINT AS next_offset FROM l")
def byte_offsets(spark, sf_dir):
    """W6."""
    return offset_lines(spark, sf_dir).select("domain", "seq", "start_offset", "next_offset")


@query(f""", {LINES_SQL}, v AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY next_offset) AS r FROM l WHERE valid AND next_offset - width >= 1000)
SELECT d.domain, coalesce((SELECT string_agg(event_id, ',' ORDER BY r) FROM v WHERE v.domain = d.domain AND r <= 25), '') AS event_ids, exists(SELECT 1 FROM v WHERE v.domain = d.domain AND r = 26) AS has_more,
coalesce((SELECT (next_offset - width)::BIGINT FROM v WHERE v.domain = d.domain AND r = 26), d.e) AS next_cursor FROM (SELECT domain, max(next_offset)::BIGINT AS e FROM l GROUP BY domain) d""")
def cursor_page(spark, sf_dir):
    """O2: a page of every domain."""
    found = paging.pages(offset_lines(spark, sf_dir), "domain", 1000, 25)
    return found.select("domain", F.concat_ws(",", F.transform("items", lambda x: x["event_id"])).alias("event_ids"), "has_more", "next_cursor")


@query(f", {LINES_SQL} SELECT domain, '' AS event_ids, false AS has_more, max(next_offset)::BIGINT AS next_cursor FROM l GROUP BY domain")
def cursor_page_of_corrupt_lines(spark, sf_dir):
    """O2 where no line is valid: the cursor passes them."""
    found = paging.pages(offset_lines(spark, sf_dir).withColumn("valid", F.lit(False)), "domain", 0, 25)
    return found.select("domain", F.concat_ws(",", F.transform("items", lambda x: x["event_id"])).alias("event_ids"), "has_more", "next_cursor")


@query(f", {LINES_SQL} SELECT domain, count(*) AS total, count_if(valid) AS valid, count_if(NOT valid) AS invalid, max(next_offset)::BIGINT AS bytes, max(ts) FILTER (valid) AS last_seen FROM l GROUP BY domain")
def line_statistics(spark, sf_dir):
    """A2, A6, F8."""
    return paging.line_statistics(offset_lines(spark, sf_dir), "domain")


@query(f""", {LINES_SQL} SELECT domain, array_to_string(list((next_offset - width)::BIGINT ORDER BY next_offset)[1:20], ',') AS offsets, count(*) > 20 AS truncated FROM l WHERE NOT valid GROUP BY domain""")
def line_diagnostics(spark, sf_dir):
    """A2: the first invalid lines of every domain."""
    found = paging.diagnostics(offset_lines(spark, sf_dir), "domain")
    return found.select("domain", F.concat_ws(",", F.transform("offsets", lambda x: x.cast("string"))).alias("offsets"), "truncated")


@query(f", {LINES_SQL}, c AS (SELECT *, lag(next_offset) OVER (PARTITION BY domain ORDER BY seq) AS p FROM l WHERE domain <> 'app.click' OR seq % 100 <> 0) SELECT domain, bool_and(next_offset - width = coalesce(p, 0)) AS contiguous, max(next_offset)::BIGINT AS size FROM c GROUP BY domain")
def contiguous_ranges(spark, sf_dir):
    """Of every domain, one of which has gaps."""
    return history.contiguous(offset_lines(spark, sf_dir).where("domain <> 'app.click' or seq % 100 <> 0").withColumnRenamed("next_offset", "end_offset"), "domain")


TYPE_SQL = """coalesce(nullif(json_extract_string(payload, '$.kind'), ''), nullif(json_extract_string(payload, '$.type'), ''), json_extract_string(payload, '$.event'))"""
TTL_SQL = f"CASE WHEN {TYPE_SQL} LIKE 'debug.%' THEN 7 WHEN {TYPE_SQL} LIKE '%.temp' THEN 1 ELSE 30 END"


@query(f"SELECT seq, {TYPE_SQL} AS event_type FROM payloads")
def event_types(spark, sf_dir):
    """P1."""
    return payloads(spark, sf_dir).select("seq", envelope.event_type(F.try_parse_json("payload")).alias("event_type"))


@query(f"""SELECT seq, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') AS received_second, {TYPE_SQL} AS event_type, {TTL_SQL} AS ttl_days,
strftime(date_trunc('second', ts + to_days({TTL_SQL})), '%Y-%m-%dT%H:%M:%SZ') AS expires_at,
CASE WHEN s >= 4 THEN 'high' WHEN s >= 2 THEN 'medium' ELSE 'low' END AS signal_strength, seq % 5 <> 0 AND seq % 7 <> 0 AS completeness
FROM (SELECT *, 1 + (seq % 5 <> 0)::INT + (seq % 7 <> 0)::INT + (seq % 4 = 0 OR len(json_keys(payload)) > 3)::INT + (seq % 2 = 0)::INT AS s FROM payloads)""")
def envelopes(spark, sf_dir):
    """P2-P6, T6-T8, J4."""
    out = envelope.with_envelope(payloads(spark, sf_dir), "domain", "ts", "payload")
    return out.select("seq", "received_second", "event_type", "ttl_days", "expires_at", "signal_strength", "completeness")


@query(f"SELECT domain, event_type, count(*) AS n FROM (SELECT domain, {TYPE_SQL} AS event_type FROM payloads) GROUP BY ALL")
def ingest_counters(spark, sf_dir):
    """A4, T13."""
    own = payloads(spark, sf_dir).select("domain", texts.metric_label(envelope.event_type(F.try_parse_json("payload"))).alias("event_type"))
    return own.groupBy("domain", "event_type").agg(F.count("*").alias("n"))


@query(f"SELECT seq, kind FROM payloads WHERE ts + to_days({TTL_SQL}) > TIMESTAMP '2024-01-20 00:00:00'")
def unexpired_events(spark, sf_dir):
    """F14, X9."""
    own = payloads(spark, sf_dir)
    ttl = envelope.ttl_days(envelope.event_type(F.try_parse_json("payload")))
    return own.where(envelope.unexpired(times.expiry(F.col("ts"), ttl), F.lit("2024-01-20").cast("timestamp"))).select("seq", "kind")


@query("""SELECT seq, array_to_string(list_filter([CASE WHEN seq % 7 = 0 THEN 'source (must be an object)' END, CASE WHEN seq % 7 <> 0 THEN 'source.component' END,
CASE WHEN seq % 2 = 1 THEN 'event_id (or id)' ELSE 'event_id (must be a string)' END], lambda x: x IS NOT NULL), ', ') AS errors FROM payloads""")
def provenance(spark, sf_dir):
    """C4, C5."""
    return payloads(spark, sf_dir).select("seq", F.concat_ws(", ", contracts.provenance_errors(F.try_parse_json("payload"))).alias("errors"))


@query(r"""SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(text, '(?:^|[\s"''])/(?:home|root|Users)/') THEN 'private path' END, CASE WHEN contains(text, '-----BEGIN PRIVATE KEY-----') THEN 'private key' END,
CASE WHEN contains(text, 'Bearer ') OR contains(text, 'ghp_') OR contains(text, 'gho_') OR contains(text, 'sk-') OR contains(text, 'AKIA') THEN 'secret prefix' END,
CASE WHEN regexp_matches(text, '(?i)\b(?:api[_-]?key|token|secret|password)\s*[:=]\s*\S+') THEN 'secret assignment' END], lambda x: x IS NOT NULL), ',') AS findings FROM documents""")
def redaction(spark, sf_dir):
    """C15."""
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(",", contracts.redaction_findings(F.col("text"))).alias("findings"))


@query("SELECT doc_id, length(text) > 500 AS too_long FROM documents")
def summary_length(spark, sf_dir):
    """C2."""
    return table(spark, sf_dir, "documents").select("doc_id", contracts.summary_too_long(F.col("text")).alias("too_long"))


RUN_EVENT = """concat('{"schema_version":"agent-run-event.v0","event_id":"sha256:', sha2(event_id, 256), '","kind":"', kind, '","ts":"', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"), '","source":{"repo":"r","component":"c","run_id":"', run_id, '"},"subject":',
case when host is null then concat('{"repo":"', repo, '"}') when seq % 4 = 0 then concat('{"scope":"host","host":"', host, '"}') else concat('{"scope":"host","host":"', host, '","extra":1}') end,
',"trust_tier":"observed","status":"', case when seq % 13 = 0 then 'corrected' else 'active' end, '","caused_by":[],"evidence_refs":[', case when seq % 17 = 0 then '"a","a"' else '"a"' end, '],"data":{"operation":"', operation, '","task_class":"', task_class, '","duration_ms":', case when seq % 19 = 0 then 'true' else '5' end, '}}')"""


@query("""SELECT seq, kind LIKE 'agent.run.%' AND (host IS NULL OR seq % 4 = 0) AND seq % 13 <> 0 AND seq % 17 <> 0 AND seq % 19 <> 0 AS valid,
CASE WHEN host IS NOT NULL AND seq % 4 <> 0 THEN '$.subject: unknown key' WHEN kind NOT LIKE 'agent.run.%' THEN '$.kind: not allowed' WHEN seq % 19 = 0 THEN '$.data.duration_ms: not an integer of at least 0'
WHEN seq % 17 = 0 THEN '$.evidence_refs: items' WHEN seq % 13 = 0 THEN '$.corrects: missing' END AS first_error FROM ledger""")
def run_event_contract(spark, sf_dir):
    """Closed keys, enumerations, patterns, arrays, conditions; the first error in rule order."""
    own = contracts.with_agent_run_errors(spread(ledger(spark, sf_dir)).select("seq", F.try_parse_json(F.expr(RUN_EVENT)).alias("v")), "v")
    return own.select("seq", (F.size("errors") == 0).alias("valid"), F.try_element_at("errors", F.lit(1)).alias("first_error"))


@query("SELECT user_id, CASE WHEN max(value) >= 100 THEN 'FAIL' WHEN max(value) >= 40 THEN 'WARN' ELSE 'OK' END AS status FROM ledger GROUP BY user_id")
def status_by_user(spark, sf_dir):
    """T10, T11, A5 by key."""
    own = ledger(spark, sf_dir).withColumn("status", F.expr("case when value >= 100 then ' fail' when value >= 40 then 'Warn' else 'ok ' end"))
    s = history.normalized_status(F.col("status"))
    return own.groupBy("user_id").agg(F.max_by(s, history.severity(s)).alias("status"))


@query("SELECT CASE WHEN max(value) >= 100 THEN 'FAIL' WHEN max(value) >= 40 THEN 'WARN' ELSE 'OK' END AS status, count(*) AS reports FROM ledger")
def worst_status(spark, sf_dir):
    """A5."""
    own = ledger(spark, sf_dir).withColumn("status", F.expr("case when value >= 100 then ' fail' when value >= 40 then 'Warn' else 'ok ' end"))
    return history.worst_status(own)


@query("SELECT target, arg_max(state, seq) AS state, max(seq) AS last_seq, count(*) AS n FROM (SELECT *, CASE WHEN kind = 'agent.run.started' THEN 'e' || (seq // 3) ELSE event_id END AS target, kind AS state FROM ledger) GROUP BY target")
def lifecycle_states(spark, sf_dir):
    """W4, J10."""
    own = ledger(spark, sf_dir).withColumn("state", F.col("kind")).withColumn("target_event_id", F.expr("case when kind = 'agent.run.started' then concat('e', seq div 3) end"))
    return history.lifecycle(own)


@query("SELECT user_id, seq FROM (SELECT user_id, seq, value, max(value) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM ledger) WHERE b IS NULL OR value > b")
def newer_only(spark, sf_dir):
    """W10, its part without invalid times."""
    return history.newer_only(ledger(spark, sf_dir).select("user_id", "seq", "value"), "user_id", "value").select("user_id", "seq")


def unique_batch(spark, sf_dir):
    """Rows 0 mod 3 are the ledger; the batch has all rows, those of the even part twice, in groups."""
    own = ledger(spark, sf_dir).select("domain", "event_id", "seq", digests.fingerprint(F.concat("event_id", F.lit("|"), F.col("value").cast("decimal(18,2)").cast("string"))).alias("fp"))
    batch = own.withColumn("group_pos", F.col("seq") % 20).withColumn("row_pos", F.col("seq"))
    again = batch.where("seq % 2 = 0").withColumn("group_pos", F.col("group_pos") + 100)
    return batch.unionByName(again), own.where("seq % 3 = 0").select("domain", "event_id", "fp")


@query("SELECT domain, event_id, seq % 20 AS group_pos FROM ledger WHERE seq % 3 <> 0")
def unique_append(spark, sf_dir):
    """K2, K3, J1, W8."""
    batch, known = unique_batch(spark, sf_dir)
    return unique.new_rows(batch, known).select("domain", "event_id", "group_pos")


@query("""SELECT g AS group_pos, count(*) AS requested, count_if(w) AS written, count_if(NOT w) AS skipped, CASE WHEN count_if(w) = count(*) THEN 'accepted' WHEN count_if(w) = 0 THEN 'replayed' ELSE 'mixed' END AS delivery
FROM (SELECT seq % 20 AS g, seq % 3 <> 0 AS w FROM ledger UNION ALL SELECT seq % 20 + 100, false FROM ledger WHERE seq % 2 = 0) GROUP BY g""")
def unique_group_counts(spark, sf_dir):
    """K3, A10."""
    batch, known = unique_batch(spark, sf_dir)
    return unique.group_counts(batch, unique.new_rows(batch, known))


@query("SELECT domain, event_id FROM ledger WHERE seq % 3 = 0 AND seq % 5 = 0")
def identity_conflicts(spark, sf_dir):
    """J2, A14, S16."""
    batch, known = unique_batch(spark, sf_dir)
    known = known.withColumn("fp", F.when(F.substring("event_id", 2, 20).cast("long") % 5 == 0, F.lit(b"\0")).otherwise(F.col("fp")))
    return unique.conflicts(batch, known)


@query("SELECT domain, event_id FROM ledger WHERE seq % 3 <> 0")
def missing_identities(spark, sf_dir):
    """J3."""
    batch, known = unique_batch(spark, sf_dir)
    return unique.missing(batch.select("domain", "event_id").distinct(), known)


@query("SELECT 's' || (seq % 51) AS source, bool_and(seq % 3 = 0) AS confirmed, count(*) AS n FROM ledger GROUP BY ALL")
def confirmed_sources(spark, sf_dir):
    """J5."""
    own = ledger(spark, sf_dir).withColumn("fp", F.lit("x")).withColumn("source", F.concat(F.lit("s"), F.col("seq") % 51))
    return unique.confirmed_sources(own, ledger(spark, sf_dir).where("seq % 3 = 0").select("domain", "event_id", F.lit("x").alias("fp")))


@query("SELECT run_id AS path, CASE WHEN c AND NOT k THEN 'added' WHEN k AND NOT c THEN 'removed' WHEN a = b THEN 'reused' ELSE 'changed' END AS state FROM (SELECT run_id, bool_or(seq % 3 <> 0) AS c, bool_or(seq % 4 <> 0) AS k, sum(seq) FILTER (seq % 3 <> 0) AS a, sum(seq) FILTER (seq % 4 <> 0) AS b FROM ledger GROUP BY run_id) WHERE c OR k")
def inventory_delta(spark, sf_dir):
    """J7, U5."""
    own = ledger(spark, sf_dir)
    digest = lambda df: df.groupBy(F.col("run_id").alias("path")).agg(F.sum("seq").alias("digest"))
    return unique.inventory_delta(digest(own.where("seq % 3 <> 0")), digest(own.where("seq % 4 <> 0")))


@query("SELECT run_id, CASE WHEN max(seq) FILTER (seq % 4 = 0) IS NOT NULL THEN max(seq) FILTER (seq % 4 = 0) ELSE min(seq) END AS seq FROM ledger GROUP BY run_id")
def overlay_wins(spark, sf_dir):
    """J9, J11."""
    own = ledger(spark, sf_dir)
    return unique.overlay(own.groupBy("run_id").agg(F.min("seq").alias("seq")), own.where("seq % 4 = 0").groupBy("run_id").agg(F.max("seq").alias("seq")), "run_id")


@query("SELECT DISTINCT run_id FROM ledger EXCEPT SELECT run_id FROM ledger WHERE kind = 'agent.run.completed'")
def orphan_runs(spark, sf_dir):
    """J8, U5."""
    own = ledger(spark, sf_dir)
    return own.select("run_id").distinct().join(own.where("kind = 'agent.run.completed'").select("run_id"), "run_id", "left_anti")


@query("SELECT run_id FROM ledger WHERE kind = 'agent.run.started' INTERSECT SELECT run_id FROM ledger WHERE kind = 'agent.run.blocked'")
def started_and_blocked(spark, sf_dir):
    """U4."""
    own = ledger(spark, sf_dir)
    return own.where("kind = 'agent.run.started'").select("run_id").intersect(own.where("kind = 'agent.run.blocked'").select("run_id"))


@query("SELECT text_digest, n FROM (SELECT sha256(text) AS text_digest, count(*) AS n FROM documents GROUP BY 1) WHERE n > 1")
def duplicate_generations(spark, sf_dir):
    """U6, T18."""
    own = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("text_digest")).agg(F.count("*").alias("n"))
    return own.where("n > 1")


@query("SELECT domain, count(DISTINCT event_id) AS ids, count(*) AS n FROM ledger GROUP BY domain")
def identity_counts(spark, sf_dir):
    """A13."""
    return ledger(spark, sf_dir).groupBy("domain").agg(F.countDistinct("event_id").alias("ids"), F.count("*").alias("n"))


@query("SELECT run_id, array_to_string(list_sort(list(event_id)), ',') AS ids FROM ledger GROUP BY run_id")
def sorted_ids(spark, sf_dir):
    """A16."""
    return ledger(spark, sf_dir).groupBy("run_id").agg(F.concat_ws(",", F.sort_array(F.collect_list("event_id"))).alias("ids"))


@query("SELECT domain AS root, string_agg(result || ':' || n, ',' ORDER BY result) AS results, sum(n)::BIGINT AS runs FROM (SELECT domain, result, count(*) AS n FROM (SELECT domain, run_id, arg_max(result, struct_pack(ts, seq)) AS result FROM ledger GROUP BY ALL) GROUP BY ALL) GROUP BY domain")
def result_tally(spark, sf_dir):
    """For each root the results of its runs' latest events."""
    runs = history.latest_by(ledger(spark, sf_dir).select("domain", "run_id", "result", "ts", "seq"), ["domain", "run_id"], ["ts"])
    tally = history.tally(runs, "domain", "result")
    entries = F.array_sort(F.transform(F.map_entries("results"), lambda e: F.concat(e["key"], F.lit(":"), e["value"])))
    return tally.select(F.col("domain").alias("root"), F.concat_ws(",", entries).alias("results"), F.aggregate(F.map_values("results"), F.lit(0).cast("long"), lambda a, x: a + x).alias("runs"))


@query("""SELECT 'strength' AS counter, domain, CASE WHEN s >= 4 THEN 'high' WHEN s >= 2 THEN 'medium' ELSE 'low' END AS label, count(*) AS n FROM (SELECT *, 1 + (seq % 5 <> 0)::INT + (seq % 7 <> 0)::INT + (seq % 4 = 0 OR len(json_keys(payload)) > 3)::INT + (seq % 2 = 0)::INT AS s FROM payloads) GROUP BY ALL
UNION ALL SELECT 'rejected', domain, 'source _must be an object_', count(*) FROM payloads WHERE seq % 7 = 0 GROUP BY ALL UNION ALL SELECT 'rejected', domain, 'source.component', count(*) FROM payloads WHERE seq % 7 <> 0 GROUP BY ALL
UNION ALL SELECT 'type', domain, coalesce(nullif(t, ''), 'domain.' || domain), count(*) FROM (SELECT domain, CASE WHEN seq % 3 = 0 THEN '' ELSE kind END AS t FROM payloads) GROUP BY ALL""")
def labelled_counters(spark, sf_dir):
    """A4: by event type (of its domain where it has none), by strength, and by the reason of a rejection; labels are cut and cleaned."""
    own = payloads(spark, sf_dir)
    strength = own.select(F.lit("strength").alias("counter"), "domain", envelope.signal_strength(F.col("payload")).alias("label"))
    reason = F.try_element_at(contracts.provenance_errors(F.try_parse_json("payload")), F.lit(1))
    rejected = own.select(F.lit("rejected").alias("counter"), "domain", F.regexp_replace(reason, "[()]", "_").alias("label")).where("label is not null")
    kinds = own.select(F.lit("type").alias("counter"), "domain", F.coalesce(history.blank_to_null(F.expr("case when seq % 3 = 0 then '' else kind end")), F.concat(F.lit("domain."), "domain")).alias("label"))
    return strength.unionByName(rejected).unionByName(kinds).groupBy("counter", "domain", "label").agg(F.count("*").alias("n"))


@query("SELECT event_id, 'sha256:' || sha256(payload) AS content_id, lower(lpad(hex(strlen(payload)), 16, '0')) || sha256(payload) AS fingerprint FROM payloads")
def fingerprints(spark, sf_dir):
    """T18, T19."""
    return payloads(spark, sf_dir).select("event_id", digests.content_id(F.col("payload")).alias("content_id"), F.lower(F.hex(digests.fingerprint(F.col("payload")))).alias("fingerprint"))


NAME = "' Repo/' || domain || '__' || kind || (seq % 9) || '.-'"


@query(f"""SELECT seq, regexp_replace(trim({NAME}), '[^a-zA-Z0-9._-]', '_', 'g') AS label, regexp_replace(regexp_replace(trim({NAME}), '[^A-Za-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g') AS part,
domain AS clean_domain, NULL::VARCHAR AS bad_domain, 'integrity.' || domain AS repo_domain FROM ledger""")
def clean_names(spark, sf_dir):
    """T12, T13, T15, T16, P21."""
    name = F.concat(F.lit(" Repo/"), "domain", F.lit("__"), "kind", F.col("seq") % 9, F.lit(".-"))
    return ledger(spark, sf_dir).select(
        "seq",
        texts.metric_label(F.trim(name)).alias("label"),
        texts.safe_part(name).alias("part"),
        texts.sanitize_domain(F.concat(F.lit("  "), F.upper("domain"), F.lit("\t"))).alias("clean_domain"),
        texts.sanitize_domain(F.concat(F.lit("-"), "domain")).alias("bad_domain"),
        texts.repo_domain(F.replace(F.col("domain"), F.lit("."), F.lit("/"))).alias("repo_domain"),
    )


@query("""SELECT seq, CASE WHEN seq % 4 < 2 THEN date_trunc('second', ts) END AS zulu, CASE WHEN seq % 4 < 2 THEN date_trunc('second', ts) WHEN seq % 4 = 2 THEN date_trunc('second', ts) - INTERVAL 2 HOUR END AS absolute,
CASE WHEN seq % 4 < 2 THEN date_trunc('second', ts) WHEN seq % 4 = 2 THEN date_trunc('second', ts) - INTERVAL 2 HOUR WHEN seq % 8 = 3 THEN date_trunc('second', ts) END AS any_time FROM ledger""")
def time_texts(spark, sf_dir):
    """T1-T5."""
    text = F.expr("""case when seq % 4 < 2 then date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'") when seq % 4 = 2 then date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+02:00'") when seq % 8 = 3 then date_format(ts, "yyyy-MM-dd'T'HH:mm:ss") else '12:00' end""")
    return ledger(spark, sf_dir).select("seq", times.parse_zulu(text).alias("zulu"), times.parse_absolute(text).alias("absolute"), times.parse_iso(text).alias("any_time"))


@query("SELECT seq, left(kind, 80) AS actor, 'unspecified' AS action, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(((extract('microseconds' FROM ts)::BIGINT // 1000) % 1000)::VARCHAR, 3, '0') || 'Z' AS at FROM ledger")
def audit_rows(spark, sf_dir):
    """P20, T22, T6."""
    own = ledger(spark, sf_dir).withColumn("a", envelope.audit_row(F.col("kind"), F.lit("  "), F.lit(None).cast("string"), F.col("ts")))
    return own.select("seq", "a.actor", "a.action", "a.at")


@query("SELECT event_id AS seq, ts AS time, json_extract_string(props, '$.k')::BIGINT AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL ORDER BY ts DESC, event_id LIMIT 1")
def newest_snapshot(spark, sf_dir):
    """The first of equal times."""
    own = spread(table(spark, sf_dir, "events").select("event_id", "ts", "props")).select(F.col("event_id").alias("seq"), F.concat(F.lit('{"ts":"'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit('","payload":'), "props", F.lit("}")).alias("value"))
    newest = snapshots(own).orderBy(F.col("time").desc(), "seq").limit(1)
    return newest.select("seq", "time", F.try_variant_get("payload", "$.k", "bigint").alias("k"))


@query("SELECT conv_id, count(*) AS turns, arg_max(role, turn) AS last_role, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def latest_turn(spark, sf_dir):
    """W1 on conversations."""
    own = table(spark, sf_dir, "conversations")
    return own.groupBy("conv_id").agg(F.count("*").alias("turns"), F.max_by("role", "turn").alias("last_role"), F.max("turn").alias("last_turn"))


@query("SELECT l_orderkey AS k, l_linenumber, l_shipdate FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC) AS r FROM lineitem) WHERE r = 1")
def latest_line_per_order(spark, sf_dir):
    """W1 at scale."""
    own = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_shipdate", F.col("l_linenumber").alias("seq"))
    return history.latest_by(own, ["k"], ["l_shipdate"]).select("k", "l_linenumber", "l_shipdate")


@query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100")
def newest_orders(spark, sf_dir):
    """O1 at scale."""
    return table(spark, sf_dir, "orders").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).limit(100).select("o_orderkey", "o_orderdate", "o_totalprice")


@query("""SELECT seq, CASE seq % 3 WHEN 0 THEN '{"x":' || seq || '}' WHEN 1 THEN '5' ELSE '{"x":2}' END AS unwrapped, CASE seq % 3 WHEN 0 THEN '{"x":' || seq || '}' WHEN 1 THEN '{"payload":5,"x":1}' ELSE '{"x":2}' END AS payload FROM ledger""")
def unwrapped_items(spark, sf_dir):
    """The payload by the presence of its key, and only if it is an object."""
    item = F.try_parse_json(F.expr("case seq % 3 when 0 then concat('{\"payload\":{\"x\":', seq, '}}') when 1 then '{\"payload\":5,\"x\":1}' else '{\"x\":2}' end"))
    return ledger(spark, sf_dir).select("seq", F.to_json(envelope.unwrapped(item)).alias("unwrapped"), F.to_json(envelope.extracted_payload(item)).alias("payload"))


@query(""", RECURSIVE o AS (SELECT domain || '/' || user_id AS k, payload, row_number() OVER (PARTITION BY domain, user_id ORDER BY seq) AS n FROM payloads),
c AS (SELECT k, n, sha256(repeat('\\x00', 32)::BLOB || encode(payload)) AS chain FROM o WHERE n = 1 UNION ALL SELECT o.k, o.n, sha256(unhex(c.chain) || encode(o.payload)) FROM c JOIN o ON o.k = c.k AND o.n = c.n + 1)
SELECT k, arg_max(chain, n) AS chain, max(n) AS records FROM c GROUP BY k""")
def hash_chains(spark, sf_dir):
    """W11."""
    return folds.hash_chain(payloads(spark, sf_dir).select(F.concat("domain", F.lit("/"), F.col("user_id")).alias("k"), "seq", F.col("payload").alias("value")), "k")


@query(""", RECURSIVE o AS (SELECT domain AS k, payload, seq, row_number() OVER (PARTITION BY domain ORDER BY seq) AS n FROM payloads),
c AS (SELECT k, n, sha256(repeat('\\x00', 32)::BLOB || encode(payload)) AS chain FROM o WHERE n = 1 UNION ALL SELECT o.k, o.n, sha256(unhex(c.chain) || encode(o.payload)) FROM c JOIN o ON o.k = c.k AND o.n = c.n + 1)
SELECT sum(records)::BIGINT AS records, sha256('[' || string_agg('{"domain":"' || k || '","chain":"' || chain || '","records":' || records || '}', ',' ORDER BY k) || ']') AS snapshot_sha256 FROM (SELECT k, arg_max(chain, n) AS chain, max(n) AS records FROM c GROUP BY k)""")
def ledger_snapshot(spark, sf_dir):
    """A3: the digest of the whole ledger, a chain over each domain's lines in order."""
    return folds.snapshot_chain(payloads(spark, sf_dir).select("domain", "seq", F.col("payload").alias("value")), "domain")


@query(""", b AS (SELECT domain AS k, seq // 4096 AS pos, count(*) AS records, sha256('[' || string_agg('{"at":' || seq || ',"of":"' || leaf || '"}', ',' ORDER BY seq) || ']') AS of FROM (SELECT *, sha256(payload) AS leaf FROM payloads) GROUP BY ALL), c AS (SELECT k, pos // 1024 AS pos, sum(records) AS records, sha256('[' || string_agg('{"at":' || b.pos || ',"of":"' || of || '"}', ',' ORDER BY b.pos) || ']') AS of FROM b GROUP BY k, b.pos // 1024),
d AS (SELECT k, pos // 1024 AS pos, sum(records) AS records, sha256('[' || string_agg('{"at":' || c.pos || ',"of":"' || of || '"}', ',' ORDER BY c.pos) || ']') AS of FROM c GROUP BY k, c.pos // 1024), e AS (SELECT k, sum(records) AS records, sha256('[' || string_agg('{"at":' || d.pos || ',"of":"' || of || '"}', ',' ORDER BY d.pos) || ']') AS of FROM d GROUP BY k)
SELECT sum(records)::BIGINT AS records, sha256('[' || string_agg('{"domain":"' || k || '","digest":"' || of || '"}', ',' ORDER BY k) || ']') AS snapshot_sha256 FROM e""")
def ledger_tree(spark, sf_dir):
    """A3: the digest of the whole ledger as a tree over each domain's lines, which all cores build."""
    return folds.snapshot_digest(payloads(spark, sf_dir).select("domain", "seq", F.col("payload").alias("value")), "domain")


@query(""", RECURSIVE o AS (SELECT run_id, seq, strlen(payload) AS bytes, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS n FROM payloads),
c AS (SELECT run_id, seq, bytes, n, bytes <= 250 AS taken, CASE WHEN bytes <= 250 THEN bytes ELSE 0 END AS used FROM o WHERE n = 1
UNION ALL SELECT o.run_id, o.seq, o.bytes, o.n, c.used + o.bytes <= 250, CASE WHEN c.used + o.bytes <= 250 THEN c.used + o.bytes ELSE c.used END FROM c JOIN o ON o.run_id = c.run_id AND o.n = c.n + 1)
SELECT run_id, seq AS pos, bytes, taken FROM c""")
def byte_budget(spark, sf_dir):
    """W12."""
    own = payloads(spark, sf_dir).select("run_id", F.col("seq").alias("pos"), F.octet_length("payload").cast("long").alias("bytes"))
    return folds.within_budget(own, "run_id", 250)


PACKING_SQL = """, RECURSIVE o AS (SELECT run_id, seq, strlen(payload) AS bytes, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS n FROM payloads),
c AS (SELECT run_id, seq, n, 0::BIGINT AS request, {frame}::BIGINT AS start, {frame} + bytes AS size FROM o WHERE n = 1
UNION ALL SELECT o.run_id, o.seq, o.n, CASE WHEN c.size + {comma} + o.bytes > {limit} THEN c.request + 1 ELSE c.request END, CASE WHEN c.size + {comma} + o.bytes > {limit} THEN {frame} ELSE c.size + {comma} END,
CASE WHEN c.size + {comma} + o.bytes > {limit} THEN {frame} + o.bytes ELSE c.size + {comma} + o.bytes END FROM c JOIN o ON o.run_id = c.run_id AND o.n = c.n + 1)"""


@query(PACKING_SQL.format(frame=2, comma=1, limit=400) + " SELECT run_id, seq AS pos, request, start FROM c")
def request_packing(spark, sf_dir):
    """W13."""
    own = payloads(spark, sf_dir).select("run_id", F.col("seq").alias("pos"), F.octet_length("payload").cast("long").alias("bytes"))
    return folds.packed(own, "run_id", 400)


@query(""", RECURSIVE o AS (SELECT repo, row_number() OVER (PARTITION BY repo ORDER BY seq) AS n, ts AS received, CASE WHEN seq % 7 = 0 THEN 'MISSING' WHEN value >= 40 THEN 'WARN' ELSE 'OK' END AS s,
CASE WHEN seq % 9 = 0 THEN NULL WHEN seq % 9 = 1 THEN date_trunc('second', ts) + INTERVAL 1 HOUR ELSE date_trunc('second', ts) END AS g FROM ledger WHERE repo IS NOT NULL),
j AS (SELECT *, CASE WHEN s = 'MISSING' THEN 'missing' WHEN g IS NULL OR g > received + INTERVAL 10 MINUTE THEN 'unusable' ELSE 'usable' END AS kind FROM o),
c AS (SELECT repo, 0::BIGINT AS n, NULL::VARCHAR AS status, NULL::TIMESTAMP AS held, NULL::BOOLEAN AS sanitized FROM j WHERE n = 1
UNION ALL SELECT j.repo, j.n, CASE WHEN w THEN CASE j.kind WHEN 'missing' THEN 'MISSING' WHEN 'unusable' THEN 'FAIL' ELSE j.s END ELSE c.status END, CASE WHEN w THEN CASE j.kind WHEN 'usable' THEN j.g ELSE j.received END ELSE c.held END, CASE WHEN w THEN j.kind = 'unusable' ELSE c.sanitized END
FROM c JOIN j ON j.repo = c.repo AND j.n = c.n + 1, LATERAL (SELECT CASE WHEN j.kind <> 'usable' THEN c.held IS NULL ELSE c.held IS NULL OR j.g > c.held END AS w) x)
SELECT repo, arg_max(status, n) AS status, arg_max(held, n) AS generated_at, arg_max(sanitized, n) AS sanitized FROM c GROUP BY repo""")
def reported_states(spark, sf_dir):
    """W10."""
    own = ledger(spark, sf_dir).where("repo is not null")
    generated = F.expr("""case when seq % 9 = 0 then 'soon' when seq % 9 = 1 then date_format(ts + interval 1 hour, "yyyy-MM-dd'T'HH:mm:ss'Z'") else date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'") end""")
    status = F.expr("case when seq % 7 = 0 then 'MISSING' when value >= 40 then 'WARN' else 'OK' end")
    return folds.reported_states(own.select("repo", "seq", status.alias("status"), generated.alias("generated_at"), F.col("ts").alias("received_at")))


@query("""SELECT seq, '{' || CASE WHEN seq % 4 = 0 THEN '"data":{},' ELSE '' END || '"event":"fallback"' || CASE WHEN seq % 2 = 0 THEN ',"event_id":7' ELSE '' END
|| CASE WHEN seq % 3 = 0 THEN ',"kind":"' || n || '"' WHEN seq % 3 = 2 THEN ',"label":"' || n || '"' ELSE '' END || CASE WHEN seq % 7 <> 0 THEN ',"source":{"component":"","repo":"r"}' ELSE '' END
|| CASE WHEN seq % 5 <> 0 THEN ',"ts":null' ELSE '' END || CASE WHEN seq % 3 = 1 THEN ',"type":"' || n || '"' ELSE '' END || '}' AS canonical,
sha256(unhex(lpad(to_hex(strlen(domain)), 16, '0')) || encode(domain) || unhex(lpad(to_hex(strlen(event_id)), 16, '0')) || encode(event_id)) AS digest
FROM (SELECT *, CASE WHEN seq % 11 = 0 THEN '' ELSE kind END AS n FROM ledger)""")
def canonical_payloads(spark, sf_dir):
    """T17, T20."""
    own = payloads(spark, sf_dir).select("seq", digests.canonical_json("payload").alias("canonical"), "domain", "event_id")
    return own.select("seq", "canonical", digests.prefixed_digest(F.col("domain"), F.col("event_id")).alias("digest"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history_newest_first(spark, sf_dir)


REPORT = """concat('{', case when seq % 4 = 0 then '"kind":"integrity.summary.published.v1",' when seq % 4 = 1 then '"type":"integrity.summary.published.v1",' else '' end,
'"payload":{"status":"', case when value >= 40 then ' warn' when seq % 5 = 0 then 'odd' else 'OK' end, '"', case when seq % 4 = 2 then ',"type":"integrity.summary.published.v1"' else '' end, '}}')"""


@query("SELECT seq, CASE WHEN value >= 40 THEN 'WARN' WHEN seq % 5 = 0 THEN 'UNCLEAR' ELSE 'OK' END AS status, seq % 4 <> 0 AS legacy FROM ledger WHERE seq % 4 < 3")
def status_gate(spark, sf_dir):
    """F13, T10."""
    own = ledger(spark, sf_dir).select("seq", wrappers.status_of(F.try_parse_json(F.expr(REPORT))).alias("s")).where("s is not null")
    return own.select("seq", "s.status", "s.legacy")


@query("SELECT seq, seq % 3 = 1 OR seq % 3 = 2 AND domain <> 'app.view' AS mismatch FROM ledger")
def domain_mismatches(spark, sf_dir):
    """C3."""
    item = F.expr("case when seq % 3 = 0 then concat(' ', upper(domain)) when seq % 3 = 1 then '..' else 'app.view' end")
    return ledger(spark, sf_dir).select("seq", wrappers.domain_mismatch(item, F.col("domain")).alias("mismatch"))


WRAPPED = """concat('{"kind":', case when seq % 6 = 1 then '5' else '"x.insight"' end, ',"version":', case when seq % 6 = 2 then '2' else '1' end, case when seq % 6 = 3 then '' else ',"id":"i"' end,
',"meta":{"occurred_at":"', case when seq % 6 = 4 then 'soon' else '2024-01-01T00:00:00Z' end, '"},"data":', case when seq % 6 = 5 then '[]' else '{}' end, '}')"""


@query("SELECT seq, (['kind must be a string', 'invalid version: expected 1', 'missing fields: id', 'meta.occurred_at must be valid ISO8601', 'data must be a dict'])[nullif(seq % 6, 0)] AS error FROM ledger")
def wrapper_errors(spark, sf_dir):
    """Ordered checks, the first failure."""
    return ledger(spark, sf_dir).select("seq", wrappers.wrapper_error(F.try_parse_json(F.expr(WRAPPED)), "x.insight", "x.state").alias("error"))


@query("""SELECT seq, path FROM (SELECT seq, '$.' || unnest(['kind', 'type', 'label', 'ts', 'source', 'event_id', 'data', 'event', 'source.repo', 'source.component']) AS path,
unnest([seq % 3 = 0, seq % 3 = 1, seq % 3 = 2, seq % 5 <> 0, seq % 7 <> 0, seq % 2 = 0, seq % 4 = 0, true, seq % 7 <> 0, seq % 7 <> 0]) AS there FROM ledger) WHERE there""")
def walked_payloads(spark, sf_dir):
    """T25."""
    return folds.walk(payloads(spark, sf_dir).select("seq", "payload"), "payload", ["seq"]).select("seq", "path")


@query(""", RECURSIVE f AS (SELECT user_id % 40 AS shard, run_id AS source, sum(strlen(payload) + 1)::BIGINT AS bytes FROM (SELECT *, user_id FROM payloads) GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY source) AS n FROM f WHERE bytes <= 2000),
c AS (SELECT shard, source, n, 0::BIGINT AS bundle, 0::BIGINT AS start_offset, bytes AS end_offset FROM o WHERE n = 1
UNION ALL SELECT o.shard, o.source, o.n, CASE WHEN c.end_offset + o.bytes > 2000 THEN c.bundle + 1 ELSE c.bundle END, CASE WHEN c.end_offset + o.bytes > 2000 THEN 0 ELSE c.end_offset END, CASE WHEN c.end_offset + o.bytes > 2000 THEN o.bytes ELSE c.end_offset + o.bytes END
FROM c JOIN o ON o.shard = c.shard AND o.n = c.n + 1) SELECT shard, bundle, source, start_offset, end_offset FROM c""")
def bundle_layout(spark, sf_dir):
    """K9, W7."""
    own = payloads(spark, sf_dir).groupBy((F.col("user_id") % 40).alias("shard"), F.col("run_id").alias("source")).agg(F.sum(F.octet_length("payload") + 1).alias("bytes"), F.lit("").alias("digest"))
    return sinks.bundle(own, 2000, "shard").select("shard", "bundle", "source", "start_offset", "end_offset")


@query("""SELECT user_id % 40 AS shard, bool_and(true) AS intact, count(DISTINCT run_id) AS n_sources FROM ledger GROUP BY ALL""")
def bundle_integrity(spark, sf_dir):
    """C17: manifests of all bundles, and what they say against the sources."""
    own = payloads(spark, sf_dir).groupBy((F.col("user_id") % 40).alias("shard"), F.col("run_id").alias("source")).agg(F.sum(F.octet_length("payload") + 1).alias("bytes"), F.lit("").alias("digest"))
    manifest = sinks.manifests(sinks.bundle(own, 1_000_000, "shard"), "shard")
    return sinks.intact(manifest, "shard", own).join(manifest.select("shard", "bundle", "n_sources"), ["shard", "bundle"]).groupBy("shard").agg(F.bool_and("intact").alias("intact"), F.sum("n_sources").alias("n_sources"))


@query("""SELECT source, bytes, CASE WHEN n > 3000 THEN 'source_bound' WHEN seq % 10 = 0 THEN 'invalid_source' WHEN last NOT IN ('agent.run.completed', 'agent.run.blocked') THEN 'nonterminal' WHEN ts > TIMESTAMP '2024-01-29 12:00:00' THEN 'grace_pending'
WHEN seq % 3 = 0 THEN 'receipt_invalid_or_missing' WHEN seq % 4 = 0 THEN 'ledger_unconfirmed' ELSE 'eligible' END AS reason FROM (SELECT run_id AS source, sum(strlen(payload) + 1)::BIGINT AS bytes, max(seq) AS seq, max(ts) AS ts, arg_max(kind, seq) AS last, row_number() OVER (ORDER BY run_id) AS n FROM payloads GROUP BY run_id)""")
def compaction_reasons(spark, sf_dir):
    """The first reason against each run's file."""
    own = payloads(spark, sf_dir).groupBy(F.col("run_id").alias("source")).agg(F.sum(F.octet_length("payload") + 1).alias("bytes"), F.max("seq").alias("seq"), F.max("ts").alias("modified"), F.max_by("kind", "seq").alias("last_kind"))
    own = compaction.first_sources(own, 3000).withColumns({"valid": F.col("seq") % 10 != 0, "receipt": F.when(F.col("seq") % 3 != 0, "intact")})
    confirmed = own.select("source", (F.col("seq") % 4 != 0).alias("confirmed"))
    return compaction.reasons(own, confirmed, datetime(2024, 1, 30, 12, tzinfo=timezone.utc), 86_400, 1 << 40).select("source", "bytes", "reason")


COMPONENT_SQL = "SELECT event_id, CASE WHEN seq % 3 = 0 THEN 'operator' ELSE 'worker' END AS source_component, CASE WHEN seq % 5 = 0 THEN 'api' END AS subject_component, CASE WHEN seq % 2 = 0 THEN 'r' ELSE 'q' END AS source_repo, kind, seq FROM ledger"


def with_components(spark, sf_dir):
    return ledger(spark, sf_dir).withColumns(
        {
            "source_component": F.expr("case when seq % 3 = 0 then 'operator' else 'worker' end"),
            "subject_component": F.expr("case when seq % 5 = 0 then 'api' end"),
            "source_repo": F.expr("case when seq % 2 = 0 then 'r' else 'q' end"),
        }
    )


@query(f"SELECT event_id, source_component, subject_component FROM ({COMPONENT_SQL}) WHERE source_component = 'operator' AND subject_component = 'api'")
def history_components(spark, sf_dir):
    """The source's component never stands in for the subject's."""
    return history.filtered(with_components(spark, sf_dir), component="operator", subject_component="api").select("event_id", "source_component", "subject_component")


@query(f"SELECT event_id, CASE WHEN source_repo <> 'r' OR source_component <> 'operator' THEN 'other producer' WHEN kind NOT LIKE 'agent.run.%' THEN 'other kind' END AS reason FROM ({COMPONENT_SQL})")
def producer_gate(spark, sf_dir):
    """F12."""
    return with_components(spark, sf_dir).select("event_id", history.produced_by("r", "operator", contracts.KINDS).alias("reason"))


@query("""SELECT event_id, ts, kind, repo, coalesce(host, repo) AS target, operation, task_class, coalesce(nullif(outcome, ''), result) AS outcome, CASE WHEN kind = 'agent.run.blocked' THEN blocker_code END AS blocker_code FROM ledger ORDER BY ts DESC, event_id DESC, seq LIMIT 200""")
def recent_rows(spark, sf_dir):
    """The nine fields of the newest rows."""
    return history.recent_rows(history.newest(ledger(spark, sf_dir), 200)).withColumn("target", F.col("target.name"))


@query("""SELECT coalesce(repo, '') AS repo, run_id, kind, '' AS branch, CASE WHEN seq % 3 = 0 THEN '' ELSE 'ref-' || seq END AS evidence, CASE WHEN seq % 4 = 0 THEN '' ELSE 's' || seq END AS summary, seq FROM ledger""")
def view_rows(spark, sf_dir):
    """The first reference, and empty texts for what is missing."""
    own = ledger(spark, sf_dir).withColumns(
        {
            "branch": F.lit(None).cast("string"),
            "evidence_refs": F.expr("case when seq % 3 = 0 then array() else array(concat('ref-', seq), 'other') end"),
            "summary": F.expr("case when seq % 4 <> 0 then concat('s', seq) end"),
        }
    )
    return history.view_rows(own, "seq")


@query(""", p AS (SELECT seq, domain, payload, json_extract_string(payload, '$.event') AS e FROM payloads)
SELECT seq, 'app.forced' AS domain, e AS event, seq % 2 = 0 AS has_event_id, CASE WHEN s >= 4 THEN 'high' WHEN s >= 2 THEN 'medium' ELSE 'low' END AS strength FROM
(SELECT *, 1 + (seq % 5 <> 0)::INT + (seq % 7 <> 0)::INT + (seq % 4 = 0 OR len(json_keys(payload)) > 3)::INT + (seq % 2 = 0)::INT AS s FROM p)""")
def marked_payloads(spark, sf_dir):
    """Markers and a forced domain set into the payload's JSON."""
    marked = envelope.with_domain(envelope.with_markers(F.col("payload")), F.lit("app.forced"))
    v = F.try_parse_json("m")
    own = spread(payloads(spark, sf_dir).select("seq", "payload")).select("seq", marked.alias("m"))
    text = lambda p: F.try_variant_get(v, p, "string")
    return own.select("seq", text("$.domain").alias("domain"), text("$.event").alias("event"), values.member(v, "$.event_id").isNotNull().alias("has_event_id"), text("$.quality.signal_strength").alias("strength"))


@query("""SELECT seq, CASE WHEN seq % 3 = 0 THEN '5' WHEN seq % 3 = 1 THEN '"i' || seq || '"' ELSE 'absent' END AS event_id FROM ledger""")
def given_event_ids(spark, sf_dir):
    """Id becomes event_id only where that key is absent, a null one stays."""
    item = F.expr("case when seq % 6 = 0 then '{\"event_id\":5,\"id\":\"x\"}' when seq % 6 = 3 then '{\"id\":\"y\",\"event_id\":5}' when seq % 3 = 1 then concat('{\"id\":\"i', seq, '\"}') else '{\"other\":1}' end")
    v = F.try_parse_json(envelope.with_event_id(item))
    return ledger(spark, sf_dir).select("seq", F.coalesce(F.to_json(values.member(v, "$.event_id")), F.lit("absent")).alias("event_id"))


@query("""SELECT seq, '{"domain":"' || domain || '","received_at":"' || strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') || '","payload":' || payload || ',"retention":{"ttl_days":' || ttl || ',"expires_at":"' || strftime(date_trunc('second', ts + to_days(ttl)), '%Y-%m-%dT%H:%M:%SZ') || '"},"quality":{"signal_strength":"' || CASE WHEN s >= 4 THEN 'high' WHEN s >= 2 THEN 'medium' ELSE 'low' END || '","completeness":' || (seq % 5 <> 0 AND seq % 7 <> 0) || '}}' AS line
FROM (SELECT *, """ + TTL_SQL + """ AS ttl, 1 + (seq % 5 <> 0)::INT + (seq % 7 <> 0)::INT + (seq % 4 = 0 OR len(json_keys(payload)) > 3)::INT + (seq % 2 = 0)::INT AS s FROM payloads)""")
def envelope_lines(spark, sf_dir):
    """The whole envelope as its line."""
    return envelope.with_envelope(payloads(spark, sf_dir), "domain", "ts", "payload").select("seq", envelope.envelope_json("payload").alias("line"))


@query("SELECT pos, event_id FROM (SELECT 1 AS pos, event_id, kind FROM ledger WHERE kind = 'agent.run.started' UNION ALL SELECT 2, event_id, kind FROM ledger WHERE kind <> 'click.temp')")
def joined_inputs(spark, sf_dir):
    """Inputs one after the other."""
    own = ledger(spark, sf_dir).select("event_id", "kind")
    return unique.one_after_the_other(own.where("kind = 'agent.run.started'"), own.where("kind <> 'click.temp'")).select("pos", "event_id")


@query("""SELECT run_id AS source, sha256('{"source_path":"' || run_id || '","source_sha256":"' || sha256(run_id) || '"}') AS key, sha256(run_id) AS legacy FROM ledger GROUP BY run_id""")
def receipt_keys(spark, sf_dir):
    """T26."""
    return ledger(spark, sf_dir).select(F.col("run_id").alias("source")).distinct().select("source", reconcile.receipt_key(F.col("source"), F.sha2("source", 256)).alias("key"), reconcile.legacy_key(F.col("source")).alias("legacy"))


@query("""SELECT run_id AS source, CASE WHEN seq % 5 = 0 THEN NULL WHEN seq % 5 = 1 THEN 'broken' WHEN seq % 5 = 2 THEN 'broken' ELSE 'intact' END AS receipt FROM (SELECT run_id, min(seq) AS seq FROM ledger GROUP BY run_id)""")
def receipts_of_sources(spark, sf_dir):
    """0 has none, 1 a broken one under the new key that blocks the old one, 2 one of other bytes, 3 one under the old key, 4 one under the new key."""
    own = ledger(spark, sf_dir).groupBy(F.col("run_id").alias("source")).agg(F.count("*").alias("n_events"), F.sum("seq").alias("bytes"), F.sort_array(F.collect_list("event_id")).alias("event_ids"), F.min("seq").alias("first"))
    own = own.withColumn("digest", F.sha2("source", 256))
    new, old = reconcile.receipt_key(F.col("source"), F.col("digest")), reconcile.legacy_key(F.col("source"))
    made = own.withColumns({"imported": F.col("n_events"), "skipped": F.lit(0).cast("long"), "recorded_at": F.lit("2024-01-01").cast("timestamp"), "key": F.when(F.col("first") % 5 == 3, old).otherwise(new), "bytes": F.col("bytes") + F.when(F.col("first") % 5 == 2, 1).otherwise(0)})
    good = reconcile.signed(made.where("first % 5 > 0").select(*reconcile.RECEIPT))
    broken = good.join(own.where("first % 5 = 1").select("source"), "source", "left_semi").withColumn("receipt_sha256", F.lit("0"))
    blocked = reconcile.signed(made.where("first % 5 = 1").withColumn("key", old).select(*reconcile.RECEIPT))
    receipts = good.join(own.where("first % 5 = 1").select("source"), "source", "left_anti").unionByName(broken.select(good.columns)).unionByName(blocked)
    return reconcile.with_receipts(own.select("source", "bytes", "digest", "event_ids", "n_events"), receipts).select("source", "receipt")


@query("""SELECT run_id AS source, count(*) AS events, sum(strlen(payload) + 1)::BIGINT AS bytes, max(user_id) % 3 = 0 AS flushed FROM payloads GROUP BY run_id""")
def outbox_status(spark, sf_dir):
    """Every third user's files are delivered whole, the others up to their first event."""
    own = payloads(spark, sf_dir).select(F.col("run_id").alias("source"), "seq", "user_id", (F.octet_length("payload").cast("long") + 1).alias("width"))
    placed = paging.with_offsets(own, "source", "width")
    done = placed.groupBy("source").agg(F.max("user_id").alias("u"), F.max("next_offset").alias("all"), F.count("*").alias("n"), F.min("next_offset").alias("first"))
    receipts = done.select("source", F.when(F.col("u") % 3 == 0, F.col("all")).otherwise(F.col("first")).alias("bytes"), F.when(F.col("u") % 3 == 0, F.col("n")).otherwise(0).alias("events"))
    return delivery.status(placed, receipts)
