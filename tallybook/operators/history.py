"""Filtered history, summaries, latest rows, roll-ups, life cycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Order of badness.
SEVERITY = {"OK": 0, "UNCLEAR": 10, "WARN": 20, "MISSING": 30, "FAIL": 40}


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def operation() -> Column:
    """P10: of the data, else of the subject. Columns: operation, subject_operation."""
    return F.coalesce(blank_to_null(F.col("operation")), blank_to_null(F.col("subject_operation")))


def target() -> Column:
    """struct(scope, name): the host of a host event, else the repository."""
    host_event = F.col("scope").eqNullSafe("host")
    return F.struct(F.when(host_event, "host").otherwise("repository").alias("scope"), F.when(host_event, F.col("host")).otherwise(F.col("repo")).alias("name"))


def recent_rows(events: DataFrame) -> DataFrame:
    """event_id, ts, kind, repo, target, operation, task_class, outcome, blocker_code; blockers of blocked events only."""
    outcome = F.coalesce(blank_to_null(F.col("outcome")), F.col("result"))
    return events.select("event_id", "ts", "kind", "repo", target().alias("target"), "operation", "task_class", outcome.alias("outcome"), F.when(F.col("kind") == "agent.run.blocked", F.col("blocker_code")).alias("blocker_code"))


def view_rows(events: DataFrame, *keep: str) -> DataFrame:
    """``keep``, repo, run_id, kind, branch, evidence (the first reference), summary; "" for what is missing."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return events.select(*keep, text("repo").alias("repo"), text("run_id").alias("run_id"), "kind", text("branch").alias("branch"), F.coalesce(F.try_element_at("evidence_refs", F.lit(1)), F.lit("")).alias("evidence"), text("summary").alias("summary"))


def produced_by(source_repo: str, component: str, kinds: tuple[str, ...]) -> Column:
    """null for an event of this producer (source_repo, source_component) and these kinds, else the reason against it."""
    fits = F.col("source_repo").eqNullSafe(source_repo) & F.col("source_component").eqNullSafe(component)
    return F.when(~fits, "other producer").when(~F.coalesce(F.col("kind").isin(*kinds), F.lit(False)), "other kind")


def on_repo(repo: str) -> Column:
    """not a host event, and of this repository."""
    return ~F.col("scope").eqNullSafe("host") & (F.col("repo") == repo)


def on_host(host: str) -> Column:
    return F.col("scope").eqNullSafe("host") & (F.col("host") == host)


def filtered(events: DataFrame, repo: str = "", host: str = "", operation: str = "", task_class: str = "", outcome: str = "", component: str = "", since: Column | None = None, subject_component: str = "") -> DataFrame:
    """Events that meet all given conditions; an empty text sets none. The source's component and the subject's stand for themselves."""
    conditions = [on_repo(repo)] * bool(repo) + [on_host(host)] * bool(host)
    given = (("operation", operation), ("task_class", task_class), ("source_component", component), ("subject_component", subject_component))
    conditions += [F.col(c) == v for c, v in given if v]
    if outcome:
        conditions.append(F.coalesce(blank_to_null(F.col("outcome")), F.col("result")) == outcome)
    if since is not None:
        conditions.append(F.col("ts") >= since)
    for c in conditions:
        events = events.where(c)
    return events


def newest(events: DataFrame, limit: int) -> DataFrame:
    """O1: newest first; of equal time and id the earlier row."""
    return events.orderBy(F.col("ts").desc(), F.col("event_id").desc(), F.col("seq").asc()).limit(limit)


def summary(events: DataFrame) -> DataFrame:
    """A1: dimension, value, n for seven dimensions in one scan: each event is spread over its own values before counting."""
    host_event = F.col("scope").eqNullSafe("host") & F.col("host").isNotNull()
    pairs = {
        "kind": F.col("kind"),
        "repo": F.coalesce("repo", F.lit("unknown")),
        "host": F.when(host_event, F.col("host")),
        "target": F.when(host_event, F.concat(F.lit("host:"), F.col("host"))).otherwise(F.concat(F.lit("repository:"), F.coalesce("repo", F.lit("unknown")))),
        "operation": F.coalesce(blank_to_null(F.col("operation")), F.lit("unspecified")),
        "task_class": F.coalesce(blank_to_null(F.col("task_class")), F.lit("unspecified")),
        "blocker": F.when(F.col("kind") == "agent.run.blocked", F.coalesce("blocker_code", F.lit("unspecified"))),
    }
    spread = F.array(*[F.struct(F.lit(k).alias("dimension"), v.alias("value")) for k, v in pairs.items()])
    rows = events.select(F.explode(spread).alias("p")).select("p.dimension", "p.value").where("value is not null")
    return rows.groupBy("dimension", "value").agg(F.count("*").alias("n"))


def latest_by(events: DataFrame, keys: list[str], order: list[str], later_wins: bool = True) -> DataFrame:
    """The row with the greatest order columns for each key; on a tie the later (or earlier) seq."""
    tie = F.col("seq") if later_wins else -F.col("seq")
    rest = [c for c in events.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*[F.col(c) for c in order], tie.alias("tie"))).alias("best")
    return events.groupBy(*keys).agg(best).select(*keys, *[F.col(f"best.{c}").alias(c) for c in rest])


def normalized_status(text: Column) -> Column:
    """Trimmed upper case, UNCLEAR if unknown."""
    s = F.upper(F.trim(text))
    return F.when(s.isin(*SEVERITY), s).otherwise("UNCLEAR")


def severity(status: Column) -> Column:
    """T11."""
    return F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair])[status]


def worst_status(reports: DataFrame) -> DataFrame:
    """A5: status of the worst report; MISSING if there is none."""
    s = normalized_status(F.col("status"))
    return reports.agg(F.coalesce(F.max_by(s, severity(s)), F.lit("MISSING")).alias("status"), F.count("*").alias("reports"))


def lifecycle(events: DataFrame) -> DataFrame:
    """The last state in input order for each target; an event without a target is its own."""
    target = F.coalesce("target_event_id", "event_id")
    return events.withColumn("target", target).groupBy("target").agg(F.max_by("state", "seq").alias("state"), F.max("seq").alias("last_seq"), F.count("*").alias("n"))


def newer_only(reports: DataFrame, key: str, time: str) -> DataFrame:
    """W10 on tables whose times are all valid: rows later than everything before them in their key, in arrival order."""
    before = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return reports.withColumn("newest_before", F.max(time).over(before)).where(F.col("newest_before").isNull() | (F.col(time) > F.col("newest_before"))).drop("newest_before")


def contiguous(ranges: DataFrame, key: str, size: str | None = None) -> DataFrame:
    """For each key its end, and whether its ranges (start_offset, end_offset) follow each other from 0 to it without gaps or
    overlaps; with a column ``size``, also whether the end is the size.

    Each offset is as often a start as an end, but for 0 and the last end: of ranges that go forward, only one chain does that.
    """
    forward = F.col("start_offset") < F.col("end_offset")
    ends = F.array(F.struct(F.col("start_offset").alias("at"), F.lit(1).alias("n")), F.struct(F.col("end_offset").alias("at"), F.lit(-1).alias("n")))
    offsets = ranges.select(key, F.explode(ends).alias("e")).groupBy(key, "e.at").agg(F.sum("e.n").alias("n"))
    open_ends = offsets.groupBy(F.col(key).alias("__key")).agg(F.count_if(F.col("n") != 0).alias("__open"), F.count_if((F.col("n") == 1) & (F.col("at") == 0)).alias("__begins"), F.max(F.when(F.col("n") == -1, F.col("at"))).alias("__ends"))
    sizes = ranges.groupBy(key).agg(F.max("end_offset").alias("end"), F.min(forward).alias("__forward"), *([F.max(size).alias("__size")] if size else []))
    follows = F.col("__forward") & (F.col("__open") == 2) & (F.col("__begins") == 1) & F.coalesce(F.col("__ends") == F.col("end"), F.lit(False))
    if size:
        follows &= F.col("end") == F.col("__size")
    joined = sizes.join(open_ends, F.col(key).eqNullSafe(F.col("__key")), "left")
    return joined.select(key, follows.alias("contiguous"), F.col("end").alias("size"))


def tally(rows: DataFrame, root: str, label: str) -> DataFrame:
    """``root`` and the counts of each label as a map."""
    counts = rows.groupBy(root, label).agg(F.count("*").alias("n"))
    return counts.groupBy(root).agg(F.map_from_entries(F.collect_list(F.struct(label, "n"))).alias("results"))
