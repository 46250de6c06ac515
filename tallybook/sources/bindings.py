"""The ledger as read from the star-schema tables: one deterministic binding of ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.contracts import OPERATIONS, TASK_CLASSES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer files than there are cores dealt to all of them, for work that costs more than moving its rows; others as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, event_id, ts, domain, kind, run_id, scope, host, repo, operation, task_class, blocker_code, outcome, result, value, user_id."""
    e = table(spark, sf_dir, "events")
    pick = lambda values, by: F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod("event_id", F.lit(by)) + 1).cast("int"))
    kind = (
        F.when(F.col("event_type") == "signup", "agent.run.started")
        .when(F.col("event_type") == "purchase", "agent.run.completed")
        .when(F.col("event_type") == "error", "agent.run.blocked")
        .when(F.col("event_type") == "view", "debug.view")
        .otherwise("click.temp")
    )
    on_host = F.col("user_id") % 10 == 0
    return e.select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("e"), F.col("event_id")).alias("event_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("app."), F.col("event_type")).alias("domain"),
        kind.alias("kind"),
        F.concat(F.lit("run-"), F.col("user_id"), F.lit("-"), F.date_format("ts", "yyyyMMdd")).alias("run_id"),
        F.when(on_host, "host").alias("scope"),
        F.when(on_host, F.concat(F.lit("host-"), F.col("user_id"))).alias("host"),
        F.when(~on_host, F.concat(F.lit("repo-"), F.col("user_id") % 20)).alias("repo"),
        pick(OPERATIONS, 7).alias("operation"),
        pick(TASK_CLASSES, 9).alias("task_class"),
        F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("blocker_code"),
        F.when(F.col("value") > 40, "completed").when(F.col("value") > 20, "").alias("outcome"),
        F.when(F.col("value") > 10, "completed").otherwise("blocked").alias("result"),
        "value",
        "user_id",
    )


def payload_json():
    """The payload text of a bound event; kinds of rows differ in which keys they have."""
    return F.concat(
        F.lit('{"'),
        F.when(F.col("seq") % 3 == 0, "kind").when(F.col("seq") % 3 == 1, "type").otherwise("label"),
        F.lit('":"'),
        F.when(F.col("seq") % 11 == 0, "").otherwise(F.col("kind")),
        F.lit('"'),
        F.when(F.col("seq") % 5 != 0, F.lit(',"ts":null')).otherwise(""),
        F.when(F.col("seq") % 7 != 0, F.lit(',"source":{"repo":"r","component":""}')).otherwise(""),
        F.when(F.col("seq") % 2 == 0, F.lit(',"event_id":7')).otherwise(""),
        F.when(F.col("seq") % 4 == 0, F.lit(',"data":{}')).otherwise(""),
        F.lit(',"event":"fallback"}'),
    )
