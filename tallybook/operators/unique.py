"""Appending each identity once, and refusing divergent duplicates."""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import commits
from ..sources.scratch import Scratch, delete, written
from . import identities

class IdentityConflict(ValueError):
    """An identity comes with two payloads; nothing is written."""


def conflicts(batch: DataFrame, ledger: DataFrame) -> DataFrame:
    """Identities with more than one fingerprint in the batch, or another one in the ledger. Both: domain, event_id, fp."""
    keys = ["domain", "event_id"]
    inside = batch.groupBy(*keys).agg(F.min("fp").alias("a"), F.max("fp").alias("b"))
    known = ledger.select(*keys, F.col("fp").alias("known"))
    return inside.join(known, keys, "left").where("a <> b or known <> a").select(*keys).distinct()


def first_rows(batch: DataFrame) -> DataFrame:
    """The first row of each identity in order of group and row, by partial minima."""
    keys = ["domain", "event_id"]
    rest = [c for c in batch.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct("group_pos", "row_pos")).alias("first")
    return batch.groupBy(*keys).agg(first).select(*keys, *[F.col(f"first.{c}").alias(c) for c in rest]).select(batch.columns)


def new_rows(batch: DataFrame, ledger: DataFrame) -> DataFrame:
    """The first row of each identity that the ledger does not have, in order of group and row."""
    keys = ["domain", "event_id"]
    return first_rows(batch).join(ledger.select(*keys), keys, "left_anti")


def check_groups(groups: DataFrame, rows: DataFrame) -> None:
    """K3: each group (group_id, group_pos) stands once and has rows (group_pos)."""
    again = groups.groupBy("group_id").count().where("count > 1 or group_id is null or group_id = ''").take(1)
    if again:
        raise ValueError(f"group {again[0]['group_id']!r} is empty or stands more than once")
    bare = groups.join(rows.select("group_pos").distinct(), "group_pos", "left_anti").take(1)
    if bare:
        raise ValueError(f"group {bare[0]['group_id']!r} has no rows")


def group_counts(batch: DataFrame, fresh: DataFrame) -> DataFrame:
    """K3, A10: requested, written and skipped rows of each group, and its class of delivery."""
    written = fresh.groupBy("group_pos").agg(F.count("*").alias("written"))
    out = batch.groupBy("group_pos").agg(F.count("*").alias("requested")).join(written, "group_pos", "left").withColumn("written", F.coalesce("written", F.lit(0)))
    kind = F.when(F.col("written") == F.col("requested"), "accepted").when(F.col("written") == 0, "replayed").otherwise("mixed")
    return out.select("group_pos", "requested", "written", (F.col("requested") - F.col("written")).alias("skipped"), kind.alias("delivery"))


def missing(wanted: DataFrame, ledger: DataFrame) -> DataFrame:
    """Identities that must be in the ledger and are not."""
    return wanted.join(ledger, ["domain", "event_id"], "left_anti")


class Appended(NamedTuple):
    written: int
    skipped: int
    #: Rows that went to the quarantine.
    held_back: int = 0


def ids_schema(batch: DataFrame) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.select("domain", "event_id", "fp").schema), "h bigint"])


def judged_batch(scratch: Scratch, path: str, commit: dict | None, own: DataFrame, n: int, schema: str) -> DataFrame:
    """The batch's identities with ``known``, the fingerprint the ledger has."""
    generations = commit["generations"] if commit else []
    if not generations:
        return own.withColumn("known", F.lit(None).cast(own.schema["fp"].dataType))
    known = identities.looked_up(scratch, path, generations, own.select("domain", "event_id", "h"), n, schema)
    same = matching(known.withColumnsRenamed({"fp": "known", "h": "__h"}))
    joined = own.join(same, (own["h"] == same["__h"]) & own["domain"].eqNullSafe(same["__domain"]) & own["event_id"].eqNullSafe(same["__event_id"]), "left")
    return scratch.written(joined.select(*own.columns, "known"))


def append(batch: DataFrame, path: str, quarantine: str | None = None, groups: str | None = None, dealt: bool = False) -> Appended:
    """K1-K3: appends the new rows of a batch (domain, event_id, fp, group_pos, row_pos, other columns) to the Parquet ledger at ``path``.

    Only identities are compared, by the index; payloads are read once, for what is new. The batch is checked as a whole first: a conflict raises and nothing is
    written, or with ``quarantine`` the rows of identities with other payloads go to that folder, in place of what it has, and the rest of the batch goes on. Where the
    batch itself has two payloads for a new identity, both go there. With ``groups`` the number of new rows of each group (group_pos, imported) is written to that folder.
    ``dealt`` tells that the batch's tasks read enough rows each for a file of their own; they write what is new as they read it if all of it is.

    Any number of writers may append at once: each commits under the next number, and one that comes second compares its batch anew with what the
    first has added. A reader sees whole commits (``commits.committed``). The batch has to give the same rows whenever it is read; null domains and ids count as identities too.
    """
    spark, keys, place = batch.sparkSession, ["domain", "event_id"], ["group_pos", "row_pos"]
    root, schema = path.rstrip("/"), ids_schema(batch)
    with Scratch(spark) as scratch:
        named = scratch.written(batch.select(*keys, identities.identity_hash().alias("h"), "fp", *place))
        requested, n = named.agg(F.count("*"), F.count_distinct("h")).first()
        if n == requested:  # no identity stands twice, for no hash does
            own = named.withColumns({"differs": F.col("fp") != F.col("fp"), "rows": F.lit(1).cast("long")})
        else:
            first = F.min_by(F.struct("fp", *place), F.struct(*place)).alias("first")
            own = named.groupBy(*keys).agg(F.first("h").alias("h"), first, (F.min("fp") != F.max("fp")).alias("differs"), F.count("*").alias("rows"))
            own = scratch.written(own.select(*keys, "h", "first.*", "differs", "rows"))
            n = own.count()
        while n:
            commit = commits.last(spark, path)
            judged = judged_batch(scratch, path, commit, own, n, schema)
            # an identity that the ledger has is divergent by each row with another payload, a new one by two payloads
            bad, fresh = F.col("differs") | (F.col("known") != F.col("fp")), F.col("known").isNull() & ~F.col("differs")
            n_bad, n_fresh = judged.agg(F.count_if(bad), F.count_if(fresh)).first()
            held_back = 0
            if n_bad and not quarantine:
                raise IdentityConflict(f"divergent payloads, among them {[tuple(r) for r in judged.where(bad).select(*keys).take(5)]}")
            if n_bad:
                same = matching(judged.where(bad).select(*keys, "known"))
                odd = batch.join(same, (batch["domain"].eqNullSafe(same["__domain"])) & (batch["event_id"].eqNullSafe(same["__event_id"]))).where("known is null or known <> fp")
                scratch_rows = scratch.written(odd.drop("__domain", "__event_id"))
                held_back = scratch_rows.count()
                scratch_rows.write.mode("overwrite").parquet(quarantine)
            new = judged.where(fresh)
            if groups:
                new.groupBy("group_pos").agg(F.count("*").alias("imported")).write.mode("overwrite").parquet(groups)
            if not n_fresh:
                return Appended(0, requested - held_back, held_back)
            name = uuid.uuid4().hex
            chosen = None if n_fresh == requested else new.select(*keys, *place)
            write_rows(batch, chosen, f"{root}/commit={name}", n_fresh, dealt)
            generations, generation = identities.add(scratch, path, commit["generations"] if commit else [], new, n_fresh, schema)
            number = commit["number"] + 1 if commit else 0
            if commits.publish(spark, path, number, {"commit": name, "rows": n_fresh, "generations": generations}):
                return Appended(n_fresh, requested - n_fresh - held_back, held_back)
            # another writer came first
            delete(spark, [f"{root}/commit={name}", identities.generation_path(path, generation)])
        return Appended(0, 0)


def matching(rows: DataFrame) -> DataFrame:
    return rows.withColumnsRenamed({"domain": "__domain", "event_id": "__event_id"})


def write_rows(batch: DataFrame, chosen: DataFrame | None, folder: str, n: int, dealt: bool = False) -> None:
    """Writes the chosen rows (domain, event_id, group_pos, row_pos; n of them, None: all) of a batch in folders by domain; large domains are dealt to several files, unless they are ``dealt`` already."""
    place, rows = ["group_pos", "row_pos"], batch
    if chosen is not None:
        same = matching(chosen.withColumnsRenamed({c: f"__{c}" for c in place}))
        both = batch["domain"].eqNullSafe(same["__domain"]) & batch["event_id"].eqNullSafe(same["__event_id"])
        for c in place:
            both &= batch[c].eqNullSafe(same[f"__{c}"])
        rows = batch.join(same, both, "left_semi")
    (rows if dealt and chosen is None else rows.hint("rebalance", "domain")).write.mode("overwrite").partitionBy("domain").parquet(folder)
    if batch.sparkSession.read.parquet(folder).count() != n:  # rows that stand twice at one place; one of each is as good as another
        rows.dropDuplicates(["domain", "event_id"]).hint("rebalance", "domain").write.mode("overwrite").partitionBy("domain").parquet(folder)


def append_unique(batch: DataFrame, path: str) -> tuple[int, int]:
    """``append`` without a quarantine: (written, skipped)."""
    return append(batch, path)[:2]


def known_rows(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """domain, event_id, fp of the wanted identities (domain, event_id) that the ledger's index has; read it before the ledger's next merge."""
    commit = commits.last(spark, path)
    keys, schema = ["domain", "event_id"], "domain string, event_id string, fp binary, h bigint"
    if not commit:
        return wanted.select(*keys, F.lit(None).cast("binary").alias("fp")).limit(0)
    with Scratch(spark) as scratch:
        own = scratch.written(wanted.select(*keys).distinct().withColumn("h", identities.identity_hash()))
        found = identities.looked_up(scratch, path, commit["generations"], own, own.count(), schema)
        return written(found.drop("h").join(own.select(*keys), keys, "left_semi"))


def vacuum(spark: SparkSession, path: str) -> int:
    """Deletes files of writers that never committed, and generations of the index that were merged; how many folders. Only while nobody writes or reads."""
    root, last = path.rstrip("/"), commits.last(spark, path)
    names = {commits.read(spark, path, i)["commit"] for i in commits.numbers(spark, path)}
    live = {g["name"] for g in last["generations"]} if last else set()
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    gone = [f"{root}/{x}" for x in there if x.startswith("commit=") and x.removeprefix("commit=") not in names]
    gone += [identities.generation_path(path, x) for x in identities.batches_of(spark, path) if x not in live]
    delete(spark, gone)
    return len(gone)


def inventory_delta(current: DataFrame, known: DataFrame) -> DataFrame:
    """Path and added, changed, reused or removed, by digest. Both: path, digest."""
    c, k = current.select("path", F.col("digest").alias("now")), known.select("path", F.col("digest").alias("then"))
    state = F.when(F.col("then").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("now") == F.col("then"), "reused").otherwise("changed")
    return c.join(k, "path", "full_outer").select("path", state.alias("state"))


def overlay(base: DataFrame, over: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Rows of both, those of the overlay in place of the base's; of several in one generation the last by ``order``, else the greatest row."""
    both = base.withColumn("__generation", F.lit(0)).unionByName(over.withColumn("__generation", F.lit(1)))
    rest = [c for c in base.columns if c != key]
    last = F.max_by(F.struct(*rest), F.struct("__generation", *([order] if order else rest))).alias("last")
    return both.groupBy(key).agg(last).select(key, *[F.col(f"last.{c}").alias(c) for c in rest]).select(base.columns)


def merged_generations(loose: DataFrame, bundled: DataFrame) -> DataFrame:
    """One row for each (path, sha256), of the loose table where both have it; unequal fingerprints (fp) of one are an error."""
    keys = ["path", "sha256"]
    both = loose.withColumn("__loose", F.lit(1)).unionByName(bundled.withColumn("__loose", F.lit(0)))
    rest = [c for c in loose.columns if c not in keys]
    found = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("__loose", *rest)).alias("kept"), (F.min("fp") != F.max("fp")).alias("differs"))
    bad = found.where("differs").take(1)
    if bad:
        raise IdentityConflict(f"generations of {bad[0]['path']} differ")
    return found.select(*keys, *[F.col(f"kept.{c}").alias(c) for c in rest]).select(loose.columns)


def confirmed_sources(events: DataFrame, ledger: DataFrame) -> DataFrame:
    """For each source whether all its events are in the ledger with equal payloads. events: source, domain, event_id, fp."""
    known = ledger.select("domain", "event_id", F.col("fp").alias("known"))
    return events.join(known, ["domain", "event_id"], "left").groupBy("source").agg(F.bool_and(F.col("fp").eqNullSafe(F.col("known"))).alias("confirmed"), F.count("*").alias("n"))


def one_after_the_other(*inputs: DataFrame) -> DataFrame:
    """The rows of all inputs with ``pos``, the number of their input."""
    out = inputs[0].withColumn("pos", F.lit(1))
    for i, df in enumerate(inputs[1:], 2):
        out = out.unionByName(df.withColumn("pos", F.lit(i)))
    return out
