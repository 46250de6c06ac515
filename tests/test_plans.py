"""Import, compaction, delivery, frozen cohorts and closed contracts on files."""

import copy
import hashlib
import json
import os
import re
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tallybook.functions import digests
from tallybook.operators import closed, contracts, history, paging, unique, wrappers
from tallybook.plans import compaction, delivery, folds, reconcile
from tallybook.sources import jsonl, sinks
from tallybook.sources.scratch import scratch_dir, setting
from tallybook.streaming import ingest


def event(i, kind="agent.run.completed", **over):
    return {"schema_version": "agent-run-event.v0", "event_id": "sha256:" + hashlib.sha256(str(i).encode()).hexdigest(), "kind": kind, "ts": "2026-01-01T00:00:00Z", "source": {"repo": "r", "component": "c", "run_id": "n"}, "subject": {"repo": "r"}, "trust_tier": "observed", "status": "active", "caused_by": [], "evidence_refs": [], "data": {}} | over


class Outbox:
    def __init__(self, tmp_path):
        self.src = tmp_path / "src"
        self.src.mkdir()
        self.path, self.ledger, self.receipts, self.bundles = (str(tmp_path / x) for x in ("src", "ledger", "receipts", "bundles"))

    def put(self, name, events, end="\n"):
        (self.src / name).write_text("\n".join(json.dumps(e) for e in events) + end)

    def run(self, spark, **more):
        return {os.path.basename(r.source): r.state for r in reconcile.import_sources(spark, self.path, self.ledger, self.receipts, **more).collect()}


@pytest.fixture
def outbox(tmp_path):
    return Outbox(tmp_path)


def test_import_reads_only_what_changed(spark, outbox, monkeypatch):
    outbox.put("a.jsonl", [event(1, "agent.run.started"), event(2)])
    outbox.put("b.jsonl", [event(3, "agent.run.started")])
    outbox.put("bad.jsonl", [{"x": 1}])
    outbox.put("cut.jsonl", [event(9)], end="")
    assert outbox.run(spark) == {"a.jsonl": "added", "b.jsonl": "added", "bad.jsonl": "invalid", "cut.jsonl": "invalid"}
    assert spark.read.parquet(outbox.ledger).count() == 3
    read = []
    whole = reconcile.source_events
    monkeypatch.setattr(reconcile, "source_events", lambda spark, paths, *a: read.append(paths) or whole(spark, paths, *a))
    assert outbox.run(spark) == {"a.jsonl": "reused", "b.jsonl": "reused", "bad.jsonl": "invalid", "cut.jsonl": "invalid"} and read == []
    outbox.put("b.jsonl", [event(3, "agent.run.started"), event(4)])
    assert outbox.run(spark)["b.jsonl"] == "changed" and [[os.path.basename(x) for x in paths] for paths in read] == [["b.jsonl"]]
    assert spark.read.parquet(outbox.ledger).count() == 4
    kept = {r.source.rsplit("/", 1)[1]: (r.imported, r.skipped) for r in spark.read.parquet(outbox.receipts).orderBy("recorded_at").collect()}
    assert kept == {"a.jsonl": (2, 0), "b.jsonl": (1, 1)}
    os.utime(outbox.src / "a.jsonl")  # the same bytes at another time: read again, and the receipt still holds
    assert outbox.run(spark)["a.jsonl"] == "reused"
    (outbox.src / "a.jsonl").unlink()
    assert outbox.run(spark)["a.jsonl"] == "removed"
    states = reconcile.import_sources(spark, outbox.path, outbox.ledger, outbox.receipts)
    assert {r.state: r.sources for r in reconcile.import_totals(states).collect()} == {"reused": 1, "invalid": 2, "removed": 1}


def test_import_stops_at_a_conflict_and_at_other_producers(spark, outbox):
    outbox.put("a.jsonl", [event(1), event(2)])
    assert outbox.run(spark, producer=("r", "other")) == {"a.jsonl": "invalid"}
    outbox.put("a.jsonl", [event(1), event(2), event(5)])
    assert outbox.run(spark, producer=("r", "c")) == {"a.jsonl": "added"} or outbox.run(spark)["a.jsonl"] in ("changed", "reused")
    outbox.put("b.jsonl", [event(7), event(1, data={"summary": "another"})])
    with pytest.raises(unique.IdentityConflict):
        outbox.run(spark)
    assert spark.read.parquet(outbox.ledger).count() == 3


def test_compaction(spark, outbox):
    for i in range(4):
        outbox.put(f"f{i}.jsonl", [event(10 * i, "agent.run.started"), event(10 * i + 1)])
    outbox.put("g.jsonl", [event(100, "agent.run.started")])
    outbox.put("h.jsonl", [{"x": 1}])
    now = datetime.now(timezone.utc) + timedelta(days=2)
    job = lambda **more: {os.path.basename(r.source): r.reason for r in compaction.compact(spark, outbox.path, outbox.receipts, outbox.ledger, outbox.bundles, **({"now": now} | more)).collect()}
    assert set(job().values()) == {"receipt_invalid_or_missing", "nonterminal", "invalid_source"}
    outbox.run(spark)
    fine = {f"f{i}.jsonl": "eligible" for i in range(4)} | {"g.jsonl": "nonterminal", "h.jsonl": "invalid_source"}
    assert job() == fine and not os.path.exists(outbox.bundles)
    assert set(job(now=datetime.now(timezone.utc)).values()) == {"grace_pending", "nonterminal", "invalid_source"}
    assert job(max_sources=2) == fine | {"f2.jsonl": "source_bound", "f3.jsonl": "source_bound", "g.jsonl": "source_bound", "h.jsonl": "source_bound"}
    size = (outbox.src / "f0.jsonl").stat().st_size
    assert sorted(job(max_bytes=2 * size + 10).values()).count("byte_bound") == 2
    with pytest.raises(ValueError):
        job(now=datetime(2030, 1, 1))
    assert job(apply=True) == fine
    manifest = spark.read.parquet(outbox.bundles + "/manifests").collect()
    assert len(manifest) == 1 and manifest[0].n_sources == 4 and manifest[0].bytes == 4 * size
    assert not compaction.refresh(spark, outbox.bundles)  # nothing changed, nothing written
    job(apply=True)  # again: the same bundle
    assert spark.read.parquet(outbox.bundles + "/manifests").count() == 1
    assert spark.read.parquet(outbox.bundles + "/index").count() == 4
    job(apply=True, remove=True)
    assert sorted(p.name for p in outbox.src.glob("*.jsonl")) == ["g.jsonl", "h.jsonl"]
    index = spark.read.parquet(outbox.bundles + "/index")
    states = {os.path.basename(r.source): r.state for r in reconcile.import_sources(spark, outbox.path, outbox.ledger, outbox.receipts, archived=index).collect()}
    assert states == {"g.jsonl": "reused", "h.jsonl": "invalid"}
    with pytest.raises(ValueError):
        compaction.rebuild(spark, outbox.bundles, outbox.ledger)
    fresh = outbox.ledger + "-again"
    assert compaction.rebuild(spark, outbox.bundles, fresh) == (8, 0)
    assert {r.payload for r in spark.read.parquet(fresh).collect()} < {r.payload for r in spark.read.parquet(outbox.ledger).collect()}


def test_rebuild_refuses_a_changed_bundle(spark, outbox):
    outbox.put("a.jsonl", [event(1), event(2)])
    outbox.run(spark)
    compaction.compact(spark, outbox.path, outbox.receipts, outbox.ledger, outbox.bundles, datetime.now(timezone.utc) + timedelta(days=2), apply=True).collect()
    folder = spark.read.parquet(outbox.bundles + "/manifests").first()["path"].removeprefix("file:")
    part = next(os.path.join(folder, f) for f in os.listdir(folder) if f.endswith(".txt"))
    for f in os.listdir(folder):  # with the checksum that would report it first
        if f.endswith(".crc"):
            os.unlink(os.path.join(folder, f))
    with open(part) as f:
        text = f.read()
    with open(part, "w") as f:
        f.write(text.replace("2026-01-01", "2026-01-02"))
    with pytest.raises(ValueError):
        compaction.rebuild(spark, outbox.bundles, outbox.ledger + "-again")


def test_rebuild_reads_several_bundles_and_refuses_a_faulty_index(spark, outbox):
    later = datetime.now(timezone.utc) + timedelta(days=2)
    for i, name in enumerate(("a.jsonl", "b.jsonl")):
        outbox.put(name, [event(2 * i), event(2 * i + 1)])
        outbox.run(spark)
        compaction.compact(spark, outbox.path, outbox.receipts, outbox.ledger, outbox.bundles, later, apply=True, remove=True).collect()
    assert spark.read.parquet(outbox.bundles + "/manifests").count() == 2
    assert compaction.archive_faults(spark, outbox.bundles).count() == 0
    index = spark.createDataFrame(spark.read.parquet(outbox.bundles + "/index").toArrow())
    for wrong, fault in ((index.limit(1), "not in the index"), (index.unionByName(index), "twice"), (index.withColumn("manifest_sha256", F.lit("x")), "not in its bundle")):
        wrong.write.mode("overwrite").parquet(outbox.bundles + "/index")
        assert fault in {r.fault for r in compaction.archive_faults(spark, outbox.bundles).collect()}
        with pytest.raises(ValueError, match="index"):
            compaction.rebuild(spark, outbox.bundles, outbox.ledger + "-again")
    assert compaction.refresh(spark, outbox.bundles)
    assert compaction.rebuild(spark, outbox.bundles, outbox.ledger + "-again") == (4, 0)


def test_bundles_keep_their_limit_and_manifests_bind(spark):
    rows = [("p", f"s{i}", n, f"d{i}") for i, n in enumerate((1000, 1500, 1500, 2000, 2500, 100))]
    df = spark.createDataFrame(rows, "shard string, source string, bytes bigint, digest string")
    placed = sinks.bundle(df, 2000, "shard")
    out = {r.source: (r.bundle, r.start_offset, r.end_offset) for r in placed.collect()}
    assert out == {"s0": (0, 0, 1000), "s1": (1, 0, 1500), "s2": (2, 0, 1500), "s3": (3, 0, 2000), "s5": (4, 0, 100)}
    manifest = sinks.manifests(placed, "shard")
    assert sinks.intact(manifest, "shard", df).where("not intact").count() == 0
    assert sinks.intact(manifest.withColumn("bytes", F.col("bytes") + 1), "shard").where("intact").count() == 0
    other = df.withColumn("digest", F.when(F.col("source") == "s1", "x").otherwise(F.col("digest")))
    assert [r.bundle for r in sinks.intact(manifest, "shard", other).where("not intact").collect()] == [1]
    index = sinks.archive_index(manifest, "shard")
    assert sinks.index_faults(index, manifest, "shard").count() == 0
    faults = sinks.index_faults(index.unionByName(index.where("source = 's0'")).where("source <> 's1'").withColumn("bundle", F.when(F.col("source") == "s2", 9).otherwise(F.col("bundle"))), manifest, "shard")
    assert sorted((r.source, r.fault) for r in faults.collect()) == [("s0", "twice"), ("s1", "not in the index"), ("s2", "not in its bundle"), ("s2", "not in the index")]


def test_freeze_binds_every_byte(spark, tmp_path):
    def receipt(values, query=None, ledger=None):
        rows = [(f"e{i}", 5, i, "d", json.dumps({"v": v})) for i, v in enumerate(values)]
        df = spark.createDataFrame(rows, "event_id string, ts int, seq int, domain string, value string")
        receipt.n += 1
        return sinks.freeze(df, str(tmp_path / f"c{receipt.n}"), query or {}, df if ledger is None else ledger).drop("cohort_path").first()

    receipt.n = 0
    aa, bb, ab, again = receipt("aa"), receipt("bb"), receipt("ab"), receipt("aa")
    assert len({x.content_sha256 for x in (aa, bb, ab, receipt("ba"))}) == 4
    assert aa.content_sha256 == again.content_sha256 and aa.event_count == 2 and aa.bytes == 2 * len('{"v":"a"}\n')
    assert receipt("aa", {"repo": "r"}).query_sha256 != aa.query_sha256
    bad = spark.createDataFrame([("d", 0, "{")], "domain string, seq int, value string")
    with pytest.raises(ValueError):
        receipt("aa", ledger=bad)
    other = spark.createDataFrame([("d", 0, "{}")], "domain string, seq int, value string")
    assert receipt("aa", ledger=other).snapshot_sha256 != aa.snapshot_sha256 and receipt("aa", ledger=other).content_sha256 == aa.content_sha256


def test_walk_has_no_depth_limit(spark):
    value = {"stdout": "x", "token": ["password: hunter2", {"deep": "/home/me"}]}
    for i in range(40):
        value = {f"k{i}": value} if i % 2 else [value]
    df = spark.createDataFrame([(1, json.dumps(value)), (2, "{"), (3, '{"a":1}')], "id int, text string")
    found = sorted((r.id, r.path.rsplit(".", 1)[-1], r.finding) for r in wrappers.nested_redaction(df, "text", ["id"]).collect())
    assert found == [(1, "deep", "private path"), (1, "stdout", "raw output"), (1, "token[0]", "secret assignment")]
    assert [(r.path, r.key, r.kind, r.value) for r in folds.walk(df.where("id = 3"), "text", ["id"]).collect()] == [("$.a", "a", "number", "1")]


def test_pages_pass_corrupt_lines(spark):
    rows = [("d", i, 10 * i, 10 * i + 10, i in (3, 7, 8)) for i in range(10)] + [("e", i, 10 * i, 10 * i + 10, False) for i in range(5)]
    df = spark.createDataFrame(rows, "domain string, seq bigint, start_offset bigint, next_offset bigint, valid boolean")
    page = lambda cursor, n: {r.domain: ([x.seq for x in r["items"]], r.has_more, r.next_cursor) for r in paging.pages(df, "domain", cursor, n).collect()}
    assert page(0, 2) == {"d": ([3, 7], True, 80), "e": ([], False, 50)}
    assert page(80, 2) == {"d": ([8], False, 100), "e": ([], False, 80)}
    assert page(100, 2) == {"d": ([], False, 100), "e": ([], False, 100)}
    with pytest.raises(ValueError):
        paging.latest(df, "domain")


def test_contiguous_ranges(spark):
    rows = [("a", 0, 5, 9), ("a", 5, 9, 9), ("b", 0, 5, 9), ("b", 6, 9, 9), ("c", 0, 5, 9), ("c", 0, 5, 9), ("c", 5, 9, 9), ("d", 1, 9, 9), ("e", 0, 8, 9), ("f", 0, 4, 8), ("f", 4, 6, 8), ("f", 2, 8, 8), ("g", 0, 0, 0)]
    df = spark.createDataFrame(rows, "k string, start_offset bigint, end_offset bigint, bytes bigint")
    assert {r.k for r in history.contiguous(df, "k", "bytes").where("contiguous").collect()} == {"a"}
    assert {r.k for r in history.contiguous(df, "k").where("contiguous").collect()} == {"a", "e"}


def test_groups_and_generations(spark):
    groups = spark.createDataFrame([("g", 0), ("h", 1)], "group_id string, group_pos int")
    rows = spark.createDataFrame([(0,), (1,)], "group_pos int")
    unique.check_groups(groups, rows)
    for bad in (groups.unionByName(groups.where("group_pos = 0")), groups.withColumn("group_id", F.lit(""))):
        with pytest.raises(ValueError):
            unique.check_groups(bad, rows)
    with pytest.raises(ValueError):
        unique.check_groups(groups, rows.where("group_pos = 0"))
    schema = "path string, sha256 string, fp string, at string"
    loose = spark.createDataFrame([("p", "1", "x", "loose"), ("q", "2", "y", "loose")], schema)
    bundled = spark.createDataFrame([("p", "1", "x", "bundle"), ("r", "3", "z", "bundle")], schema)
    assert {(r.path, r.at) for r in unique.merged_generations(loose, bundled).collect()} == {("p", "loose"), ("q", "loose"), ("r", "bundle")}
    with pytest.raises(unique.IdentityConflict):
        unique.merged_generations(loose, bundled.withColumn("fp", F.lit("other")))
    base = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, v int")
    assert {(r.k, r.v) for r in unique.overlay(base, spark.createDataFrame([("b", 0)], "k string, v int"), "k").collect()} == {("a", 2), ("b", 0)}


def test_inventory_and_loaders(spark, tmp_path):
    root = tmp_path / "root"
    for name in ("p/outbox/a.jsonl", "q/outbox/b.jsonl", "p/outbox/bundles/x.manifest.json"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("{}\n")
    assert sorted((r.kind, r.name, r.bytes) for r in jsonl.inventory(spark, str(root)).collect()) == [("loose", "a.jsonl", 3), ("loose", "b.jsonl", 3), ("manifest", "x.manifest.json", 3)]
    assert jsonl.inventory(spark, str(tmp_path / "none")).collect() == []
    stream = tmp_path / "s.json"
    stream.write_text('{"a":\n 1}\n\n[1,\n2] {"b": "é"}"x" oops {"c":1}')
    values = lambda **more: [r.value for r in jsonl.concatenated(spark, str(stream), **more).orderBy("seq").collect()]
    assert values() == ['{"a":1}', "[1,2]", '{"b":"é"}', '"x"'] and values(last=2) == ['{"b":"é"}', '"x"']
    odd = tmp_path / "odd"
    odd.mkdir()
    (odd / "a").write_text('[{"id":1},5]')
    assert jsonl.loaded(spark, str(odd)).count() == 2
    with pytest.raises(ValueError):
        jsonl.loaded(spark, str(odd), only_objects=True)
    log = tmp_path / "log.jsonl"
    log.write_text('{"a":1}\n{"a":2}\n{"a":')
    first, sizes = jsonl.snapshot(spark, str(log))
    assert first.count() == 2
    log.write_text('{"a":1}\n{"a":2}\n{"a":3}\n')
    assert jsonl.snapshot(spark, str(log), sizes=sizes)[0].count() == 2 and jsonl.snapshot(spark, str(log))[0].count() == 3


def test_many_small_files_share_tasks(spark, tmp_path):
    for i in range(90):
        (tmp_path / f"{i:03}.txt").write_text("".join(f"{i} {'x' * k}\n" for k in range(i % 7 + 1)))
    with setting(spark, "spark.sql.files.maxPartitionBytes", "4194304"):  # a file in each of Spark's own tasks
        own = jsonl.lines(spark, f"{tmp_path}/*.txt")
        assert own.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
        rows = own.collect()
    texts = {os.path.basename(r.path): (tmp_path / os.path.basename(r.path)).read_bytes() for r in rows}
    assert len(texts) == 90 and len(rows) == sum(i % 7 + 1 for i in range(90))
    assert all(texts[os.path.basename(r.path)][r.start_offset : r.next_offset] == r.value.encode() + b"\n" for r in rows)


def test_delivery_resumes(spark, tmp_path):
    src, receipts, sent = tmp_path / "src", str(tmp_path / "receipts"), tmp_path / "sent"
    src.mkdir()
    sent.mkdir()
    put = lambda name, ids: (src / name).write_text("".join(json.dumps(event(i)) + "\n" for i in ids))
    put("a.jsonl", range(5))
    put("b.jsonl", range(10, 12))
    size = len(json.dumps(event(0)))
    refuse = str(sent / "refuse")

    def send(values):
        if os.path.exists(refuse) and any('"sha256:' + hashlib.sha256(b"2").hexdigest() in v for v in values):
            return 503
        with open(os.path.join(os.path.dirname(refuse), "log"), "a") as f:
            f.write(json.dumps([json.loads(v)["event_id"] for v in values]) + "\n")
        return 200

    ids = lambda ns: ["sha256:" + hashlib.sha256(str(n).encode()).hexdigest() for n in ns]
    log = lambda: sorted(json.loads(x) for x in open(sent / "log").read().splitlines())
    run = lambda: {os.path.basename(r.source): (r.events, r.state) for r in delivery.deliver(spark, str(src), receipts, send, 2 * size + 10).collect()}
    own = lambda: delivery.outbox_lines(spark, str(src))
    flushed = lambda: {os.path.basename(r.source): r.flushed for r in delivery.status(own(), delivery.progress(spark, receipts)).collect()}
    open(refuse, "w").close()
    assert run() == {"a.jsonl": (2, "failed"), "b.jsonl": (2, "done")}
    assert log() == sorted([ids((0, 1)), ids((10, 11))]) and flushed() == {"a.jsonl": False, "b.jsonl": True}
    waiting, by_repo, by_run = delivery.preview(own(), delivery.progress(spark, receipts))
    assert waiting.count() == 1 and by_repo.count() == 1 and by_run.count() == 1 and delivery.pending(own(), delivery.progress(spark, receipts)).count() == 5
    os.unlink(refuse)
    assert run()["a.jsonl"] == (5, "done") and log() == sorted([ids((0, 1)), ids((10, 11)), ids((2, 3)), ids((4,))])
    before = log()
    assert run() == {"a.jsonl": (5, "done"), "b.jsonl": (2, "done")} and log() == before
    put("b.jsonl", range(10, 13))
    assert run()["b.jsonl"] == (3, "done") and log() == sorted([*before, ids((12,))])
    put("a.jsonl", [7, 1, 2, 3, 4, 5])
    assert run()["a.jsonl"] == (5, "changed") and [os.path.basename(r.source) for r in delivery.delivered(own(), delivery.progress(spark, receipts)).collect()] == ["b.jsonl"]


def test_delivery_of_many_requests_is_one_pass(spark, tmp_path):
    """As many jobs for a thousand requests of a source as for one, and a task that dies goes on behind its last accepted request."""
    src, log, crash = tmp_path / "src", str(tmp_path / "log"), str(tmp_path / "crash")
    src.mkdir()
    (src / "a.jsonl").write_text("".join(f'{{"n":{i:04}}}\n' for i in range(1000)))
    (src / "b.jsonl").write_text('{"n":0000}\n')

    def send(values):
        with open(log, "a") as f:
            f.write("".join(v[5:9] + "\n" for v in values))
        if os.path.exists(crash) and "0400" in values[0]:
            os.unlink(crash)
            os._exit(1)  # the worker dies after the receiver has it and before it is noted
        return 200

    tracker = spark.sparkContext.statusTracker()
    def jobs(receipts, path):
        spark.sparkContext.setJobGroup(receipts, receipts)
        out = {os.path.basename(r.source): (r.events, r.state) for r in delivery.deliver(spark, path, str(tmp_path / receipts), send, 12).collect()}
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return out, len(tracker.getJobIdsForGroup(receipts))

    few, n_few = jobs("few", str(src / "b.jsonl"))
    os.unlink(log)
    many, n_many = jobs("many", str(src / "a.jsonl"))
    assert few == {"b.jsonl": (1, "done")} and many == {"a.jsonl": (1000, "done")} and n_many <= n_few + 2
    assert open(log).read().split() == [f"{i:04}" for i in range(1000)]
    # a run whose task dies for good leaves its notes; the next one goes on there
    os.unlink(log)
    open(crash, "w").close()
    with pytest.raises(Exception):
        delivery.deliver(spark, str(src / "a.jsonl"), str(tmp_path / "killed"), send, 12)
    assert {r.events for r in delivery.progress(spark, str(tmp_path / "killed")).collect()} == {400}
    (src / "c.jsonl").write_text('{"n":2000}\n')
    delivery.Progress(delivery.progress_folder(str(tmp_path / "killed"))).write("file:" + str(src / "c.jsonl"), 11, 1, hashlib.sha256(folds.START + b'{"n":2000}').digest())
    assert jobs("killed", str(src / "[ac].jsonl"))[0] == {"a.jsonl": (1000, "done"), "c.jsonl": (1, "done")}
    assert {r.events for r in spark.read.parquet(str(tmp_path / "killed")).collect()} == {1000, 1}
    assert open(log).read().split() == [f"{i:04}" for i in range(401)] + [f"{i:04}" for i in range(400, 1000)]
    assert not os.path.exists(delivery.progress_folder(str(tmp_path / "killed")))
    with pytest.raises(ValueError):
        delivery.deliver(spark, str(src), str(tmp_path / "none"), send, 5)


def test_outbox_append(spark, tmp_path):
    path = str(tmp_path / "box")
    rows = lambda events: spark.createDataFrame([(json.dumps(e),) for e in events], "value string")
    assert delivery.append_outbox(rows([event(1), event(2)]), path).count() == 0
    assert os.path.isdir(path + "/producer=r_c/run=n")
    with pytest.raises(ValueError):
        delivery.append_outbox(rows([event(3), {"x": 1}]), path)
    assert spark.read.text(path).count() == 2
    ordered = spark.createDataFrame([(json.dumps(event(i)), i * 7 % 40) for i in range(40)] + [('{"x": 1}', 41)], "value string, seq long").repartition(5)
    assert delivery.append_outbox(ordered, path + "2", refuse_all=False).count() == 1
    (part,) = [f for f in os.listdir(path + "2/producer=r_c/run=n") if f.endswith(".txt")]
    assert [json.loads(x)["event_id"] for x in open(f"{path}2/producer=r_c/run=n/{part}")] == [event(i)["event_id"] for i in sorted(range(40), key=lambda i: i * 7 % 40)]
    delivery.raw_append(rows([{"domain": "other", "a": 1}]), "mine", str(tmp_path / "raw"))
    assert json.loads(spark.read.text(str(tmp_path / "raw")).first()["value"]) == {"a": 1, "domain": "mine"}


def test_outbox_of_many_runs_starts_no_process_for_a_file(spark, tmp_path):
    path = str(tmp_path / "box")
    text = json.dumps(event(1))
    rows = spark.range(120).selectExpr(f"replace('{text}', '\"run_id\": \"n\"', concat('\"run_id\": \"n', id % 40, '\"')) AS value", "120 - id AS seq")
    assert delivery.append_outbox(rows, path).count() == 0
    found = [os.path.join(folder, f) for folder, _, names in os.walk(path) for f in names]
    assert len(found) == 40 and all(re.fullmatch(r".*/producer=r_c/run=n\d+/part-\w+\.txt", f) for f in found)  # Spark's writers leave a .crc beside each
    assert {len(open(f).readlines()) for f in found} == {3}


def test_members_of_an_event_are_read_in_one_pass(spark):
    own = contracts.with_agent_run_errors(jsonl.records(spark.createDataFrame([(json.dumps(event(1) | {"more": 1}),), (json.dumps(event(2) | {"corrects": None}),), ("[1]",)], "value string")), "v")
    assert not re.search(r"variant_get\([^,]+, \$\.", own._jdf.queryExecution().optimizedPlan().toString())
    first, second, third = (r.errors for r in own.orderBy(F.length("value").desc()).collect())
    assert sorted([first, second]) == [["$.corrects: items"], ["$: unknown key"]] and third[0] == "$: not an object"


def test_event_list_receipt(spark):
    df = spark.createDataFrame([("b", "{}"), ("a", "[]")], "event_id string, canonical string")
    row = reconcile.event_list_receipt(df, 2, 0).first()
    assert row.event_ids == ["a", "b"] and row.requested == 2 and row.receipt_sha256.startswith("sha256:")
    assert reconcile.event_list_receipt(df.withColumn("canonical", F.lit("{}")), 2, 0).first().batch_sha256 != row.batch_sha256


def changed(value, path, new):
    out = copy.deepcopy(value)
    at = out
    *front, last = path.split(".")
    for k in front:
        at = at[int(k)] if k.isdigit() else at[k]
    if new is KeyError:
        del at[int(last) if last.isdigit() else last]
    else:
        at[int(last) if last.isdigit() else last] = new
    return out


def errors(spark, judge, values):
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "id int, text string").withColumn("v", F.try_parse_json("text"))
    return [r.errors for r in judge(df).orderBy("id").collect()]


HISTORY = {
    "schema_version": "own.history.v1", "domain": "own.history", "event_id": "e", "kind": "deployment", "ts": "2026-01-01T00:00:00+01:00", "source": {"origin": "o", "repo": "r", "component": "c", "version": "1", "revision": None},
    "correlation_id": "c", "source_evidence": [{"authority": "a", "reference": "r", "sha256": "0" * 64}], "privacy": {"classification": "public", "contains_personal_data": False},
    "lifecycle": {"state": "active", "target_event_id": None, "authority_reference": "x"}, "authority": {"primary_truth": "elsewhere", "role": "projection", "writeback_allowed": False}, "payload": {"any": {"thing": 1}},
}


def test_history_contract(spark):
    given = {"$.schema_version": "own.history.v1", "$.domain": "own.history", "$.authority.role": "projection"}
    cases = [
        (HISTORY, None), (changed(HISTORY, "kind", "other"), "$.kind: not allowed"), (changed(HISTORY, "extra", 1), "$: unknown key"), (changed(HISTORY, "payload", []), "$.payload: not allowed"),
        (changed(HISTORY, "lifecycle.target_event_id", "t"), "$.lifecycle.target_event_id: not allowed"), (changed(HISTORY, "lifecycle.state", "deleted"), "$.lifecycle.target_event_id: not allowed"),
        (changed(changed(HISTORY, "lifecycle.state", "deleted"), "lifecycle.target_event_id", "t"), None), (changed(HISTORY, "authority.primary_truth", "ledger:x"), "$.authority.primary_truth: not allowed"),
        (changed(HISTORY, "authority.primary_truth", "ledgers"), None), (changed(HISTORY, "authority.writeback_allowed", True), "$.authority.writeback_allowed: not allowed"), (changed(HISTORY, "source_evidence", []), "$.source_evidence: not allowed"),
        (changed(HISTORY, "source_evidence.0.extra", 1), "$.source_evidence: not allowed"), (changed(HISTORY, "source_evidence.0.sha256", 5), "$.source_evidence: not allowed"), (changed(HISTORY, "source.revision", KeyError), None),
        (changed(HISTORY, "source", KeyError), "$.source: missing"), (changed(HISTORY, "ts", "2026-01-01"), "$.ts: not allowed"), (changed(HISTORY, "domain", "other"), "$.domain: not allowed"), (changed(HISTORY, "event_id", 5), "$.event_id: not allowed"),
        ([], "$: not an object"),
    ]
    found = errors(spark, lambda df: closed.with_history_errors(df, "v", given, r"^(?:own/)?ledger(?:$|[.:/])"), [c for c, _ in cases])
    assert [(e or [None])[0] for e in found] == [e for _, e in cases]
    both = changed(changed(HISTORY, "kind", "other"), "correlation_id", "")
    assert errors(spark, lambda df: closed.with_history_errors(df, "v", given, "^$"), [both]) == [["$.correlation_id: not allowed", "$.kind: not allowed"]]


def export_of(**over):
    payload = {"version": "operator.routing_outcome.v1", "decision_id": "d", "ts": "2026-01-01T00:00:00Z", "task_class": "coding", "route_used": "a:b", "outcome": "success", "resolved": True, "reward": 0.5, "metrics": {"completion_state": "completed", "friction_count": 0, "blocked_by_platform_filter": False, "manual_operator_needed": False}, "does_not_establish": ["x"]} | over.pop("payload", {})
    canonical = lambda x: json.dumps(x, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()
    out = {
        "schema_version": "export.v1", "kind": "operator.routing_outcome.exported", "ts": "2026-01-01T00:00:05Z", "source": {"repo": "own/repo", "component": "c", "revision": "a" * 40, "run_id": "n"},
        "payload_contract": {"owner": "o", "source_repository": "o", "source_revision": "b" * 40, "source_path": "p", "sha256": "c" * 64}, "payload_sha256": hashlib.sha256(canonical(payload)).hexdigest(), "payload": payload,
        "freshness": {"observed_at": "2026-01-01T00:00:00Z", "exported_at": "2026-01-01T00:00:05Z", "consumer_must_recompute": True}, "evidence_refs": [{"kind": "k", "ref": "r", "sha256": "0" * 64}],
        "boundary": {"transport_authority": "t", "payload_authority": "p", "routing_authority": "none", "raw_logs_included": False, "secrets_included": False, "auto_apply_permitted": False}, "non_claims": ["a", "b"],
    }
    for path, new in over.items():
        out = changed(out, path.replace("__", "."), new)
    return out | {"event_id": "sha256:" + hashlib.sha256(canonical(out)).hexdigest()}


def test_export_contract(spark):
    fixed = export_of()
    given = {f"$.payload_contract.{k}": v for k, v in fixed["payload_contract"].items()} | {"$.schema_version": "export.v1", "$.source.repo": "own/repo", "$.boundary.transport_authority": "t", "$.boundary.payload_authority": "p", "$.non_claims": ("a", "b")}
    cases = [
        (fixed, []),
        (export_of(payload={"reward": 2}), ["$.payload.reward: not allowed"]),
        (export_of(payload={"reward": 1.0}), []),
        (export_of(payload={"friction": [{"kind": "network", "surface": "s", "resolved": 1}]}), ["$.payload.friction: not allowed"]),
        (export_of(payload_sha256="0" * 64), ["$.payload_sha256: not the payload's"]),
        (fixed | {"event_id": "sha256:" + "0" * 64}, ["$.event_id: not the content's"]),
        (export_of(payload_contract__sha256="d" * 64), ["$.payload_contract.sha256: not allowed"]),
        (export_of(freshness__observed_at="2026-01-01T00:00:09Z"), ["$.freshness.exported_at: before observed_at"]),
        (export_of(ts="2026-01-01T00:00:06Z"), ["$.ts: not the time of export"]),
        (export_of(non_claims=["b", "a"]), []),
        (export_of(non_claims=["a", "a"]), ["$.non_claims: not allowed"]),
        (export_of(evidence_refs__0__ref="see /home/me"), ["$.evidence_refs[0].ref: private path"]),
    ]
    assert errors(spark, lambda df: closed.with_export_errors(df, "text", "id", given), [c for c, _ in cases]) == [e for _, e in cases]


def test_runtime_contract(spark):
    second = "2026-01-01T00:00:00Z"
    good = {
        "schema_version": "runtime-lens-observation.v1", "event_id": "sha256:" + "0" * 64, "kind": "runtime.lens.observation", "ts": second, "source": {"repo": "r", "component": "c", "run_id": "n"}, "subject": {"system": "s", "repo": "r"},
        "code_evidence": {"authority_label": "snapshot", "snapshot": {"stem": "s", "repo": "r", "commit": "abcdef1", "manifest_sha256": "0" * 64}, "citations": [{"ref": "r", "source_file": "f", "line_start": 1, "line_end": 2, "content_sha256": "0" * 64}]},
        "runtime_evidence": [{"source_type": "health_endpoint", "observed_at": second, "authority_label": "observed_runtime", "provenance": {"uri": "u"}, "summary": "s"}], "drift": {"status": "unknown", "basis": "none", "summary": "s"},
        "authority": {"code_authority": "c", "runtime_authority": "r", "verdict_authority": "none"}, "boundary": {"forbidden": ["deploy", "write"]}, "non_claims": ["x", "y"],
    }
    given = {"$.code_evidence.authority_label": "snapshot", "$.authority.code_authority": "c", "$.authority.runtime_authority": "r", "$.boundary.forbidden": ("deploy", "write"), "$.non_claims": ("x", "y")}
    cases = [
        (good, None), (changed(good, "runtime_evidence.0.provenance", {}), "$.runtime_evidence: not allowed"), (changed(good, "runtime_evidence.0.provenance.uri", ""), "$.runtime_evidence: not allowed"),
        (changed(good, "code_evidence.citations.0.line_start", 0), "$.code_evidence.citations: not allowed"), (changed(good, "boundary.forbidden", ["deploy"]), "$.boundary.forbidden: not allowed"), (changed(good, "boundary.forbidden", ["write", "deploy"]), None),
        (changed(good, "authority.verdict_authority", "all"), "$.authority.verdict_authority: not allowed"), (changed(good, "drift.basis", "guess"), "$.drift.basis: not allowed"), (changed(good, "runtime_evidence.0.source_type", "own_receipt"), None),
    ]
    found = errors(spark, lambda df: closed.with_runtime_errors(df, "v", given, ("own_receipt",)), [c for c, _ in cases])
    assert [(e or [None])[0] for e in found] == [e for _, e in cases]
    assert errors(spark, lambda df: closed.with_outside_errors(df, "v"), [{"event": "e", "status": "s", "more": 1}, {"event": 5}]) == [[], ["$.event: not allowed", "$.status: missing"]]


def test_chains_over_streams(spark, tmp_path):
    rows = [("a", i, f"v{i}") for i in range(6)] + [("b", i, f"w{i}") for i in range(4)]
    df = spark.createDataFrame(rows, "k string, seq int, value string")
    whole = {r.k: (r.chain, r.records) for r in folds.hash_chain(df, "k").collect()}
    for part in ("seq < 2", "seq = 2 and k = 'a'", "seq > 2 or seq = 2 and k = 'b'"):
        df.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = ingest.poll(spark, str(tmp_path / "in"), "k string, seq int, value string")
        ingest.chains(stream, "k", str(tmp_path / "state"), str(tmp_path / "ck")).awaitTermination(120)
    assert {r.k: (r.chain, r.records) for r in ingest.latest_chains(spark, "k", str(tmp_path / "state")).collect()} == whole


def test_validity_is_reused(spark, tmp_path):
    rows = [("f", 10 * i, 10 * i + 10, i % 3) for i in range(6)]
    df = spark.createDataFrame(rows, "path string, start_offset bigint, next_offset bigint, v int")
    seen = []

    def judge(lines):
        seen.append(sorted(r.start_offset for r in lines.collect()))
        return lines.withColumn("errors", F.expr("case when v = 0 then array('zero') else array() end"))

    run = lambda lines, contract="c1": sorted((r.start_offset, r.errors) for r in ingest.validated(lines, "path", str(tmp_path / "v"), contract, judge).collect())
    first = run(df.where("start_offset < 30"))
    again = run(df)
    assert seen == [[0, 10, 20], [30, 40, 50]] and again[:3] == first and len(again) == 6
    assert run(df) == again and seen[-1] == []
    run(df, "c2")
    assert len(seen[-1]) == 6


def test_counters_as_a_stream(spark, tmp_path):
    df = spark.createDataFrame([("d", "k"), ("d", "k"), ("e", "k")], "domain string, kind string")
    df.write.parquet(str(tmp_path / "in"))
    query = ingest.counters(ingest.poll(spark, str(tmp_path / "in"), "domain string, kind string")).writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r.domain, r.n) for r in spark.table("counted").collect()} == {("d", 2), ("e", 1)}


def test_metrics_export_takes_the_first_of_equal_times(spark, tmp_path):
    rows = [("2026-01-01T23:30:00-02:00", "late", 0), ("2026-01-02T01:30:00+00:00", "same time", 1), ("2026-01-01T00:00:00Z", "early", 2)]
    sinks.export_metrics(spark.createDataFrame(rows, "time_text string, payload string, seq int"), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m/latest")).first()["payload"] == "late"
    days = lambda: sorted(p for p in os.listdir(tmp_path / "m/by_date") if p.startswith("date="))
    assert days() == ["date=2026-01-01", "date=2026-01-02"]
    sinks.export_metrics(spark.createDataFrame([("2026-01-02T09:00:00Z", "again", 0), ("2026-01-03T09:00:00Z", "next", 1)], "time_text string, payload string, seq int"), str(tmp_path / "m"))
    assert days() == ["date=2026-01-01", "date=2026-01-02", "date=2026-01-03"]  # earlier dates stay
    assert {r.payload for r in spark.read.json(str(tmp_path / "m/by_date/date=2026-01-02")).collect()} == {"again"}
    assert spark.read.json(str(tmp_path / "m/latest")).first()["payload"] == "next"


def test_digests_bind_order_and_not_splits(spark):
    rows = [("k", i * 7, f"v{i}") for i in range(3000)] + [("j", i * 5, "w") for i in range(10)]
    df = spark.createDataFrame(rows, "k string, seq bigint, leaf string")
    found = lambda d: {r.k: r.digest for r in folds.merkle(d, ["k"], "leaf", 5).collect()}
    whole = found(df.coalesce(1))
    assert found(df.repartition(7)) == whole and set(whole) == {"j", "k"}
    swapped = df.withColumn("seq", F.when(F.col("seq") == 7, 14).when(F.col("seq") == 14, 7).otherwise(F.col("seq")))
    assert found(swapped)["k"] != whole["k"] and found(swapped)["j"] == whole["j"]
    assert found(df.withColumn("leaf", F.when(F.col("seq") == 20993, "x").otherwise(F.col("leaf"))))["k"] != whole["k"]




def test_snapshot_chain_is_over_all_bytes_of_each_domain(spark):
    rows = [("b", 3, "z"), ("a", 2, "y"), ("a", 1, "é"), ("b", 9, "")]
    found = folds.snapshot_chain(spark.createDataFrame(rows, "domain string, seq int, value string"), "domain").first()
    entries = []
    for d in ("a", "b"):
        chain = b"\0" * 32
        for _, _, value in sorted(r for r in rows if r[0] == d):
            chain = hashlib.sha256(chain + value.encode()).digest()
        entries.append({"domain": d, "chain": chain.hex(), "records": 2})
    assert tuple(found) == (4, hashlib.sha256(json.dumps(entries, separators=(",", ":")).encode()).hexdigest())
    from tallybook import queries

    assert "RECURSIVE" in queries.ORACLE_SQL["ledger_snapshot"]  # the chain is what the query's SQL asks for


def odd_and_plain_lines():
    """Lines that keep the contract or break it in one or two places, and lines that Spark's parser has to judge."""
    values = [None, True, 5, -1, 1.5, 10**20, "", "x", "x" * 600, [], {}, ["a"], ["a", "a"], [None], [1], "merge", "host", "repository", "corrected", ["0" * 26], ["0" * 26, "1" * 26], [f"{i:026}" for i in range(6)], "a.b\n", "é", "2026-02-30T00:00:00Z", "2026-01-01", "2026-01-01T00:00:00Z"]
    paths = [*[f"$.{k}" for k in (*contracts.REQUIRED, "corrects", "extra")], *[f"{p}.{k}" for p, keys in contracts.KEYS.items() if p != "$" for k in (*keys, "extra")]]
    out = []
    for n, p in enumerate(paths):
        *front, name = p.split(".")[1:]
        for i, x in enumerate([*values, "gone"]):
            own = event(n * 100 + i)
            if i % 3 == 0:
                own |= {"subject": {"scope": ("host", "repository", "x")[n % 3], "host": "h"}, "status": "corrected"}
            at = own.setdefault(front[0], {}) if front else own
            if x == "gone":
                at.pop(name, None)
            else:
                at[name] = x
            out.append(json.dumps(own, ensure_ascii=i % 2 == 0))
    good = json.dumps(event(1))
    return [*out, good, good.replace('"data": {}', '"data": {"result": "started", "result": "x"}'), good + " ", good + "x", "[]", "1", "{", "\t", good.replace("{}", "NaN"), good.replace('"kind"', '"k\\u0069nd"'), good.replace("{}", '{"duration_ms": 1e3}'), good.replace("{}", '{"duration_ms": -0}')]


def test_plain_events_are_judged_as_spark_does(spark):
    lines = odd_and_plain_lines()
    own = spark.createDataFrame([("s", i, x, False) for i, x in enumerate(lines)], "source string, seq bigint, value string, cut boolean")
    found = {r.seq: r for r in reconcile.line_events(own).collect()}
    judged = 0
    for i, x in enumerate(lines):
        if told := contracts.plain_event(x):
            judged += 1
            assert told[1] == found[i].errors, x
            assert digests.compact(told[0]) == found[i].canonical and digests.fingerprint_of(found[i].canonical.encode()) == bytes(found[i].fp)
    assert judged > len(lines) // 2


def test_sources_are_profiled_where_they_are_read(spark, tmp_path, monkeypatch):
    keep = tmp_path / "src"
    keep.mkdir()
    lines = odd_and_plain_lines()
    for i, part in enumerate((lines[:40], [json.dumps(event(i)) for i in range(70)], [json.dumps(event(1)), "", "  ", json.dumps(event(2))], [json.dumps(event(1), ensure_ascii=False).replace('"r"', '"é"')], lines)):
        (keep / f"{i}.jsonl").write_text("\n".join(part) + ("" if i == 2 else "\n"))
    (keep / "empty.jsonl").write_text("")
    (keep / "bytes.jsonl").write_bytes(b'{"a": "\xff\xc3("}\n' + json.dumps(event(3)).encode() + b"\n")
    monkeypatch.setattr(reconcile, "BLOCK_BYTES", 1 << 10)

    def columns(df, *names):
        return sorted(tuple(map(str, r)) for r in df.select("source", *names).collect())

    whole = jsonl.lines(spark, f"{keep}/*").where(F.trim("value") != "")
    own = whole.select(F.col("path").alias("source"), "seq", "value", (F.col("next_offset") > F.col("file_size")).alias("cut"), (F.col("next_offset") - F.col("start_offset")).alias("width"))
    for producer in (None, ("r", "c"), ("r", "x")):
        before = reconcile.line_events(own, producer)
        for most in (1 << 20, 1 << 12):  # the second leaves the larger files to Spark
            monkeypatch.setattr(reconcile, "BATCH", most)
            now = reconcile.source_events(spark, f"{keep}/*", producer)
            assert columns(now, "seq", "width", "event_id", "kind", "fp", "canonical", "errors", "value") == columns(before, "seq", "width", "event_id", "kind", "fp", "canonical", "errors", "value")
            assert now.where("profile is not null").count() in ((2, 3) if most > 1 << 12 else (1,))
            names = ("bytes", "n_events", "event_ids", "last_kind", "digest", "valid")
            assert columns(reconcile.profiles(now), *names) == columns(reconcile.profiles(before), *names)


def test_plain_sources_need_no_expressions_of_spark(spark, outbox, monkeypatch):
    for i in range(3):
        outbox.put(f"{i}.jsonl", [event(2 * i), event(2 * i + 1)])
    outbox.put("bad.jsonl", [event(9, data={"more": 1})])
    for name in ("line_events", "merkle", "lines"):
        monkeypatch.setattr(reconcile, name, None)
    assert outbox.run(spark) == {f"{i}.jsonl": "added" for i in range(3)} | {"bad.jsonl": "invalid"}
    assert spark.read.parquet(outbox.ledger).count() == 6


def test_tasks_list_what_spark_lists(spark, tmp_path):
    for name in ("a/1.txt", "a/_2.txt", "a/.3.txt", "a/4 x%20é.txt", "_b/5.txt", ".c/6.txt", "d=1/_k=7.txt", "e/8.json", "e/9.txt._COPYING_"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    (tmp_path / "top.txt").write_text("x")
    (tmp_path / "a" / "empty.txt").write_text("")
    rows = lambda df: sorted(map(tuple, df.collect()))
    spark_lists = lambda p: rows(spark.read.format("binaryFile").load(p).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified")))
    for pattern in ("*/*.txt", "*/*", "a/?.txt", "*/1.txt", "?/*.tx?", "*.txt"):
        found = jsonl.listed_by_tasks(spark, f"{tmp_path}/{pattern}")
        assert rows(found) == spark_lists(f"{tmp_path}/{pattern}") and found.count()
        assert rows(jsonl.files(spark, f"file:{tmp_path}/{pattern}")) == rows(found)
    for pattern in ("{a,e}/*", "a", "*", "none/*.txt", "[ab]/*"):  # folders among the files, other globs, nothing
        assert jsonl.listed_by_tasks(spark, f"{tmp_path}/{pattern}") is None
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        jsonl.files(spark, f"{tmp_path}/none/*.txt")


def test_a_root_is_that_of_the_digest_tree(spark):
    for leaves in ([(0, "A")], [(i * 300, f"{i:X}") for i in range(3000)]):
        df = spark.createDataFrame([("k", *x) for x in leaves], "k string, seq bigint, leaf string")
        assert folds.merkle(df, ["k"], "leaf", 64).first()["digest"] == folds.merkle_root(leaves, 64)


def test_compaction_groups_the_receipts_of_its_sources_alone(spark, outbox, monkeypatch):
    for i in range(6):
        outbox.put(f"f{i}.jsonl", [event(2 * i), event(2 * i + 1)])
    outbox.run(spark)
    given, whole = [], compaction.with_receipts
    monkeypatch.setattr(compaction, "with_receipts", lambda own, receipts: given.append(receipts.count()) or whole(own, receipts))
    now = datetime.now(timezone.utc) + timedelta(days=2)
    found = {os.path.basename(r.source): r.reason for r in compaction.compact(spark, outbox.path, outbox.receipts, outbox.ledger, outbox.bundles, now, max_sources=2).collect()}
    assert found == {f"f{i}.jsonl": "eligible" if i < 2 else "source_bound" for i in range(6)} and given == [2]


def test_a_rebuild_reads_plain_bundles_without_expressions_of_spark(spark, outbox, monkeypatch):
    for i in range(3):
        outbox.put(f"f{i}.jsonl", [event(2 * i), event(2 * i + 1)])
    outbox.run(spark)
    for name in ("line_events", "lines"):
        monkeypatch.setattr(reconcile, name, None)
    compaction.compact(spark, outbox.path, outbox.receipts, outbox.ledger, outbox.bundles, datetime.now(timezone.utc) + timedelta(days=2), apply=True, remove=True).collect()
    tables = set(os.listdir(scratch_dir(spark)))
    assert compaction.rebuild(spark, outbox.bundles, outbox.ledger + "-again") == (6, 0)
    assert set(os.listdir(scratch_dir(spark))) == tables  # all of its own are gone
