"""Appends by index and commit, concurrent writers, quarantine, and streams of growing files."""

import json
import os
import threading
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tallybook.functions.digests import fingerprint
from tallybook.operators import identities, unique
from tallybook.plans import retention
from tallybook.sources import commits, growing, jsonl
from tallybook.sources.scratch import Scratch
from tallybook.streaming import ingest

from .test_plans import event

SCHEMA = "domain string, event_id string, fp string, group_pos int, row_pos int, payload string"


def batch(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def stored_bytes(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def scanned_bytes(spark, run):
    """Bytes of the files that scans have read while ``run`` ran, by the metrics of Spark's own plans."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    total = 0
    executions = store.executionsList()
    for i in range(int(before), int(store.executionsCount())):
        e = executions.apply(i)
        values = store.executionMetrics(e.executionId())
        metrics = (e.metrics().apply(k) for k in range(e.metrics().size()))
        for i in {m.accumulatorId() for m in metrics if m.name() == "size of files read"}:  # a plan that is changed as it runs names its metrics again
            if values.contains(i):
                n, unit = values.apply(i).split("\n")[-1].split(" (")[0].split()
                total += float(n.replace(",", "")) * {"B": 1, "KiB": 1 << 10, "MiB": 1 << 20, "GiB": 1 << 30}[unit]
    return total


def test_small_append_reads_little_of_a_large_index(spark, tmp_path):
    path = str(tmp_path / "ledger")
    rows = lambda low, high: spark.range(low, high).select(F.lit("d").alias("domain"), F.concat(F.lit("sha256:"), F.sha2(F.col("id").cast("string"), 256)).alias("event_id"), fingerprint(F.col("id").cast("string")).alias("fp"), F.lit(0).alias("group_pos"), F.col("id").alias("row_pos"), F.lit("p").alias("payload"))
    assert unique.append(rows(0, 1_000_000), path).written == 1_000_000
    held = stored_bytes(f"{path}/_index")
    found = []
    read = scanned_bytes(spark, lambda: found.append(unique.append(rows(1_000_000, 1_001_000), path)))
    own = stored_bytes(f"{path}/_index") - held
    assert found == [(1_000, 0, 0)] and read < 0.05 * held, (read, held, own)
    # what is known is found behind the filters, and what diverges
    assert unique.append(rows(999_500, 1_000_500), path) == (0, 1_000, 0)
    with pytest.raises(unique.IdentityConflict):
        unique.append(rows(5, 7).withColumn("fp", F.lit(b"x")), path)


def test_generations_merge(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(identities, "MOST", 3)
    monkeypatch.setattr(identities, "FILTERED", 20)
    monkeypatch.setattr(identities, "BUCKET_ROWS", 4)
    path = str(tmp_path / "ledger")
    for i in range(8):
        rows = [("d" if k % 2 else None, str(k), "x", 0, k, "p") for k in range(5 * i, 5 * i + 5)]
        assert unique.append(batch(spark, rows), path) == (5, 0, 0)
        assert unique.append(batch(spark, rows[:1]), path) == (0, 1, 0)
    last = commits.last(spark, path)
    assert len(last["generations"]) <= 4 and sum(g["rows"] for g in last["generations"]) == 40 and any(g["depth"] and g["filtered"] for g in last["generations"])
    assert unique.append(batch(spark, [("d" if k % 2 else None, str(k), "x", 0, k, "p") for k in range(41)]), path) == (1, 40, 0)
    assert unique.vacuum(spark, path) > 0 and unique.append(batch(spark, [("d", "1", "x", 0, 0, "p")]), path) == (0, 1, 0)
    assert commits.committed(spark, path).count() == 41


@pytest.mark.parametrize("depth", [0, 1, 5])
def test_filters_have_no_false_negatives(spark, depth):
    ids = spark.range(2_000).select(F.xxhash64("id").alias("h")).withColumn("bucket", identities.bucket(depth))
    passed = identities.passing(ids, identities.filters(ids)).count()
    others = spark.range(5_000, 25_000).select(F.xxhash64("id").alias("h")).withColumn("bucket", identities.bucket(depth))
    assert passed == 2_000 and identities.passing(others, identities.filters(ids)).count() < 30


def test_concurrent_appends_lose_and_double_nothing(spark, tmp_path):
    path, out, errors = str(tmp_path / "ledger"), {}, []
    start = threading.Barrier(3)

    def run(k):
        try:
            rows = [("d", str(i), "x", k, i, f"by {k}") for i in range(10 * k, 10 * k + 30)]
            start.wait(60)
            out[k] = unique.append(batch(spark, rows), path)
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=run, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(300)
    assert not errors and sum(x.written for x in out.values()) == 50 and sum(x.skipped for x in out.values()) == 40
    ids = sorted(int(r.event_id) for r in commits.committed(spark, path).collect())
    assert ids == list(range(50)) and spark.read.parquet(path).count() == 50  # who lost has taken its files back
    assert len(commits.numbers(spark, path)) == sum(x.written > 0 for x in out.values())


def test_a_second_writer_looks_again(spark, tmp_path, monkeypatch):
    path, publish, between = str(tmp_path / "ledger"), commits.publish, []

    def late(spark, where, number, commit):
        if not between:
            between.append(1)
            unique.append(batch(spark, [("d", "1", "x", 0, 0, "first"), ("d", "9", "z", 0, 1, "p")]), path)
        return publish(spark, where, number, commit)

    monkeypatch.setattr(commits, "publish", late)
    assert unique.append(batch(spark, [("d", "1", "x", 0, 0, "second"), ("d", "2", "y", 0, 1, "p")]), path) == (1, 1, 0)
    assert {(r.event_id, r.payload) for r in commits.committed(spark, path).collect()} == {("1", "first"), ("2", "p"), ("9", "p")}
    between.clear()
    monkeypatch.setattr(commits, "publish", lambda s, w, n, c: late(s, w, n, c))
    with pytest.raises(unique.IdentityConflict):
        unique.append(batch(spark, [("d", "9", "other", 0, 0, "q"), ("d", "10", "v", 0, 1, "p")]), path)


def test_commits_take_a_number_once(spark, tmp_path):
    path = str(tmp_path / "table")
    assert commits.last(spark, path) is None and commits.committed(spark, path) is None
    assert commits.publish(spark, path, 0, {"commit": "a"}) and not commits.publish(spark, path, 0, {"commit": "b"})
    assert commits.last(spark, path) == {"commit": "a", "number": 0} and os.listdir(f"{path}/_commits") == ["000000000000.json"]
    for name in ("a", "lost"):
        spark.createDataFrame([(name,)], "v string").write.parquet(f"{path}/commit={name}")
    assert [r.v for r in commits.committed(spark, path).collect()] == ["a"]


def test_quarantine(spark, tmp_path):
    path, odd = str(tmp_path / "ledger"), str(tmp_path / "odd")
    unique.append(batch(spark, [("d", "1", "x", 0, 0, "p")]), path)
    rows = [("d", "1", "x", 0, 0, "p"), ("d", "1", "other", 0, 1, "q"), ("d", "2", "a", 0, 2, "a"), ("d", "2", "b", 0, 3, "b"), ("d", "3", "z", 1, 0, "r"), ("d", "3", "z", 1, 0, "r")]
    for k in range(2):
        assert unique.append(batch(spark, rows), path, quarantine=odd) == (1 - k, 2 + k, 3)
        assert {(r.event_id, r.payload) for r in spark.read.parquet(odd).collect()} == {("1", "q"), ("2", "a"), ("2", "b")}
    assert sorted(r.event_id for r in spark.read.parquet(path).collect()) == ["1", "3"]
    assert unique.append(batch(spark, []), path, quarantine=odd) == (0, 0, 0)


def test_stream_goes_on_behind_a_divergent_event(spark, tmp_path):
    schema = "domain string, event_id string, group_pos int, row_pos int, payload string"
    for i, rows in enumerate(([("d", "1", 0, 0, "p")], [("d", "1", 0, 0, "another"), ("d", "2", 0, 1, "q")], [("d", "3", 0, 0, "r")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ingest.ingest(ingest.poll(spark, str(tmp_path / "in"), schema), str(tmp_path / "ledger"), str(tmp_path / "ck"), str(tmp_path / "odd")).awaitTermination(120)
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "ledger")).collect()) == ["1", "2", "3"]
    assert [(r.event_id, r.payload, r.batch) for r in spark.read.parquet(str(tmp_path / "odd")).collect()] == [("1", "another", 1)]


def test_growing_files_are_read_from_where_they_ended(spark, tmp_path, monkeypatch):
    src, ledger, states, check = (str(tmp_path / x) for x in ("src", "ledger", "states", "ck"))
    os.mkdir(src)

    def put(name, events, end="\n"):
        with open(f"{src}/{name}", "a") as f:
            f.write("\n".join(json.dumps(e) for e in events) + end)

    def run():
        ingest.incremental_import(spark, src, ledger, check, states).awaitTermination(120)
        return {os.path.basename(r.source): (r.state, r.events) for r in ingest.source_states(spark, states).collect()}

    put("a.jsonl", [event(1), event(2)])
    put("b.jsonl", [{"x": 1}])
    put("c.jsonl", [event(7)], end="")  # no line end yet
    assert run() == {"a.jsonl": ("added", 2), "b.jsonl": ("invalid", 1)}
    size = os.path.getsize(f"{src}/a.jsonl")
    put("a.jsonl", [event(2), event(3)])
    put("b.jsonl", [event(4)])
    put("c.jsonl", [], end="\n")
    assert run() == {"a.jsonl": ("grown", 4), "b.jsonl": ("invalid", 2), "c.jsonl": ("added", 1)}
    assert run() == {"a.jsonl": ("grown", 4), "b.jsonl": ("invalid", 2), "c.jsonl": ("added", 1)}
    assert spark.read.parquet(ledger).count() == 4
    # the second trigger asked for the appended bytes alone
    offsets = [json.loads(open(f"{check}/offsets/{i}").read().splitlines()[-1]) for i in (0, 1)]
    reader = growing.GrowingReader({"path": src})
    asked = [(os.path.basename(s.path), s.start, s.stop) for s in reader.partitions(*offsets)]
    assert ("a.jsonl", size, os.path.getsize(f"{src}/a.jsonl")) in asked and all(s[0] != "a.jsonl" or s[1] >= size for s in asked)
    assert {os.path.basename(p) for p in reader.latestOffset()} == {"a.jsonl", "b.jsonl", "c.jsonl"}


@pytest.mark.parametrize("split, chunk", [(1, 1), (3, 2), (7, 5), (100, 100)])
def test_stretches_give_each_line_once(tmp_path, split, chunk):
    path = str(tmp_path / "f")
    for data in (b"", b"\n", b"a\n", b"a", b"\n\nab\n", b"abc\n\n\nd\nefghij\nk", b"\xff\n" * 5):
        with open(path, "wb") as f:
            f.write(data)
        files, _ = growing.file_system(str(tmp_path))
        for begins in [0, *(i + 1 for i, c in enumerate(data) if c == 10)]:
            stop = growing.last_line_end(files, path, begins, len(data))
            assert stop == max(begins, data.rfind(b"\n") + 1)
            got = [line for s in growing.stretches(path, begins, stop, split) for _, _, line in growing.lines_of(files, s, chunk)]
            assert got == data[begins:stop].split(b"\n")[:-1]


def test_tail_reads_from_the_end(spark, tmp_path, monkeypatch):
    lines = [f"{i} é " + "x" * (i % 90) for i in range(20_000)]
    for k in range(4):
        (tmp_path / f"f{k}").write_text("".join(x + "\n" for x in lines[5_000 * k : 5_000 * k + 5_000]) if k < 3 else "\n".join(lines[15_000:]))
    (tmp_path / "f4").write_text("")
    found = lambda n, **more: [(r.value, r.start_offset) for r in jsonl.tail(spark, f"{tmp_path}/f*", n, **more).collect()]
    assert found(0) == found(-1) == [] and [v for v, _ in found(40)] == lines[-40:]  # the last line has no end
    assert [v for v, _ in found(1, width=1)] == lines[-1:] and [v for v, _ in found(7_000, width=100)] == lines[-7_000:]
    assert [v for v, _ in found(10**6)] == lines
    data = (tmp_path / "f3").read_bytes()
    assert all(data[at:].startswith(v.encode()) for v, at in found(40))
    asked = []
    whole = spark.createDataFrame
    monkeypatch.setattr(spark, "createDataFrame", lambda rows, schema=None: asked.append(sum(r[2] - r[1] for r in rows)) or whole(rows, schema))
    found(40)
    assert asked == [jsonl.LAST_BYTES]  # of some 1 MB
    assert jsonl.tail(spark, f"{tmp_path}/f4", 5).count() == 0


def test_sweep_rewrites_the_day_of_the_boundary_alone(spark, tmp_path):
    path, at = str(tmp_path / "ledger"), lambda d, h=0: f"2026-01-{d:02} {h:02}:00:00"
    times = [None, at(1), at(2, 3), at(3, 1), at(3, 12), at(3, 23), at(4), at(9)]
    rows = [(i, t, None if i % 3 == 0 else "b:c") for i, t in enumerate(times * 5)]
    retention.append_by_expiry(spark.createDataFrame(rows, "id int, t string, domain string").select("id", F.col("t").cast("timestamp").alias("expires_at"), "domain"), path)
    left = lambda: sorted(r.id % 8 for r in spark.read.parquet(path).collect())
    files = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}
    before = files()
    assert retention.sweep(spark, path, datetime(2026, 1, 3, 12, tzinfo=timezone.utc)) == (2, 1, 20, 5)
    assert left() == sorted([0, 5, 6, 7] * 5)
    kept = {f: t for f, t in files().items() if f in before}
    assert {f.split("expires_on=")[1].split("/")[0] for f in kept} == {"__HIVE_DEFAULT_PARTITION__", "2026-01-04", "2026-01-09"} and all(before[f] == t for f, t in kept.items())
    assert retention.sweep(spark, path, datetime(2026, 1, 3, 12, tzinfo=timezone.utc)) == (0, 0, 0, 0)
    assert retention.sweep(spark, path, datetime(2026, 1, 4, tzinfo=timezone.utc)) == (2, 0, 10, 0) and left() == sorted([0, 7] * 5)
    with pytest.raises(ValueError):
        retention.sweep(spark, path, datetime(2026, 1, 4))


def test_scratch_goes(spark):
    with Scratch(spark) as scratch:
        df = scratch.written(spark.range(3))
        (path,) = scratch.paths
        assert df.count() == 3
    assert not os.path.exists(path.removeprefix("file:"))


def test_many_small_files_share_tasks(tmp_path):
    sizes = [*[10] * 1000, 5 << 20]
    for i, n in enumerate(sizes):
        (tmp_path / f"{i:04}.jsonl").write_bytes(b"x" * (n - 1) + b"\n")
    reader = growing.GrowingReader({"path": str(tmp_path)})
    tasks = reader.partitions({}, reader.latestOffset())
    assert 16 < len(tasks) <= 2 * growing.TASKS
    rows = [(os.path.basename(p), a, b) for t in tasks for batch in reader.read(t) for p, a, b in zip(*(batch.column(i).to_pylist() for i in range(3)))]
    assert sorted(rows) == [(f"{i:04}.jsonl", 0, n) for i, n in enumerate(sizes)]
