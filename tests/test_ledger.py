"""The ledger library on golden files and small tables; every query with SQL against DuckDB."""

import hashlib
import json
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from tallybook import queries
from tallybook.functions import digests, texts, times, values
from tallybook.operators import contracts, envelope, history, paging, unique
from tallybook.plans import folds
from tallybook.sources import jsonl
from tallybook.streaming import ingest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("events", "documents", "conversations", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, float):
        return round(x, 6)
    return x.replace(tzinfo=None) if hasattr(x, "tzinfo") else x


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    cur = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    exact = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == exact


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.fixture(scope="module")
def one(spark):
    return lambda value, kind="string": spark.createDataFrame([(value,)], f"x {kind}")


@pytest.mark.parametrize("text, good", [('{"a":1}', True), ('{"a":1} x', False), ("1,2", False), ('{"a":1}] x', False), ("", False), ('{"a":1}\r', True), ("[1]", True), (None, False)])
def test_strict_json(one, text, good):
    assert one(text).select(values.strict_json(F.col("x")).isNotNull()).first()[0] is good


@pytest.mark.parametrize("text, kind", [('{"kind":"","type":0,"event":"e"}', "e"), ('{"kind":null,"type":[],"event":{}}', None), ('{"kind":false,"type":"t"}', "t"), ('{"kind":"k"}', "k"), ("[]", None)])
def test_truthiness(one, text, kind):
    assert one(text).select(envelope.event_type(F.try_parse_json("x"))).first()[0] == kind


@pytest.mark.parametrize("kind, days", [("debug.", 7), ("debugger", 30), ("a.published.v2", 0), ("x.temp", 1), ("x.temp.y", 1), ("insights.daily", 90), (None, 30)])
def test_retention(one, kind, days):
    assert one(kind).select(envelope.ttl_days(F.col("x"))).first()[0] == days


@pytest.mark.parametrize("pattern, text, fits", [("a*", "a", True), ("a?c", "abc", True), ("[!a]b", "ab", False), ("[ab]c", "bc", True), ("a.b", "axb", False), ("*", "a\nb", True)])
def test_globs(one, pattern, text, fits):
    assert one(text).select(texts.matches_glob(F.col("x"), pattern)).first()[0] is fits


@pytest.mark.parametrize("text, clean", [(" A.b-C ", "a.b-c"), ("-a", None), ("a..b", None), ("a" * 64, None), ("a" * 63, "a" * 63), (".".join(["a" * 60] * 5), None)])
def test_domains(one, text, clean):
    assert one(text).select(texts.sanitize_domain(F.col("x"))).first()[0] == clean


def test_labels_and_times(one):
    row = one("___").select(texts.metric_label(F.col("x")).alias("l"), texts.safe_part(F.col("x")).alias("p"), texts.bounded(F.lit(None).cast("string"), 5, "none").alias("b")).first()
    assert (row.l, row.p, row.b) == ("unknown", None, "none")
    odd = one("2026").select(times.parse_iso(F.col("x")), times.parse_iso(F.lit("20260101T000000Z")), times.parse_absolute(F.lit("2026-01-01T00:00:00")), times.parse_utc_second(F.lit("2026-01-01T00:00:00.5Z"))).first()
    assert list(odd) == [None] * 4


def test_digests(one):
    text = '{"b":1.0,"a":"é"}'
    row = one(text).select(digests.canonical_json("x").alias("c"), digests.fingerprint(F.col("x")).alias("f"), digests.pseudonym(F.col("x"), b"k").alias("p")).first()
    assert row.c == '{"a":"é","b":1.0}' and row.p.startswith("anon:") and len(row.p) == 25
    raw = text.encode()
    assert bytes(row.f) == len(raw).to_bytes(8, "big") + hashlib.sha256(raw).digest()
    assert one("NaN").select(digests.canonical_json("x")).first()[0] is None


GOLDEN = b'{"a":1}\n{"b":"\xe2\x80\xa8"}\r\n\xff\n\n{"c":3}\n{"d":4}'


def test_scan_offsets(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_bytes(GOLDEN)
    exact, at = [], 0
    for part in GOLDEN.split(b"\n")[:-1]:
        exact.append((at, at + len(part) + 1, part.decode(errors="replace")))
        at += len(part) + 1
    for size in ("128m", "8b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        rows = [(r.start_offset, r.next_offset, r.value) for r in jsonl.scan(spark, str(path)).orderBy("start_offset").collect()]
        assert rows == exact
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.value for r in jsonl.scan(spark, str(path), exact[4][0]).collect()] == ['{"c":3}']
    assert jsonl.scan(spark, str(path), 10**6).collect() == []
    with pytest.raises(ValueError):
        jsonl.scan(spark, str(path), 3)
    assert paging.tail(jsonl.lines(spark, str(path)), 1).first().value == '{"d":4}'
    assert jsonl.records(jsonl.scan(spark, str(path))).where("valid").count() == 3
    with pytest.raises(ValueError):
        jsonl.strict_batch(spark, str(path))


def test_loader_takes_four_shapes(spark, tmp_path):
    for name, text in (("a", '{"id":1}\n{"id":2}\n'), ("b", '[{"id":1},{"id":2}]'), ("c", '{"id":1}'), ("d", '{"events":[{"id":1},{"id":2},{"id":3}]}')):
        (tmp_path / name).write_text(text)
    counts = {r.path[-1]: r["count"] for r in jsonl.loaded(spark, str(tmp_path)).groupBy("path").count().collect()}
    assert counts == {"a": 2, "b": 2, "c": 1, "d": 3}


def batch(spark, rows):
    return spark.createDataFrame(rows, "domain string, event_id string, fp string, group_pos int, row_pos int, payload string")


def test_append_once(spark, tmp_path):
    path = str(tmp_path / "ledger")
    rows = [("d", "1", "x", 0, 0, "p"), ("d", "1", "x", 0, 1, "p"), ("d", "2", "y", 1, 0, "q")]
    assert unique.append_unique(batch(spark, rows), path) == (2, 1)
    assert unique.append_unique(batch(spark, rows), path) == (0, 3)
    with pytest.raises(unique.IdentityConflict):
        unique.append_unique(batch(spark, [("d", "3", "z", 0, 0, "r"), ("d", "2", "other", 0, 1, "r")]), path)
    assert spark.read.parquet(path).count() == 2


def event(i, kind="agent.run.completed", **over):
    return {"schema_version": "agent-run-event.v0", "event_id": "sha256:" + hashlib.sha256(str(i).encode()).hexdigest(), "kind": kind, "ts": "2026-01-01T00:00:00Z", "source": {"repo": "r", "component": "c", "run_id": "n"}, "subject": {"repo": "r"}, "trust_tier": "observed", "status": "active", "caused_by": [], "evidence_refs": [], "data": {}} | over


@pytest.mark.parametrize(
    "over, error",
    [({}, None), ({"evidence_refs": [5, True]}, "$.evidence_refs: items"), ({"evidence_refs": [None]}, "$.evidence_refs: items"), ({"caused_by": [7]}, "$.caused_by: items"), ({"extra": 1}, "$: unknown key"), ({"status": "corrected"}, "$.corrects: missing"), ({"subject": {"scope": "host", "host": "h"}}, "$.data: operation and task_class missing"), ({"data": {"duration_ms": True}}, "$.data.duration_ms: not an integer of at least 0"), ({"ts": "2026-01-01"}, "$.ts: pattern"), ({"evidence_refs": ["a", "a"]}, "$.evidence_refs: items"), ({"source": []}, "$.source: not an object")],
)
def test_event_contract(one, over, error):
    errors = contracts.with_agent_run_errors(one(json.dumps(event(1, **over))).select(F.try_parse_json("x").alias("v")), "v").first()["errors"]
    assert (errors == []) if error is None else (error in errors)


def test_hash_chain(spark):
    rows = [(f"k{i % 3}", i, f"v{i}") for i in range(50)]
    exact = {}
    for k, _, v in rows:
        exact[k] = hashlib.sha256(exact.get(k, b"\0" * 32) + v.encode()).digest()
    df = spark.createDataFrame(rows, "k string, seq int, value string").repartition(5)
    assert {r.k: r.chain for r in folds.hash_chain(df, "k").collect()} == {k: v.hex() for k, v in exact.items()}


def test_budget_and_packing(spark):
    sizes = [50, 60, 10, 45, 5]
    df = spark.createDataFrame([("k", i, n) for i, n in enumerate(sizes)], "k string, pos int, bytes int")
    rows = folds.within_budget(df, "k", 70).where("taken").orderBy("pos").collect()
    assert (sum(r.bytes for r in rows), [r.pos for r in rows]) == (65, [0, 2, 4])
    assert [r.request for r in folds.packed(df, "k", 70).orderBy("pos").collect()] == [0, 1, 2, 2, 2]
    with pytest.raises(ValueError):
        folds.packed(df, "k", 61)


REPORTS = [
    ("a", 0, "MISSING", None), ("a", 1, "OK", "2026-01-01T00:00:00Z"), ("a", 2, "OK", "2026-01-01T00:00:01Z"),
    ("b", 0, "OK", "junk"), ("b", 1, "WARN", None), ("c", 0, "OK", "2026-01-01T00:05:00Z"), ("c", 1, "FAIL", "2026-01-01T00:04:00Z"), ("c", 2, "MISSING", None), ("d", 0, "OK", "2027-01-01T00:00:00Z"),
]


def test_states_batch_and_stream(spark, tmp_path):
    df = spark.createDataFrame(REPORTS, "repo string, seq int, status string, generated_at string").withColumn("received_at", F.lit("2026-01-01 00:00:00").cast("timestamp"))
    out = {r.repo: (r.status, r.sanitized) for r in folds.reported_states(df).collect()}
    assert out == {"a": ("OK", False), "b": ("FAIL", True), "c": ("OK", False), "d": ("FAIL", True)}
    own = df.withColumn("generated", times.parse_iso(F.col("generated_at"))).drop("generated_at")
    for i in range(3):
        own.where(f"seq = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = ingest.states(ingest.poll(spark, str(tmp_path / "in"), "repo string, seq int, status string, received_at timestamp, generated timestamp", 1))
    found = {}
    q = stream.writeStream.outputMode("update").foreachBatch(lambda b, n: found.update({r.repo: (r.status, r.sanitized) for r in b.collect()})).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert found == out


@pytest.mark.parametrize("framed, limit", [(True, 60), (False, 60), (True, 5_000), (False, 1 << 40)])
def test_hot_keys_are_packed_in_blocks(spark, monkeypatch, framed, limit):
    """Keys over many blocks, small ones and null, against the plain rule."""
    rng = random.Random(limit)
    sizes = {"hot": 4_000, "warm": 700, "one": 1, None: 300}
    rows = [(k, i, rng.choice((0, 1, 5, 20, 58 if limit == 60 else 40))) for k, n in sizes.items() for i in range(n)]
    frame, comma, want = (2, 1, {}) if framed else (0, 0, {})
    for k in sizes:
        number, size, some = 0, frame, False
        for _, i, n in (r for r in rows if r[0] == k):
            if size + n + comma * some > limit:
                number, size, some = number + 1, frame, False
            size += comma * some
            want[k, i] = number, size
            size, some = size + n, True
    df = spark.createDataFrame(rows, "k string, pos bigint, bytes int").repartition(6)
    monkeypatch.setattr(folds, "HOT_ITEMS", 500)
    found = folds.packed(df, "k", limit, framed)
    assert {(r.k, r.pos): (r.request, r.start) for r in found.collect()} == want
    blocks = folds.packed_in_blocks(df, "k", limit, frame, comma)
    assert {(r.k, r.pos): (r.request, r.start) for r in blocks.collect()} == want


def test_states_sum_up_as_the_fold_does(spark):
    """Random reports of few times, so with many ties, in random order and grouping."""
    rng, rows, want = random.Random(11), [], {}
    arrived = pd.Timestamp("2026-01-01T00:00:00Z")
    for k in range(150):
        state, order = None, list(range(rng.randint(1, 7)))
        for seq in order:
            status, minutes = rng.choice(("OK", "WARN", "MISSING", "FAIL")), rng.choice((None, -5, 0, 5, 10, 11, 60))
            received = arrived + pd.Timedelta(minutes=rng.choice((0, 0, 3)))
            generated = None if minutes is None else arrived + pd.Timedelta(minutes=minutes)
            state = folds.step(state, status, generated, received) or state
            rows.append((f"r{k}", seq, status, "soon" if generated is None else generated.strftime("%Y-%m-%dT%H:%M:%SZ"), received.to_pydatetime()))
        want[f"r{k}"] = (state["status"], state["generated_at"].isoformat(), state["sanitized"])
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "repo string, seq int, status string, generated_at string, received_at timestamp").repartition(5)
    assert {r.repo: (r.status, pd.Timestamp(r.generated_at, tz="UTC").isoformat(), r.sanitized) for r in folds.reported_states(df).collect()} == want


def test_stream_ingest_is_idempotent(spark, tmp_path):
    rows = [("d", str(i % 7), 0, i, f"p{i % 7}") for i in range(20)]
    df = spark.createDataFrame(rows, "domain string, event_id string, group_pos int, row_pos int, payload string")
    schema = df.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
    for k in range(2):
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = ingest.ingest(ingest.poll(spark, str(tmp_path / "in"), schema), str(tmp_path / "ledger"), str(tmp_path / f"ck{k}"))
        q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "ledger")).count() == 7


def test_ties(spark):
    df = spark.createDataFrame([("r", 5, 0, "a"), ("r", 5, 1, "b"), ("s", 1, 2, "c")], "repo string, ts int, seq int, event_id string")
    assert {r.repo: r.event_id for r in history.latest_by(df, ["repo"], ["ts"]).collect()} == {"r": "b", "s": "c"}
    assert {r.repo: r.event_id for r in history.latest_by(df, ["repo"], ["ts"], later_wins=False).collect()} == {"r": "a", "s": "c"}
    same = df.withColumn("event_id", F.lit("x"))
    assert [r.seq for r in history.newest(same, 1).collect()] == [0]
