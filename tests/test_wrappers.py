"""Wrapped events, day reports, source lists, walks, frozen cohorts and bundles."""

import json

import pytest
from pyspark.sql import functions as F

from tallybook.functions.values import member_names
from tallybook.operators import wrappers
from tallybook.sources import sinks

GOOD = {"kind": "x.insight", "version": 1, "id": "i", "meta": {"occurred_at": "2026-01-01T00:00:00Z"}, "data": {}}
STATE = {"confidence": 0.5, "fatigue": 0, "risk_tension": 1.0, "autonomy_level": "aware", "last_updated": "2026-01-01T00:00:00Z", "basis_signals": ["a"]}
DAY = {"ts": "2026-01-31", "topics": [], "questions": [], "deltas": [1], "source": "s", "metadata": {"generated_at": "2026-01-31T00:00:00Z"}}


def values(spark, items):
    rows = [(i, x if isinstance(x, str) else json.dumps(x)) for i, x in enumerate(items)]
    return spark.createDataFrame(rows, "seq int, x string").withColumn("v", F.try_parse_json("x"))


def test_wrapper_errors(spark):
    cases = [
        (GOOD, None),
        (GOOD | {"version": True}, None),
        ({"kind": "x.insight"}, "missing fields: data, id, meta, version"),
        (GOOD | {"kind": "other"}, "invalid kind"),
        (GOOD | {"version": "1"}, "version must be an integer"),
        (GOOD | {"meta": {}}, "missing meta.occurred_at"),
        (GOOD | {"kind": "x.state", "data": STATE}, None),
        (GOOD | {"kind": "x.state", "data": STATE | {"fatigue": 2}}, "schema validation failed"),
        (GOOD | {"kind": "x.state", "data": STATE | {"more": 2}}, "schema validation failed"),
        ("[1]", "not an object"),
    ]
    df = values(spark, [c for c, _ in cases])
    out = df.select("seq", wrappers.wrapper_error(F.col("v"), "x.insight", "x.state").alias("e")).orderBy("seq").collect()
    assert [r.e for r in out] == [e for _, e in cases]


def test_legacy_form(spark):
    legacy = {"id": "i", "source": "s", "timestamp": "2026-01-01T00:00:00Z", "payload": {"kind": "x.insight", "version": 1, "a": 2, "b": {"c": "d"}}}
    inner = legacy | {"payload": {"kind": "x.insight", "version": 1, "data": {"z": 1}, "a": 2}}
    df = values(spark, [legacy, inner, GOOD, {"id": 1}])
    out = [r.j and json.loads(r.j) for r in df.select("seq", wrappers.from_legacy(F.col("v")).alias("j")).orderBy("seq").collect()]
    made = GOOD | {"meta": {"occurred_at": "2026-01-01T00:00:00Z", "producer": "s"}}
    assert out == [made | {"data": {"a": 2, "b": {"c": "d"}}}, made | {"data": {"z": 1}}, GOOD, None]


@pytest.mark.parametrize("over, errors", [({}, []), ({"ts": "2026-02-31"}, ["ts: not a date"]), ({"topics": {}}, ["topics: not an array"]), ({"x": 1}, ["unknown key"]), ({"metadata": {}}, ["metadata.generated_at: not a time"])])
def test_day_reports(spark, over, errors):
    assert values(spark, [DAY | over]).select(wrappers.day_errors(F.col("v"))).first()[0] == errors


def test_source_lists(spark):
    first = {"generated_at": "2026-01-01T00:00:00Z", "sources": [{"repo": "a", "summary_url": "1"}, {"repo": "", "summary_url": "1"}, 5, {"repo": "b", "summary_url": "1", "enabled": False}, {"repo": "c", "summary_url": "1", "enabled": "yes"}, {"repo": "a", "summary_url": "2", "enabled": None}]}
    out = wrappers.source_list(values(spark, [first, first | {"generated_at": "soon"}])).collect()
    assert [tuple(r) for r in out] == [("a", "2")]


def test_ingest_errors(spark):
    df = values(spark, [{"summary": "x" * 501, "domain": "other"}, {"kind": "k", "source": {"repo": "r", "component": "c"}, "id": "1"}])
    own = wrappers.ingest_errors(F.col("v"), F.lit("d.e"), {"days": wrappers.day_errors(F.col("v"))})
    out = [r.e for r in df.select("seq", own.alias("e")).orderBy("seq").collect()]
    assert out[0][:2] == ["summary too long", "domain mismatch"] and out[1] == []
    assert values(spark, [{"kind": 1}]).select(wrappers.client_errors(F.col("v"))).first()[0] == ["ts", "source"]


def test_nested_findings(spark):
    item = {"a": [{"b": "see /home/x"}, "token: abc"], "c": {"STDOUT": 1}, "d": ["fine"]}
    out = {(r.path, r.finding) for r in wrappers.nested_redaction(spark.createDataFrame([(0, json.dumps(item))], "seq int, text string"), "text", ["seq"]).collect()}
    assert out == {("$.a[0].b", "private path"), ("$.a[1]", "secret assignment"), ("$.c.STDOUT", "raw output")}


def test_frozen_cohort(spark, tmp_path):
    df = spark.createDataFrame([("1", 5, 0, '{"b":1,"a":2}', "d"), ("2", 6, 1, '{"c":3}', "d")], "event_id string, ts int, seq int, value string, domain string")
    receipt = sinks.freeze(df, str(tmp_path / "cohort"), {"repo": "r"}, df).first()
    lines = [r.value for r in spark.read.text(str(tmp_path / "cohort")).collect()]
    assert lines == ['{"c":3}', '{"a":2,"b":1}'] and (receipt.event_count, receipt.bytes) == (2, 22)
    with pytest.raises(ValueError):
        sinks.freeze(df.withColumn("value", F.lit("{")), str(tmp_path / "other"), {}, df)


def test_metric_export(spark, tmp_path):
    df = spark.createDataFrame([("2026-01-01T23:30:00-05:00", "{}", 0), ("2026-01-02T01:00:00Z", "{}", 1)], "time_text string, payload string, seq int")
    sinks.export_metrics(df, str(tmp_path))
    assert spark.read.json(str(tmp_path / "latest")).first().time_text == "2026-01-01T23:30:00-05:00"
    assert spark.read.json(str(tmp_path / "by_date")).select("date").distinct().count() == 2


def test_bundles(spark):
    df = spark.createDataFrame([("p", f"s{i:02}", 30 + i, f"d{i}") for i in range(20)], "shard string, source string, bytes bigint, digest string")
    manifest = sinks.manifests(sinks.bundle(df, 100, "shard"), "shard")
    assert all(r.intact for r in sinks.intact(manifest, "shard").collect()) and manifest.agg(F.sum("n_sources")).first()[0] == 20
    assert manifest.agg(F.max("bytes")).first()[0] <= 100
    broken = manifest.withColumn("manifest_sha256", F.when(F.col("bundle") == 0, "x").otherwise(F.col("manifest_sha256")))
    assert {r.bundle for r in sinks.intact(broken, "shard").where("not intact").collect()} == {0}


def test_only_texts_that_can_have_a_finding_are_taken_apart(spark):
    texts = [
        '{"a":"\\u002fhome/me"}', '{"a":["/root/x"]}', '{"STDOUT":1}', '{"raw_logs_included":false,"monkey":"token","k":"see /homestead/"}', '{"a":{"b":"API-Key = x"}}', '{"\\u0073tderr":null}', '{"a":"sk-1"}', '{"a":"-----BEGIN PRIVATE KEY-----"}', '{"password":"x"}', '{"a":"password: x"}',
    ]
    assert [i for i, t in enumerate(texts) if not wrappers.suspect(t)] == [3, 8]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    found = {(r.n, r.path, r.finding) for r in wrappers.nested_redaction(df, "text", ["n"]).collect()}
    assert found == {(0, "$.a", "private path"), (1, "$.a[0]", "private path"), (2, "$.STDOUT", "raw output"), (4, "$.a.b", "secret assignment"), (5, "$.stderr", "raw output"), (6, "$.a", "secret prefix"), (7, "$.a", "private key"), (9, "$.a", "secret assignment")}


def test_names_of_members_without_text(spark):
    df = spark.sql("""select try_parse_json(t) v from values ('{"a":1,"b":null,"c":{"d":1}}'), ('[1]'), ('5'), ('null'), (null), ('{}') x(t)""")
    names = df.select(member_names(df["v"]).alias("k"))
    assert [sorted(r.k) for r in names.collect()] == [["a", "b", "c"], [], [], [], [], []]
