"""Closed contracts as tables of rules: history events, routing outcome exports, runtime observations, outside events.

A contract lists paths with a check each; what stands beside them in an object is an unknown key. The errors of a row come in order of path, so the first one is that of the
least path.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.times import parse_absolute, parse_utc_second
from ..functions.values import Field, extracted, member, member_names
from .contracts import errors_of, texts_fit
from .wrappers import nested_redaction

Check = Callable[[Field], Column]


class Rule(NamedTuple):
    path: str
    #: None for a value (or the values of an array) that the caller gives.
    check: Check | None
    needed: bool = True


#: Values by path that only the caller knows: names of repositories, domains, authorities.
Given = dict[str, str | tuple[str, ...]]


def text(most: int | None = None, pattern: str | None = None, least: int = 1) -> Check:
    def check(f: Field) -> Column:
        fits = f.is_text & (F.length(f.text) >= least)
        if most is not None:
            fits &= F.length(f.text) <= most
        return fits & f.text.rlike(pattern) if pattern else fits

    return check


def one_of(*values: str) -> Check:
    return lambda f: f.is_text & f.text.isin(*values)


def flag(value: bool | None = None) -> Check:
    return lambda f: (f.shape == "BOOLEAN") if value is None else (f.shape == "BOOLEAN") & (f.text == str(value).lower())


def whole(least: int = 0) -> Check:
    return lambda f: f.is_integer & (f.text.try_cast("bigint") >= least)


def number(low: float, high: float) -> Check:
    return lambda f: (f.is_integer | f.shape.rlike("^(DOUBLE|FLOAT|DECIMAL)")) & f.text.try_cast("double").between(low, high)


def null() -> Check:
    return lambda f: f.shape == "VOID"


def either(*checks: Check) -> Check:
    def check(f: Field) -> Column:
        out = F.lit(False)
        for c in checks:
            out |= F.coalesce(c(f), F.lit(False))
        return out

    return check


def instant(f: Field) -> Column:
    return f.is_text & parse_absolute(f.text).isNotNull()


def second(f: Field) -> Column:
    return f.is_text & parse_utc_second(f.text).isNotNull()


def an_object(f: Field) -> Column:
    return f.is_object


def texts(least: int, most: int | None, item: Callable[[Column], Column] = lambda x: F.length(x) >= 1, unique: bool = True) -> Check:
    return lambda f: texts_fit(f, least, most, item, unique)


def all_of(*values: str) -> Check:
    """An array of just these texts, in any order."""
    return texts(len(values), len(values), lambda x: x.isin(*values))


def objects(least: int, most: int | None, rules: list[Rule]) -> Check:
    """An array of closed objects that meet the rules."""

    def check(f: Field) -> Column:
        items = F.try_variant_get(f.value, "$", "array<variant>")
        size = F.size(items) >= least if most is None else F.size(items).between(least, most)
        allowed = names([r.path.rsplit(".", 1)[1] for r in rules])
        closed = lambda x: F.startswith(F.schema_of_variant(x), F.lit("OBJECT")) & (F.size(F.array_except(member_names(x), allowed)) == 0)
        # values first, then their shapes and texts, so that each is read once for all checks
        values = F.transform(items, lambda x: F.struct(closed(x).alias("closed"), *[member(x, r.path).alias(f"v{i}") for i, r in enumerate(rules)]))
        texts = lambda v: [c.alias(f"{n}{i}") for i in range(len(rules)) for n, c in (("v", v[f"v{i}"]), ("s", F.schema_of_variant(v[f"v{i}"])), ("t", F.try_variant_get(v[f"v{i}"], "$", "string")))]
        fields = F.transform(values, lambda v: F.struct(v["closed"].alias("closed"), *texts(v)))

        def fits(x: Column) -> Column:
            out = x["closed"]
            for i, r in enumerate(rules):
                own = F.coalesce(r.check(Field(x[f"v{i}"], x[f"s{i}"], x[f"t{i}"])), F.lit(False))
                out &= own if r.needed else x[f"v{i}"].isNull() | own
            return out

        return F.startswith(f.shape, F.lit("ARRAY")) & size & F.forall(fields, lambda x: F.coalesce(fits(x), F.lit(False)))

    return check


def check_of(value: str | tuple[str, ...]) -> Check:
    return one_of(value) if isinstance(value, str) else all_of(*value)


def names(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def with_errors(df: DataFrame, v: str, rules: list[Rule], open_objects: tuple[str, ...] = (), more: Callable[[dict[str, Field]], list[tuple[str, Column, str]]] | None = None, name: str = "errors", given: Given | None = None) -> DataFrame:
    """df and the errors of the VARIANT column ``v`` under a contract, in order of path; empty if it is valid. ``more``: conditions between fields as (path, error condition, text)."""
    own = df.columns
    rules = [r if r.check else r._replace(check=check_of(given[r.path])) for r in rules]
    df, at = extracted(df, v, ["$", *[r.path for r in rules]])
    inner = {r.path.rsplit(".", 1)[0] for r in rules} | {"$"}
    found: list[tuple[str, Column, str]] = [("$", ~F.coalesce(at["$"].is_object, F.lit(False)), "not an object")]
    for path in sorted(inner - set(open_objects)):
        allowed = [r.path.rsplit(".", 1)[1] for r in rules if r.path.rsplit(".", 1)[0] == path]
        extra = F.array_except(member_names(at[path].value), names(allowed))
        found.append((path, F.size(extra) > 0, "unknown key"))
    for r in rules:
        parent = at[r.path.rsplit(".", 1)[0]]
        if r.needed:
            found.append((r.path, F.coalesce(parent.is_object, F.lit(False)) & ~at[r.path].there, "missing"))
        found.append((r.path, at[r.path].there & ~F.coalesce(r.check(at[r.path]), F.lit(False)), "not allowed"))
    found += more(at) if more else []
    return df.withColumn(name, errors_of([(c, f"{p}: {t}") for p, c, t in sorted(found, key=lambda x: x[0])])).select(*own, name)


# Fixed values of the contracts below.
HEX = "^[0-9a-f]{64}$"
HISTORY = [
    Rule("$.schema_version", None), Rule("$.domain", None), Rule("$.event_id", text(200)),
    Rule("$.kind", one_of("domain_event", "deployment", "federation_delivery", "operator_receipt")), Rule("$.ts", instant),
    Rule("$.source", an_object), Rule("$.source.origin", text(160)), Rule("$.source.repo", text(200)), Rule("$.source.component", text(160)), Rule("$.source.version", text(160)),
    Rule("$.source.revision", either(text(160), null()), False), Rule("$.correlation_id", text(200)),
    Rule("$.source_evidence", objects(1, 16, [Rule("$.authority", text(120)), Rule("$.reference", text(1000)), Rule("$.sha256", text(pattern=HEX))])),
    Rule("$.privacy", an_object), Rule("$.privacy.classification", one_of("public", "restricted", "private")), Rule("$.privacy.contains_personal_data", flag()),
    Rule("$.lifecycle", an_object), Rule("$.lifecycle.state", one_of("active", "redacted", "revoked", "deleted")), Rule("$.lifecycle.target_event_id", either(text(200), null())),
    Rule("$.lifecycle.authority_reference", text(1000)),
    Rule("$.authority", an_object), Rule("$.authority.primary_truth", text(160)), Rule("$.authority.writeback_allowed", flag(False)),
    Rule("$.payload", an_object),
]
ROUTING_EXPORT = [
    Rule("$.schema_version", None), Rule("$.event_id", text(pattern="^sha256:[0-9a-f]{64}$")), Rule("$.kind", one_of("operator.routing_outcome.exported")),
    Rule("$.ts", second), Rule("$.source", an_object), Rule("$.source.repo", None), Rule("$.source.component", text(pattern="^[A-Za-z0-9._-]{1,120}$")),
    Rule("$.source.revision", text(pattern="^[0-9a-f]{40}$")), Rule("$.source.run_id", text(pattern="^[A-Za-z0-9._:-]{1,160}$")),
    Rule("$.payload_contract", an_object), Rule("$.payload_contract.owner", None), Rule("$.payload_contract.source_repository", None),
    Rule("$.payload_contract.source_revision", None), Rule("$.payload_contract.source_path", None), Rule("$.payload_contract.sha256", None), Rule("$.payload_sha256", text(pattern=HEX)), Rule("$.payload", an_object),
    Rule("$.freshness", an_object), Rule("$.freshness.observed_at", second), Rule("$.freshness.exported_at", second), Rule("$.freshness.consumer_must_recompute", flag(True)),
    Rule("$.evidence_refs", objects(1, 8, [Rule("$.kind", text(pattern="^[a-z][a-z0-9._:-]{0,80}$")), Rule("$.ref", text(240)), Rule("$.sha256", text(pattern=HEX))])),
    Rule("$.boundary", an_object), Rule("$.boundary.transport_authority", None), Rule("$.boundary.payload_authority", None),
    Rule("$.boundary.routing_authority", one_of("none")), Rule("$.boundary.raw_logs_included", flag(False)), Rule("$.boundary.secrets_included", flag(False)), Rule("$.boundary.auto_apply_permitted", flag(False)),
    Rule("$.non_claims", None),
]
ROUTING_OUTCOME = [
    Rule("$.version", one_of("operator.routing_outcome.v1")), Rule("$.decision_id", text(pattern="^[A-Za-z0-9._:-]{1,160}$")), Rule("$.ts", instant), Rule("$.task_class", text(pattern="^[a-z][a-z0-9._-]{0,80}$")),
    Rule("$.route_used", text(pattern="^[a-z][a-z0-9._:-]{0,119}$")), Rule("$.outcome", one_of("success", "failure", "partial", "unknown")), Rule("$.resolved", flag()), Rule("$.reward", number(-1, 1)),
    Rule("$.metrics", an_object), Rule("$.metrics.completion_state", one_of("completed", "blocked", "deferred", "failed", "unknown")), Rule("$.metrics.friction_count", whole()),
    Rule("$.metrics.blocked_by_platform_filter", flag()), Rule("$.metrics.manual_operator_needed", flag()), Rule("$.metrics.ci_state", one_of("pass", "fail", "pending", "not_applicable", "unknown"), False),
    Rule("$.metrics.pr_state", one_of("merged", "open", "closed", "not_applicable", "unknown"), False), Rule("$.metrics.elapsed_seconds", whole(), False), Rule("$.metrics.rework_count", whole(), False),
    Rule("$.friction", objects(0, None, [
        Rule("$.kind", one_of("ci_contract", "connector_snapshot", "execution_context", "fail_closed_gate", "network", "operator_bug", "platform_filter", "unknown", "user_input")),
        Rule("$.surface", text(160)), Rule("$.operation", text(160), False), Rule("$.resolved", flag()), Rule("$.fallback", text(500), False),
    ]), False),
    Rule("$.evidence_refs", objects(0, None, [Rule("$.kind", text(pattern="^[a-z][a-z0-9._:-]{0,80}$")), Rule("$.ref", text()), Rule("$.sha256", text(pattern=HEX), False)]), False),
    Rule("$.does_not_establish", texts(1, None)),
]
OUTSIDE = [Rule("$.event", text(least=0)), Rule("$.status", text(least=0)), Rule("$.domain", text(least=0), False)]
CITATION = [Rule("$.ref", text(240)), Rule("$.source_file", text(260)), Rule("$.line_start", whole(1)), Rule("$.line_end", whole(1)), Rule("$.content_sha256", text(pattern=HEX))]
PROVENANCE = {"artifact_sha256": text(pattern=HEX), "command_sha256": text(pattern=HEX), "receipt_sha256": text(pattern=HEX), "uri": text(260)}


def provenance(f: Field) -> Column:
    """A closed object with one of the keys at least."""
    own = member_names(f.value)
    fits = f.is_object & (F.size(own) >= 1) & (F.size(F.array_except(own, names(list(PROVENANCE)))) == 0)
    for k, check in PROVENANCE.items():
        value = member(f.value, f"$.{k}")
        fits &= value.isNull() | F.coalesce(check(Field(value, F.schema_of_variant(value), F.try_variant_get(value, "$", "string"))), F.lit(False))
    return fits


SIGHTING = [
    Rule("$.observed_at", second), Rule("$.authority_label", one_of("observed_runtime", "declared_runtime", "inferred_runtime")), Rule("$.provenance", provenance), Rule("$.summary", text(500)),
]
RUNTIME = [
    Rule("$.schema_version", one_of("runtime-lens-observation.v1")), Rule("$.event_id", text(pattern="^([0-9A-HJKMNP-TV-Z]{26}|sha256:[0-9a-f]{64})$")), Rule("$.kind", one_of("runtime.lens.observation")), Rule("$.ts", second),
    Rule("$.source", an_object), Rule("$.source.repo", text(200)), Rule("$.source.component", text(120)), Rule("$.source.run_id", text(160)), Rule("$.source.version", text(80), False),
    Rule("$.subject", an_object), Rule("$.subject.system", text(120)), Rule("$.subject.repo", text(200)), Rule("$.subject.service", text(160), False), Rule("$.subject.environment", text(120), False),
    Rule("$.subject.runtime_id", text(200), False),
    Rule("$.code_evidence", an_object), Rule("$.code_evidence.authority_label", None), Rule("$.code_evidence.snapshot", an_object), Rule("$.code_evidence.snapshot.stem", text(180)),
    Rule("$.code_evidence.snapshot.repo", text(200)), Rule("$.code_evidence.snapshot.commit", text(pattern="^[0-9a-f]{7,40}$")), Rule("$.code_evidence.snapshot.manifest_sha256", text(pattern=HEX)),
    Rule("$.code_evidence.snapshot.generated_at", second, False), Rule("$.code_evidence.citations", objects(1, 8, CITATION)), Rule("$.runtime_evidence", an_object),
    Rule("$.drift", an_object), Rule("$.drift.status", one_of("aligned_observed", "drift_observed", "unknown", "not_checked")),
    Rule("$.drift.basis", one_of("commit_identity_match", "commit_identity_mismatch", "runtime_newer_than_snapshot", "snapshot_newer_than_runtime", "missing_runtime_evidence", "missing_code_evidence", "inconclusive", "none")),
    Rule("$.drift.summary", text(500)),
    Rule("$.authority", an_object), Rule("$.authority.code_authority", None), Rule("$.authority.runtime_authority", None), Rule("$.authority.verdict_authority", one_of("none")),
    Rule("$.boundary", an_object), Rule("$.non_claims", None),
]


def with_history_errors(df: DataFrame, v: str, given: Given, ledger_itself: str, name: str = "errors") -> DataFrame:
    """Errors of a history event: an active one has no target, the others have one, and the ledger (names by the pattern ``ledger_itself``) is never its own primary truth.

    given: schema_version, domain, and whatever of ``authority`` names its role.
    """

    def more(at: dict[str, Field]) -> list[tuple[str, Column, str]]:
        state, target, truth = at["$.lifecycle.state"], at["$.lifecycle.target_event_id"], at["$.authority.primary_truth"]
        active = state.is_text & (state.text == "active")
        other = state.is_text & state.text.isin("redacted", "revoked", "deleted")
        return [
            ("$.lifecycle.target_event_id", active & target.there & (target.shape != "VOID"), "not allowed"),
            ("$.lifecycle.target_event_id", other & target.there & ~target.is_text, "not allowed"),
            ("$.authority.primary_truth", truth.is_text & truth.text.rlike(ledger_itself), "not allowed"),
        ]

    return with_errors(df, v, with_given(HISTORY, given), ("$.payload",), more, name, given)


def with_given(rules: list[Rule], given: Given) -> list[Rule]:
    """The rules, and one for each given path that they have not."""
    return [*rules, *[Rule(p, None) for p in given if p not in {r.path for r in rules}]]


def with_runtime_errors(df: DataFrame, v: str, given: Given, source_types: tuple[str, ...] = (), name: str = "errors") -> DataFrame:
    """Errors of a runtime observation. given: labels of the authorities, forbidden actions (arrays under ``boundary``), non-claims; ``source_types`` add to those of a sighting."""
    kinds = ("service_status", "service_log_excerpt", "deployment_identity", "health_endpoint", "metrics_snapshot", "manual_observation", *source_types)
    sighting = [Rule("$.source_type", one_of(*kinds)), *SIGHTING]
    rules = [r._replace(check=objects(1, 8, sighting)) if r.path == "$.runtime_evidence" else r for r in RUNTIME]
    return with_errors(df, v, with_given(rules, given), (), None, name, given)


def with_outside_errors(df: DataFrame, v: str, name: str = "errors") -> DataFrame:
    """Errors of an outside event; other keys are free."""
    return with_errors(df, v, OUTSIDE, ("$",), None, name)


def with_export_errors(df: DataFrame, json_text: str, key: str, given: Given, name: str = "errors") -> DataFrame:
    """C14: errors of an exported routing outcome: both contracts, the pinned payload contract, digest and id over canonical JSON, times in order, and nothing that must not leave.

    ``key`` names the rows. given: schema_version, source.repo, the members of payload_contract (the pin), the authorities under boundary, non_claims.
    """
    own = df.columns
    v = F.try_parse_json(json_text)
    df = df.withColumns({"__v": v, "__p": F.try_variant_get(v, "$.payload", "variant")})

    def more(at: dict[str, Field]) -> list[tuple[str, Column, str]]:
        observed, exported, ts = (parse_utc_second(at[p].text) for p in ("$.freshness.observed_at", "$.freshness.exported_at", "$.ts"))
        return [("$.freshness.exported_at", exported < observed, "before observed_at"), ("$.ts", ts != exported, "not the time of export")]

    df = with_errors(df, "__v", ROUTING_EXPORT, ("$.payload",), more, "__a", given)
    df = with_errors(df, "__p", ROUTING_OUTCOME, (), None, "__b")
    # canonical bytes as Python writes them: numbers keep their form
    df = df.withColumns({"__payload": canonical_member(F.col(json_text), F.lit("payload"), F.lit(True)), "__rest": canonical_member(F.col(json_text), F.lit("event_id"), F.lit(False))})
    digests = errors_of(
        [
            (~F.sha2("__payload", 256).eqNullSafe(F.try_variant_get("__v", "$.payload_sha256", "string")), "$.payload_sha256: not the payload's"),
            (~F.concat(F.lit("sha256:"), F.sha2("__rest", 256)).eqNullSafe(F.try_variant_get("__v", "$.event_id", "string")), "$.event_id: not the content's"),
        ]
    )
    findings = nested_redaction(df, json_text, [key]).groupBy(F.col(key).alias("__key")).agg(F.sort_array(F.collect_set(F.concat("path", F.lit(": "), "finding"))).alias("__leaks"))
    joined = df.withColumn("__d", digests).join(findings, F.col(key).eqNullSafe(F.col("__key")), "left")
    inner = F.transform("__b", lambda e: F.concat(F.lit("$.payload"), F.substring(e, 2, 1_000)))
    nothing = F.array().cast("array<string>")
    return joined.withColumn(name, F.concat("__a", inner, "__d", F.coalesce("__leaks", nothing))).select(*own, name)


def dump(value) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


@F.pandas_udf(StringType())
def canonical_member(texts: pd.Series, names: pd.Series, alone: pd.Series) -> pd.Series:
    """Canonical JSON of an object's member (``alone``), or of the object without it; null for what is no object."""

    def one(text: str, name: str, alone: bool) -> str | None:
        try:
            value = json.loads(text)
            return dump(value[name]) if alone else dump({k: x for k, x in value.items() if k != name})
        except (TypeError, ValueError, KeyError, AttributeError):
            return None

    return pd.Series([one(*row) for row in zip(texts, names, alone)], dtype=object)
