"""Contracts of wrapped events, day reports, status reports and source lists; walks over nested values."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.texts import sanitize_domain
from ..functions.times import parse_absolute, parse_iso
from ..functions.values import is_object, member, member_names, once
from ..plans.folds import walk
from .contracts import KEY_MARKER, RAW_KEYS, SECRET_PREFIXES, errors_of, provenance_errors, redaction_findings, summary_too_long
from .history import normalized_status

# Fixed values of the wrapped events.
WRAPPER_KEYS = ("kind", "version", "id", "meta", "data")
LEGACY_KEYS = ("id", "source", "timestamp", "payload")
DAY_KEYS = ("ts", "topics", "questions", "deltas", "source", "metadata")
STATE_KEYS = ("confidence", "fatigue", "risk_tension", "autonomy_level", "last_updated", "basis_signals")
LEVELS = ("dormant", "aware", "reflective", "critical")
STATUS_KIND = "integrity.summary.published.v1"


def shape(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("MISSING"))


def names(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(x) for x in values])


def own_keys(v: Column) -> Column:
    return member_names(v)


def is_integer(v: Column) -> Column:
    return shape(v).isin("BIGINT", "TINYINT", "SMALLINT", "INT")


def first_error(rules: list[tuple[Column, Column | str]]) -> Column:
    """The text of the first rule whose condition for an error holds; null if none does."""
    return F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(t) if isinstance(t, str) else t) for c, t in rules])


def wrapper_error(v: Column, insight: str, state: str) -> Column:
    """The first error (fixed texts) of a wrapped event of the kinds ``insight`` or ``state``; null if it is valid. A version of true counts as 1 for insights."""

    def rules(v: Column) -> Column:
        m = lambda path: member(v, path)
        missing = F.array_sort(F.array_except(names(WRAPPER_KEYS), own_keys(v)))
        one = (is_integer(m("$.version")) & (member(v, "$.version", "bigint") == 1)) | ((shape(m("$.version")) == "BOOLEAN") & member(v, "$.version", "boolean"))
        is_state = member(v, "$.kind", "string") == state
        number = lambda k: shape(m(f"$.data.{k}")).rlike("INT|DOUBLE|FLOAT|DECIMAL") & member(v, f"$.data.{k}", "double").between(0, 1)
        good_state = number("confidence") & number("fatigue") & number("risk_tension") & (shape(m("$.data.autonomy_level")) == "STRING")
        good_state &= member(v, "$.data.autonomy_level", "string").isin(*LEVELS) & parse_absolute(member(v, "$.data.last_updated", "string")).isNotNull()
        good_state &= shape(m("$.data.basis_signals")).isin("ARRAY<STRING>", "ARRAY<VOID>") & (F.size(F.array_except(own_keys(m("$.data")), names(STATE_KEYS))) == 0)
        good_state &= (F.size(F.array_except(own_keys(v), names(WRAPPER_KEYS))) == 0) & is_integer(m("$.version"))
        return first_error(
            [
                (~is_object(v), "not an object"),
                (F.size(missing) > 0, F.concat(F.lit("missing fields: "), F.concat_ws(", ", missing))),
                (shape(m("$.kind")) != "STRING", "kind must be a string"),
                (~member(v, "$.kind", "string").isin(insight, state), "invalid kind"),
                (~(is_integer(m("$.version")) | (shape(m("$.version")) == "BOOLEAN")), "version must be an integer"),
                (~one, "invalid version: expected 1"),
                (shape(m("$.id")) != "STRING", "id must be a string"),
                (~is_object(m("$.data")), "data must be a dict"),
                (is_state & ~F.coalesce(good_state, F.lit(False)), "schema validation failed"),
                (~is_object(m("$.meta")), "meta must be a dict"),
                (m("$.meta.occurred_at").isNull(), "missing meta.occurred_at"),
                (shape(m("$.meta.occurred_at")) != "STRING", "meta.occurred_at must be a string"),
                (parse_iso(member(v, "$.meta.occurred_at", "string")).isNull(), "meta.occurred_at must be valid ISO8601"),
            ]
        )

    return once(v, rules)


def from_legacy(v: Column) -> Column:
    """The wrapper as JSON text, made from the legacy form where the value has that; null if it has neither. Inner data come first, else the payload without kind and version."""

    def made(v: Column) -> Column:
        own = own_keys(v)
        wrapped = F.size(F.array_except(names(WRAPPER_KEYS), own)) == 0
        legacy = (F.size(F.array_except(names(LEGACY_KEYS), own)) == 0) & (F.size(F.array_except(names(("kind", "version")), own_keys(member(v, "$.payload")))) == 0)
        payload = F.from_json(F.to_json(member(v, "$.payload")), "map<string,string>")
        stripped = F.map_filter(payload, lambda k, _: ~k.isin("kind", "version"))
        # Values of the map are strings or raw JSON; each goes back in the form it has in the payload.
        entries = F.transform(F.map_keys(stripped), lambda k: F.concat(F.to_json(F.array(k)), F.lit(":"), raw_member(v, k)))
        rest = F.concat(F.lit("{"), F.regexp_replace(F.concat_ws(",", entries), r'\["((?:[^"\\]|\\.)*)"\]:', '"$1":'), F.lit("}"))
        data = F.coalesce(F.to_json(truthy_or_empty(member(v, "$.payload.data"))), rest)
        j = lambda path: F.to_json(member(v, path))
        text = F.concat(F.lit('{"kind":'), j("$.payload.kind"), F.lit(',"version":'), j("$.payload.version"), F.lit(',"id":'), j("$.id"), F.lit(',"meta":{"occurred_at":'), j("$.timestamp"), F.lit(',"producer":'), j("$.source"), F.lit('},"data":'), data, F.lit("}"))
        return F.when(wrapped, F.to_json(v)).when(legacy, text)

    return once(v, made)


def raw_member(v: Column, key: Column) -> Column:
    """JSON text of the payload's member ``key``."""
    items = F.from_json(F.to_json(member(v, "$.payload")), "map<string,variant>")
    return F.to_json(items[key])


def truthy_or_empty(v: Column) -> Column:
    """The value unless it is missing or JSON null."""
    return F.when(v.isNotNull() & ~F.is_variant_null(v), v)


def day_errors(v: Column) -> Column:
    """C11: errors of a day report."""

    def rules(v: Column) -> Column:
        m = lambda path: member(v, path)
        date = member(v, "$.ts", "string")
        return errors_of(
            [
                (~is_object(v), "not an object"),
                *[(m(f"$.{k}").isNull(), f"{k}: missing") for k in DAY_KEYS],
                (F.size(F.array_except(own_keys(v), names(DAY_KEYS))) > 0, "unknown key"),
                (m("$.ts").isNotNull() & ~((shape(m("$.ts")) == "STRING") & date.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(date).isNotNull()), "ts: not a date"),
                *[(m(f"$.{k}").isNotNull() & ~shape(m(f"$.{k}")).startswith("ARRAY"), f"{k}: not an array") for k in ("topics", "questions", "deltas")],
                (m("$.source").isNotNull() & (shape(m("$.source")) != "STRING"), "source: not a string"),
                (m("$.metadata").isNotNull() & parse_absolute(member(v, "$.metadata.generated_at", "string")).isNull(), "metadata.generated_at: not a time"),
            ]
        )

    return once(v, rules)


def client_errors(v: Column) -> Column:
    """Missing keys of a strict client's event."""
    return once(v, lambda v: F.array_except(names(("kind", "ts", "source")), own_keys(v)))


def domain_mismatch(item_domain: Column, batch_domain: Column) -> Column:
    """An item's own domain, cleaned, is another than its batch's (or no domain at all)."""
    return item_domain.isNotNull() & ~sanitize_domain(item_domain).eqNullSafe(batch_domain)


def ingest_errors(v: Column, domain: Column, rules: dict[str, Column], enforce_provenance: bool = True) -> Column:
    """The errors of the domain's own contract, else of summary and domain, then of provenance. rules: domain -> column of errors."""
    plain = errors_of([(summary_too_long(member(v, "$.summary", "string")), "summary too long"), (domain_mismatch(member(v, "$.domain", "string"), domain), "domain mismatch")])
    own = F.lit(None).cast("array<string>")
    for name, errors in rules.items():
        own = F.when(domain == name, errors).otherwise(own)
    out = F.coalesce(own, plain)
    return F.concat(out, provenance_errors(v)) if enforce_provenance else out


def source_list(lists: DataFrame) -> DataFrame:
    """Repo, url of the enabled sources of a table of source lists (seq, v); the last entry of a repo counts. Entries with a missing or wrong field are passed over."""
    ok = lists.where(shape(member(F.col("v"), "$.sources")).startswith("ARRAY") & parse_iso(member(F.col("v"), "$.generated_at", "string")).isNotNull())
    items = ok.select("seq", F.posexplode(F.try_variant_get("v", "$.sources", "array<variant>")).alias("pos", "s"))
    text = lambda k: F.when(shape(member(F.col("s"), f"$.{k}")) == "STRING", F.nullif(member(F.col("s"), f"$.{k}", "string"), F.lit("")))
    enabled = member(F.col("s"), "$.enabled")
    rows = items.select("seq", "pos", text("repo").alias("repo"), text("summary_url").alias("url"), F.coalesce(F.try_variant_get("s", "$.enabled", "boolean"), F.lit(True)).alias("enabled"), (enabled.isNull() | F.is_variant_null(enabled) | (shape(enabled) == "BOOLEAN")).alias("fits"))
    rows = rows.where("repo is not null and url is not null and fits and enabled")
    last = F.max_by(F.struct("repo", "url"), F.struct("seq", "pos")).alias("last")
    return rows.groupBy(F.col("repo").alias("__repo")).agg(last).select("last.repo", "last.url")


def status_of(v: Column) -> Column:
    """struct(status, legacy) of a status report, by where its kind stands; null for anything else."""

    def judged(v: Column) -> Column:
        text = lambda path: member(v, path, "string")
        found = F.when(text("$.kind") == STATUS_KIND, False)
        for path in ("$.payload.kind", "$.payload.type", "$.type"):
            found = found.when(text(path) == STATUS_KIND, True)
        return F.when(found.isNotNull(), F.struct(normalized_status(F.coalesce(text("$.payload.status"), F.lit("UNCLEAR"))).alias("status"), found.alias("legacy")))

    return once(v, judged)


#: Marks of C15 that a text shows as they are, names before which a secret may be assigned, and all that its pattern holds of an assignment.
MARKS = ("\\", "/home/", "/root/", "/Users/", KEY_MARKER, *SECRET_PREFIXES)
ASSIGNED, ASSIGNMENT = ("key", "token", "secret", "password"), re.compile(r"(?:api[_-]?key|token|secret|password)\s*[:=]")
RAW_MEMBERS = tuple(f'"{k}"' for k in RAW_KEYS)


def suspect(text: str) -> bool:
    """Whether JSON text shows a mark of C15, or an escape behind which one may be hidden. What it passes over has no finding."""
    low = text.lower()
    return any(m in text for m in MARKS) or any(k in low for k in RAW_MEMBERS) or (any(w in low for w in ASSIGNED) and ASSIGNMENT.search(low) is not None)


def worth(key: str | None, value: str) -> bool:
    """Whether a member or element (its key, its value as JSON) can have a finding."""
    return (key or "").lower() in RAW_KEYS or (value[:1] == '"' and suspect(value))


def nested_redaction(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """C15 on JSON text: path and finding of forbidden keys and texts at any depth.

    Only a text that can have a finding is taken apart, and of its values only those that can are judged.
    """
    rows = walk(df, text, keep, suspect, worth)
    raw = F.when(F.lower("key").isin(*RAW_KEYS), F.array(F.lit("raw output")))
    findings = F.when(F.col("kind") == "string", redaction_findings(F.try_variant_get(F.try_parse_json("value"), "$", "string")))
    nothing = F.array().cast("array<string>")
    return rows.select(*keep, "path", F.explode(F.concat(F.coalesce(raw, nothing), F.coalesce(findings, nothing))).alias("finding"))
