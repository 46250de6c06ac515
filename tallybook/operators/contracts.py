"""Contracts as rule columns: every row gets its errors, and tables split into valid rows and quarantine."""

from __future__ import annotations

import json
import re
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import parse_utc_second
from ..functions.values import Field, extracted, is_object, member, member_names, once, truthy

# Fixed values of the agent-run contract.
KINDS = ("agent.run.started", "agent.run.completed", "agent.run.blocked")
OPERATIONS = ("implement", "review", "merge", "deploy", "runtime_verify", "recovery", "other")
TASK_CLASSES = ("coding", "review", "merge", "deploy", "runtime_verify", "recovery", "maintenance", "diagnostic", "other")
EVENT_ID = r"^(?:[0-9A-HJKMNP-TV-Z]{26}|sha256:[a-f0-9]{64})$"
REQUIRED = ("schema_version", "event_id", "kind", "ts", "source", "subject", "trust_tier", "status", "caused_by", "evidence_refs", "data")
KEYS = {
    "$": (*REQUIRED, "corrects"),
    "$.source": ("repo", "component", "run_id"),
    "$.subject": ("repo", "branch", "head", "component", "operation", "bureau_task_id", "pr_number", "scope", "host"),
    "$.data": ("result", "blocker_code", "summary", "duration_ms", "outcome", "operation", "task_class"),
}
ENUMS = {
    "$.schema_version": ("agent-run-event.v0",),
    "$.kind": KINDS,
    "$.subject.operation": OPERATIONS[:-1],
    "$.subject.scope": ("repository", "host"),
    "$.trust_tier": ("observed", "declared", "inferred"),
    "$.status": ("active", "superseded", "corrected"),
    "$.data.result": ("started", "completed", "blocked"),
    "$.data.outcome": ("completed", "blocked", "failed", "reverted", "outcome_unknown"),
    "$.data.operation": OPERATIONS,
    "$.data.task_class": TASK_CLASSES,
}
LENGTHS = {
    "$.source.repo": 200, "$.source.component": 80, "$.source.run_id": 160, "$.subject.repo": 200, "$.subject.branch": 200, "$.subject.head": 80,
    "$.subject.component": 160, "$.subject.bureau_task_id": 160, "$.subject.host": 80, "$.data.blocker_code": 80, "$.data.summary": 500,
}
ARRAYS = {"$.corrects": (1, 3), "$.caused_by": (0, 3), "$.evidence_refs": (0, 5)}
INTEGERS = {"$.subject.pr_number": 1, "$.data.duration_ms": 0}
SUMMARY_LENGTH = 500
# What must not leave the boundary.
RAW_KEYS = ("raw_log", "raw_logs", "stdout", "stderr", "command_output", "log_excerpt")
PRIVATE_PATH = r"(?:^|[\s\"'])/(?:home|root|Users)/"
SECRET_ASSIGNMENT = r"(?i)\b(?:api[_-]?key|token|secret|password)\s*[:=]\s*\S+"
SECRET_PREFIXES = ("Bearer ", "ghp_", "gho_", "sk-", "AKIA")
KEY_MARKER = "-----BEGIN PRIVATE KEY-----"


def errors_of(rules: list[tuple[Column, str]]) -> Column:
    """The texts of the rules whose condition for an error holds, in order."""
    found = F.concat_ws("\0", *[F.when(F.coalesce(c, F.lit(False)), F.lit(text)) for c, text in rules])  # compiled, and skips the rules that hold
    return F.array_remove(F.array_distinct(F.split(found, "\0")), "")


CONDITIONAL = ("$.subject.scope", "$.subject.repo", "$.subject.host", "$.status", "$.data.operation", "$.data.task_class")


def with_agent_run_errors(df: DataFrame, v: str, name: str = "errors") -> DataFrame:
    """Df and the errors of an agent-run event in the VARIANT column ``v``; empty if it is valid."""
    own = df.columns
    paths = ["$", "$.source", "$.subject", "$.data", *[f"$.{k}" for k in REQUIRED], *[f"$.source.{k}" for k in KEYS["$.source"]], *ENUMS, *LENGTHS, *INTEGERS, *ARRAYS, *CONDITIONAL, *[f"{p}.{k}" for p, allowed in KEYS.items() for k in allowed]]
    df, at = extracted(df, v, paths)
    known = {p: sum((at[f"{p}.{k}"].there.cast("int") for k in allowed), F.lit(0)) for p, allowed in KEYS.items()}
    rules: list[tuple[Column, str]] = [(~F.coalesce(at["$"].is_object, F.lit(False)), "$: not an object")]
    rules += [(at[p].there & ~at[p].is_object, f"{p}: not an object") for p in ("$.source", "$.subject", "$.data")]
    rules += [(F.size(member_names(at[p].value)) > n, f"{p}: unknown key") for p, n in known.items()]
    rules += [(~at[f"$.{k}"].there, f"$.{k}: missing") for k in REQUIRED]
    rules += [(at["$.source"].there & ~at[f"$.source.{k}"].there, f"$.source.{k}: missing") for k in KEYS["$.source"]]
    rules += [(at[p].there & ~(at[p].is_text & at[p].text.isin(*allowed)), f"{p}: not allowed") for p, allowed in ENUMS.items()]
    rules += [(at[p].there & ~(at[p].is_text & F.length(at[p].text).between(1, most)), f"{p}: length") for p, most in LENGTHS.items()]
    rules += [(at[p].there & ~(at[p].is_integer & (at[p].text.try_cast("bigint") >= least)), f"{p}: not an integer of at least {least}") for p, least in INTEGERS.items()]
    event_id, ts = at["$.event_id"], at["$.ts"]
    rules.append((event_id.there & ~(event_id.is_text & event_id.text.rlike(EVENT_ID)), "$.event_id: pattern"))
    rules.append((ts.there & (~ts.is_text | parse_utc_second(ts.text).isNull()), "$.ts: pattern"))
    for p, (least, most) in ARRAYS.items():
        fits = texts_fit(at[p], least, most, (lambda x: x.rlike(EVENT_ID)) if p != "$.evidence_refs" else (lambda x: F.length(x).between(1, 240)))
        rules.append((at[p].there & ~fits, f"{p}: items"))
    there = lambda p: at[p].there
    scope = at["$.subject.scope"].text
    rules += [
        ((at["$.status"].text == "corrected") & ~there("$.corrects"), "$.corrects: missing"),
        (there("$.subject") & ~there("$.subject.repo") & ~(there("$.subject.scope") & there("$.subject.host")), "$.subject: no target"),
        ((scope == "repository") & (~there("$.subject.repo") | there("$.subject.host")), "$.subject: not a repository's"),
        ((scope == "host") & (~there("$.subject.host") | there("$.subject.repo")), "$.subject: not a host's"),
        (there("$.subject.scope") & (~there("$.data.operation") | ~there("$.data.task_class")), "$.data: operation and task_class missing"),
    ]
    return df.withColumn(name, errors_of(rules)).select(*own, name)


def _members(pairs: list[tuple[str, object]]) -> dict:
    own = dict(pairs)
    if len(own) != len(pairs):
        raise ValueError("a name stands twice")
    return own


def _number(text: str) -> int:
    if len(text) > 15:
        raise ValueError("a large number")
    return int(text)


def _odd(text: str):
    raise ValueError("a number that is no plain integer")


_plain = json.JSONDecoder(object_pairs_hook=_members, parse_int=_number, parse_float=_odd, parse_constant=_odd).decode
_event_id, _utc_second = re.compile(EVENT_ID).match, re.compile(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ").fullmatch


def _member_rules() -> dict[str, dict[str, list[tuple]]]:
    """For each object its members and the rules over the value of each alone: place among all rules, whether a value fits, text."""
    reference = lambda i: 0 < len(i) <= 240
    texts = lambda x, least, most, fits: x.__class__ is list and least <= len(x) <= most and (not x or all(i.__class__ is str and fits(i) for i in x) and len(set(x)) == len(x))
    rules = [(0, f"$.{k}", lambda x: x.__class__ is dict, "not an object") for k in ("source", "subject", "data")]
    rules += [(4, p, lambda x, allowed=frozenset(allowed): x.__class__ is str and x in allowed, "not allowed") for p, allowed in ENUMS.items()]
    rules += [(5, p, lambda x, most=most: x.__class__ is str and 0 < len(x) <= most, "length") for p, most in LENGTHS.items()]
    rules += [(6, p, lambda x, least=least: x.__class__ is int and x >= least, f"not an integer of at least {least}") for p, least in INTEGERS.items()]
    rules.append((7, "$.event_id", lambda x: x.__class__ is str and _event_id(x), "pattern"))
    # a time of this form that is none is left to Spark: it raises here
    rules.append((8, "$.ts", lambda x: x.__class__ is str and _utc_second(x) and datetime.fromisoformat(x), "pattern"))
    rules += [(9, p, lambda x, n=n, fits=reference if p == "$.evidence_refs" else _event_id: texts(x, *n, fits), "items") for p, n in ARRAYS.items()]
    out: dict[str, dict[str, list[tuple]]] = {p: {k: [] for k in allowed} for p, allowed in KEYS.items()}
    for i, (phase, p, fits, why) in enumerate(rules):
        holder, _, name = p.rpartition(".")
        out[holder][name].append(((phase, i), fits, f"{p}: {why}"))
    return out


_rules, _required, _required_of_source = _member_rules(), frozenset(REQUIRED), frozenset(KEYS["$.source"])


def plain_event(text: str) -> tuple[dict, list[str]] | None:
    """C10 for a single line: the event and its errors as ``with_agent_run_errors`` gives them, None if it is not for this to judge.

    Judged are objects in ASCII without escapes, equal names or numbers other than small integers: of these Spark's parser and Python's read the same. All other lines are left to Spark.
    """
    if "\\" in text or not text.isascii():
        return None
    try:
        own = _plain(text)
        if own.__class__ is not dict:
            return None
        source, subject, data = own.get("source"), own.get("subject"), own.get("data")
        found = []
        for i, (members, (p, rules)) in enumerate(zip((own, source, subject, data), _rules.items())):
            if members.__class__ is dict:
                for name, x in members.items():
                    if name in rules:
                        for place, fits, why in rules[name]:
                            if not fits(x):
                                found.append((place, why))
                    else:
                        found.append(((1, i), f"{p}: unknown key"))
    except (ValueError, RecursionError):
        return None
    if not own.keys() >= _required:
        found += [((2, i), f"$.{k}: missing") for i, k in enumerate(REQUIRED) if k not in own]
    source, subject, data = (x if x.__class__ is dict else {} for x in (source, subject, data))
    if "source" in own and not source.keys() >= _required_of_source:
        found += [((3, i), f"$.source.{k}: missing") for i, k in enumerate(KEYS["$.source"]) if k not in source]
    if own.get("status") == "corrected" and "corrects" not in own:
        found.append(((10, 0), "$.corrects: missing"))
    if "subject" in own and "repo" not in subject and not ("scope" in subject and "host" in subject):
        found.append(((10, 1), "$.subject: no target"))
    if "scope" in subject:
        scope = subject["scope"]
        if scope == "repository" and ("repo" not in subject or "host" in subject):
            found.append(((10, 2), "$.subject: not a repository's"))
        if scope == "host" and ("host" not in subject or "repo" in subject):
            found.append(((10, 3), "$.subject: not a host's"))
        if "operation" not in data or "task_class" not in data:
            found.append(((10, 4), "$.data: operation and task_class missing"))
    return own, list(dict.fromkeys(why for _, why in sorted(found))) if found else []


def texts_fit(field: Field, least: int, most: int | None, item, unique: bool = True) -> Column:
    """Whether a field is an array of texts, all different, that meet ``item``. The elements' own types count: a number is no text."""
    items = F.try_variant_get(field.value, "$", "array<string>")
    fits = field.shape.isin("ARRAY<STRING>", "ARRAY<VOID>") & (F.size(items) >= least) & F.forall(items, lambda x: F.coalesce(item(x), F.lit(False)))
    if most is not None:
        fits &= F.size(items) <= most
    if unique:
        fits &= F.size(F.array_distinct(items)) == F.size(items)
    return F.coalesce(fits, F.lit(False))


def provenance_errors(v: Column) -> Column:
    """C4: missing or invalid fields of provenance, in order."""
    return once(v, _provenance_errors)


def _provenance_errors(v: Column) -> Column:
    source = member(v, "$.source")
    has_source = is_object(source)

    def field(name: str) -> list[tuple[Column, str]]:
        own = member(v, f"$.source.{name}")
        return [(has_source & truthy(own).isNull(), f"source.{name}"), (has_source & truthy(own).isNotNull() & (F.schema_of_variant(own) != "STRING"), f"source.{name} (must be a string)")]

    identity = F.coalesce(truthy(member(v, "$.event_id")), truthy(member(v, "$.id")))
    return errors_of(
        [
            (~has_source, "source (must be an object)"),
            *field("repo"),
            *field("component"),
            (identity.isNull(), "event_id (or id)"),
            (identity.isNotNull() & (F.schema_of_variant(identity) != "STRING"), "event_id (must be a string)"),
        ]
    )


def redaction_findings(text: Column) -> Column:
    """Kinds of forbidden material in one text."""
    prefix = F.lit(False)
    for p in SECRET_PREFIXES:
        prefix |= F.contains(text, F.lit(p))
    return errors_of([(text.rlike(PRIVATE_PATH), "private path"), (F.contains(text, F.lit(KEY_MARKER)), "private key"), (prefix, "secret prefix"), (text.rlike(SECRET_ASSIGNMENT), "secret assignment")])


def summary_too_long(summary: Column) -> Column:
    """More code points than allowed."""
    return F.length(summary) > SUMMARY_LENGTH


def split(df: DataFrame, errors: str = "errors", whole_batch: bool = False) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantine); with ``whole_batch`` a single error raises, and nothing passes."""
    bad = df.where(F.size(errors) > 0)
    if whole_batch:
        first = bad.select(errors).first()
        if first:
            raise ValueError(f"batch rejected: {first[0][0]}")
    return df.where(F.size(errors) == 0).drop(errors), bad
