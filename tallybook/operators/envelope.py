"""Event type, retention and quality of payloads, and the envelope around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.texts import bounded, matches_glob
from ..functions.times import expiry, utc_millis, utc_second
from ..functions.values import has_any, is_object, keys, member, once, truthy

# Retention patterns in order, first match wins; 0 days is unlimited.
POLICIES = (
    ("debug.*", 7), ("*.debug", 7), ("*.debug.*", 7), ("probe.*", 7), ("*.probe", 7), ("test.*", 7), ("*.test", 7), ("*.test.*", 7),
    ("temp.*", 1), ("*.temp", 1), ("*.temp.*", 1), ("*.self_state.snapshot", 0), ("*.published.v1", 0), ("*.published.v*", 0), ("insights.*", 90), ("*", 30),
)
DEFAULT_TTL = 30
# Names that mean the same.
KIND, TIME, DATA, IDENTITY = ("kind", "type", "event"), ("ts", "timestamp", "occurred_at"), ("data", "payload"), ("id", "event_id")


def ttl_days(event_type: Column, policies=POLICIES) -> Column:
    """Days of the first pattern that fits, compiled to one CASE."""

    def first_match(name: Column) -> Column:
        out = F.lit(DEFAULT_TTL)
        for pattern, days in reversed(policies):
            out = F.when(matches_glob(name, pattern), days).otherwise(out)
        return F.when(name.isNull(), DEFAULT_TTL).otherwise(out).cast("int")

    return once(event_type, first_match)


def event_type(payload: Column) -> Column:
    """Kind, type or event, the first that is truthy; null if none."""
    return F.coalesce(*[once(member(payload, f"$.{k}"), truthy).cast("string") for k in KIND])


def signal_strength(payload_json: Column) -> Column:
    """P5: low, medium or high by the presence of keys."""
    own = keys(payload_json)
    score = sum(
        (c.cast("int") for c in (has_any(own, *KIND), has_any(own, *TIME), has_any(own, "source"), has_any(own, *DATA) | (F.size(own) > 3), has_any(own, *IDENTITY))),
        F.lit(0),
    )
    return F.when(score >= 4, "high").when(score >= 2, "medium").otherwise("low")


def completeness(payload_json: Column, required: tuple[str, ...] | None = None) -> Column:
    """Kind, time and source are present, or exactly the required keys."""
    own = keys(payload_json)
    if required is not None:
        return F.size(F.array_except(F.array(*[F.lit(r) for r in required]), own)) == 0
    return has_any(own, *KIND) & has_any(own, *TIME) & has_any(own, "source")


def with_envelope(df: DataFrame, domain: str, received: str, payload_json: str, quality: bool = True) -> DataFrame:
    """Adds received_at, ttl_days, expires_at, and signal_strength and completeness (null without quality)."""
    kind = F.coalesce(event_type(F.try_parse_json(F.col(payload_json))), F.lit("unknown"))
    ttl = ttl_days(kind)
    text = F.col(payload_json)
    return df.withColumns(
        {
            "event_type": kind,
            "received_second": utc_second(F.col(received)),
            "ttl_days": ttl,
            "expires_at": utc_second(expiry(F.col(received), ttl)),
            "signal_strength": signal_strength(text) if quality else F.lit(None).cast("string"),
            "completeness": completeness(text) if quality else F.lit(None).cast("boolean"),
        }
    ).withColumn("envelope_domain", F.col(domain))


def envelope_json(payload_json: str) -> Column:
    """The envelope as JSON of the rows of ``with_envelope``; a null expiry stays as null, without quality its key is left out."""
    field = lambda name, value: F.concat(F.lit(f'"{name}":'), value)
    text = lambda c: F.coalesce(F.to_json(F.col(c).cast("variant")), F.lit("null"))
    retention = F.concat(F.lit("{"), F.concat_ws(",", field("ttl_days", F.col("ttl_days").cast("string")), field("expires_at", text("expires_at"))), F.lit("}"))
    quality = F.when(F.col("signal_strength").isNotNull(), field("quality", F.concat(F.lit('{"signal_strength":'), text("signal_strength"), F.lit(',"completeness":'), F.col("completeness").cast("string"), F.lit("}"))))
    parts = [field("domain", text("envelope_domain")), field("received_at", text("received_second")), field("payload", F.col(payload_json)), field("retention", retention), quality]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def with_markers(payload_json: Column) -> Column:
    """The payload with its quality, in place of one it has."""
    quality = F.concat(F.lit('{"signal_strength":"'), signal_strength(payload_json), F.lit('","completeness":'), completeness(payload_json).cast("string"), F.lit("}"))
    return with_member(payload_json, "quality", quality)


def with_domain(payload_json: Column, domain: Column) -> Column:
    """The item with this domain, whatever it had."""
    return with_member(payload_json, "domain", F.to_json(domain.cast("variant")))


def with_event_id(payload_json: Column) -> Column:
    """The item with its id as event_id too, only if it has no event_id, not even null."""
    v = F.try_parse_json(payload_json)
    own = keys(payload_json)
    given = has_any(own, "id") & ~has_any(own, "event_id")
    return F.when(given, with_member(payload_json, "event_id", F.to_json(member(v, "$.id")))).otherwise(payload_json)


def with_member(object_json: Column, name: str, value_json: Column) -> Column:
    """An object's JSON with one member set, behind the others."""
    items = F.from_json(object_json, "map<string,variant>")
    others = F.filter(keys(object_json), lambda k: k != name)
    pairs = F.transform(others, lambda k: F.concat(F.to_json(k.cast("variant")), F.lit(":"), F.coalesce(F.to_json(items[k]), F.lit("null"))))
    return F.concat(F.lit("{"), F.concat_ws(",", pairs, F.array(F.concat(F.lit(f'"{name}":'), value_json))), F.lit("}"))


def unwrapped(item: Column) -> Column:
    """The payload if there is that key, else the whole item."""
    return F.coalesce(member(item, "$.payload"), item)


def extracted_payload(item: Column) -> Column:
    """The payload if it is an object, else the whole item."""
    payload = member(item, "$.payload")
    return F.when(is_object(payload), payload).otherwise(item)


def unexpired(expires_at: Column, now: Column) -> Column:
    """no expiry, or one after now."""
    return expires_at.isNull() | (expires_at > now)


def audit_row(actor: Column, action: Column, detail: Column, at: Column) -> Column:
    """P20: bounded fields with default texts and a time in milliseconds."""
    return F.struct(bounded(actor, 80, "unknown").alias("actor"), bounded(action, 40, "unspecified").alias("action"), bounded(detail, 200, "none").alias("detail"), utc_millis(at).alias("at"))
