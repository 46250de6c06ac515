"""Time texts. Sessions are expected to run in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE = r"^\d{4}-\d{2}-\d{2}"
MOMENT = DATE + r"[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?"
ZONE = r"(Z|[+-]\d{2}:?\d{2})$"


def parse_iso(text: Column) -> Column:
    """A timestamp from extended ISO text; without an offset it counts as UTC; null on any other text."""
    fits = text.rlike(f"{MOMENT}({ZONE})?$") | text.rlike(f"{DATE}$")
    return F.when(fits, F.try_to_timestamp(text))


def parse_absolute(text: Column) -> Column:
    """As parse_iso, but null without an offset."""
    return F.when(text.rlike(f"{MOMENT}{ZONE}"), F.try_to_timestamp(text))


def parse_zulu(text: Column) -> Column:
    """As parse_iso, but null unless the text ends with Z."""
    return F.when(text.endswith("Z"), parse_absolute(text))


def parse_utc_second(text: Column) -> Column:
    """T5: exactly yyyy-mm-ddThh:mm:ssZ, else null."""
    return F.when(text.rlike(DATE + r"T\d{2}:\d{2}:\d{2}Z$"), F.try_to_timestamp(text))


def utc_second(ts: Column) -> Column:
    """Text of a time cut to seconds, with Z."""
    return F.date_format(F.date_trunc("second", ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def utc_millis(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def expiry(received: Column, ttl_days: Column) -> Column:
    """Received + ttl days; null for a ttl of 0 (unlimited)."""
    return F.when(ttl_days > 0, received + F.make_dt_interval(days=ttl_days))
