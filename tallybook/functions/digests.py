"""Fingerprints, content ids, canonical JSON, keyed pseudonyms."""

from __future__ import annotations

import hashlib
import hmac
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def fingerprint(text: Column) -> Column:
    """40 bytes, the length in 8 bytes and the SHA-256 of the UTF-8 bytes."""
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(text).cast("long")), 16, "0")), F.unhex(F.sha2(text, 256)))


def fingerprint_of(text: bytes) -> bytes:
    """T19 of a single text."""
    return len(text).to_bytes(8, "big") + hashlib.sha256(text).digest()


def content_id(canonical: Column) -> Column:
    """sha256: and the hex digest."""
    return F.concat(F.lit("sha256:"), F.sha2(canonical, 256))


def prefixed_digest(*parts: Column) -> Column:
    """Digest of several fields, each behind its length, so that no two splits of the same bytes meet."""
    framed = [F.concat(F.unhex(F.lpad(F.hex(F.octet_length(p).cast("long")), 16, "0")), p.cast("binary")) for p in parts]
    return F.sha2(F.concat(*framed), 256)


#: JSON with sorted keys, no white space and plain UTF-8.
compact = json.JSONEncoder(ensure_ascii=False, check_circular=False, sort_keys=True, separators=(",", ":"), allow_nan=False).encode


@F.pandas_udf(StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """Sorted keys, no white space, plain UTF-8, last of equal keys; null for invalid text and NaN."""

    def one(text):
        try:
            return None if text is None else compact(json.loads(text))
        except ValueError:
            return None

    return texts.map(one)


def pseudonym(address: Column, key: bytes) -> Column:
    """Anon: and 20 hex digits of a keyed digest; unknown for an empty address."""

    @F.pandas_udf(StringType())
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda x: "anon:" + hmac.new(key, x.encode(), hashlib.sha256).hexdigest()[:20] if x else "unknown")

    return run(address)
