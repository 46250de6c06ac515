"""Text clean-up: labels, names, domains, patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

LABEL = r"[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"


def sanitize_domain(text: Column) -> Column:
    """Trimmed, lower case, dot-separated host labels of at most 253 characters; else null."""
    d = F.lower(F.regexp_replace(text, r"^\s+|\s+$", ""))
    return F.when(d.rlike(rf"^{LABEL}(?:\.{LABEL})*$") & (F.length(d) <= 253), d)


def metric_label(text: Column, longest: int = 80) -> Column:
    """Cut, other characters than [a-zA-Z0-9._-] as _, ``unknown`` if nothing else is left."""
    clean = F.regexp_replace(F.substring(text, 1, longest), r"[^a-zA-Z0-9._-]", "_")
    return F.when(F.coalesce(clean.rlike("^_*$"), F.lit(True)), F.lit("unknown")).otherwise(clean)


def safe_part(text: Column) -> Column:
    """Runs of other characters as _, no ._- at either end, at most 160; null if empty."""
    clean = F.regexp_replace(F.regexp_replace(F.trim(text), r"[^A-Za-z0-9._-]+", "_"), r"^[._-]+|[._-]+$", "")
    return F.when(clean != "", F.substring(clean, 1, 160))


def repo_domain(repo: Column) -> Column:
    """Integrity.<owner>.<name>; where that is no domain, everything else collapses to dots."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(repo), r"[^a-z0-9-]", "."), r"\.+", ".")
    return F.coalesce(sanitize_domain(F.concat(F.lit("integrity."), F.replace(repo, F.lit("/"), F.lit(".")))), F.concat(F.lit("integrity."), plain))


def bounded(text: Column, longest: int, default: str) -> Column:
    """At most ``longest`` characters, ``default`` for empty or null."""
    return F.coalesce(F.nullif(F.substring(F.trim(text), 1, longest), F.lit("")), F.lit(default))


def glob_regex(pattern: str) -> str:
    """A shell pattern (* ? [seq] [!seq]) as a regular expression for a whole text."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2 + (pattern[i + 1 : i + 2] == "!")) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif end > 0:
            body = pattern[i + 1 : end].replace("\\", r"\\")
            out.append(f"[{'^' + body[1:] if body[0] == '!' else body}]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return rf"(?s)\A(?:{''.join(out)})\z"


def matches_glob(text: Column, pattern: str) -> Column:
    return text.rlike(glob_regex(pattern))
