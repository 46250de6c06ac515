"""Expressions over JSON text read as VARIANT: truthiness, key presence, strict parsing."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NONCE = "tallybook-end-of-record"


def strict_json(text: Column) -> Column:
    """The VARIANT of text that is one JSON value and nothing else, else null.

    Spark's own parser stops after the first value; read inside an array that a marker closes, text with
    anything behind the value either fails or puts the marker elsewhere.
    """
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{NONCE}"]')))
    marked = F.try_variant_get(wrapped, "$[1]", "string") == NONCE
    return F.when(marked & F.try_variant_get(wrapped, "$[2]", "variant").isNull(), F.try_variant_get(wrapped, "$[0]", "variant"))


def once(value: Column, fn) -> Column:
    """fn(value) with the value computed once, however often fn uses it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def member(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def truthy(v: Column) -> Column:
    """The VARIANT itself unless it is missing, null, "", 0, false, [] or {}; then null."""
    text = F.to_json(v)
    number = F.try_variant_get(v, "$", "double")
    shape = F.schema_of_variant(v)
    falsy = v.isNull() | F.is_variant_null(v) | text.isin('""', "false", "[]", "{}") | (~shape.isin("STRING", "BOOLEAN") & (number == 0))
    return F.when(~F.coalesce(falsy, F.lit(False)), v)


def keys(json_text: Column) -> Column:
    """Names of an object's own keys, those with null values too; empty if it is no object."""
    return F.coalesce(F.json_object_keys(json_text), F.array().cast("array<string>"))


def member_names(v: Column) -> Column:
    """Names of the members of a VARIANT object, those with null values too; empty if it is no object. Its text is not written for them."""
    return F.coalesce(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")), F.array().cast("array<string>"))


def has_any(names: Column, *wanted: str) -> Column:
    return F.arrays_overlap(names, F.array(*[F.lit(w) for w in wanted]))


class Field(NamedTuple):
    """What a path of a VARIANT holds: its value, the name of its type and its text; null where there is no such path."""

    value: Column
    shape: Column
    text: Column

    @property
    def there(self) -> Column:
        return self.value.isNotNull()

    @property
    def is_text(self) -> Column:
        return self.shape == "STRING"

    @property
    def is_object(self) -> Column:
        return F.startswith(self.shape, F.lit("OBJECT"))

    @property
    def is_integer(self) -> Column:
        return self.shape.isin("BIGINT", "TINYINT", "SMALLINT", "INT")


def extracted(df: DataFrame, v: str, paths: list[str]) -> tuple[DataFrame, dict[str, Field]]:
    """df with columns for the value, shape and text of each path, read once each, and the fields by path. Rules over them are plain expressions.

    The members of an object that paths name are read in one pass over it, level by level; only paths through arrays are looked up one by one.
    """
    at = {p: f"__{v}_{i}" for i, p in enumerate(dict.fromkeys(paths))}
    levels: dict[str, list[str]] = {}  # an object's path -> its members that are asked for, or lead to some
    for p in at:
        if re.fullmatch(r"\$(\.[A-Za-z_]\w*)+", p):
            steps = p.split(".")
            for k in range(1, len(steps)):
                names = levels.setdefault(".".join(steps[:k]), [])
                if steps[k] not in names:
                    names.append(steps[k])
    own = {p: f"__{v}_o{i}" for i, p in enumerate(levels)}

    def value(p: str) -> Column:
        if p == "$":
            return F.col(v)
        parent, _, name = p.rpartition(".")
        return F.col(own[parent])[name] if name in levels.get(parent, ()) else member(F.col(v), p)

    for p in sorted(levels, key=lambda p: p.count(".")):
        df = df.withColumn(own[p], F.try_variant_get(value(p), "$", f"struct<{', '.join(f'`{n}`: variant' for n in levels[p])}>"))
    df = df.withColumns({f"{c}v": value(p) for p, c in at.items()})
    shape = lambda p, c: F.when(F.col(own[p]).isNotNull(), F.lit("OBJECT<>")).otherwise(F.schema_of_variant(f"{c}v")) if p in own else F.schema_of_variant(f"{c}v")
    df = df.withColumns({f"{c}s": shape(p, c) for p, c in at.items()} | {f"{c}t": F.try_variant_get(f"{c}v", "$", "string") for c in at.values()})
    return df, {p: Field(F.col(f"{c}v"), F.col(f"{c}s"), F.col(f"{c}t")) for p, c in at.items()}
