"""Nested payloads: one function over every string of a value by its schema, and the check of offsets that came as JSON."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as S

from quillstone.functions import text as T


def map_strings(value: Column, kind: S.DataType, f: Callable[[Column], Column]) -> Column:
    """value with f over each string of it at any depth; names of fields and keys of maps stay, nulls stay null."""
    if isinstance(kind, S.StringType):
        return f(value)
    if isinstance(kind, S.ArrayType):
        return F.transform(value, lambda x: map_strings(x, kind.elementType, f)) if has_strings(kind) else value
    if isinstance(kind, S.MapType):
        return F.transform_values(value, lambda _, x: map_strings(x, kind.valueType, f)) if has_strings(kind) else value
    if isinstance(kind, S.StructType) and has_strings(kind):
        return F.when(value.isNotNull(), F.struct(*[map_strings(value[c.name], c.dataType, f).alias(c.name) for c in kind]))
    return value


def has_strings(kind: S.DataType) -> bool:
    """Whether a value of this type can hold a string that is no key."""
    if isinstance(kind, S.StructType):
        return any(has_strings(c.dataType) for c in kind)
    if isinstance(kind, S.MapType):
        return has_strings(kind.valueType)
    return has_strings(kind.elementType) if isinstance(kind, S.ArrayType) else isinstance(kind, S.StringType)


def map_json_strings(json: Column, kind: S.DataType, f: Callable[[Column], Column]) -> Column:
    """JSON text of that schema with f over each string value; null where the text is no such JSON."""
    return F.to_json(map_strings(F.from_json(json, kind), kind, f))


def put_back(text: Column, pairs: Column) -> Column:
    """text with each placeholder of pairs (array of token, value) replaced by its value."""
    none = F.array().cast("array<struct<token:string,value:string>>")
    return F.aggregate(F.coalesce(pairs, none), text, lambda t, p: F.replace(t, p["token"], p["value"]))


RANGES = "ARRAY<ARRAY<BIGINT>>"
MISSED_LINES = f"show BOOLEAN, languages ARRAY<STRING>, quotes MAP<STRING, {RANGES}>, sentences ARRAY<STRUCT<text STRING, start BIGINT, end BIGINT, critical {RANGES}, group BIGINT>>"
#: Fixed value: clients hold offsets in 32 bits.
LARGEST = 2**31 - 1


def valid_missed_lines(json: Column, length: Column | None = None) -> Column:
    """Whether a payload of missed lines keeps every rule that its reader relies on; never null.

    It is shown, has a sentence, every range lies within the source, critical ranges lie in their sentence, and each
    sentence's group is one that leads itself, comes no later and reads the same. What from_json cannot read is null and breaks a rule.
    """
    limit = F.least(F.lit(LARGEST), F.coalesce(length, F.lit(LARGEST)) if length is not None else F.lit(LARGEST))
    sure = lambda test: F.coalesce(test, F.lit(False))
    span = lambda a, b: (a >= 0) & (a < b) & (b <= limit)
    ranges = lambda some, test: some.isNotNull() & F.forall(some, lambda r: sure((F.size(r) == 2) & test(F.get(r, 0), F.get(r, 1))))

    def decide(p: Column) -> Column:
        def sentence(s: Column, i: Column) -> Column:
            first = F.get(p["sentences"], s["group"].cast("int"))
            inside = lambda a, b: span(a, b) & (a >= s["start"]) & (b <= s["end"])
            same = (s["group"] == i) | (T.normalize(s["text"]) == T.normalize(first["text"]))
            return sure(s["text"].isNotNull() & span(s["start"], s["end"]) & ranges(s["critical"], inside) & s["group"].between(0, i) & (first["group"] == s["group"]) & same)

        every = F.forall(F.transform(p["sentences"], sentence), lambda ok: ok)
        listed = F.forall(p["languages"], lambda x: x.isNotNull()) & F.forall(F.map_values(p["quotes"]), lambda r: sure(ranges(r, span)))
        return sure(p["show"] & (F.size(p["sentences"]) > 0) & listed & every)

    return T.let(F.from_json(json, MISSED_LINES), decide)
