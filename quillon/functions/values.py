"""Tests and conversions of JSON values and of the types that profiles store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Types that profiles store as text, and the Spark types they stand for.
STORED = {"str": T.StringType(), "int": T.LongType(), "Int64": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType(), "bytes": T.BinaryType(), "datetime": T.TimestampNTZType(), "date": T.DateType(), "NoneType": T.NullType(), "list": T.ArrayType(T.StringType()), "dict": T.MapType(T.StringType(), T.StringType())}
MARK = "__type__:"


def kind(json: Column) -> Column:
    """What a JSON text holds, as a type name; null if it is no JSON."""
    return F.schema_of_variant(F.try_parse_json(json))


def is_text(json: Column) -> Column:
    return F.coalesce(kind(json) == "STRING", F.lit(False))


def is_float(json: Column) -> Column:
    return F.coalesce(kind(json).rlike("^(DECIMAL|DOUBLE|FLOAT)"), F.lit(False))


def is_sequence(json: Column) -> Column:
    return F.coalesce(kind(json).startswith("ARRAY"), F.lit(False))


def is_scalar(json: Column) -> Column:
    """A text, number, truth value or null."""
    return F.coalesce(~kind(json).rlike("^(ARRAY|OBJECT)"), F.lit(False))


def converted(text: Column, to: str) -> tuple[Column, Column]:
    """(value, text kept): the text as the type where it can be read, else the text itself."""
    value = text.try_cast(to)
    return value, F.when(value.isNull(), text)


def mapped(xs: Column, f: Callable[[Column], Column]) -> Column:
    """A function of the values of a list, or of a map."""
    return F.transform(xs, f)


def mapped_entries(m: Column, key: Callable[[Column], Column] | None = None, value: Callable[[Column], Column] | None = None) -> Column:
    """A map with functions of its keys and of its values."""
    if key:
        m = F.transform_keys(m, lambda k, v: key(k))
    return F.transform_values(m, lambda k, v: value(v)) if value else m


def updated(m: Column, more: dict[str, Column]) -> Column:
    """A map with further keys; the new value of a key wins."""
    add = F.create_map(*[x for k, v in more.items() for x in (F.lit(k), v)])
    return F.map_concat(F.map_filter(m, lambda k, v: ~F.array_contains(F.array(*[F.lit(k) for k in more]), k)), add)


def distinct(xs: Column) -> Column:
    return F.array_sort(F.array_distinct(xs))


def distinct_count(xs: Column) -> Column:
    return F.size(F.array_distinct(xs)).cast("bigint")


def translated(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The text after a list of substitutions, one after the other."""
    for pattern, by in rules:
        text = F.regexp_replace(text, pattern, by)
    return text


def masked(text: Column, mask: str = "#") -> Column:
    """The text with a mask for every character that could not be decoded."""
    return F.regexp_replace(text, "\ufffd", mask)


def day_stamp(ts: Column) -> Column:
    """A day as eight digits."""
    return F.date_format(ts, "yyyyMMdd")


def pseudonym(*parts: Column) -> Column:
    """An id in the shape of a UUID that stands for the parts and does not show them."""
    h = F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)
    return F.concat_ws("-", *[F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def typed(stored) -> T.DataType | dict | list | str:
    """A stored profile with its types restored: names are looked up, nothing is evaluated."""
    if isinstance(stored, dict):
        return {typed(k): typed(v) for k, v in stored.items()}
    if isinstance(stored, list):
        return [typed(x) for x in stored]
    if isinstance(stored, str) and stored.startswith(MARK):
        return STORED[stored.removeprefix(MARK)]
    return stored
