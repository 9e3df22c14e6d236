"""Reshaping hits: flattening, licences, JMESPath expressions, field metadata."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import arrays as A


def any_equal(value, columns: list[str]) -> Column:
    """Whether one of the columns has the value; the value is never put into a string."""
    return reduce(lambda a, b: a | b, [F.col(c) == F.lit(value) for c in columns])


def root_sources(sources: DataFrame, name: str, wanted: list[str]) -> DataFrame:
    """The listed sources, or all but those listed after ``!``; a mixture is an error."""
    negated = [w for w in wanted if w.startswith("!")]
    if negated and len(negated) != len(wanted):
        raise ValueError("either all or none of the sources may be negated")
    if negated:
        return sources.filter(~F.col(name).isin(*[w[1:] for w in negated]))
    return sources.filter(F.col(name).isin(*wanted)) if wanted else sources


def exclude_fields(docs: DataFrame, ids: DataFrame, fields: list[str], key: str = "_id", min_size: int = 1000) -> DataFrame:
    """For listed ids, null for list fields longer than ``min_size``."""
    listed = ids.select(F.col(key).alias("_listed")).distinct()
    met = docs.join(listed, docs[key] == listed["_listed"], "left")
    return met.select(*[F.when(F.col("_listed").isNotNull() & (F.size(c) > min_size), F.lit(None)).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in docs.columns])


def flattened(docs: DataFrame, key: str = "_id", sep: str = ".") -> DataFrame:
    """(_id, path, value): each leaf path with its values joined by ``|``, paths in order."""
    pairs = []
    for path, _, _ in sorted(A.leaves(docs.schema)):
        if path != key:
            values = F.transform(A.values_at(docs.schema, path), lambda x: x.cast("string"))
            pairs.append(F.struct(F.lit(path.replace(".", sep)).alias("path"), values.alias("values")))
    rows = docs.select(F.col(key).alias("_id"), F.explode(F.array(*pairs)).alias("p")).filter(F.size("p.values") > 0)
    return rows.select("_id", "p.path", F.array_join("p.values", "|").alias("value"))


def truthy_items(xs: Column) -> Column:
    """A flattened list without its empty values: null, zero, false and the empty string."""
    return F.filter(xs, lambda x: x.isNotNull() & ~x.cast("string").isin("", "0", "0.0", "false"))


def ensure_field(docs: DataFrame, path: str, value: Column) -> DataFrame:
    """The dotted field, made with its parents where the schema lacks it."""
    head, *rest = path.split(".")

    def made(kind: T.DataType | None, column: Column | None, parts: list[str]) -> Column:
        if not parts:
            return column if column is not None else value
        if isinstance(kind, T.StructType):
            names = {f.name: f.dataType for f in kind.fields}
            fields = [(column.getField(n) if n != parts[0] else made(t, column.getField(n), parts[1:])).alias(n) for n, t in names.items()]
            if parts[0] not in names:
                fields.append(made(None, None, parts[1:]).alias(parts[0]))
            return F.struct(*fields)
        return F.struct(made(None, None, parts[1:]).alias(parts[0]))

    if head in docs.columns:
        return docs.withColumn(head, made(docs.schema[head].dataType, F.col(head), rest))
    return docs.withColumn(head, made(None, None, rest))


def with_license(docs: DataFrame, licences: dict[str, str]) -> DataFrame:
    """Adds ``_license`` to the objects at the paths given, through lists."""
    for path, url in licences.items():
        cols = A.on_document(docs.schema, path + "._license", lambda x, u=url: F.lit(u))
        docs = docs.select(*cols)
    return docs


_STEP = re.compile(r"\.?(?:([A-Za-z_]\w*)|(\[\])|(\[\*\])|\[(-?\d+)\]|\[\?\s*([\w.]+)\s*(==|!=|<=|>=|<|>)\s*(?:'([^']*)'|`([^`]*)`)\s*\])")
_CALL = re.compile(r"^(length|unique|unique_count|sort|min|max|sum|keys)\((.*)\)$", re.S)


def _getter(name: str):
    return lambda x: x.getField(name)


def _test(path: list[str], op: str, value: str, literal: bool):
    def test(x: Column) -> Column:
        for p in path:
            x = x.getField(p)
        right = F.lit(value).try_cast("double") if literal else F.lit(value)
        return {"==": x == right, "!=": x != right, "<": x < right, ">": x > right, "<=": x <= right, ">=": x >= right}[op]

    return test


def jmespath(docs: DataFrame, expression: str) -> Column:
    """A subset of JMESPath: fields, ``[]``, ``[*]``, ``[n]``, ``[?a=='x']``, and a few functions."""
    if m := _CALL.match(expression.strip()):
        if m[1] == "keys":
            kind = docs.select(m[2]).schema[0].dataType
            return F.array(*[F.lit(n) for n in sorted(kind.names)])
        inner = jmespath(docs, m[2])
        return {"length": lambda: F.size(inner).cast("bigint"), "unique": lambda: F.array_sort(F.array_distinct(inner)), "unique_count": lambda: F.size(F.array_distinct(inner)).cast("bigint"), "sort": lambda: F.array_sort(inner), "min": lambda: F.array_min(inner), "max": lambda: F.array_max(inner), "sum": lambda: F.aggregate(inner, F.lit(0.0), lambda a, x: a + x)}[m[1]]()
    at, column, kind, many = 0, None, docs.schema, False
    while at < len(expression):
        m = _STEP.match(expression, at)
        if not m:
            raise ValueError(f"cannot read {expression[at:]!r}")
        at = m.end()
        if m[1]:
            inner = kind.elementType if many else kind
            if not isinstance(inner, T.StructType) or m[1] not in inner.names:
                return F.lit(None)
            field = inner[m[1]].dataType
            if column is None:
                column, kind = F.col(m[1]), field
            elif many:
                column = F.filter(F.transform(column, _getter(m[1])), lambda x: x.isNotNull())
                kind = T.ArrayType(field)
            else:
                column, kind = column.getField(m[1]), field
        elif m[2] or m[3]:
            if many and isinstance(kind.elementType, T.ArrayType):
                column, kind = F.flatten(column), kind.elementType
            many = True
        elif m[4]:
            i = int(m[4])
            column, kind, many = F.try_element_at(column, F.lit(i if i < 0 else i + 1)), kind.elementType, False
        else:
            value, op = m[7] if m[7] is not None else m[8], m[6]
            path = m[5].split(".")

            column, many = F.filter(column, _test(path, op, value, m[7] is None)), True
    return column


def field_metadata(spark: SparkSession, schema: T.StructType, prefix: str = "", search: str | None = None, excluded: tuple[str, ...] = ()) -> DataFrame:
    """(path, type, is_list) of the fields whose path starts with, or holds, what is asked for."""
    rows = [(p, k.simpleString(), many) for p, k, many in A.leaves(schema) if p.startswith(prefix) and (search is None or search in p) and p.split(".")[0] not in excluded]
    return spark.createDataFrame(rows, "path string, type string, is_list boolean")


@dataclass(frozen=True)
class HitOptions:
    """How hits are shaped; ``hook`` may change the documents after their licences."""

    version: bool = False
    score: bool = True
    licences: tuple[tuple[str, str], ...] = ()
    allow_null: tuple[str, ...] = ()
    always_list: tuple[str, ...] = ()
    sort_keys: bool = True
    jmespath: tuple[tuple[str, str], ...] = ()
    dotfield: bool = False
    hook: Callable[[DataFrame], DataFrame] | None = None


def format_hits(docs: DataFrame, options: HitOptions, key: str = "_id") -> DataFrame:
    """Hits in their final shape: version and score, licences and the hook, null fields, lists, key order, expressions, dots."""
    gone = [c for c, keep in (("_version", options.version), ("_score", options.score)) if not keep]
    docs = with_license(docs.drop(*gone), dict(options.licences))
    if options.hook:
        docs = options.hook(docs)
    for path in options.allow_null:
        docs = ensure_field(docs, path, F.lit(None).cast("string"))
    for path in options.always_list:
        docs = docs.select(*A.on_document(docs.schema, path, lambda x: F.when(x.isNull(), F.array().cast("array<string>")).otherwise(F.array(x.cast("string")))))
    if options.sort_keys:
        docs = docs.select(*[A.sorted_keys(docs.schema[c].dataType, F.col(c)).alias(c) for c in sorted(docs.columns)])
    for name, expression in options.jmespath:
        docs = docs.withColumn(name, jmespath(docs, expression))
    if options.dotfield:
        paths = [p for p, _, _ in A.leaves(docs.schema) if p != key]
        joined = [F.array_join(F.transform(A.values_at(docs.schema, p), lambda x: x.cast("string")), ",").alias(p) for p in paths]
        docs = docs.select(key, *joined)
    return docs


def envelope(hits: DataFrame) -> DataFrame:
    """Each hit as an object, beside the number of them and how that relates to all matches."""
    total = F.struct(hits.agg(F.count("*")).scalar().alias("value"), F.lit("gte").alias("relation"))
    return hits.select(total.alias("total"), F.struct(*hits.columns).alias("hit"))


def rows_as_documents(header: list[str], rows: DataFrame) -> DataFrame:
    """The rows of an SQL result as documents with the names of its header."""
    return rows.toDF(*header)


def dotted(docs: DataFrame, paths: list[str], key: str = "_id") -> DataFrame:
    """Selected fields as columns with dotted names."""
    return docs.select(key, *[A.get(docs.schema, p).alias(p) for p in paths])


def without(docs: DataFrame, names: list[str]) -> DataFrame:
    return docs.drop(*names)


def united(*tables: dict) -> dict:
    """Mappings or licences of several sources as one: of a root field the last one counts."""
    return {k: v for t in tables for k, v in t.items()}


def with_notes(fields: DataFrame, notes: dict[str, str]) -> DataFrame:
    """Field metadata with the notes on fields, null without one."""
    pairs = F.create_map(*[F.lit(x) for item in sorted(notes.items()) for x in item]) if notes else F.lit(None).cast("map<string,string>")
    return fields.withColumn("note", pairs[F.col("path")])


def execute(spark: SparkSession, text: str, arguments: dict, **tables: DataFrame) -> DataFrame:
    """SQL with named arguments and tables; values are never put into the text."""
    return spark.sql(text, args=arguments, **tables)
