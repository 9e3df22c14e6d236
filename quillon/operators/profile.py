"""Inspection of documents: types and statistics by path, naming rules, schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import arrays as A

# Names of types in a profile, and the types of a generated mapping.
TYPE_NAMES = {"string": "str", "bigint": "int", "int": "int", "smallint": "int", "tinyint": "int", "double": "float", "float": "float", "boolean": "bool", "binary": "bytes", "timestamp_ntz": "datetime", "timestamp": "datetime", "date": "datetime"}
MAPPING_TYPES = {"int": "integer", "float": "float", "bool": "boolean", "str": "keyword", "splitstr": "text", "datetime": "date"}
JSON_TYPES = {"int": "integer", "float": "number", "bool": "boolean", "str": "string", "datetime": "string", "bytes": "string"}


def leaf_rows(docs: DataFrame, key: str = "_id") -> DataFrame:
    """(key, path, type, in_list, text, number): a row for each leaf value, null ones included.

    ``number`` is what statistics are taken of: the value, or the length of a string.
    """
    parts = []
    for path, kind, many in A.leaves(docs.schema):
        if path == key:
            continue
        name = TYPE_NAMES.get(kind.simpleString(), kind.simpleString())
        values = A.values_at(docs.schema, path) if many else F.array(F.col(path))
        parts.append(F.transform(values, _leaf(path, name, many, isinstance(kind, T.StringType))))
    return docs.select(F.col(key), F.explode(F.concat(*parts)).alias("x")).select(key, "x.*")


def _leaf(path: str, name: str, many: bool, is_text: bool):
    def leaf(x: Column) -> Column:
        number = F.length(x).cast("double") if is_text else (x.cast("double") if name in ("int", "float") else F.lit(None).cast("double"))
        return F.struct(F.lit(path).alias("path"), F.lit(name).alias("type"), F.lit(many).alias("in_list"), x.cast("string").alias("text"), number.alias("number"))

    return leaf


def statistics(leaves: DataFrame, deep: bool = False, exact_median: bool = False) -> DataFrame:
    """By path and type: count, none, min and max; deep: also mean, median and sample deviation.

    The median is approximate, in a buffer of bounded size; the exact one holds all values of a path in one task.
    """
    aggs = [F.count("text").alias("count"), F.count_if(F.col("text").isNull()).alias("none"), F.min("number").alias("min"), F.max("number").alias("max")]
    if deep:
        many = F.count("number") > 1
        aggs += [F.avg("number").alias("mean"), (F.median("number") if exact_median else F.percentile_approx("number", 0.5, 10_000)).alias("median"), F.when(many, F.stddev_samp("number")).alias("stdev")]
    return leaves.groupBy("path", "type", "in_list").agg(*aggs)


def merged_statistics(parts: DataFrame) -> DataFrame:
    """Statistics of batches as one."""
    return parts.groupBy("path", "type", "in_list").agg(F.sum("count").alias("count"), F.sum("none").alias("none"), F.min("min").alias("min"), F.max("max").alias("max"))


def observed_types(leaves: DataFrame) -> DataFrame:
    """By path: the types seen, an integer giving way to a float, in order; long texts are splitstr."""
    name = F.when((F.col("type") == "str") & F.contains("text", F.lit(" ")), "splitstr").otherwise(F.col("type"))
    seen = leaves.filter("text IS NOT NULL").groupBy("path").agg(F.array_sort(F.collect_set(name)).alias("types"))
    without = lambda xs, gone, by: F.when(F.array_contains(xs, by), F.array_remove(xs, gone)).otherwise(xs)
    return seen.select("path", F.array_join(without(without(F.col("types"), "int", "float"), "str", "splitstr"), ",").alias("types"))


def name_warnings(fields: DataFrame) -> DataFrame:
    """(path, code): W001 space, W002 upper case, W003 another character, W004 more than one type.

    ``fields`` has path and type; int and float agree, and so do a type and a list of it.
    """
    kind = F.when(F.col("type").isin("int", "float"), "number").otherwise(F.regexp_replace("type", "^list of ", ""))
    grouped = fields.groupBy("path").agg(F.count_distinct(kind).alias("types"))
    p = F.col("path")
    codes = F.array(F.when(F.contains(p, F.lit(" ")), "W001"), F.when(p != F.lower(p), "W002"), F.when(p.rlike("[^a-zA-Z0-9_.]"), "W003"), F.when(F.col("types") > 1, "W004"))
    return grouped.select("path", F.explode(F.array_compact(codes)).alias("code"))


def identifiers(leaves: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """(path, info, n): values that begin with an identifier's pattern."""
    hits = [F.when(F.col("text").rlike("^(?:" + regex + ")"), F.lit(info)) for info, regex in sorted(patterns.items())]
    return leaves.select("path", F.explode(F.array_compact(F.array(*hits))).alias("info")).groupBy("path", "info").agg(F.count("*").alias("n"))


def json_schema(kind: T.DataType) -> dict:
    """A JSON Schema of a type."""
    if isinstance(kind, T.StructType):
        return {"type": "object", "properties": {f.name: json_schema(f.dataType) for f in kind.fields}}
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": json_schema(kind.elementType)}
    if isinstance(kind, T.MapType):
        return {"type": "object", "additionalProperties": json_schema(kind.valueType)}
    return {"type": JSON_TYPES.get(TYPE_NAMES.get(kind.simpleString(), ""), "string")}


def mapping(kind: T.DataType, split: frozenset[str] = frozenset(), path: str = "") -> dict:
    """An index mapping of a type; strings are lower-cased keywords, those in ``split`` texts."""
    while isinstance(kind, T.ArrayType):
        kind = kind.elementType
    if isinstance(kind, T.StructType):
        return {"properties": {f.name: mapping(f.dataType, split, f"{path}.{f.name}" if path else f.name) for f in kind.fields}}
    name = TYPE_NAMES.get(kind.simpleString())
    if name is None:
        raise ValueError(f"no mapping for {kind.simpleString()}")
    if name == "str":
        return {"type": "text"} if path in split else {"type": "keyword", "normalizer": "keyword_lowercase_normalizer"}
    return {"type": MAPPING_TYPES[name]}


def total_fields(m: dict) -> int:
    return sum(total_fields(x) for x in m["properties"].values()) if "properties" in m else 1


def invalid_values(docs: DataFrame, kinds: dict[str, str], key: str = "_id") -> DataFrame:
    """(key, field): string values that cannot be read as the type asked for; nulls are fine."""
    bad = [F.when(F.col(c).isNotNull() & F.col(c).try_cast(k).isNull(), F.lit(c)) for c, k in sorted(kinds.items())]
    return docs.select(key, F.explode(F.array_compact(F.array(*bad))).alias("field"))


def within_64_bits(n: Column) -> Column:
    """Null for an integer above 2**64; others as long where they fit."""
    kept = F.when(n <= F.lit(str(2**64)).cast("decimal(38,0)"), n)
    return kept.try_cast("bigint")


def merged_type(a: str, b: str) -> str:
    """The type that holds both: equal ones, or a float for an int; else both names."""
    if a == b:
        return a
    return "float" if {a, b} == {"int", "float"} else ",".join(sorted({*a.split(","), *b.split(",")}))


def traversal(docs: DataFrame, depth_first: bool, key: str = "_id") -> DataFrame:
    """(key, path, value, step): the fields of nested documents breadth-first or depth-first."""
    rows: list[tuple[str, Column]] = []

    def visit(fields: list[tuple[str, T.DataType, Column]]) -> None:
        queue = list(fields)
        while queue:
            path, kind, column = queue.pop(0)
            rows.append((path, F.to_json(F.struct(column.alias("v")))))
            below = [(f"{path}.{f.name}", f.dataType, column.getField(f.name)) for f in kind.fields] if isinstance(kind, T.StructType) else []
            queue[:] = below + queue if depth_first else queue + below

    visit([(f.name, f.dataType, F.col(f.name)) for f in docs.schema.fields if f.name != key])
    steps = [F.struct(F.lit(p).alias("path"), v.alias("value"), F.lit(i).cast("bigint").alias("step")) for i, (p, v) in enumerate(rows)]
    return docs.select(key, F.explode(F.array(*steps)).alias("x")).select(key, "x.*")


def merged_observations(a: DataFrame, b: DataFrame) -> DataFrame:
    """By path: the type of two observations of leaves as one; what is a list in either is a list."""
    rows = a.unionByName(b).filter("text IS NOT NULL")
    seen = rows.groupBy("path").agg(F.array_sort(F.collect_set("type")).alias("types"), F.max("in_list").alias("many"))
    types = F.when(F.array_contains("types", "float"), F.array_remove("types", "int")).otherwise(F.col("types"))
    return seen.select("path", F.concat(F.when(F.col("many"), F.lit("list of ")).otherwise(F.lit("")), F.array_join(types, ",")).alias("type"))


def observed_fields(leaves: DataFrame) -> DataFrame:
    """(path, type) as seen, a row for each type: what naming rules look at."""
    kind = F.concat(F.when(F.col("in_list"), F.lit("list of ")).otherwise(F.lit("")), F.col("type"))
    return leaves.filter("text IS NOT NULL").select("path", kind.alias("type")).distinct()


def flat_validated(leaves: DataFrame) -> DataFrame:
    """(path, types, codes): the flat profile of documents and the warnings about each field."""
    seen = observed_fields(leaves)
    flat = seen.groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"))
    warned = name_warnings(seen).groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"))
    return flat.join(warned, "path", "left")


def schema_rows(schema: dict, path: str = "") -> list[tuple[str, str]]:
    """(path, type) of the leaves of a JSON Schema or a mapping."""
    below = schema.get("properties")
    if below is not None:
        return [row for name, inner in below.items() for row in schema_rows(inner, f"{path}.{name}" if path else name)]
    return schema_rows(schema["items"], path) if "items" in schema else [(path, schema["type"])]


def model(schema: T.StructType) -> list[tuple[str, str]]:
    """(field, annotation) of a model of documents: every field may be absent, and one value or a list."""
    names = {"str": "str", "int": "int", "float": "float", "bool": "bool", "datetime": "datetime", "bytes": "bytes"}
    return [(path, f"Optional[Union[{(n := names.get(TYPE_NAMES.get(kind.simpleString(), ''), 'Any'))}, list[{n}]]]") for path, kind, _ in A.leaves(schema)]


def merged_values(parts: DataFrame) -> DataFrame:
    """Deep statistics of batches as one: counts and sums add up, so mean and deviation need no values.

    ``parts`` has path, count, total and squares (sums of the values and of their squares).
    """
    out = parts.groupBy("path").agg(F.sum("count").alias("count"), F.sum("total").alias("total"), F.sum("squares").alias("squares"))
    mean = F.col("total") / F.col("count")
    spread = F.sqrt(F.greatest(F.lit(0.0), (F.col("squares") - F.col("count") * mean * mean) / (F.col("count") - 1)))
    return out.select("path", "count", mean.alias("mean"), F.when(F.col("count") > 1, spread).alias("stdev"))


def value_sums(leaves: DataFrame) -> DataFrame:
    """path, count, total and squares of the numbers of a batch."""
    x = F.col("number")
    return leaves.filter(x.isNotNull()).groupBy("path").agg(F.count("*").alias("count"), F.sum(x).alias("total"), F.sum(x * x).alias("squares"))


def examples(leaves: DataFrame) -> DataFrame:
    """(path, example): the smallest value of each field, as text."""
    return leaves.groupBy("path").agg(F.min("text").alias("example"))
