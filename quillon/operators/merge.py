"""Merging sources into one collection, structural merges, identifier mapping."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.cluster import ship
from quillon.operators.load import update_roots


def merge_source(target: DataFrame, source: DataFrame, key: str = "_id", root: bool = True) -> DataFrame:
    """One source over the target by id; only a root source may add ids."""
    return update_roots(target, source, key, insert=root)


def merge_sources(sources: dict[str, DataFrame], roots: list[str] | None = None, order: list[str] | None = None, key: str = "_id") -> DataFrame:
    """All sources, root ones first, then the others by name or as ordered; later ones win a column.

    One aggregation for any number of sources: rows carry their source's rank, and each
    column takes the value of the highest rank that has one.
    """
    names = sorted(sources)
    first = [n for n in names if roots and n in roots]
    rest = [n for n in (order or names) if n not in first]
    columns = sorted({c for df in sources.values() for c in df.columns if c != key})
    ranked = [sources[n].withColumns({"_rank": F.lit(i), "_root": F.lit(not roots or n in first)}) for i, n in enumerate(first + rest)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)
    aggs = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_rank"))).alias(c) for c in columns]
    return rows.groupBy(key).agg(F.max("_root").alias("_root"), *aggs).filter("_root").drop("_root")


def batch_duplicates(docs: DataFrame, key: str, position: str, fail_if_different: bool = False) -> DataFrame:
    """Documents of one id, updated in order; equal ones are one. Differing ones can be an error."""
    columns = [c for c in docs.columns if c not in (key, position)]
    shape = F.to_json(F.struct(*columns))
    aggs = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(position))).alias(c) for c in columns]
    out = docs.groupBy(key).agg(F.count_distinct(shape).alias("_shapes"), *aggs)
    if fail_if_different:
        checked = F.when(F.col("_shapes") > 1, F.raise_error(F.concat(F.lit("different documents of "), F.col(key).cast("string")))).otherwise(F.col(key))
        out = out.withColumn(key, checked)
    return out.drop("_shapes")


def map_ids(docs: DataFrame, mapping: DataFrame, key: str = "_id", transparent: bool = True) -> DataFrame:
    """Ids translated by a table (src, dst): a copy for each target; without one kept, or dropped."""
    met = docs.join(mapping.select(F.col("src").alias("_src"), F.col("dst").alias("_dst")), docs[key] == F.col("_src"), "left" if transparent else "inner")
    return met.withColumn(key, F.coalesce(F.col("_dst").cast("string"), F.col(key).cast("string"))).drop("_src", "_dst")


def outer_merge(parts: dict[str, DataFrame], key: str, missing=None) -> DataFrame:
    """key and a column for each named table (key, value), null or ``missing`` where it has none."""
    out = None
    for name, df in parts.items():
        own = df.select(F.col(key), F.col("value").alias(name))
        out = own if out is None else out.join(own, key, "full_outer")
    return out if missing is None else out.fillna(missing, list(parts))


def registry(collections: dict[str, DataFrame], key: str = "_id") -> DataFrame:
    """Each id and the sorted names of the collections that hold it."""
    rows = reduce(lambda a, b: a.unionByName(b), [df.select(F.col(key).cast("string").alias(key), F.lit(n).alias("source")) for n, df in collections.items()])
    return rows.groupBy(key).agg(F.array_sort(F.collect_set("source")).alias("sources"))


def merge_lists(a: Column, b: Column) -> Column:
    """The structural merge of two lists: what of b is unseen comes after a."""
    return F.concat(a, F.filter(b, lambda x: ~F.array_contains(a, x)))


def merge_scalars(a: Column, b: Column) -> Column:
    """The structural merge of two scalars, as a list: one value if they agree."""
    return F.when(a.eqNullSafe(b), F.array(a)).otherwise(F.array(a, b))


def merge_root_lists(a: Column, b: Column) -> Column:
    """Two list-valued columns, one after the other; a null adds nothing."""
    return F.concat(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>")))


def merge_structures(left, right):
    """Two JSON values merged: lists append what is unseen, objects merge by key, differing scalars pair up.

    An object meets only an object or a list.
    """
    if isinstance(left, list):
        return left + [x for x in (right if isinstance(right, list) else [right]) if x not in left]
    if isinstance(right, list):
        return right if left in right else [*right, left]
    if isinstance(left, dict) != isinstance(right, dict):
        raise ValueError("an object cannot be merged with a scalar")
    if isinstance(left, dict):
        return {k: merge_structures(left[k], right[k]) if k in left and k in right else left.get(k, right.get(k)) for k in [*left, *(k for k in right if k not in left)]}
    return left if left == right else [left, right]


def apply_delta(value: dict, delta: dict) -> dict:
    """A recursive update; ``__REPLACE__`` starts its level anew, ``__REMOVE__`` drops its key."""
    out = {} if delta.get("__REPLACE__") else dict(value)
    for k, v in delta.items():
        if k == "__REPLACE__":
            continue
        if not isinstance(v, dict):
            out[k] = v
        elif v.get("__REMOVE__"):
            out.pop(k, None)
        else:
            out[k] = apply_delta(out[k] if isinstance(out.get(k), dict) else {}, v)
    return out


def _fold(f):
    def fold(parts: pd.Series) -> pd.Series:
        out = []
        for texts in parts:
            value = None
            for i, text in enumerate(texts):
                value = json.loads(text) if i == 0 else f(value, json.loads(text))
            out.append(json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True))
        return pd.Series(out)

    return fold


def fold_documents(docs: DataFrame, key: str, position: str, document: str = "doc", f=merge_structures) -> DataFrame:
    """One JSON document an id, folded in order; ids with a single document skip Python."""
    ship(docs.sparkSession)
    ordered = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(document).alias("d"))))
    grouped = docs.groupBy(key).agg(F.transform(ordered, lambda x: x.d).alias("parts"))
    folded = F.pandas_udf(_fold(f), "string")
    many = grouped.filter(F.size("parts") > 1).select(key, folded("parts").alias(document))
    return grouped.filter(F.size("parts") == 1).select(key, F.get("parts", F.lit(0)).alias(document)).unionByName(many)


def first_different(rows: DataFrame, key: str, position: str, columns: list[str]) -> DataFrame:
    """Rows of one key: a column is its first value, and all later ones that differ from what is there."""
    aggs = []
    for c in columns:
        xs = F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(F.col(position).alias("p"), F.col(c).alias("v"))))), lambda x: x.v)
        # after a second value the list differs from any scalar, so every later value is added
        seen = F.aggregate(xs, F.array().cast(f"array<{dict(rows.dtypes)[c]}>"), lambda acc, x: F.when((F.size(acc) == 1) & (F.get(acc, F.lit(0)) == x), acc).otherwise(F.concat(acc, F.array(x))))
        aggs.append(seen.alias(c))
    return rows.groupBy(key).agg(*aggs)


def whats_new(built: DataFrame, current: DataFrame) -> DataFrame:
    """(source, old, new) of the sources whose version changed since the last build."""
    b, c = built.select("source", F.col("version").alias("old")), current.select("source", F.col("version").alias("new"))
    return c.join(b, "source", "left").filter(~F.col("old").eqNullSafe(F.col("new"))).select("source", "old", "new")


def latest(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def combine_metadata(rows: DataFrame, group: list[str]) -> DataFrame:
    """Type and version if all agree, else ``__multiple__``; newest date, united sources, summed totals."""
    agree = lambda c: F.when(F.count_distinct(c) == 1, F.min(c)).otherwise(F.lit("__multiple__")).alias(c)
    return rows.groupBy(*group).agg(agree("type"), agree("version"), F.max("build_date").alias("build_date"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))), ",").alias("sources"), F.sum("total").alias("total"))


def update_nested(old: DataFrame, new: DataFrame, key: str = "_id") -> DataFrame:
    """Documents that both have, updated level by level: a value of the new one wins, at any depth."""
    both = old.alias("o").join(new.alias("n"), key)
    return both.select(key, *[_updated(old.schema[c].dataType, F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c) for c in old.columns if c != key])


def _updated(kind: T.DataType, old: Column, new: Column) -> Column:
    if isinstance(kind, T.StructType):
        inner = F.struct(*[_updated(f.dataType, old.getField(f.name), new.getField(f.name)).alias(f.name) for f in kind.fields])
        return F.when(new.isNull(), old).otherwise(inner)
    return F.coalesce(new, old)


def documents_of(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Documents of maps id -> value, by id in the ids' own order; the id is text."""
    pairs = rows.select(F.explode(column).alias("_k", name)).sort("_k")
    return pairs.select(F.col("_k").cast("string").alias("_id"), name)


def merged_schema(sources: list[DataFrame]) -> T.StructType:
    """The root fields of all sources, each once."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [s.limit(0) for s in sources]).schema


def united_values(rows: DataFrame, group: str, column: str) -> DataFrame:
    """The different values of a column by group, sorted."""
    return rows.groupBy(group).agg(F.array_sort(F.collect_set(column)).alias(column))
