"""Differences between two versions of a collection, patches, and their application."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.cluster import ship
from quillon.functions import jsonpatch


def compared(old: DataFrame, new: DataFrame, key: str = "_id", exclude: tuple[str, ...] = ("_timestamp",)) -> DataFrame:
    """key, op (add, delete, update or same) and the changed root columns, from one full join.

    Columns are compared with null as a value of its own.
    """
    columns = [c for c in new.columns if c in old.columns and c != key and c not in exclude]
    o, n = old.withColumn("_in", F.lit(True)).alias("o"), new.withColumn("_in", F.lit(True)).alias("n")
    both = o.join(n, key, "full_outer")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")), F.lit(c)) for c in columns]))
    op = F.when(F.col("o._in").isNull(), "add").when(F.col("n._in").isNull(), "delete").when(F.size(changed) > 0, "update").otherwise("same")
    return both.select(key, op.alias("op"), F.when(F.col("o._in") & F.col("n._in"), changed).otherwise(F.array().cast("array<string>")).alias("changed"))


def attribute_changes(old: DataFrame, new: DataFrame, key: str = "_id", exclude: tuple[str, ...] = ("_timestamp",)) -> DataFrame:
    """(key, attribute, change) of the documents in both: null in a version means it lacks the attribute."""
    columns = [c for c in new.columns if c in old.columns and c != key and c not in exclude]
    both = old.alias("o").join(new.alias("n"), key)
    change = lambda c: F.when(F.col(f"o.{c}").isNull() & F.col(f"n.{c}").isNotNull(), "add").when(F.col(f"o.{c}").isNotNull() & F.col(f"n.{c}").isNull(), "delete").when(F.col(f"o.{c}") != F.col(f"n.{c}"), "update")
    found = F.array(*[F.struct(F.lit(c).alias("attribute"), change(c).alias("change")) for c in columns])
    return both.select(key, F.explode(F.filter(found, lambda x: x.change.isNotNull())).alias("x")).select(key, "x.attribute", "x.change")


def same_members(a: Column, b: Column) -> Column:
    """Whether two lists have the same members; order and number do not matter."""
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def unwrapped(hits: DataFrame) -> DataFrame:
    """Exported hits {_id, _source} as documents."""
    return hits.select("_id", "_source.*")


def report(changes: DataFrame, key: str = "_id", examples: int = 10) -> DataFrame:
    """Number and first ids of the changes, by operation and path."""
    counts = changes.groupBy("op", "path").agg(F.count("*").alias("n"))
    # Spark keeps ``examples`` rows of each group and partition before anything is shuffled
    first = F.row_number().over(Window.partitionBy("op", "path").orderBy(key))
    few = changes.select("op", "path", key).withColumn("_at", first).filter(F.col("_at") <= examples)
    shown = few.groupBy("op", "path").agg(F.array_sort(F.collect_list(key)).alias("ids"))
    return counts.join(shown, ["op", "path"])


def _pairwise(f):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([json.dumps(f(json.loads(x), json.loads(y)), ensure_ascii=False, separators=(",", ":")) for x, y in zip(a, b, strict=True)])

    return run


def json_patches(old: DataFrame, new: DataFrame, key: str = "_id", document: str = "doc", whole_lists: bool = True) -> DataFrame:
    """(key, patch) of the documents that differ; the plain comparison stays in the JVM.

    Lists that differ are replaced whole, or else patched item by item.
    """
    ship(old.sparkSession)
    both = old.select(key, F.col(document).alias("a")).join(new.select(key, F.col(document).alias("b")), key).filter("a <> b")
    make = jsonpatch.make if whole_lists else jsonpatch.make_with_lists
    return both.select(key, F.pandas_udf(_pairwise(make), "string")("a", "b").alias("patch"))


def root_patches(old: DataFrame, new: DataFrame, key: str = "_id") -> DataFrame:
    """(key, patch) for documents of scalar root columns, with built-in functions alone: null is a value."""
    columns = [c for c in old.columns if c in new.columns and c != key]
    both = old.alias("o").join(new.alias("n"), key)
    op = lambda c: F.to_json(F.struct(F.lit("replace").alias("op"), F.lit(f"/{c}").alias("path"), F.col(f"n.{c}").alias("value")), {"ignoreNullFields": "false"})
    ops = F.array_compact(F.array(*[F.when(~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")), op(c)) for c in columns]))
    return both.select(key, ops.alias("_ops")).filter(F.size("_ops") > 0).select(key, F.concat(F.lit("["), F.array_join("_ops", ","), F.lit("]")).alias("patch"))


def _apply_one(document, patch):
    try:
        return jsonpatch.apply(document, patch)
    except jsonpatch.Conflict:
        return None


def patched(docs: DataFrame, patches: DataFrame, key: str = "_id", document: str = "doc") -> DataFrame:
    """(key, doc, status): patched, unchanged, or skipped where a patch does not fit."""
    ship(docs.sparkSession)
    both = docs.join(patches, key, "left").select(key, document, "patch")
    out = F.when(F.col("patch").isNotNull(), F.pandas_udf(_pairwise(_apply_one), "string")(F.col(document), F.coalesce("patch", F.lit("[]"))))
    done = both.withColumn("_new", out)
    status = F.when(F.col("patch").isNull() | (F.col("_new") == F.col(document)), "unchanged").when(F.col("_new") == "null", "skipped").otherwise("patched")
    return done.select(key, F.when(status == "patched", F.col("_new")).otherwise(F.col(document)).alias(document), status.alias("status"))


def stats_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(name, old, new, change) of two tables (name, count): added, deleted, updated, same."""
    both = old.select("name", F.col("count").alias("old")).join(new.select("name", F.col("count").alias("new")), "name", "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "updated").otherwise("same")
    return both.select("name", "old", "new", change.alias("change"))
