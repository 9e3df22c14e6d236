"""Terms facets, counts and keep-the-newest selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def terms_facet(docs: DataFrame, field: str, size: int = 10, is_array: bool = False) -> DataFrame:
    """term, count, other and total of the ``size`` most frequent terms; ties by term.

    An element counts once in a document. ``total`` sums the shown counts, ``other`` the rest;
    counts are exact, so nothing is ``missing``.
    """
    terms = docs.select((F.explode(F.array_distinct(field)) if is_array else F.col(field)).alias("term")).filter("term IS NOT NULL")
    counts = terms.groupBy("term").agg(F.count("*").alias("count"))
    shown = counts.orderBy(F.desc("count"), "term").limit(size)
    total, whole = shown.agg(F.sum("count")).scalar(), counts.agg(F.sum("count")).scalar()
    return shown.select("term", "count", (whole - total).alias("other"), total.alias("total"), F.lit(0).cast("bigint").alias("missing"))


def nested_facet(docs: DataFrame, outer: str, inner: str, size: int = 10) -> DataFrame:
    """The most frequent inner terms of each of the most frequent outer terms."""
    pairs = docs.filter(F.col(outer).isNotNull()).groupBy(outer, inner).agg(F.count("*").alias("inner_count"))
    tops = pairs.groupBy(outer).agg(F.sum("inner_count").alias("outer_count")).orderBy(F.desc("outer_count"), outer).limit(size)
    ranked = pairs.filter(F.col(inner).isNotNull()).join(F.broadcast(tops), outer)  # ``size`` rows
    w = Window.partitionBy(outer).orderBy(F.desc("inner_count"), inner)
    return ranked.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= size)


def field_counts(docs: DataFrame, fields: list[str]) -> DataFrame:
    """(field, n): documents that have the field."""
    counted = docs.agg(*[F.count(F.col(f)).alias(f) for f in fields])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("n")) for f in fields])).alias("x")).select("x.field", "x.n")


def group_count(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def newest(df: DataFrame, group: list[str], order: list[Column], keep: int) -> DataFrame:
    """Adds whether a row is among the ``keep`` first of its group in the order given."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("kept", F.row_number().over(w) <= keep)


def common_fields(docs: DataFrame, fields: list[str], least: int = 1) -> DataFrame:
    """Which fields documents have together, largest combinations first, with their number of documents."""
    held = F.array_compact(F.array(*[F.when(F.col(f).isNotNull(), F.lit(f)) for f in fields]))
    combos = docs.select(held.alias("held")).groupBy(F.array_join("held", ",").alias("fields"), F.size("held").cast("bigint").alias("n_fields")).agg(F.count("*").alias("n_docs"))
    return combos.filter(F.col("n_fields") >= least)
