"""Connected components of a graph that fits on no single machine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.storage import Table


def apart(node: Column | str) -> Column:
    """A key derived from a column: joining on it gives both sides an exchange, which lets Spark split hot keys."""
    return F.struct(F.col(node) if isinstance(node, str) else node)


def _rewire(edges: DataFrame, larger: bool) -> DataFrame:
    """Links the neighbours of each node to the smallest node among itself and them.

    ``larger``: neighbours above the node (large star); else those below, and itself.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if larger:
        sides = both
    else:
        sides = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = sides.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    keyed = least.select(apart("a").alias("k"), "m")
    met = sides.withColumn("k", apart("a")).join(keyed, "k")
    if larger:
        out = met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame, name: str = "edges") -> DataFrame:
    """node and component (its smallest node), for every node that has an edge (a, b), of one type that has an order.

    Alternates large-star and small-star rewiring until every edge leads to the smallest
    node; each round is written out, so a lost executor repeats one round at most.
    Loops and repeated edges are allowed; empty edges give an empty result.
    """
    table = Table(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    seen = None
    while True:
        after = Table(_rewire(_rewire(table.read(), True), False), name)
        table.drop()
        table = after
        now = table.read().agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            stars = table.read()
            return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        seen = now
