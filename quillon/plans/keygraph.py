"""Conversion of identifiers along the edges of a graph of lookup tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class Edge:
    """A hop from one kind of id to another: a lookup table, or a regular expression."""

    source: str
    target: str
    table: DataFrame | None = None
    lookup: str = ""
    field: str = ""
    weight: float = 1.0
    ignore_case: bool = False
    pattern: str | None = None
    replacement: str = ""

    def follow(self, pairs: DataFrame) -> DataFrame:
        """(orig, cur) one hop on; an id may have several targets."""
        if self.pattern is not None:
            return pairs.filter(F.col("cur").rlike(self.pattern)).withColumn("cur", F.regexp_replace("cur", self.pattern, self.replacement))
        kind = dict(self.table.dtypes)
        value = F.col(self.field)
        targets = self.table.select(F.col(self.lookup).cast("string").alias("_from"), (F.explode(value) if kind[self.field].startswith("array") else value).alias("_to")).filter("_from IS NOT NULL AND _to IS NOT NULL")
        fold = F.lower if self.ignore_case else (lambda c: c)
        targets = targets.select(fold(F.col("_from")).alias("_from"), F.col("_to").cast("string").alias("_to")).distinct()
        return pairs.join(targets, fold(F.col("cur")) == F.col("_from")).select("orig", F.col("_to").alias("cur")).distinct()


class IdPairs:
    """Which ids stand for which: pairs (orig, cur), each once; a null or empty side is left out."""

    def __init__(self, pairs: DataFrame, ignore_case: bool = False):
        orig = F.lower("orig") if ignore_case else F.col("orig")
        some = lambda c: F.col(c).isNotNull() & (F.col(c).cast("string") != "")
        self.pairs, self.ignore_case = pairs.filter(some("orig") & some("cur")).select(orig.alias("orig"), "cur").distinct(), ignore_case

    def add(self, more: DataFrame) -> IdPairs:
        return IdPairs(self.pairs.unionByName(more.select("orig", "cur")), self.ignore_case)

    def left(self, wanted: DataFrame) -> DataFrame:
        """What the original ids in ``wanted`` (column ``orig``) stand for."""
        asked = wanted.select(F.lower("orig").alias("orig") if self.ignore_case else F.col("orig"))
        return self.pairs.join(asked, "orig", "left_semi").select("cur").distinct()

    def right(self, wanted: DataFrame) -> DataFrame:
        """The original ids of those in ``wanted`` (column ``cur``)."""
        return self.pairs.join(wanted.select("cur"), "cur", "left_semi").select("orig").distinct()


def simple_paths(edges: list[Edge], source: str, target: str) -> list[list[Edge]]:
    """All paths without a repeated kind, by weight; a kind to itself is an edge to itself."""
    if source == target:
        return [[e] for e in edges if e.source == e.target == source]
    out: list[list[Edge]] = []

    def walk(at: str, path: list[Edge], seen: set[str]) -> None:
        if at == target:
            out.append(path)
            return
        for e in edges:
            if e.source == at and e.target not in seen:
                walk(e.target, [*path, e], {*seen, e.target})

    walk(source, [], {source})
    return sorted(out, key=lambda p: (sum(e.weight for e in p), len(p)))


def travel(ids: DataFrame, edges: list[Edge], source: str, target: str) -> DataFrame:
    """(orig, cur) for the ids (column ``orig``) that some path converts.

    Of the paths, by weight, that convert an id the first one counts. All paths are followed in one
    plan, of which Spark shares the hops that paths begin with; an id's results meet by id.
    """
    asked = ids.select(F.col("orig").cast("string").alias("orig")).distinct()
    paths = simple_paths(edges, source, target)
    if not paths:
        return asked.select("orig", F.col("orig").alias("cur")).limit(0)
    reached = [_along(asked, path) for path in paths]
    if len(reached) == 1:
        return reached[0]
    ranked = reduce(lambda a, b: a.unionByName(b), [pairs.withColumn("_path", F.lit(i)) for i, pairs in enumerate(reached)])
    first = F.min("_path").over(Window.partitionBy("orig"))
    return ranked.withColumn("_first", first).filter("_path = _first").select("orig", "cur")


def _along(asked: DataFrame, path: list[Edge]) -> DataFrame:
    pairs = asked.withColumn("cur", F.col("orig"))
    for edge in path:
        pairs = edge.follow(pairs)
    return pairs


def convert(docs: DataFrame, edges: list[Edge], inputs: list[tuple[str, str]], outputs: list[str], key: str = "_id", skip_failures: bool = False, skip_regex: str | None = None) -> DataFrame:
    """Documents with the id converted; ``inputs`` are (kind, field), in order of priority.

    Outputs are tried in their order, inputs within each; a document is taken by the first
    pair that converts it, once for every id found. What no pair converts is dropped, or
    kept with ``skip_failures``. Ids that match ``skip_regex`` pass as they are.
    """
    columns = docs.columns
    done, left = None, docs
    if skip_regex:
        done = left.filter(F.col(key).rlike(skip_regex)).select(*columns)
        left = left.filter(~F.coalesce(F.col(key).rlike(skip_regex), F.lit(False)))
    for output in outputs:
        for kind, field in inputs:
            asked = left.select(F.col(field).cast("string").alias("orig")).filter("orig IS NOT NULL")
            pairs = asked.distinct().withColumn("cur", F.col("orig")) if kind == output and not any(e.source == e.target == kind for e in edges) else travel(asked, edges, kind, output)
            hit = left.join(pairs, F.col(field).cast("string") == pairs["orig"])
            out = hit.withColumn(key, F.col("cur")).select(*columns)
            done = out if done is None else done.unionByName(out)
            left = left.join(pairs.select("orig").distinct(), F.col(field).cast("string") == F.col("orig"), "left_anti")
    if skip_failures:
        done = done.unionByName(left.select(*columns))
    return done


def copy_id(docs: DataFrame, field: str, key: str = "_id") -> DataFrame:
    """The id from a field, where the document has it."""
    return docs.withColumn(key, F.coalesce(F.col(field).cast("string"), F.col(key).cast("string")))


def by_priority(kind: Column, priorities: list[str]) -> Column:
    """A sort key: the place in the list, behind all of it where not listed."""
    at = F.array_position(F.array(*[F.lit(p) for p in priorities]), kind)
    return F.when(at == 0, F.lit(len(priorities) + 1)).otherwise(at)
