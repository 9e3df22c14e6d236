"""A build: sources merged into a collection, with the hooks that a project may replace."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.merge import map_ids, merge_sources
from quillon.plans.shaping import united

Hook = Callable[[DataFrame, list[str]], DataFrame]


def transparent(docs: DataFrame) -> DataFrame:
    """The mapper that leaves documents as they are."""
    return docs


@dataclass
class Build:
    """Which sources count, how each is chosen and mapped, and what is done after the merge."""

    roots: list[str] | None = None
    order: list[str] | None = None
    predicates: dict[str, str] | None = None
    mappers: dict[str, Callable[[DataFrame], DataFrame]] | None = None
    post_merge: Hook | None = None
    custom_metadata: Callable[[DataFrame, list[str]], dict] | None = None

    def documents(self, name: str, source: DataFrame) -> DataFrame:
        """What of a source is merged: its predicate's documents, through its mapper."""
        chosen = source.filter((self.predicates or {}).get(name, "true"))
        return (self.mappers or {}).get(name, transparent)(chosen)

    def run(self, sources: dict[str, DataFrame]) -> DataFrame:
        names = sorted(sources)
        out = merge_sources({n: self.documents(n, sources[n]) for n in names}, self.roots, self.order)
        return self.post_merge(out, names) if self.post_merge else out

    def metadata(self, built: DataFrame, names: list[str]) -> dict:
        """The number of documents, and what the project adds."""
        total = built.agg(F.count("*")).first()[0]
        return united({"stats": {"total": total}, "sources": names}, self.custom_metadata(built, names) if self.custom_metadata else {})


def id_mapper(mapping: DataFrame) -> Callable[[DataFrame], DataFrame]:
    return lambda docs: map_ids(docs, mapping)
