"""Versions of a collection: chains of releases, cold and hot builds, notes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def update_path(spark, releases: list[tuple[str, str | None]], current: str | None, wanted: str) -> list[str]:
    """Releases to apply, oldest first, to get from ``current`` to ``wanted``.

    A release is (target, required version): full if nothing is required. An increment from
    a version is preferred to a full release; among several the newest required one.
    """
    if wanted == current:
        return []
    options = sorted({(t, r) for t, r in releases if t == wanted}, key=lambda x: (x[1] is not None, x[1] or ""), reverse=True)
    for target, required in options:
        if required is None:
            return [target]
        if required < target:  # versions only ever grow, so chains end
            try:
                return [*update_path(spark, releases, current, required), f"{required}.{target}"]
            except LookupError:
                continue
    raise LookupError(f"no path to {wanted}")


def reachable(increments: DataFrame, start: str, steps: int) -> DataFrame:
    """(version, hops): versions that increments (required, target) lead to from the start."""
    frontier = increments.sparkSession.createDataFrame([(start, 0)], "version string, hops bigint")
    out = frontier
    for _ in range(steps):
        frontier = frontier.join(increments, F.col("version") == F.col("required")).select(F.col("target").alias("version"), (F.col("hops") + 1).alias("hops")).distinct()
        out = out.unionByName(frontier)
    return out.groupBy("version").agg(F.min("hops").alias("hops"))


def best_version(versions: DataFrame, group: list[str]) -> DataFrame:
    """The newest version of each group; those with a dot come first."""
    order = F.struct(F.contains("version", F.lit(".")).alias("d"), F.col("version"))
    return versions.groupBy(*group).agg(F.max_by("version", order).alias("version"))


def keep_cold(changes: DataFrame, cold: DataFrame, key: str = "_id", columns: list[str] | None = None) -> DataFrame:
    """Changes of a hot build corrected for the cold one below it.

    ``changes``: (key, op, removed): a removed column that the cold document has stays; a
    deleted document that the cold build has becomes an update.
    """
    names = columns or [c for c in cold.columns if c != key]
    held = cold.select(F.col(key), F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in names])).alias("cold"))
    met = changes.join(held, key, "left")
    some = F.coalesce("cold", F.array().cast("array<string>"))
    return met.select(key, F.when((F.col("op") == "delete") & F.col("cold").isNotNull(), "update").otherwise(F.col("op")).alias("op"), F.array_except("removed", some).alias("removed"))
