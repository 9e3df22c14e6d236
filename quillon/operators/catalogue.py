"""Listings of sources, builds and releases: what a hub keeps about its collections."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_age(builds: DataFrame, date: str, days: int, today: Column) -> DataFrame:
    """Builds that are older than so many days."""
    return builds.filter(F.datediff(today, F.col(date)) > days)


def last_status(jobs: DataFrame, group: str, order: str, status: str) -> DataFrame:
    """(group, status of its last job, number of jobs), in one aggregation without a list of jobs."""
    return jobs.groupBy(group).agg(F.max_by(status, order).alias("status"), F.count("*").alias("jobs"))


def source_totals(subs: DataFrame, sources: DataFrame, on: str, group: str, count: str) -> DataFrame:
    """Counts of sub-sources summed for their sources."""
    return subs.join(sources, on).groupBy(group).agg(F.sum(count).alias("n"))


def newest_first(names: DataFrame, order: Column, limit: int | None = None) -> DataFrame:
    out = names.orderBy(order)
    return out if limit is None else out.limit(limit)


def places(names: DataFrame, order: Column, name: str = "place") -> DataFrame:
    """Numbers from 1 in an order; for listings of names, which fit one task."""
    return names.withColumn(name, F.row_number().over(Window.orderBy(order)).cast("bigint"))


def previous(names: DataFrame, group: str, name: str) -> DataFrame:
    """Adds the name before each one in its group, by order of name."""
    return names.withColumn("previous", F.lag(name).over(Window.partitionBy(group).orderBy(name)))


def temporary(names: DataFrame, name: str, pattern: str, spare: str) -> DataFrame:
    """Names that fit a pattern at their start and do not hold the word to spare."""
    return names.filter(F.col(name).rlike("^(?:" + pattern + ")") & ~F.contains(F.col(name), F.lit(spare)))


def without_temporary(names: DataFrame, name: str, pattern: str, spare: str) -> DataFrame:
    return names.join(temporary(names, name, pattern, spare).select(name), name, "left_anti")


def matching_sources(names: DataFrame, name: str, wanted: list[str]) -> DataFrame:
    """Names that one of the expressions fits whole; an expression that fits none is an error when rows are read."""
    fits = [F.col(name).rlike("^(?:" + w + ")$") for w in wanted]
    found = names.filter(reduce(lambda a, b: a | b, fits))
    for w in wanted:
        re.compile(w)
    return found


def exploded_sources(configs: DataFrame, sources: Column) -> DataFrame:
    """A row for each source of a build's configuration."""
    return configs.withColumn("source", F.explode(sources))


def not_ready(sources: DataFrame, uploads: DataFrame, on: Column) -> DataFrame:
    """Sources without a successful upload; a build needs none of them."""
    return sources.join(uploads, on, "left_anti")


def with_last(sources: DataFrame, uploads: DataFrame, on: Column, keys: list[str], last: str, name: str) -> DataFrame:
    """Sources with their last upload, null without one."""
    return sources.join(uploads, on, "left").groupBy(*keys).agg(F.max(last).alias(name))


def to_fetch(remote: DataFrame, changed: str, since: Column, force: bool = False) -> DataFrame:
    """Remote files that are newer than ours, or all."""
    return remote if force else remote.filter(F.col(changed) > since)


def versions(releases: DataFrame, version: Column) -> DataFrame:
    return releases.select(version.alias("version")).distinct().orderBy("version")


def remote_is_better(remote: DataFrame, local: DataFrame, name: str = "source") -> DataFrame:
    """(name, better): a version that is greater than ours, or that we lack."""
    r, ours = remote.select(name, F.col("version").alias("_new")), local.select(name, F.col("version").alias("_old"))
    return r.join(ours, name, "left").select(name, (F.col("_old").isNull() | (F.col("_new") > F.col("_old"))).alias("better"))


def source_registry(parts: dict[str, DataFrame], key: str = "source") -> DataFrame:
    """Each source and in which of the named registries it is."""
    flags = [df.select(key).distinct().withColumn(n, F.lit(True)) for n, df in parts.items()]
    return reduce(lambda a, b: a.join(b, key, "full_outer"), flags).fillna(False)


def totals(parts: dict[str, DataFrame]) -> DataFrame:
    """(name, total): live counts of named collections."""
    return reduce(lambda a, b: a.unionByName(b), [df.agg(F.count("*").alias("total")).select(F.lit(n).alias("name"), "total") for n, df in parts.items()])


def source_versions(subs: DataFrame, source: str, version: str) -> DataFrame:
    """(source, version, n): the version if all sub-sources agree on one."""
    return subs.groupBy(F.col(source).alias("source")).agg(F.when(F.count_distinct(version) == 1, F.min(version)).alias("version"), F.count("*").alias("n"))


def idle(docs: DataFrame, statuses: str, busy: list[str]) -> DataFrame:
    """Documents none of whose jobs is in one of the states; a missing list counts as empty."""
    return docs.filter(~F.coalesce(F.exists(statuses, lambda s: s.isin(*busy)), F.lit(False)))


#: What may follow a build by itself, each for some types of releases.
AUTOMATIC = ("autobuild", "autopublish", "autorelease")


def automatic_steps(config: dict) -> list[tuple[str, str]]:
    """(step, type of release) that a build's configuration asks for: true means both types."""
    out = []
    for step in AUTOMATIC:
        wanted = config.get(step)
        types = wanted.get("type", True) if isinstance(wanted, dict) else wanted
        names = ("full", "incremental") if types is True else (types,) if isinstance(types, str) else tuple(types or ())
        out += [(step, name) for name in sorted(set(names))]
    return out


def public_metadata(rows: DataFrame) -> DataFrame:
    """(name, value) by name, without private names."""
    return rows.filter(~F.col("name").startswith("_")).orderBy("name")
