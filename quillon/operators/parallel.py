"""User functions over documents, and the folding of their results."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.cluster import ship


def map_documents(docs: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str) -> DataFrame:
    """A function over batches of documents, in parallel; empty results are passed over."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = f(batch)
            if out is not None and len(out):
                yield out

    return docs.mapInPandas(run, schema)


def fold_sum(docs: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame | None], column: str) -> DataFrame:
    """The sum of a function's numbers over all batches."""
    return map_documents(docs, f, f"{column} bigint").agg(F.sum(column).alias(column))


def fold_append(docs: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str) -> DataFrame:
    """A function's rows of all batches."""
    return map_documents(docs, f, schema)


def parse_arguments(spark: SparkSession, arguments: list, parser: Callable[[object], Iterator[dict]], schema: str) -> DataFrame:
    """Documents from a user's parser, one task for each argument."""
    ship(spark)
    asked = spark.createDataFrame([(i, str(a)) for i, a in enumerate(arguments)], "n int, argument string").repartition(max(1, len(arguments)), "n")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in batch["argument"]:
                rows = list(parser(a))
                if rows:
                    yield pd.DataFrame(rows)

    return asked.mapInPandas(run, schema)


def checked_parser_output(docs: DataFrame, key: str = "_id") -> DataFrame:
    """(problem, n): documents without an id."""
    return docs.select(F.when(F.col(key).isNull(), "no id").alias("problem")).filter("problem IS NOT NULL").groupBy("problem").agg(F.count("*").alias("n"))


def listed_ids(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The ids of text files or of all files of folders, one a line; empty lines are none."""
    return spark.read.text(paths).select(F.trim("value").alias("_id")).filter("_id <> ''").distinct()


def over_ids(docs: DataFrame, ids: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str, key: str = "_id") -> DataFrame:
    """A function over the documents of listed ids, in parallel; ids are compared as text."""
    asked = ids.select(F.col("_id").cast("string").alias("_asked"))
    return map_documents(docs.join(asked, F.col(key).cast("string") == F.col("_asked"), "left_semi"), f, schema)


def loaded_in_parts(spark: SparkSession, arguments: list, load: Callable[[object], DataFrame]) -> DataFrame:
    """The documents that a loader gives for each argument, as one plan whose parts run side by side."""
    return reduce(lambda a, b: a.unionByName(b), [load(a) for a in arguments])


def run_jobs(spark: SparkSession, jobs: dict[str, Callable[[], int]], at_once: int) -> DataFrame:
    """(job, n): driver-side jobs run side by side, so many at once; Spark's scheduler shares the executors among them."""
    with ThreadPoolExecutor(max_workers=at_once) as pool:
        done = {name: pool.submit(inheritable_thread_target(spark)(job)) for name, job in jobs.items()}
        rows = [(name, f.result()) for name, f in done.items()]
    return spark.createDataFrame(rows, "job string, n bigint")
