"""Incremental ingest: micro-batches that update a collection, and change feeds."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.cluster import shared_folder
from quillon.operators.load import keep_last, update_roots


def ingest(spark: SparkSession, folder: str, schema, apply: Callable[[DataFrame, int], None], name: str = "ingest", files_per_batch: int = 100) -> None:
    """Every file of a folder that has not been seen, handed over in micro-batches; ends when all are done.

    The checkpoint lies in the shared folder, so a lost executor or driver repeats one batch.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    checkpoint = f"{shared_folder(spark)}/streams/{name}-{uuid.uuid4().hex[:8]}"
    stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


class Upserter:
    """Keeps a collection up to date, batch by batch, in buckets by key; a batch rewrites the buckets it touches.

    A bucket's newest version is known by its path, so a batch that comes again after a failure
    starts from what was there before it, and counts once.
    """

    def __init__(self, spark: SparkSession, key: str, order: str, folder: str | None = None, buckets: int = 64):
        self.spark, self.key, self.order, self.buckets = spark, key, order, buckets
        self.folder = folder or f"{shared_folder(spark)}/upserts-{uuid.uuid4().hex[:8]}"
        self.paths: dict[int, str] = {}
        self.before: dict[int, dict[int, str]] = {}
        self.schema = None

    def __call__(self, batch: DataFrame, number: int) -> None:
        held = dict(self.before.setdefault(number, self.paths))
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        new = keep_last(batch, self.key, self.order)
        touched = sorted(r["_bucket"] for r in new.select(bucket.alias("_bucket")).distinct().collect())  # ``buckets`` rows
        old = [held[b] for b in touched if b in held]
        out = update_roots(self.spark.read.schema(self.schema).parquet(*old), new, self.key) if old else new
        self.schema = self.schema or out.schema
        path = f"{self.folder}/v{number}"
        out.withColumn("_bucket", bucket).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(path)
        self.paths = held | {b: f"{path}/_bucket={b}" for b in touched}

    def read(self) -> DataFrame:
        """The collection as it is after the last batch."""
        return self.spark.read.schema(self.schema).parquet(*[self.paths[b] for b in sorted(self.paths)])


def pending(jobs: DataFrame, state: str) -> DataFrame:
    """Jobs that ask for a state to be worked on."""
    return jobs.filter(F.array_contains("pending", state))


def windowed_counts(events: DataFrame, ts: str, width: str, late: str, *keys: str) -> DataFrame:
    """Counts by event-time window with a watermark, for a stream or a table. An extension."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")
