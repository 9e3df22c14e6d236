"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from quillon.cluster import shared_folder, small_batches


class Table:
    """A DataFrame written as Parquet, so that lost executors recompute nothing before it."""

    def __init__(self, df: DataFrame, name: str):
        self.spark, self.schema = df.sparkSession, df.schema
        self.path = f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex}"
        with small_batches(self.spark):
            df.write.parquet(self.path)
        tidy(self.spark)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def tidy(spark: SparkSession) -> None:
    """Let Spark remove shuffle files whose plans are no longer referenced.

    Its cleaner acts on what the collector of the driver has found dead, which without a hint
    comes too late for the disk of a run of many steps. It takes some hundredths of a second.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
