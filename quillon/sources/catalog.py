"""Versioned collections behind views, and names of sources."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quillon.cluster import shared_folder


class Collection:
    """A collection kept as versions in a folder; a temporary view shows the current one."""

    def __init__(self, spark: SparkSession, name: str, folder: str | None = None):
        self.spark, self.name = spark, name
        self.folder = folder or f"{shared_folder(spark)}/collections/{name}-{uuid.uuid4().hex[:8]}"
        self.versions: list[str] = []

    @staticmethod
    def linked(spark: SparkSession, name: str, source: DataFrame) -> DataFrame:
        """A collection that is a source itself, by reference; nothing is copied."""
        source.createOrReplaceTempView(name)
        return spark.table(name)

    def write(self, df: DataFrame, version: str | None = None) -> DataFrame:
        """A new version, then the view is switched; readers never see half of one."""
        path = f"{self.folder}/{version or len(self.versions)}"
        df.write.parquet(path)
        self.versions.append(path)
        return self.read()

    def read(self, version: int = -1) -> DataFrame:
        df = self.spark.read.parquet(self.versions[version])
        df.createOrReplaceTempView(self.name)
        return df

    def rename(self, name: str) -> None:
        self.spark.catalog.dropTempView(self.name)
        self.name = name
        self.read()

    def checked_copy(self, other: Collection) -> DataFrame:
        """A copy of another collection's current version; an error if numbers differ."""
        seen = Observation()
        copy = self.write(other.read().observe(seen, F.count(F.lit(1)).alias("n")))
        if copy.count() != seen.get["n"]:
            raise ValueError(f"{self.name} has another number of documents than {other.name}")
        return copy


def full_names(subs: DataFrame, main: str = "main", sub: str = "sub"):
    """``main.sub``, or the main name alone where they agree."""
    return subs.withColumn("fullname", F.when(F.col(main) == F.col(sub), F.col(main)).otherwise(F.concat_ws(".", main, sub)))
