"""Row-to-document steps: projection, grouping by key, adjacent groups, line expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.cluster import checkpointed


def project(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns)


def group_values(df: DataFrame, key: list[str], value: Column, order: Column) -> DataFrame:
    """One row a key with its values in the given order; the counterpart of key -> scalar or list."""
    pairs = F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v"))))
    return df.groupBy(*key).agg(F.transform(pairs, lambda p: p.v).alias("values"))


def group_adjacent(df: DataFrame, key: str, order: str, within: list[str] | None = None) -> DataFrame:
    """Numbers runs of equal neighbours (``island``): a key that comes back starts a new one.

    ``within`` names columns that part the input, such as the file; runs never cross them.
    """
    w = Window.partitionBy(*(within or [])).orderBy(order)
    change = (~F.col(key).eqNullSafe(F.lag(key).over(w)) | (F.row_number().over(w) == 1)).cast("bigint")
    return df.withColumn("_change", change).withColumn("island", F.sum("_change").over(w)).drop("_change")


def expand_lines(df: DataFrame, columns: list[str], sep: str, strip: bool = False) -> DataFrame:
    """One row for each combination of the pieces of the columns."""
    for c in columns:
        piece = F.explode(F.split(F.col(c), "\\Q" + sep + "\\E"))
        df = df.withColumn(c, piece)
        if strip:
            df = df.withColumn(c, F.trim(c))
    return df


def concatenated(parts: list[DataFrame]) -> DataFrame:
    """Same-shaped inputs, one after the other."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def chunked(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """Adds ``chunk``, numbering runs of n rows in the order given.

    Ranges are sorted where they lie and kept by a checkpoint, so a row's number is its place
    in its range plus the sizes of the ranges before; only those sizes meet in one task.
    """
    at = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("_at", F.monotonically_increasing_id())
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = at.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each range
    numbered = at.withColumn("_part", part).join(F.broadcast(before), "_part")
    return numbered.withColumn("chunk", F.floor((F.col("_before") + place) / n)).drop("_part", "_at", "_before")
