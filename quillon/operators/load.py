"""Strategies for storing documents that may repeat an _id, and for updating a collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes that a document may have.
MAX_DOCUMENT = 16 << 20


def duplicated_ids(docs: DataFrame, key: str = "_id") -> DataFrame:
    return docs.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def store_basic(docs: DataFrame, key: str = "_id", batch_size: int = 10_000, max_batches: int | None = None, order: list[str] | None = None) -> DataFrame:
    """The documents, of at most so many batches; a repeated id is an error when rows are read."""
    if max_batches is not None:
        docs = docs.orderBy(*(order or [key])).limit(batch_size * max_batches)
    n = F.count("*").over(Window.partitionBy(key))
    checked = F.when(n > 1, F.raise_error(F.concat(F.lit("duplicated id "), F.col(key).cast("string")))).otherwise(F.col(key))
    return docs.withColumn(key, checked)


def small_enough(docs: DataFrame, limit: int = MAX_DOCUMENT) -> DataFrame:
    """Documents whose JSON, as a measure of their size, is below the limit."""
    return docs.filter(F.octet_length(F.to_json(F.struct("*"))) < limit)


def keep_one(docs: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order given."""
    w = Window.partitionBy(*key).orderBy(*order)
    return docs.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def keep_first(docs: DataFrame, key: str, position: str) -> DataFrame:
    return keep_one(docs, [key], [F.col(position).asc()])


def keep_last(docs: DataFrame, key: str, position: str) -> DataFrame:
    return keep_one(docs, [key], [F.col(position).desc()])


def keep_last_of_first_batch(docs: DataFrame, key: str, position: str, batch_size: int) -> DataFrame:
    """Within a batch the last document of an id wins, across batches the first batch does."""
    return keep_one(docs, [key], [F.floor(F.col(position) / batch_size).asc(), F.col(position).desc()])


def merge_root_lists(docs: DataFrame, key: str, position: str, columns: list[str]) -> DataFrame:
    """One row an id; each root column is the list of its values in order."""
    aggs = [F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(F.col(position).alias("o"), F.col(c).alias("v"))))), lambda x: x.v).alias(c) for c in columns]
    return docs.groupBy(key).agg(*aggs)


def upsert(old: DataFrame, new: DataFrame, key: str = "_id") -> DataFrame:
    """Whole documents: the new one where there is one."""
    pairs = old.withColumn("_o", F.lit(True)).alias("o").join(new.withColumn("_n", F.lit(True)).alias("n"), key, "full_outer")
    cols = [F.when(F.col("n._n"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in old.columns if c != key]
    return pairs.select(key, *cols)


def update_roots(old: DataFrame, new: DataFrame, key: str = "_id", insert: bool = True, present: str | None = None) -> DataFrame:
    """Root columns that the new document has replace the old ones; ``insert`` adds unknown ids.

    ``present`` names an array column of ``new`` that lists the columns a document has;
    without it a null means that the column is absent.
    """
    pairs = old.withColumn("_o", F.lit(True)).alias("o").join(new.alias("n"), key, "full_outer" if insert else "left")
    cols = []
    for c in old.columns:
        if c == key:
            continue
        if c not in new.columns:
            cols.append(F.col(f"o.{c}").alias(c))
        elif present:
            cols.append(F.when(F.array_contains(f"n.{present}", c), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        else:
            cols.append(F.coalesce(f"n.{c}", f"o.{c}").alias(c))
    return pairs.select(key, *cols)


def remove_ids(docs: DataFrame, ids: DataFrame, key: str = "_id") -> DataFrame:
    return docs.join(ids.select(key), key, "left_anti")


def only_ids(docs: DataFrame, ids: DataFrame, key: str = "_id") -> DataFrame:
    return docs.join(ids.select(key), key, "left_semi")


def exists_flags(ids: DataFrame, docs: DataFrame, key: str = "_id") -> DataFrame:
    """The asked ids with whether the collection has them."""
    known = docs.select(F.col(key).alias("_k")).distinct()
    return ids.join(known, ids[key] == known["_k"], "left").select(*ids.columns, F.col("_k").isNotNull().alias("exists"))


def create_only(old: DataFrame, new: DataFrame, key: str = "_id") -> DataFrame:
    """New documents whose id is not taken; the others are conflicts."""
    return new.join(old.select(key), key, "left_anti")


def clean_field(docs: DataFrame, field: str, key: str = "_id") -> DataFrame:
    """Without the field, and without documents that had nothing else."""
    rest = [c for c in docs.columns if c not in (field, key)]
    some = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(True)) for c in rest])
    return docs.filter(some.isNotNull() | F.col(field).isNull()).drop(field)


def apply_diff(old: DataFrame, add: DataFrame, update: DataFrame, delete: DataFrame, key: str = "_id") -> DataFrame:
    """Added documents come, updated root columns are set, deleted ids go."""
    kept = remove_ids(old, delete, key)
    return update_roots(kept, update, key, insert=False).unionByName(create_only(old, add, key))


def hot_over_cold(cold: DataFrame, hot: DataFrame, key: str = "_id") -> DataFrame:
    """Two collections layered: root columns of the hot one come first."""
    return update_roots(cold, hot, key, insert=True)


def store_none(docs: DataFrame) -> int:
    """Reads everything and keeps nothing; 0 is stored."""
    docs.write.format("noop").mode("overwrite").save()
    return 0


def store(docs: DataFrame, on_duplicates: str | None, key: str = "_id", position: str | None = None) -> DataFrame:
    """The documents by the strategy for ids that come again: an error (also None), ``ignore`` or ``merge``."""
    if on_duplicates in (None, "error"):
        return store_basic(docs, key)
    if position is None:
        raise ValueError(f"{on_duplicates} needs the documents' order")
    if on_duplicates == "ignore":
        return keep_first(docs, key, position)
    if on_duplicates == "merge":
        return merge_root_lists(docs, key, position, [c for c in docs.columns if c not in (key, position)])
    raise ValueError(f"no strategy {on_duplicates}")
