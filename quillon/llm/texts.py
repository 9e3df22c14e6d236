"""Whole texts as Arrow buffers, and the identity of a row.

A row is known by ``k1`` and ``k2``, 128 bits of its doc_id and text, so rows that share
a doc_id, or have none, stay apart unless their texts agree too; such rows are one row
that is there several times. ``did`` orders rows: the doc_id, or the largest long if null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.cluster import ship

NO_ID = (1 << 63) - 1


def _half(digest: Column, at: int) -> Column:
    return F.conv(F.substring(digest, at, 16), 16, -10).cast("long")


def row_key(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """k1 and k2 of a row; a null text is as an empty one."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("long").cast("string"), F.lit("")), F.lit("\0"), F.coalesce(text.cast("string"), F.lit(""))).cast("binary"))
    return _half(digest, 1), _half(digest, 17)


def with_keys(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of docs as _c0, _c1 and so on, which clash with nothing, and did, k1 and k2."""
    at = {c: i for i, c in reversed(list(enumerate(docs.columns)))}
    plain = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    own_id, own_text = F.col(f"_c{at[doc_id]}"), F.col(f"_c{at[text]}")
    k1, k2 = row_key(own_id, own_text)
    return plain.withColumns({"did": F.coalesce(own_id.cast("long"), F.lit(NO_ID)), "k1": k1, "k2": k2})


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, did, k1 and k2 of each row; other columns are left behind."""
    ship(docs.sparkSession)
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    k1, k2 = row_key(F.col("doc_id"), F.col("text"))
    return own.select("doc_id", "text", F.coalesce("doc_id", F.lit(NO_ID)).alias("did"), k1.alias("k1"), k2.alias("k2"))


def few(docs: DataFrame, rows: int, text: str | None = None) -> DataFrame:
    """About ``rows`` random rows, to choose splitters from; results do not depend on them.

    With ``text`` longer texts are likelier to be there, so that what one of them repeats is seen.
    """
    if text is None:
        n = docs.count()
        return docs if n <= rows else docs.sample(fraction=rows / n, seed=17)
    size = F.octet_length(F.coalesce(F.col(text).cast("string"), F.lit("")))
    n, mean = docs.agg(F.count("*"), F.avg(size)).first()
    return docs if n <= rows or not mean else docs.filter(F.rand(17) < size * (rows / n / mean))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column and each row's start and end among them; null is empty."""
    column = column.cast(pa.large_string()) if pa.types.is_string(column.type) else column.cast(pa.large_binary()) if pa.types.is_binary(column.type) else column
    n, (_, offsets, data) = len(column), column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    starts, ends = at[:-1], at[1:]
    if column.null_count:
        ends = np.where(column.is_null().to_numpy(zero_copy_only=False), starts, ends)
    return np.frombuffer(data or b"", np.uint8), starts, ends


def parts(batch: pa.RecordBatch, column: str, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``size`` bytes of a column, so that what is made of them stays small."""
    _, starts, ends = buffers(batch.column(column))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + size, "right")))
        yield batch.slice(at, stop - at)
        at = stop
