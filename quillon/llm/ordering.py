"""Groups of equal keys found by sampled splitters, local sorts and a look across boundaries.

Rows are range-partitioned by (keys, ties) with sampled splitters, so a key held by a
third of all rows is spread over as many ranges as it needs. Each range is sorted and its
neighbours are compared, chunk by chunk. Only a group that touches an end of its chunk can
go on in another one; there are at most two such groups a chunk and level, and their sums
are joined back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.storage import Table

Emit = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

#: Sampled rows for a range that come to the driver.
SAMPLED = 64
#: Sorted rows that are held at once; a longer group goes on in the next chunk.
CHUNK_ROWS = 1 << 18
#: Groups at the ends of chunks that may be broadcast; above, they are joined by a shuffle.
MAX_ENDS = 1 << 18


def numbers(table: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    column = table.column(name)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.to_numpy(zero_copy_only=False)


def group_bounds(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """First row and length of each group of equal neighbours; the rows are sorted."""
    n = len(keys[0])
    change = np.zeros(n, bool)
    change[:1] = True
    for key in keys:
        change[1:] |= key[1:] != key[:-1]
    first = np.flatnonzero(change)
    return first, np.diff(np.append(first, n))


def ranges_of(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def splitters(sample: DataFrame, columns: list[str], ranges: int) -> np.ndarray:
    """Sorted rows of ``columns``, all long, that part the sample into ranges of about one size."""
    held = Table(sample.select(*columns), "sample")
    n = held.read().count()
    share = max(1, n // (SAMPLED * ranges))  # about SAMPLED rows a range come to the driver
    got = held.read().filter(F.pmod(F.xxhash64(*columns), F.lit(share)) == 0).collect()
    held.drop()
    rows = np.array([tuple(r) for r in got], np.int64).reshape(-1, len(columns))
    rows = rows[np.lexsort(rows.T[::-1])]
    return rows[np.arange(1, ranges) * len(rows) // ranges] if len(rows) else rows


def range_of(columns: list[np.ndarray], cut: np.ndarray) -> np.ndarray:
    """How many of the sorted splitters lie below each row."""
    part = np.searchsorted(cut[:, 0], columns[0], "left")
    if len(columns) > 1:
        above = np.searchsorted(cut[:, 0], columns[0], "right")
        tied = np.flatnonzero(above > part)
        start = part[tied]
        for lo in np.unique(start).tolist():  # keys that are splitters: their further columns decide
            rows = tied[start == lo]
            part[rows] += range_of([c[rows] for c in columns[1:]], cut[lo : above[rows[0]], 1:])
    return part


def _with_range(emit: Emit, columns: list[str], cut: np.ndarray) -> Emit:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in emit(batches):
            part = range_of([numbers(batch, c) for c in columns], cut)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part, pa.int32())], names=[*batch.schema.names, "part"])

    return run


def emitted(base: DataFrame, emit: Emit, schema: str, keys: list[str], ties: list[str], sample: DataFrame) -> DataFrame:
    """The rows that ``emit`` makes of ``base``, once, in ranges of (keys, ties) that a sample's rows part, sorted."""
    ranges, columns = ranges_of(base), [*keys, *ties]
    cut = splitters(sample.mapInArrow(emit, schema), columns, ranges)
    out = base.mapInArrow(_with_range(emit, columns, cut), schema + ", part int")
    return out.repartitionById(ranges, "part").drop("part").sortWithinPartitions(*columns)


def ranged(df: DataFrame, keys: list[str], ties: list[str]) -> DataFrame:
    """Rows that are cheap to read twice, in ranges that Spark samples, sorted."""
    return df.repartitionByRange(*keys, *ties).sortWithinPartitions(*keys, *ties)


def chunks(batches: Iterator[pa.RecordBatch], rows: int = CHUNK_ROWS) -> Iterator[pa.Table]:
    """Neighbouring batches together, of about ``rows`` rows."""
    held, load = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            load += batch.num_rows
        if load >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, load = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], size: int) -> Iterator[pa.Table]:
    """Tables of about ``size`` bytes, which hold the groups of equal neighbours whole."""
    held, load = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        load += batch.nbytes
        if load >= size:
            table = pa.Table.from_batches(held).combine_chunks()
            last = int(group_bounds([numbers(table, k) for k in keys])[0][-1])
            if last:
                yield table.slice(0, last).combine_chunks()
            held = table.slice(last).to_batches()
            load = sum(b.nbytes for b in held)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _compare(keys: list[str], levels: list[int], heads: list[str], keep_single: bool) -> Emit:
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches):
            columns = [numbers(table, k) for k in keys]
            values, keep = {h: numbers(table, h) for h in heads}, None
            for level in levels:
                first, size = group_bounds(columns[:level])
                touch = np.zeros(len(first), bool)
                touch[[0, -1]] = True
                if keep is None:
                    keep = np.ones(table.num_rows, bool) if keep_single else np.repeat(touch | (size > 1), size)
                for name, x in ((f"n{level}", size), *((f"h{level}_{h}", v[first]) for h, v in values.items()), (f"touch{level}", touch)):
                    table = table.append_column(name, pa.array(np.repeat(x, size)))
            yield from table.filter(pa.array(keep)).to_batches(max_chunksize=50_000)

    return compare


def equal_groups(ordered: DataFrame, keys: list[str], heads: list[str], levels: list[int], name: str, keep_single: bool = False) -> tuple[DataFrame, list[Table]]:
    """Adds to each row, for each level j, the size and the head of its group by the first j keys.

    ``ordered`` comes from ``emitted`` or ``ranged``: its ties begin with ``heads``. ``n{j}`` is
    the number of rows that agree in ``keys[:j]``, ``h{j}_<head>`` the ``heads`` of the first
    of them. Rows alone at the first level are left out unless ``keep_single``. Returns the
    rows and the tables below them, which the caller drops when it has used them.
    """
    added = [T.StructField(f"{x}{j}{h}", kind) for j in levels for x, h, kind in (("n", "", T.LongType()), *(("h", f"_{h}", T.LongType()) for h in heads), ("touch", "", T.BooleanType()))]
    schema = T.StructType([*ordered.schema.fields, *added])
    table = Table(ordered.mapInArrow(_compare(keys, levels, heads, keep_single), schema), name)
    out = table.read()
    parts = []
    for j in levels:
        known = [F.col(k) if i < j else F.lit(None).cast("long").alias(k) for i, k in enumerate(keys)]
        first = F.min(F.struct(*[f"h{j}_{h}" for h in heads])).alias("head")
        parts.append(out.filter(f"touch{j}").groupBy(*keys[:j]).agg(F.count("*").alias("n"), first).select(F.lit(j).alias("level"), *known, "n", F.col("head").cast("struct<" + ",".join(f"{h}:bigint" for h in heads) + ">").alias("head")))
    joined = parts[0]
    for p in parts[1:]:
        joined = joined.unionByName(p)
    ends = Table(joined, f"{name}-ends")
    small = ends.read().count() <= MAX_ENDS
    for j in levels:
        found = ends.read().filter(F.col("level") == j)
        on = [F.col(f"r.{k}") == F.col(f"e.{k}") for k in keys[:j]] + [F.col(f"r.touch{j}")]
        mine = [f"n{j}", *(f"h{j}_{h}" for h in heads)]
        here = [F.col(f"r.{c}") for c in out.columns if c not in mine]
        sums = [F.coalesce("e.n", f"r.n{j}").alias(f"n{j}"), *(F.coalesce(F.col(f"e.head.{h}"), F.col(f"r.h{j}_{h}")).alias(f"h{j}_{h}") for h in heads)]
        out = out.alias("r").join((F.broadcast(found) if small else found).alias("e"), on, "left").select(*here, *sums)
    out = out.drop(*[f"touch{j}" for j in levels])
    return (out if keep_single else out.filter(F.col(f"n{levels[0]}") > 1)), [table, ends]


def drop(tables: list[Table]) -> None:
    for table in tables:
        table.drop()
