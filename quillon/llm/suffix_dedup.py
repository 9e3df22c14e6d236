"""Suffix-array dedup: suffixes range-partitioned by their anchors' leading bytes, sorted by multikey quicksort."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import hashing, ordering
from quillon.llm.repeats import Bytes, remove_repeats, windows_of

#: Bytes in a string that may not repeat, and in the gram that anchors are chosen by.
LENGTH, TOKEN = 200, 64


def characters(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number in their order; zeros follow the end."""
    out = np.append(data, np.zeros(8, np.uint8)).astype(np.uint64)
    for width in (1, 2, 4):
        out = out[:-width] << np.uint64(8 * width) | out[width:]
    return out[: len(data)]


def multikey_quicksort(data: np.ndarray, starts: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings data[s : s + length] by (group, bytes), and whether each is equal to the one before.

    ``group`` ascends. Eight bytes are a character. All parts of strings that share what has been
    read go on at once: a part whose strings share the next character too goes on to the
    one after, others are sorted by it and parted; a part of one string is done.
    """
    order = np.arange(len(starts))
    word, spare = characters(data), np.uint64(8 * max(0, 8 - length))
    begins = np.append(True, group[1:] != group[:-1])[: len(starts)]
    live = np.arange(len(starts))
    for depth in range(0, length, 8):
        size = np.diff(np.append(np.flatnonzero(begins[live]), len(live)))
        live = live[np.repeat(size > 1, size)]
        if not len(live):
            break
        char = word[starts[order[live]] + min(depth, max(0, length - 8))] >> spare
        part = np.cumsum(begins[live]) - 1
        start = np.flatnonzero(begins[live])
        mixed = np.logical_or.reduceat(char != char[start][part], start)[part]
        if mixed.any():
            rows = np.flatnonzero(mixed)
            by = rows[np.lexsort((char[rows], part[rows]))]
            order[live[rows]], char[rows] = order[live[by]], char[by]
            begins[live[1:]] |= char[1:] != char[:-1]
    return order, ~begins


def sort_suffixes(table: pa.Table, units: Bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last unit of the strings of ``length`` bytes that another suffix of the group shares.

    The suffixes that open windows of the rows are sorted within their anchor's group, and neighbours
    compared. A suffix whose hash is nowhere else in the group has no equal and is left out.
    """
    ah = ordering.numbers(table, "ah")
    group = np.cumsum(np.append(False, ah[1:] != ah[:-1]))
    parts = []
    for row, at in windows_of(units, length):
        lo = int(at[0]) if len(at) else 0
        codes = units.codes(lo, int(at[-1]) + length if len(at) else lo)
        parts.append((row, at, hashing.Prefix(codes).ranges(at - lo, at - lo + length)))
    none = np.zeros(0, np.int64)
    if not parts:
        return none, none, none
    row, at, h = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((h, group[row]))
    same = (h[order][1:] == h[order][:-1]) & (group[row][order][1:] == group[row][order][:-1])
    held = np.sort(order[np.append(False, same) | np.append(same, False)]) if len(order) else order
    row, at = row[held], at[held]
    if not len(row):
        return none, none, none
    order, same = multikey_quicksort(units.data, at, group[row], length)
    hit = np.sort(order[same | np.append(same[1:], False)])
    row, at = row[hit], at[hit]
    first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1))[: len(row)])
    last = np.append(first[1:] - 1, len(row) - 1)[: len(first)]
    return row[first], at[first], at[last] + length


def suffix_dedup(docs: DataFrame, length: int = LENGTH, token: int = TOKEN, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Removes each byte covered by a string of ``length`` bytes that also starts anywhere else.

    The array is a sparse one. Suffixes enter it at winnowed anchors, of which every string of
    ``length`` bytes holds one, each with the windows around it: sampled splitters range-partition
    them by their leading three bytes, then by the hash of ``token`` bytes and of the content,
    and neighbours are compared, across boundaries too. That settles anchors that are nowhere else and
    windows that repeat together. For the others the suffixes at every window are sorted in their
    bucket by multikey quicksort on the bytes and neighbours compared; buckets of over
    ``repeats.WHOLE`` rows are parted by longer anchors first. Returns doc_id, n_bytes, n_removed,
    n_spans and kept_sha256 for each row. Null or empty text: no bytes, the hash of nothing.
    Rows that repeat a doc_id or have none are separate texts; wholly repeated rows of ``length``
    bytes or more are removed by each other. Empty tables give an empty result; other columns
    are not looked at, whatever their names.
    """
    return remove_repeats(docs, "byte", length, token, sort_suffixes, doc_id, text).select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")
