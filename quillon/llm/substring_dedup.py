"""Substring dedup by seed and extend: documents joined on winnowed anchors, matches extended both ways."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import hashing, ordering
from quillon.llm.repeats import Words, remove_repeats

#: Words in a window, and in the anchors that seed matches.
WINDOW, ANCHOR = 35, 10


def _agreement(codes: np.ndarray, x: np.ndarray, y: np.ndarray, step: int, limit: np.ndarray) -> np.ndarray:
    """How many units agree from x and y on, at most ``limit``; ``step`` 1 is to the right, -1 to the left."""
    n, alive, at = np.zeros(len(x), np.int64), np.flatnonzero(limit > 0), 0
    while len(alive):
        alive = alive[codes[x[alive] + step * at] == codes[y[alive] + step * at]]
        at += 1
        n[alive] = at
        alive = alive[limit[alive] > at]
    return n


def anchors_of(units: Words, ah: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Where each row's anchor starts; it lies in all windows of the row."""
    grams = hashing.Prefix(units.all).windows(gram).view(np.int64)
    size = units.ends - units.starts
    hit = np.flatnonzero(grams == np.repeat(ah, size)[: len(grams)])
    row = np.searchsorted(units.starts, hit, "right") - 1
    off = hit - units.starts[row]
    inside = (off >= size[row] - length) & (off <= length - gram)
    row, first = np.unique(row[inside], return_index=True)
    out = np.full(len(ah), -1, np.int64)
    out[row] = hit[inside][first]
    return out


def _extended_by_bytes(units: Words, i: int, j: int, x: int, y: int) -> tuple[int, int]:
    """The same, unit by unit on the bytes: how far i's and j's units agree to the left of x and y and to the right."""
    word = lambda k: units.data[units.first[k] : units.last[k]].tobytes()
    left = right = 0
    while min(x - units.starts[i], y - units.starts[j]) > left and word(x - left - 1) == word(y - left - 1):
        left += 1
    while min(units.ends[i] - x, units.ends[j] - y) > right and word(x + right) == word(y + right):
        right += 1
    return left, right


def extend_matches(table: pa.Table, units: Words, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last unit of the maximal repeats of at least ``length`` units around shared anchors.

    Rows of one anchor key follow one another; each two of which one is open are a seed,
    extended to both sides as far as they agree. Words are compared by code, then the
    match by its bytes.
    """
    ah, is_open = ordering.numbers(table, "ah"), ordering.numbers(table, "open")
    at = anchors_of(units, ah, length, gram)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    _, sizes = ordering.group_bounds([ah])
    for shift in range(1, int(sizes.max())):
        i = np.flatnonzero((ah[shift:] == ah[:-shift]) & (is_open[shift:] | is_open[:-shift]) & (at[shift:] >= 0) & (at[:-shift] >= 0))
        j = i + shift
        left = _agreement(units.all, at[i] - 1, at[j] - 1, -1, np.minimum(at[i] - units.starts[i], at[j] - units.starts[j]))
        right = _agreement(units.all, at[i], at[j], 1, np.minimum(units.ends[i] - at[i], units.ends[j] - at[j]))
        ok = left + right >= length
        i, j, left, right = i[ok], j[ok], left[ok], right[ok]
        if not len(i):
            continue
        (a, b), (c, d) = (units.places(at[k] - left, at[k] + right) for k in (i, j))
        for k, (p, q, r, s) in enumerate(zip(a.tolist(), b.tolist(), c.tolist(), d.tolist(), strict=True)):
            if units.data[p:q].tobytes() != units.data[r:s].tobytes():  # equal codes of other words
                left[k], right[k] = _extended_by_bytes(units, int(i[k]), int(j[k]), int(at[i[k]]), int(at[j[k]]))
        long = left + right >= length
        for k in (i, j):
            found.append((k[long], (at[k] - left)[long], (at[k] + right)[long]))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (none, none, none)


def substring_dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Removes words covered by a window of ``window`` words that also starts anywhere else.

    Documents are joined on winnowed word anchors: every window has one, so equal windows share
    it. Runs of windows that repeat as a whole are settled in that join; the others
    are extended from the anchor to both sides, and what agrees over ``window`` words or more
    is kept as a maximal repeat (see ``repeats`` for the join of large groups). Returns doc_id,
    n_words, n_removed, n_spans and kept_sha256 for each row. Null or empty text: no words, the
    hash of nothing. Texts shorter than a window lose nothing. Rows that repeat a doc_id or have
    none are separate texts, and wholly repeated rows are removed by each other. Empty
    tables give an empty result; other columns are not looked at, whatever their names.
    """
    return remove_repeats(docs, "word", window, anchor, extend_matches, doc_id, text).select("doc_id", F.col("n_units").alias("n_words"), "n_removed", "n_spans", "kept_sha256")
