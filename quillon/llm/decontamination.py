"""Benchmark decontamination with the q-gram lemma and banded alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.cluster import ship
from quillon.llm import hashing
from quillon.llm.storage import Table
from quillon.llm.texts import parts

#: Bytes in a gram; edits allowed for a byte of a probe; bytes in a probe, and from one to the next.
GRAM, EDIT_RATE, PROBE, STRIDE = 10, 0.08, 160, 80
#: The same for excerpts: any 80 bytes lie within 4, fewer than the edits allowed, of a probe's place.
EXCERPT, EXCERPT_STRIDE = 80, 8
#: Benchmark text that is sent to the executors at once; a larger benchmark comes in blocks.
BLOCK_BYTES = 4 << 20
#: Blocks that are searched in one pass over the texts; after it the marks are written out.
BLOCKS_A_PASS = 4
#: Document text that is looked at in one go; longer texts overlap from piece to piece.
CHUNK = 1 << 20
_BITS = 22


def normalised(text: str | None) -> bytes:
    """Lower case, white space as single spaces."""
    return " ".join((text or "").lower().split()).encode("utf-8", "replace")


def budget(m: int, gram: int = GRAM, rate: float = EDIT_RATE) -> int:
    """Edits allowed in a probe of m bytes: the rate, as far as the lemma still asks for grams."""
    return max(0, min(int(rate * m), (m + 1) // gram - 2))


def rounds_of(length: int, stride: int) -> list[tuple[int, int, int]]:
    """Probes of an item in rounds of (bytes, first start, step), where no gram lies in two probes of a round.

    The first round, of step 0, is the item's last ``length`` bytes, or all of a shorter one.
    """
    step = -(-(length - GRAM + 1) // stride) * stride
    return [(length, 0, 0), *((length, first, step) for first in range(0, step, stride))]


LONG, SHORT = rounds_of(PROBE, STRIDE), rounds_of(EXCERPT, EXCERPT_STRIDE)


def banded_distance(probe: np.ndarray, text: np.ndarray, edits: int) -> int:
    """Fewest edits between the probe and any stretch of ``text``; edits + 1 if there are more.

    ``text`` is the band's stretch of the document, so whole rows are the band.
    """
    n = len(text)
    step = np.arange(n + 1)
    row = np.zeros(n + 1, np.int64)
    for i, byte in enumerate(probe.tolist(), 1):
        new = np.minimum(row + 1, np.append(i, row[:-1] + (text != byte)))
        row = np.minimum.accumulate(new - step) + step
        if row.min() > edits:
            return edits + 1
    return int(row.min())


class Index:
    """The grams of a block of items, an item under a gram's length has none; its probes come in rounds."""

    def __init__(self, items: list[tuple[int | None, bytes]], rounds: list[tuple[int, int, int]] = LONG):
        self.rounds = rounds
        self.items = [item for item, _ in items]
        self.texts = [np.frombuffer(text, np.uint8) for _, text in items]
        self.size = np.array([len(x) for x in self.texts], np.int64)
        grams = [hashing.Prefix(hashing.BYTE_CODES[x]).windows(GRAM) for x in self.texts]
        owner, at = [np.full(len(g), i) for i, g in enumerate(grams)], [np.arange(len(g)) for g in grams]
        order = np.argsort(np.concatenate(grams), kind="stable") if grams else np.zeros(0, np.int64)
        joined = [np.concatenate(x)[order] if x else np.zeros(0, np.int64) for x in (grams, owner, at)]
        self.grams, first = np.unique(joined[0], return_index=True)
        self.first, self.owner, self.at = np.append(first, len(order)), joined[1], joined[2]
        longest = max(length for length, _, _ in rounds)
        self.edits = np.array([budget(m) for m in range(longest + 1)], np.int64)
        self.need = np.arange(longest + 1) + 1 - GRAM * (self.edits + 1)
        self.table = np.zeros(1 << _BITS, bool)
        self.table[(self.grams.astype(np.uint64) >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        sizes = [m for x in self.size.tolist() if x >= GRAM for m in {min(x, length) for length, _, _ in rounds}]
        self.least = min((int(self.need[m]) for m in sizes), default=1)
        self.reach = max((m + 2 * int(self.edits[m]) for m in sizes), default=0)

    def search(self, data: np.ndarray) -> set[int]:
        """Items of which some stretch of the bytes, of one or more texts, matches a probe within its budget."""
        return {p for p, _ in self.matches(data, np.zeros(1, np.int64), np.array([len(data)]))}

    def matches(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> set[tuple[int, int]]:
        """(item, text) for the texts that follow one another in ``data``."""
        found: set[tuple[int, int]] = set()
        if not len(self.grams) or len(data) < GRAM:
            return found
        g = hashing.Prefix(hashing.BYTE_CODES[data]).windows(GRAM)
        pos = np.flatnonzero(self.table[(g >> np.uint64(64 - _BITS)).astype(np.int64)])
        slot = np.searchsorted(self.grams, g[pos])
        ok = (slot < len(self.grams)) & (self.grams[np.minimum(slot, len(self.grams) - 1)] == g[pos])
        pos, slot = pos[ok], slot[ok]
        # of the grams around it, as many must be known as the least of all probes asks for
        crowd = np.searchsorted(pos, pos + self.reach) - np.searchsorted(pos, pos - self.reach)
        pos, slot = pos[crowd >= self.least], slot[crowd >= self.least]
        if not len(pos):
            return found
        many = self.first[slot + 1] - self.first[slot]
        entry = np.repeat(self.first[slot], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        pos, item, off = np.repeat(pos, many), self.owner[entry], self.at[entry]
        text = np.searchsorted(starts, pos, "right") - 1
        inside = pos + GRAM <= ends[text]
        pos, item, off, text = pos[inside], item[inside], off[inside], text[inside]
        near = np.zeros(len(pos), bool)  # as many on one item's diagonals, in bands as wide as any probe needs
        width = 2 * int(self.edits.max()) + 1
        for shift in (0, 1):
            band = (pos - off + shift * width) // (2 * width)
            order, first, count = _groups(band, text, item)
            near[order] |= np.repeat(count >= self.least, count)
        pos, item, off, text = pos[near], item[near], off[near], text[near]
        for length, begin, step in self.rounds:
            if not len(pos):
                break
            size = self.size[item]
            m = np.minimum(size, length)
            start = size - m if not step else begin + (off - begin) // step * step
            inside = (off >= start) & (off + GRAM <= start + m) & (start >= 0) & (start + m <= size)
            self._judge(data, starts, ends, found, *(x[inside] for x in (pos, item, off, text, start, m)))
            if found:  # what is found needs no further rounds
                known = np.array([i * len(starts) + t for i, t in found], np.int64)
                left = ~np.isin(item * len(starts) + text, known)
                pos, item, off, text = pos[left], item[left], off[left], text[left]
        return found

    def _judge(self, data, starts, ends, found, pos, item, off, text, start, m) -> None:
        """Adds the (item, text) of which a probe, ``m`` bytes of the item from ``start``, matches."""
        diagonal, half = pos - off, 2 * self.edits[m] + 1
        for shift in (0, 1):  # bands of twice the needed width, overlapping by half
            band = (diagonal + shift * half) // (2 * half)
            order, first, count = _groups(band, text, start, item)
            for k in np.flatnonzero(count >= self.need[m[order[first]]]).tolist():
                rows = order[first[k] : first[k] + count[k]]
                key = (int(item[rows[0]]), int(text[rows[0]]))
                if key in found:
                    continue
                at, size = int(start[rows[0]]), int(m[rows[0]])
                # the lemma's grams are different ones of the probe, at different places of the text
                if min(len(np.unique(off[rows])), len(np.unique(pos[rows]))) < self.need[size]:
                    continue
                probe, e = self.texts[key[0]][at : at + size], int(self.edits[size])
                # where the probe's own start would be
                a = max(int(starts[key[1]]), int(diagonal[rows].min()) + at - e)
                z = min(int(ends[key[1]]), int(diagonal[rows].max()) + at + size + e)
                if probe.tobytes() in data[a:z].tobytes() or banded_distance(probe, data[a:z], e) <= e:
                    found.add(key)


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that brings equal keys together, where in it each group starts, and the groups' sizes."""
    order = np.lexsort(keys)
    if not len(order):
        return order, order, order
    change = np.zeros(len(order) - 1, bool)
    for x in keys:
        change |= x[order][1:] != x[order][:-1]
    first = np.flatnonzero(np.append(True, change))
    return order, first, np.diff(np.append(first, len(order)))


def _found_items(index: Index, texts: list[str | None]) -> list[set]:
    out: list[set] = [set() for _ in texts]
    held: list[bytes] = []
    rows: list[int] = []
    load = 0

    def flush() -> None:
        nonlocal load
        ends = np.cumsum([len(x) for x in held])
        for item, text in index.matches(np.frombuffer(b"".join(held), np.uint8), ends - [len(x) for x in held], ends):
            out[rows[text]].add(index.items[item])
        held.clear()
        rows.clear()
        load = 0

    for i, text in enumerate(texts):
        data = normalised(text)
        for a in range(0, max(1, len(data)), CHUNK):
            held.append(data[a : a + CHUNK + 2 * index.reach])
            rows.append(i)
            load += len(held[-1])
            if load >= CHUNK:
                flush()
    if held:
        flush()
    return out


def _mark(items: list[tuple[int | None, bytes]]):
    cache: list[Index] = []

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not cache:
            cache.append(Index(items, LONG + SHORT))
        for batch in (p for b in batches for p in parts(b, "_text")):
            at = {n: i for i, n in enumerate(batch.schema.names)}
            found = _found_items(cache[0], batch.column(at["_text"]).to_pylist())
            before = batch.column(at["item_ids"]).to_pylist()
            ids = [sorted({*(b or ()), *f}, key=lambda x: (x is None, x)) for b, f in zip(before, found, strict=True)]
            arrays = [pa.array(ids, pa.list_(pa.int64())) if n == "item_ids" else batch.column(i) for n, i in at.items()]
            yield pa.RecordBatch.from_arrays(arrays, names=list(at))

    return mark


def _blocks(benchmark: DataFrame, size: int) -> Iterator[list[tuple[int | None, bytes]]]:
    """Items, normalised, in blocks of about ``size`` bytes."""
    block, load = [], 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL").orderBy("item_id", "text")
    for row in rows.toLocalIterator():
        block.append((row.item_id, normalised(row.text)))
        load += len(block[-1][1])
        if load >= size:
            yield block
            block, load = [], 0
    if block:
        yield block


def with_items(docs: DataFrame, benchmark: DataFrame, columns: list, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``columns`` of docs, and ``item_ids``: the benchmark items found in each text."""
    ship(docs.sparkSession)
    own = docs.select(*columns, F.col("text").cast("string").alias("_text"), F.array().cast("array<bigint>").alias("item_ids"))
    held = None
    for n, block in enumerate(_blocks(benchmark, block_bytes)):  # no shuffle; the driver holds one pass's blocks
        if n and n % BLOCKS_A_PASS == 0:
            after = Table(own, "marks")
            if held is not None:
                held.drop()
            own, held = after.read(), after
        own = own.mapInArrow(_mark(block), own.schema)
    return own.drop("_text")


def find_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_items and item_ids (sorted) for each row of docs.

    Texts and items are compared in lower case with single spaces, as UTF-8 bytes. An item
    counts as found if one of its probes (stretches of ``PROBE`` bytes every ``STRIDE`` and of
    ``EXCERPT`` bytes every ``EXCERPT_STRIDE``, or all of a shorter item) is within its edit
    budget of some stretch of the text; so is any ``EXCERPT`` bytes copied word for word. By the
    q-gram lemma such a stretch shares at least m + 1 - q (e + 1) q-grams with the probe on
    diagonals that differ by no more than 2 e, so only regions are aligned whose band, of
    bands that overlap by half, has that many different ones at different places. Null and empty texts, and items under
    ``GRAM`` bytes, match nothing; repeated rows are judged alike; a repeated or null
    item_id is listed once. An empty benchmark marks nothing, empty documents give an empty
    result; other columns are not looked at, whatever their names.
    """
    marked = with_items(docs, benchmark, [F.col("doc_id").cast("long").alias("doc_id")])
    return marked.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), F.size("item_ids").cast("long").alias("n_items"), "item_ids")


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs``, all its columns, without the rows that hold a benchmark item."""
    plain = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    named = plain.withColumn("text", F.col(f"_c{docs.columns.index('text')}"))
    marked = with_items(named, benchmark, plain.columns)
    return marked.filter(F.size("item_ids") == 0).select(*[F.col(a).alias(b) for a, b in zip(plain.columns, docs.columns, strict=True)])
