"""What the two operators on repeated stretches share: anchors, runs of windows, and their groups.

Both remove every unit (byte or word) that is covered by a window of ``length`` units whose
content also starts anywhere else, exactly. The steps:

1. Winnowing: each window chooses the gram of ``gram`` units with the smallest hash in it,
   the leftmost among equals; that place is its *anchor*. Neighbouring windows with one anchor
   form a *run*. Equal windows have equal anchors in the same place, so a window can only
   repeat among the runs that share its anchor's key.
2. The runs are range-partitioned by sampled splitters and sorted by (anchor key, content);
   neighbours are compared, also across boundaries (``ordering.equal_groups``). Runs whose anchor
   is nowhere else are settled, and so are runs whose whole content repeats (128 bits of XXH3
   of the bytes). What is left, runs that share their anchor but not their content, is *open*.
3. Texts meet their runs, by row. Texts without open runs are done. Open runs, and one of
   each repeated content in their groups, send their units on.
4. Those are range-partitioned by anchor key, and the operator's own method, ``matcher``, finds
   what repeats in each group: ``substring_dedup`` extends matches from the anchors both ways,
   ``suffix_dedup`` sorts the suffixes. Both compare the bytes themselves.
   Groups of over ``WHOLE`` rows are first cut into runs of longer anchors, which go through
   step 2 again, and in the end into single windows, so no task holds a large group.
5. The texts with open runs meet the stretches found.

Nothing is capped: large groups are spread by step 2 and 4's ranges of (key, row, position).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import hashing, ordering
from quillon.llm.storage import Table, tidy
from quillon.llm.texts import buffers, few, keyed, parts

#: Units that are hashed at once; it bounds the memory of a step, not its input.
CHUNK = 1 << 19
#: A run is known by its first window's position and its number of windows, below this.
SPAN = 1 << 12
#: Rows of an anchor's group that one task compares; larger groups are cut, with the same result.
WHOLE = 384
#: Bytes of units that are compared at once; a byte takes some hundred of memory.
HELD = 1 << 19
#: Rows that splitters are sampled from.
SAMPLE_ROWS = 3000

RUNS = "ah long, r1 long, r2 long, k1 long, k2 long, sp long"
STEP = "kind int, doc_id long, k1 long, k2 long, n_units long, n_removed long, n_spans long, kept_sha256 string, text binary, cover binary, ah long, s0 long, open boolean, n long, payload binary"
FOUND = "k1 long, k2 long, lo long, hi long"
CUT = "ah long, r1 long, r2 long, k1 long, k2 long, lo long, hi long, open boolean, payload binary"
WINDOWS = "ah long, r1 long, r2 long, k1 long, k2 long, lo long, hi long, open boolean"
DONE = "doc_id long, n_units long, n_removed long, n_spans long, kept_sha256 string"


class Bytes:
    """Texts as bytes."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.data, self.starts, self.ends = data, starts, ends

    def codes(self, lo: int, hi: int) -> np.ndarray:
        return hashing.BYTE_CODES[self.data[lo:hi]]

    def places(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last byte of stretches of units."""
        return lo, hi

    def anchor_keys(self, at: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """The anchor's three leading bytes, in their order, then 40 bits of its hash."""
        head = self.data[at].astype(np.int64) << 16 | self.data[at + 1].astype(np.int64) << 8 | self.data[at + 2]
        return (head - (1 << 23)) << 40 | (grams >> np.uint64(24)).astype(np.int64)

    @staticmethod
    def kept(text: bytes, removed: np.ndarray) -> tuple[bytes, int]:
        """The bytes that stay and the number of all; ``removed``: start and end of each removed run."""
        edges = [0, *removed.ravel().tolist(), len(text)]
        return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)), len(text)


class Words:
    """Texts as words ``[^\\x20\\x09-\\x0D]+``; ``data`` has them with single spaces."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        whole = memoryview(np.ascontiguousarray(data))
        words, counts = [], []
        for a, z in zip(starts.tolist(), ends.tolist(), strict=True):
            own = bytes(whole[a:z]).split()  # splits at these six bytes and no others
            words += own
            counts.append(len(own))
        self.data = np.frombuffer(b" ".join(words), np.uint8)
        self.all = hashing.WORD_CODES.of(words)
        space = np.flatnonzero(self.data == 32)
        self.first, self.last = np.append(0, space + 1), np.append(space, len(self.data))
        self.ends = np.cumsum(np.array(counts, np.int64))
        self.starts = self.ends - np.array(counts, np.int64)

    def codes(self, lo: int, hi: int) -> np.ndarray:
        return self.all[lo:hi]

    def places(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.first[lo], self.last[hi - 1]

    def anchor_keys(self, at: np.ndarray, grams: np.ndarray) -> np.ndarray:
        return grams.view(np.int64)

    @staticmethod
    def kept(text: bytes, removed: np.ndarray) -> tuple[bytes, int]:
        own = text.split()
        if len(removed):
            stays = np.ones(len(own), bool)
            for a, b in removed.tolist():
                stays[a:b] = False
            return b" ".join(compress(own, stays.tolist())), len(own)
        return b" ".join(own), len(own)


UNITS = {"byte": Bytes, "word": Words}
Units = Bytes | Words
#: A table of payloads with one anchor key after another, its units, and the anchors' length: row, first and last unit (of all units) of what repeats.
Matcher = Callable[[pa.Table, Units, int, int], tuple[np.ndarray, np.ndarray, np.ndarray]]


def pieces(starts: np.ndarray, ends: np.ndarray, size: int, overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, starts and ends of neighbouring texts of about ``size`` units together.

    A text longer than that comes in pieces of its own, which overlap by ``overlap``.
    """
    i, n = 0, len(starts)
    while i < n:
        if ends[i] - starts[i] > size:
            lo = int(starts[i])
            while True:
                hi = min(int(ends[i]), lo + size)
                yield np.array([i]), np.array([lo]), np.array([min(int(ends[i]), hi + overlap)])
                if hi + overlap >= ends[i]:
                    break
                lo = hi
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + size, "right")))
        long = np.flatnonzero(ends[i:j] - starts[i:j] > size)
        j = i + int(long[0]) if len(long) else j
        if ends[j - 1] > starts[i] or overlap == 0:
            yield np.arange(i, j), starts[i:j], ends[i:j]
        i = j


def window_runs(codes: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: piece, first window, windows, anchor, the anchor's hash."""
    none = np.zeros(0, np.int64)
    if len(codes) < length:
        return none, none, none, none, none
    grams = hashing.Prefix(codes).windows(gram)
    order = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    chosen = (hashing.sliding_min(order, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    at = np.arange(len(chosen))
    at = at[at + length <= np.repeat(hi, hi - lo)[: len(chosen)]]
    if not len(at):
        return none, none, none, none, none
    chosen = chosen[at]
    first = np.flatnonzero(np.append(True, (chosen[1:] != chosen[:-1]) | (at[1:] != at[:-1] + 1)))
    s0 = at[first]
    return np.searchsorted(lo, s0, "right") - 1, s0, np.diff(np.append(first, len(at))), chosen[first], grams[chosen[first]]


def _runs_of(units: Units, length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Row, first window, windows, anchor key and content of each run."""
    for rows, lo, hi in pieces(units.starts, units.ends, CHUNK, length - 1):
        base = int(lo[0])
        piece, s0, size, anchor, grams = window_runs(units.codes(base, int(hi[-1])), lo - base, hi - base, length, gram)
        if len(s0):
            r1, r2 = hashing.digests(units.data, *units.places(s0 + base, s0 + base + size - 1 + length))
            yield rows[piece], s0 + base, size, units.anchor_keys(anchor + base, grams), r1, r2


def _emit_runs(unit: str, length: int, gram: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in parts(b, "text")):
            units = UNITS[unit](*buffers(batch.column("text")))
            k1, k2 = ordering.numbers(batch, "k1"), ordering.numbers(batch, "k2")
            for row, s0, size, ah, r1, r2 in _runs_of(units, length, gram):
                sp = (s0 - units.starts[row]) * SPAN + size
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ah, r1, r2, k1[row], k2[row], sp)], names=["ah", "r1", "r2", "k1", "k2", "sp"])

    return emit


def merged(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Start and end of each maximal run covered by intervals."""
    if not len(lo):
        return np.zeros((0, 2), np.int64)
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    first = np.flatnonzero(np.append(True, lo[1:] > hi[:-1]))
    return np.stack([lo[first], hi[np.append(first[1:] - 1, len(lo) - 1)]], axis=1)


def _result(unit: str, doc_id, text: bytes, removed: np.ndarray) -> dict:
    kept, n = UNITS[unit].kept(text, removed)
    return {"doc_id": doc_id, "n_units": n, "n_removed": int((removed[:, 1] - removed[:, 0]).sum()), "n_spans": len(removed), "kept_sha256": hashlib.sha256(kept).hexdigest()}


def _rows(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in ddl.split(", ")])


def _meet(unit: str, length: int):
    schema = _arrow(STEP)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts, ends = buffers(batch.column("text"))
            own, k1, k2 = batch.column("doc_id").to_pylist(), ordering.numbers(batch, "k1"), ordering.numbers(batch, "k2")
            runs = batch.column("runs")
            out, load = [], 0
            for i in range(batch.num_rows):
                if not runs[i].is_valid:
                    out.append({"kind": 0} | _result(unit, own[i], data[starts[i] : ends[i]].tobytes(), np.zeros((0, 2), np.int64)))
                else:
                    key = {"k1": int(k1[i]), "k2": int(k2[i])}
                    mine = pa.RecordBatch.from_struct_array(runs[i].values)
                    sp, kind, ah, group = (ordering.numbers(mine, x) for x in ("sp", "kind", "ah", "n1"))
                    s0, size, text = sp // SPAN, sp % SPAN, data[starts[i] : ends[i]]
                    end = s0 + size - 1 + length
                    removed = merged(s0[kind < 3], end[kind < 3])
                    if (kind == 3).any():
                        out.append({"kind": 1, "doc_id": own[i], **key, "text": text.tobytes(), "cover": removed.tobytes()})
                    else:
                        out.append({"kind": 0} | _result(unit, own[i], text.tobytes(), removed))
                    some = np.flatnonzero(kind > 1)
                    if len(some):
                        units = UNITS[unit](text, np.zeros(1, np.int64), np.array([len(text)]))
                        for j, a, z in zip(some.tolist(), *(x.tolist() for x in units.places(s0[some], end[some])), strict=True):
                            out.append({"kind": 2, **key, "ah": int(ah[j]), "s0": int(s0[j]), "open": bool(kind[j] == 3), "n": int(group[j]), "payload": units.data[a:z].tobytes()})
                load += int(ends[i] - starts[i])
                if len(out) > 5000 or load > 1 << 23:
                    yield _rows(out, schema)
                    out, load = [], 0
            if out:
                yield _rows(out, schema)

    return meet


def _longer_grams(length: int) -> list[int]:
    """The anchors that large groups are cut by: runs then have an eighth, then a 32nd, of the length in windows."""
    return sorted({length - length // n + 1 for n in (8, 32) if length // n > 1})


def _match(unit: str, length: int, gram: int, matcher: Matcher):
    schema = _arrow(FOUND)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in ordering.whole_groups(batches, ["ah"], HELD):
            k1, k2, s0, is_open = (ordering.numbers(table, x) for x in ("k1", "k2", "lo", "open"))
            units = UNITS[unit](*buffers(table.column("payload").chunk(0)))
            row, lo, hi = matcher(table, units, length, gram)
            mine = is_open[row]
            row, lo, hi = row[mine], lo[mine], hi[mine]
            if len(row):
                base = s0[row] - units.starts[row]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k1[row], k2[row], base + lo, base + hi)], schema=schema)

    return match


def _cut(unit: str, length: int, gram: int):
    schema = _arrow(CUT)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in parts(b, "payload")):
            k1, k2, lo, is_open = (ordering.numbers(batch, x) for x in ("k1", "k2", "lo", "open"))
            units = UNITS[unit](*buffers(batch.column("payload")))
            for row, s0, size, ah, r1, r2 in _runs_of(units, length, gram):
                end = s0 + size - 1 + length
                sent = [units.data[a:z].tobytes() for a, z in zip(*(x.tolist() for x in units.places(s0, end)), strict=True)]
                base = lo[row] - units.starts[row]
                yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in (ah, r1, r2, k1[row], k2[row], base + s0, base + end, is_open[row])), pa.array(sent, pa.binary())], schema=schema)

    return cut


def _emit_windows(unit: str, length: int):
    schema = _arrow(WINDOWS)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in parts(b, "payload")):
            ah, k1, k2, lo, is_open = (ordering.numbers(batch, x) for x in ("ah", "k1", "k2", "lo", "open"))
            units = UNITS[unit](*buffers(batch.column("payload")))
            for row, s0 in windows_of(units, length):
                r1, r2 = hashing.digests(units.data, *units.places(s0, s0 + length))
                at = lo[row] + s0 - units.starts[row]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ah[row], r1, r2, k1[row], k2[row], at, at + length, is_open[row])], schema=schema)

    return emit


def windows_of(units: Units, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row and first unit of every window, in pieces."""
    for rows, lo, hi in pieces(units.starts, units.ends, CHUNK, length - 1):
        size = np.maximum(0, hi - lo - length + 1)
        yield np.repeat(rows, size), np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())


def _finish(unit: str):
    schema = _arrow(DONE)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                lo_hi = np.frombuffer(batch.column("cover")[i].as_py(), np.int64).reshape(-1, 2)
                found = batch.column("found")[i]
                if found.is_valid:
                    mine = pa.RecordBatch.from_struct_array(found.values)
                    lo_hi = np.concatenate([lo_hi, np.stack([ordering.numbers(mine, "lo"), ordering.numbers(mine, "hi")], axis=1)])
                out.append(_result(unit, batch.column("doc_id")[i].as_py(), batch.column("text")[i].as_py(), merged(lo_hi[:, 0], lo_hi[:, 1])))
            if out:
                yield _rows(out, schema)

    return finish


def _open_stretches(sent: DataFrame, unit: str, length: int, gram: int, matcher: Matcher) -> DataFrame:
    """k1, k2, lo and hi of the stretches of open runs that repeat, by groups of ah."""
    place = [x.split()[0] for x in FOUND.split(", ")]
    grams, found = _longer_grams(length), None
    while True:
        small = sent.filter(F.col("n") <= WHOLE).repartitionByRange("ah").sortWithinPartitions("ah", "k1", "lo")
        part = small.mapInArrow(_match(unit, length, gram, matcher), FOUND)
        found = part if found is None else found.unionByName(part)
        large = sent.filter(F.col("n") > WHOLE)
        if large.isEmpty():
            return found
        some = few(large, SAMPLE_ROWS)
        if not grams:
            windows = ordering.emitted(large, _emit_windows(unit, length), WINDOWS, ["ah", "r1", "r2"], ["k1", "lo"], some)
            twice, _ = ordering.equal_groups(windows, ["ah", "r1", "r2"], ["k1"], [3], "windows")
            return found.unionByName(twice.filter("open").select(*place))
        gram = grams.pop(0)
        runs = ordering.emitted(large, _cut(unit, length, gram), CUT, ["ah", "r1", "r2"], ["k1", "lo"], some)
        groups, _ = ordering.equal_groups(runs, ["ah", "r1", "r2"], ["k1"], [1, 3], "cut")
        found = found.unionByName(groups.filter("open AND n3 > 1").select(*place))
        apart = groups.filter((F.col("n1") != F.col("n3")) & ((F.col("n3") == 1) | (F.col("k1") == F.col("h3_k1"))))
        sent = apart.select("ah", "k1", "k2", "lo", (F.col("open") & (F.col("n3") == 1)).alias("open"), F.col("n1").alias("n"), "payload")


def remove_repeats(docs: DataFrame, unit: str, length: int, gram: int, matcher: Matcher, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_units, n_removed, n_spans (maximal removed runs), kept_sha256.

    Null and empty texts have no units and stay as they are; rows that repeat a doc_id or have
    none, or repeat wholly, are texts of their own, whose stretches repeat each other's. Empty
    tables give an empty result; other columns are not looked at, whatever their names.
    """
    spark = docs.sparkSession
    base = keyed(docs, doc_id, text)
    keys, ties = ["ah", "r1", "r2"], ["k1", "sp"]
    runs = ordering.emitted(base, _emit_runs(unit, length, gram), RUNS, keys, ties, keyed(few(docs, SAMPLE_ROWS, text), doc_id, text))
    shared, tables = ordering.equal_groups(runs, keys, ["k1"], [1, 3], "runs")
    # 1: repeats as a whole; 2: that too, and stands for its content in a group with others; 3: open
    kind = F.when(F.col("n1") == F.col("n3"), 1).when(F.col("n3") == 1, 3).when(F.col("k1") == F.col("h3_k1"), 2).otherwise(1)
    by_row = shared.groupBy("k1", "k2").agg(F.collect_set(F.struct("sp", kind.alias("kind"), "ah", "n1")).alias("runs"))
    step = Table(base.join(by_row, ["k1", "k2"], "left").mapInArrow(_meet(unit, length), STEP), "texts")
    ordering.drop(tables)

    sent = step.read().filter("kind = 2").select("ah", "k1", "k2", F.col("s0").alias("lo"), "open", "n", "payload")
    found = Table(_open_stretches(sent, unit, length, gram, matcher), "stretches")
    stretches = found.read().groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "hi")).alias("found"))
    waiting = step.read().filter("kind = 1").select("doc_id", "text", "cover", "k1", "k2")
    ended = waiting.join(stretches, ["k1", "k2"], "left").select("doc_id", "text", "cover", "found")
    done = step.read().filter("kind = 0").select(*[c.split()[0] for c in DONE.split(", ")])
    tidy(spark)
    return done.unionByName(ended.mapInArrow(_finish(unit), DONE))
