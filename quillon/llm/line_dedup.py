"""Line dedup: first occurrences streamed from range-partitioned, sorted line hashes."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import ordering
from quillon.llm.texts import NO_ID, few, keyed, with_keys

#: Code points that a key needs to count; rows that splitters are sampled from.
MIN_KEY, SAMPLE_ROWS = 10, 3000


def line_key(line: bytes) -> bytes:
    """The line without white space at its ends, A-Z lower-cased; bytes() methods know ASCII only."""
    return line.strip().lower()


def _counts(key: bytes, least: int) -> bool:
    return len(key) >= 4 * least or len(key) >= least and len(key.decode("utf-8", "replace")) >= least


LINES = "h1 long, h2 long, did long, k1 long, k2 long, line long"


def _emit_lines(least: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [ordering.numbers(batch, x) for x in ("did", "k1", "k2")]
            text = batch.column("text").cast(pa.large_binary())
            hashes, rows, lines = [], [], []
            for i in range(batch.num_rows):
                value = text[i].as_py()
                for j, line in enumerate(value.split(b"\n") if value else ()):
                    if _counts(key := line_key(line), least):
                        hashes.append(xxhash.xxh3_128_digest(key))
                        rows.append(i)
                        lines.append(j)
                if len(rows) > 50_000 or i == batch.num_rows - 1 and rows:
                    h = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
                    at = np.array(rows)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h[:, 0], h[:, 1], *(x[at] for x in own), np.array(lines, np.int64))], names=["h1", "h2", "did", "k1", "k2", "line"])
                    hashes, rows, lines = [], [], []

    return emit


def _bitmap(n: int, dropped: np.ndarray) -> bytes:
    keep = np.ones(n, bool)
    keep[dropped] = False
    return zlib.compress(np.packbits(keep).tobytes(), 6)


def bitmap_lines(bitmap: bytes, n_lines: int) -> np.ndarray:
    """Whether each line stays, from a compressed keep bitmap."""
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n_lines).astype(bool)


def _make_bitmaps(with_hash: bool):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dropped, text = batch.column("dropped"), batch.column("text").cast(pa.large_binary())
            n_lines, n_dropped, maps, hashes = [], [], [], []
            for i in range(batch.num_rows):
                value = text[i].as_py() or b""
                drop = dropped[i].values.to_numpy(zero_copy_only=False) if dropped[i].is_valid else np.zeros(0, np.int64)
                n = value.count(b"\n") + 1
                n_lines.append(n)
                n_dropped.append(len(drop))
                maps.append(_bitmap(n, drop))
                if with_hash and len(drop):
                    gone = set(drop.tolist())
                    value = b"\n".join(x for j, x in enumerate(value.split(b"\n")) if j not in gone)
                hashes.append(hashlib.sha256(value).hexdigest() if with_hash else None)
            names = ["doc_id", "n_lines", "n_dropped", "keep", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(maps, pa.binary()), pa.array(hashes, pa.string())], names=names)

    return make


def dropped_lines(docs: DataFrame, min_key: int = MIN_KEY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """k1, k2 and the line numbers that go, for rows that lose lines."""
    keys, ties = ["h1", "h2"], ["did", "k1", "k2", "line"]
    sample = keyed(few(docs, SAMPLE_ROWS, text), doc_id, text)
    lines = ordering.emitted(keyed(docs, doc_id, text), _emit_lines(min_key), LINES, keys, ties, sample)
    marked, _ = ordering.equal_groups(lines, keys, ["did", "k1", "k2"], [2], "lines")
    first = (F.col("did") == F.col("h2_did")) & ((F.col("did") != NO_ID) | ((F.col("k1") == F.col("h2_k1")) & (F.col("k2") == F.col("h2_k2"))))
    return marked.filter(~first).groupBy("k1", "k2").agg(F.collect_set("line").alias("dropped"))


def line_dedup(docs: DataFrame, min_key: int = MIN_KEY, doc_id: str = "doc_id", text: str = "text", with_hash: bool = False) -> DataFrame:
    """A compressed keep bitmap for each row: which of its lines stay.

    Lines are split at \\n; keys are the lines stripped of white space and lower-cased (A-Z).
    128-bit hashes of keys of at least ``min_key`` code points are range-partitioned by (hash,
    document, line), sorted, and streamed: a key's first document keeps its lines, all others
    lose theirs. Returns doc_id, n_lines, n_dropped, keep (zlib over packed bits, see
    ``bitmap_lines``) and, ``with_hash``, the SHA-256 of the lines that stay. Null or
    empty text is one empty line. Rows with one doc_id are one document: they never drop
    each other's lines. Rows without a doc_id come after all others and are documents of
    their own, unless their texts agree too. Empty tables give an empty result; other columns
    are not looked at, whatever their names.
    """
    dropped = dropped_lines(docs, min_key, doc_id, text)
    met = keyed(docs, doc_id, text).join(dropped, ["k1", "k2"], "left").select("doc_id", "text", "dropped")
    out = met.mapInArrow(_make_bitmaps(with_hash), "doc_id long, n_lines long, n_dropped long, keep binary, kept_sha256 string")
    return out if with_hash else out.drop("kept_sha256")


def without_repeated_lines(docs: DataFrame, min_key: int = MIN_KEY) -> DataFrame:
    """``docs``, all its columns, with the lines gone that ``line_dedup`` drops.

    The rest of a text is put together by built-in functions: whole rows do not go through Python.
    """
    own, width = with_keys(docs), len(docs.columns)
    met = own.join(dropped_lines(docs, min_key), ["k1", "k2"], "left")
    name = f"_c{docs.columns.index('text')}"
    lines = F.split(name, "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0).cast("long"), F.size(lines).cast("long") - 1), "dropped")
    rest = F.array_join(F.transform(stay, lambda i: F.get(lines, i.cast("int"))), "\n")
    text = F.when(F.col("dropped").isNotNull(), rest).otherwise(F.col(name)).cast(docs.schema["text"].dataType)
    return met.select(*[text.alias(name) if c == name else F.col(c) for c in own.columns[:width]]).toDF(*docs.columns)
