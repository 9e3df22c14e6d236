"""Jaccard join of word n-gram sets along chosen paths."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import hashing, ordering
from quillon.llm.components import apart, components
from quillon.llm.storage import Table
from quillon.llm.texts import NO_ID, few, keyed, with_keys

#: Words in a shingle, the similarity of a link, and the share of links to be found.
SHINGLE, SIMILARITY, RECALL = 5, 0.8, 0.9999
#: Sets in a bucket that are compared without further splitting, and in a block of a larger bucket.
SMALL, BLOCK = 256, 1024
#: Rows that splitters are sampled from.
SAMPLE_ROWS = 3000
SEED = 0x51ED270B


#: Random orders of all tokens that nodes below the roots draw from.
ORDERS = 32


def _branching(similarity: float) -> tuple[int, float]:
    """Children of every node, and the share of nodes with one more: 1 / similarity on average."""
    mean = 1 / max(similarity, 1 / ORDERS)
    return int(mean), mean - int(mean)


def miss_of(runs: int, similarity: float) -> float:
    """The probability that a pair at the similarity shares no path of three steps.

    The nodes below the roots draw from shared orders: of these, a binomial number has the
    pair's first token in common, and given that, the runs are independent.
    """
    few, more = _branching(similarity)
    lost = lambda q: (1 - more) * q**few + more * q ** (few + 1)
    total = 0.0
    for good in range(ORDERS + 1):
        f = good / ORDERS
        below = lost(1 - f + f * lost(1 - f))
        total += math.comb(ORDERS, good) * similarity**good * (1 - similarity) ** (ORDERS - good) * lost(1 - similarity + similarity * below) ** runs
    return total


def runs_for(recall: float, similarity: float) -> int:
    """Runs until a pair at the similarity shares a path of three steps with the probability ``recall``."""
    if similarity >= 1:
        return 1
    runs = 1
    while runs < 1000 and miss_of(runs, similarity) > 1 - recall:
        runs += 1
    return runs


def shingle_set(text: bytes | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of a text's words; a shorter text is one shingle."""
    codes = hashing.WORD_CODES.of((text or b"").split())
    if not len(codes):
        return np.zeros(0, np.uint64)
    return np.unique(hashing.Prefix(codes).windows(min(n, len(codes))))


def _mix1(x: int) -> int:
    x &= 0xFFFFFFFFFFFFFFFF
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
    return x ^ (x >> 31)


def _order_seeds(orders: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = np.array([[_mix1(SEED * 3 + i), _mix1(SEED * 5 + i) | 1] for i in range(orders)], np.uint64)
    return seeds[:, :1], seeds[:, 1:]


def first_tokens(shingles: np.ndarray, orders: int) -> np.ndarray:
    """The set's first token in each random order."""
    flip, factor = _order_seeds(orders)
    return ((shingles[None, :] ^ flip) * factor).min(axis=1)


def _orders_of(runs: int, similarity: float) -> int:
    few, more = _branching(similarity)
    return (few + (more > 0)) * runs + ORDERS


def paths_of(first: np.ndarray, runs: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Set and steps of all paths of three steps that the sets go along, in all runs.

    ``first`` has a row for each set: its first token in each order. A node's children are chosen
    with tokens sampled by the node: the first ones in random orders of all tokens, 1 / similarity
    on average. Two sets share a child of an order with the probability of their Jaccard
    similarity. The roots have orders of their own.
    """
    few, more = _branching(similarity)
    width = few + (more > 0)
    base, bar = width * runs, np.uint64(int(more * (1 << 24)))
    u = np.uint64

    def children(row: np.ndarray, node: np.ndarray, orders: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The parent's place and the child, parent by parent."""
        many = few + ((hashing.mix(node ^ u(0xA5A5)) & u(0xFFFFFF)) < bar)
        at = np.repeat(np.arange(len(node)), many)
        i = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
        o = np.stack(orders, axis=1)[at, i]
        return at, hashing.mix(node[at] ^ hashing.mix(first[row[at], o] + o.astype(np.uint64)))

    def drawn(node: np.ndarray) -> list[np.ndarray]:
        return [(u(base) + node // u(ORDERS**i) % u(ORDERS)).astype(np.int64) for i in range(width)]

    run = np.tile(np.arange(runs), len(first))
    row = np.repeat(np.arange(len(first)), runs)
    roots = hashing.mix(np.arange(SEED, SEED + runs, dtype=np.uint64))[run]
    at, a = children(row, roots, [i * runs + run for i in range(width)])
    row = row[at]
    at, b = children(row, a, drawn(a))
    row, a = row[at], a[at]
    at, c = children(row, b, drawn(b))
    return row[at], np.stack([a[at], b[at], c], axis=1)


def paths(shingles: np.ndarray, runs: int, similarity: float = SIMILARITY) -> list[tuple[int, int, int]]:
    """The paths of one set."""
    _, steps = paths_of(first_tokens(shingles, _orders_of(runs, similarity))[None, :], runs, similarity)
    return [tuple(x) for x in steps.tolist()]


PATHS = "c1 long, c2 long, did long, k1 long, k2 long, paths binary"
STEPS = "p1 long, p2 long, p3 long, c1 long, c2 long"
CELLS = "bucket long, i int, j int, c1 long, c2 long, copies long, own int, buckets binary, shingles binary"
LINKS = "c1 long, c2 long, links long, b1 long, b2 long"


def _emit_paths(n: int, runs: int, similarity: float):
    orders = _orders_of(runs, similarity)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, hashes, first, some = batch.column("text").cast(pa.large_binary()), [], [], []
            for i in range(batch.num_rows):
                s = shingle_set(text[i].as_py(), n)
                hashes.append(xxhash.xxh3_128_digest(s.tobytes()))
                if len(s):
                    some.append(i)
                    first.append(first_tokens(s, orders))
            packed = [b""] * batch.num_rows
            if some:
                row, steps = paths_of(np.stack(first), runs, similarity)
                ends = np.searchsorted(row, np.arange(len(some) + 1))
                for k, i in enumerate(some):
                    packed[i] = steps[ends[k] : ends[k + 1]].tobytes()
            c = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(c[:, 0]), pa.array(c[:, 1]), *(batch.column(x) for x in ("did", "k1", "k2")), pa.array(packed, pa.binary())], names=["c1", "c2", "did", "k1", "k2", "paths"])

    return emit


def _explode_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        c1, c2, packed = ordering.numbers(batch, "c1"), ordering.numbers(batch, "c2"), batch.column("paths").to_pylist()
        steps = np.frombuffer(b"".join(packed), np.int64).reshape(-1, 3)
        row = np.repeat(np.arange(len(packed)), [len(p) // 24 for p in packed])
        for i in range(0, len(row), 50_000):
            r, s = row[i : i + 50_000], steps[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(s[:, k])) for k in range(3)] + [pa.array(c1[r]), pa.array(c2[r])], names=["p1", "p2", "p3", "c1", "c2"])


def _send_sets(n: int, block: int):
    schema = pa.schema([("bucket", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("c1", pa.int64()), ("c2", pa.int64()), ("copies", pa.int64()), ("own", pa.int32()), ("buckets", pa.binary()), ("shingles", pa.binary())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, out, load = batch.column("text").cast(pa.large_binary()), [], 0
            for k in range(batch.num_rows):
                s = shingle_set(text[k].as_py(), n).tobytes()
                c1, c2, copies = (batch.column(x)[k].as_py() for x in ("c1", "c2", "copies"))
                own = {x["bucket"]: x["size"] for x in batch.column("into")[k].as_py()}
                known = np.array(sorted(own), np.int64).tobytes()
                for bucket, size in own.items():
                    blocks = -(-size // block)
                    mine = _mix1(c1 ^ bucket) % blocks
                    for other in range(blocks):  # blocks of a large bucket meet pair by pair
                        out.append({"bucket": bucket, "i": min(mine, other), "j": max(mine, other), "c1": c1, "c2": c2, "copies": copies, "own": mine, "buckets": known, "shingles": s})
                        load += len(s)
                        if load > 1 << 23 or len(out) > 5000:
                            yield pa.RecordBatch.from_pylist(out, schema=schema)
                            out, load = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return send


def _blocks_of(size: np.ndarray, rows: int, tokens: int) -> np.ndarray:
    """Where blocks of neighbouring sets start and end: of at most so many rows, and tokens unless one set has more."""
    ends, cuts, at = np.cumsum(size), [0], 0
    while at < len(size):
        before = int(ends[at - 1]) if at else 0
        at = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + tokens, "right"))))
        cuts.append(at)
    return np.array(cuts)


def similar(sets: list[np.ndarray], threshold: float, block: int = 128, tokens: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs x < y whose Jaccard similarity reaches the threshold.

    Blocks of sets are multiplied as matrices over the tokens of one of them; ``block`` and
    ``tokens`` bound a matrix, whatever the sets' sizes.
    """
    size = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), size)
    _, token, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = held[token] > 1
    row, token = row[shared], token[shared]
    least = np.zeros(len(held), np.int64)
    least[held > 1] = np.arange((held > 1).sum())
    token = least[token]
    cuts = _blocks_of(np.bincount(row, minlength=len(sets)), block, tokens)
    starts = np.searchsorted(row, cuts)

    def dense(k: int, known: np.ndarray) -> np.ndarray:
        lo, hi = starts[k], starts[k + 1]
        at = np.searchsorted(known, token[lo:hi])
        ok = (at < len(known)) & (known[np.minimum(at, len(known) - 1)] == token[lo:hi])
        out = np.zeros((cuts[k + 1] - cuts[k], len(known)), np.float32)
        out[row[lo:hi][ok] - cuts[k], at[ok]] = 1
        return out

    for a in range(len(cuts) - 1):
        known = np.unique(token[starts[a] : starts[a + 1]])
        if not len(known):
            continue
        left = dense(a, known)
        for b in range(a, len(cuts) - 1):
            both = (left @ (left if b == a else dense(b, known)).T).astype(np.int64)
            x, y = np.nonzero(both)
            x, y, inter = x + cuts[a], y + cuts[b], both[x, y]
            ok = (x < y) & (inter >= threshold * (size[x] + size[y] - inter) - 1e-9)
            if ok.any():
                yield x[ok], y[ok]


def _compare(threshold: float):
    schema = pa.schema([(x, pa.int64()) for x in ("c1", "c2", "links", "b1", "b2")])

    def cell(bucket: int, i: int, j: int, table: pa.Table) -> pa.RecordBatch | None:
        c1, c2, copies, own = (ordering.numbers(table, x) for x in ("c1", "c2", "copies", "own"))
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        known = [np.frombuffer(x, np.int64) for x in table.column("buckets").to_pylist()]
        before: dict[int, list[int]] = {}
        for k, ids in enumerate(known):  # a pair counts in the first bucket that holds both
            for b in ids[ids < bucket].tolist():
                before.setdefault(b, []).append(k)
        earlier = np.zeros((len(sets), len(sets)), bool) if len(sets) <= 8192 else None
        sets_before = None
        if earlier is not None:
            for rows in before.values():
                if len(rows) > 1:
                    earlier[np.ix_(rows, rows)] = True
        else:
            sets_before = [set(ids[ids < bucket].tolist()) for ids in known]
        links, parent = np.zeros(len(sets), np.int64), np.arange(len(sets))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = int(parent[x])
            return x

        edges = []
        for x, y in similar(sets, threshold):
            ok = ~earlier[x, y] if earlier is not None else np.array([sets_before[a].isdisjoint(sets_before[b]) for a, b in zip(x.tolist(), y.tolist(), strict=True)])
            if i != j:
                ok &= own[x] != own[y]
            x, y = x[ok], y[ok]
            np.add.at(links, x, copies[y])
            np.add.at(links, y, copies[x])
            for a, b in zip(x.tolist(), y.tolist(), strict=True):
                if (ra := root(a)) != (rb := root(b)):
                    parent[ra] = rb
                    edges.append((a, b))
        some = np.flatnonzero(links)
        if not len(some):
            return None
        a, b = np.array(edges, np.int64).reshape(-1, 2).T
        node = np.append(some, a)
        ends = [pa.array([None] * len(some) + c[b].tolist(), pa.int64()) for c in (c1, c2)]
        return pa.RecordBatch.from_arrays([pa.array(c1[node]), pa.array(c2[node]), pa.array(np.append(links[some], np.zeros(len(a), np.int64))), *ends], schema=schema)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                table = pa.Table.from_batches(held).combine_chunks()
                first = table.slice(0, 1).to_pylist()[0]
                if table.num_rows > 1 and (got := cell(first["bucket"], first["i"], first["j"], table)) is not None:
                    yield got

        last = None
        for batch in batches:  # rows come sorted by cell
            keys = [ordering.numbers(batch, x) for x in ("bucket", "i", "j")]
            if not batch.num_rows:
                continue
            first, size = ordering.group_bounds(keys)
            for lo, n in zip(first.tolist(), size.tolist(), strict=True):
                key = tuple(int(x[lo]) for x in keys)
                if key != last:
                    yield from flush()
                    held, last = [], key
                held.append(batch.slice(lo, n))
        yield from flush()

    return compare


def _without_subsets(held: DataFrame, tops: int = 3) -> DataFrame:
    """Rows (c1, c2, bucket, size) of the buckets that no other bucket is known to hold in full.

    Runs find the same copies again and again. A bucket is dropped if all its rows have
    one other bucket among their ``tops`` largest; of equal buckets the first stays.
    """
    sizes = held.groupBy("bucket").agg(F.count("*").alias("rows"))
    sized = held.withColumn("k", apart("bucket")).join(sizes.select(apart("bucket").alias("k"), "rows"), "k").drop("k").filter("rows > 1")
    own = sized.groupBy("c1", "c2").agg(F.sort_array(F.collect_list(F.struct("rows", "bucket")), asc=False).alias("all"))
    pairs = own.select(F.explode("all").alias("a"), F.slice("all", 1, tops).alias("top")).select("a", F.explode("top").alias("b"))
    larger = pairs.filter((F.col("a.rows") < F.col("b.rows")) | ((F.col("a.rows") == F.col("b.rows")) & (F.col("a.bucket") < F.col("b.bucket"))))
    inside = larger.groupBy(F.col("a.bucket").alias("bucket"), F.col("a.rows").alias("rows"), F.col("b.bucket").alias("by")).agg(F.count("*").alias("n")).filter("n = rows")
    gone = inside.select(apart("bucket").alias("k")).distinct()
    return sized.withColumn("k", apart("bucket")).join(gone, "k", "left_anti").drop("k", "rows")


def _buckets(standing: Table, small: int) -> Table:
    """c1, c2, bucket and size: where the sets meet, and how many are there."""
    keys = ["p1", "p2", "p3"]
    steps = ordering.emitted(standing.read().select("c1", "c2", "paths"), _explode_paths, STEPS, keys, ["c1"], few(standing.read().select("c1", "c2", "paths"), SAMPLE_ROWS))
    placed, tables = ordering.equal_groups(steps, keys, ["c1"], [1, 2, 3], "paths")
    wide = small * 1.6  # a set takes 1.6 rows below a first step
    stays = (F.col("n1") <= wide) | (F.col("n2") * 2 > F.col("n1"))
    splits = (F.col("n2") <= small * 1.25) | (F.col("n3") * 2 > F.col("n2"))
    at = lambda p, n: F.struct(F.col(p).alias("bucket"), n.alias("size"))
    bucket = F.when(stays, at("p1", F.ceil(F.col("n1") / 1.5))).when(splits, at("p2", F.col("n2"))).otherwise(at("p3", F.col("n3")))
    held = Table(placed.select("c1", "c2", bucket.alias("x")).filter("x.size > 1").select("c1", "c2", "x.*").distinct(), "buckets")
    ordering.drop(tables)
    return held


def ngram_classes(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, recall: float = RECALL, small: int = SMALL, block: int = BLOCK, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, class_id, n_links and first of each row, with k1 and k2 (``texts.row_key``).

    ``first`` marks one document of each class, the one of the smallest doc_id, and one of all
    that have no words: those are copies of each other, though they link with nothing.

    Rows link if the Jaccard similarity of their sets of word ``shingle``-grams is at least
    ``similarity``; the set of a shorter text has one shingle, all its words. ``n_links``
    counts the other rows linked to a row, ``class_id`` is the smallest doc_id that
    links lead to, null only if there is none. Texts with equal sets are one node of the search
    and count as often as they are there. Null and empty texts, and texts of white space, link
    with nothing and are classes of their own. Rows that repeat a doc_id or have none are rows
    of their own and link by their texts alone. Empty tables give an empty result; other
    columns are not looked at, whatever their names.

    Sets go down paths of sampled tokens: a node of the path tree draws a random order of
    all tokens and splits its sets by their first one. Buckets of at most ``small`` sets,
    and buckets that a step does not split further, are compared in full, larger ones
    by pairs of blocks of about ``block`` sets; as many runs are made as ``recall`` needs. A link
    is counted in the first bucket that holds both sides; a bucket sends on a spanning forest
    of its links and their numbers, not the links.
    """
    base = keyed(docs, doc_id, text)
    node, row = ["c1", "c2"], ["did", "k1", "k2"]
    runs = runs_for(recall, similarity)
    drawn = Table(base.mapInArrow(_emit_paths(shingle, runs, similarity), PATHS), "paths")
    grouped, tables = ordering.equal_groups(ordering.ranged(drawn.read(), node, row), node, row, [2], "sets", keep_single=True)
    head = F.struct(*[F.col(f"h2_{c}").alias(c) for c in row])
    named = grouped.withColumns({"own": F.struct(*row), "head": head, "some": F.length("paths") > 0, "copies": F.col("n2")})
    members = Table(named.select(*node, "own", "head", "some", "copies"), "members")
    # rows that repeat wholly share their key: one of them stands for all
    standing = Table(named.filter("own = head AND some").select(*node, *row, "copies", "paths").dropDuplicates(node), "standing")
    ordering.drop([*tables, drawn])

    held = _buckets(standing, small)
    into = _without_subsets(held.read()).groupBy(*node).agg(F.collect_list(F.struct("bucket", "size")).alias("into"))
    sets = standing.read().select(*node, *row, "copies")
    met = base.select("text", "k1", "k2").join(into.join(sets.drop("did"), node), ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    sent = met.select("text", *node, "copies", "into").mapInArrow(_send_sets(shingle, block), CELLS)
    cells = sent.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "c1")
    found = Table(cells.mapInArrow(_compare(similarity), LINKS), "links")
    held.drop()

    edges = found.read().filter("b1 IS NOT NULL").select(F.struct(*node).alias("a"), F.struct(F.col("b1").alias("c1"), F.col("b2").alias("c2")).alias("b"))
    label = components(edges, "ngram").select(F.col("node.*"), "component")
    label = label.join(sets, node).select(*node, "component", F.struct(*row).alias("own"))
    least = label.groupBy("component").agg(F.min("own").alias("least"))
    label = label.withColumn("k", apart("component")).join(least.select(apart("component").alias("k"), "least"), "k")
    links = found.read().filter("b1 IS NULL").groupBy(*node).agg(F.sum("links").alias("links"))
    known = Table(links.join(label, node).select(*node, "links", "least"), "labels")
    nodes = F.struct(*node)
    out = members.read().withColumn("k", nodes).join(known.read().select(nodes.alias("k"), "links", "least"), "k", "left")
    n_links = F.when(F.col("some"), F.coalesce("links", F.lit(0)) + F.col("copies") - 1).otherwise(0)
    leads = F.coalesce("least", "head")
    at = F.when(F.col("some"), leads.did).otherwise(F.col("own.did"))
    clean = lambda c: F.when(c != NO_ID, c)
    first = F.when(F.col("some"), F.col("own") == leads).otherwise(F.col("own") == F.col("head"))
    return out.select(clean(F.col("own.did")).alias("doc_id"), clean(at).alias("class_id"), n_links.cast("long").alias("n_links"), first.alias("first"), "own.k1", "own.k2")


def one_of_each_class(docs: DataFrame) -> DataFrame:
    """``docs``, all its columns, with one row of each class, that of the smallest doc_id; of texts without words too.

    Rows without a doc_id come after the others; of rows that repeat wholly one stays.
    """
    stays = ngram_classes(docs).filter("first").select("k1", "k2").distinct()
    own = with_keys(docs)
    met = own.join(stays, ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    return met.select(*own.columns[: len(docs.columns)]).toDF(*docs.columns)
