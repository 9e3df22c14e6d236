"""Near-duplicate embeddings: a robust-pruned flat graph, united over overlapping shards, and range search on it.

1. Vectors go to the shards of their nearest centers, in several sets of centers.
2. In each shard the vectors get adjacency lists by robust pruning.
3. The lists of a vector are united over its shards: together they are one flat graph, a table.
4. Each shard's vectors search the graph, greedily from the medoid and from their own lists, then
   expanding the range. A shard holds the vectors of other shards too that the lists of its
   own name, as far as they are near enough to be on the way to a link (its *halo*).
5. Cosines are verified in double precision; a sample of all vectors is held against all
   others, and where recall falls short all is done again with more sets of centers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.cluster import ship
from quillon.llm import ordering
from quillon.llm.components import apart, components
from quillon.llm.ngram_join import _mix1
from quillon.llm.storage import Table
from quillon.llm.texts import NO_ID

THRESHOLD = 0.93
#: Vectors in a shard, shards a vector goes to in each set of centers, sets at least, and centers at most.
SHARD, OVERLAP, SETS, MAX_CENTERS = 600, 2, 2, 8192
#: The share of pairs at the threshold that are to meet in a shard, the pairs it is measured on, and sets at most.
RECALL, TRIALS, MAX_SETS = 0.9999, 4000, 24
#: Vectors of a shard's block; a larger shard is searched block pair by block pair.
BLOCK = 1024
#: Neighbours kept by pruning, candidates for them, long-range neighbours, and the search's beam steps.
DEGREE, CANDIDATES, FAR, BEAM, ALPHA = 16, 40, 4, 4, 1.2
#: The search goes on from vectors within this multiple of the threshold's angle.
REACH = 1.25
#: Vectors that are held against all others, and the recall that has to be seen there.
AUDITED, AUDIT_RECALL, ATTEMPTS = 512, 0.999, 3

PLACED = "label long, shard long, did long, copies long, raw binary"
LISTS = "label long, did long, list binary, near binary"
LOADED = "label long, shard long, i int, j int, own int, did long, copies long, raw binary, member boolean, inside binary, around binary, list binary"
LINKS = "did long, links long, b long"


def usable(vector: list | None, label: int | None) -> np.ndarray | None:
    """The vector with length 1 in double precision; None if it links with nothing."""
    if vector is None or label is None or any(x is None for x in vector):
        return None
    return _unit(np.array(vector, np.float64))


def _unit(x: np.ndarray) -> np.ndarray | None:
    norm = math.sqrt(float(x @ x)) if len(x) and np.isfinite(x).all() else 0.0
    if not norm or not math.isfinite(norm):
        top = np.abs(x).max() if len(x) and np.isfinite(x).all() else 0.0
        if not top:
            return None
        x = x / top
        norm = math.sqrt(float(x @ x))
    return x / norm


def packed(x: np.ndarray) -> bytes:
    """The components, in four bytes each where that loses nothing."""
    with np.errstate(over="ignore"):
        short = x.astype(np.float32)
    return b"f" + short.tobytes() if np.array_equal(short.astype(np.float64), x) else b"d" + x.tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    """The unit vector of packed components."""
    return _unit(np.frombuffer(raw, np.float32 if raw[:1] == b"f" else np.float64, offset=1).astype(np.float64))


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, labels, rows = batch.column("did").to_pylist(), batch.column("label").to_pylist(), batch.column("embedding").to_pylist()
        unit = [usable(v, label) for v, label in zip(rows, labels, strict=True)]
        raw = [None if u is None else packed(np.array(v, np.float64)) for u, v in zip(unit, rows, strict=True)]
        keys = [xxhash.xxh3_128_digest(b"%d" % i, seed=1) if u is None else xxhash.xxh3_128_digest(u.tobytes()) for u, i in zip(unit, ids, strict=True)]
        h = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([NO_ID if x is None else x for x in labels], pa.int64()), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(raw, pa.binary())], names=["did", "label", "v1", "v2", "raw"])


# centers


def _spread(rows: list[np.ndarray], k: int) -> list[np.ndarray]:
    """Up to k of the rows, no two of which are close."""
    chosen: list[np.ndarray] = []
    by_width: dict[int, np.ndarray] = {}
    held: dict[int, int] = {}
    for x in rows:
        if len(chosen) >= k:
            break
        own, n = by_width.setdefault(len(x), np.zeros((k, len(x)))), held.get(len(x), 0)
        if not n or float((own[:n] @ x).max()) < 0.8:
            own[n], held[len(x)] = x, n + 1
            chosen.append(x)
    return chosen


def _nearest(units: np.ndarray, centers: list[np.ndarray], overlap: int) -> np.ndarray:
    """For each row of units the nearest centers; those of other lengths come last."""
    near = np.full((len(units), len(centers)), -2.0)
    same = [i for i, c in enumerate(centers) if len(c) == units.shape[1]]
    if same:
        near[:, same] = units @ np.stack([centers[i] for i in same]).T
    if len(centers) > 8 * overlap:
        some = np.argpartition(-near, overlap, axis=1)[:, :overlap]
        return np.take_along_axis(some, np.argsort(-np.take_along_axis(near, some, 1), axis=1, kind="stable"), 1)
    return np.argsort(-near, axis=1, kind="stable")[:, :overlap]


def center_sets(rows: list[np.ndarray], k: int, threshold: float, least: int = SETS) -> list[list[np.ndarray]]:
    """Sets of up to k centers, as many as pairs at the threshold need to meet with the probability ``RECALL``.

    That is measured on pairs of a row and a vector at the threshold from it, in any direction.
    """
    sets = [c for c in (_spread(rows[s::SETS], k) for s in range(SETS)) if c]
    if not sets:
        return sets
    rng = np.random.default_rng(k)
    pairs, lonely = [], []
    for width in sorted({len(x) for x in rows}):
        mine = [x for x in rows if len(x) == width]
        x = np.stack([mine[i] for i in rng.integers(0, len(mine), -(-TRIALS * len(mine) // len(rows)))])
        side = rng.normal(size=x.shape)
        side -= (side * x).sum(1, keepdims=True) * x
        norm = np.linalg.norm(side, axis=1, keepdims=True)
        cosine = min(1.0, max(-1.0, threshold))
        pairs.append((x, cosine * x + math.sqrt(1 - cosine**2) * side / np.where(norm > 0, norm, 1)))
        lonely.append(np.ones(len(x), bool))
    chance, done = 1.0, 0
    while True:
        for centers in sets[done:]:
            lone = []
            for (x, y), both in zip(pairs, lonely, strict=True):
                a, b = _nearest(x, centers, OVERLAP), _nearest(y, centers, OVERLAP)
                lone.append(~(a[:, :, None] == b[:, None, :]).any((1, 2)))
                both &= lone[-1]
            chance *= max(np.concatenate(lone).mean(), 1 / TRIALS)
        done = len(sets)
        if (done >= least and chance <= 1 - RECALL and not any(x.any() for x in lonely)) or done >= MAX_SETS:
            return sets
        sets.append(_spread([rows[i] for i in rng.permutation(len(rows))], k))


def _route(sets: list[list[np.ndarray]], overlap: int):
    """A row for each shard that a vector goes to."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = [unpacked(u) for u in batch.column("raw").to_pylist()]
            width, mine = np.array([len(x) for x in units]), [[] for _ in units]
            for w in np.unique(width):
                at, base = np.flatnonzero(width == w), 0
                x = np.stack([units[i] for i in at])
                for centers in sets:
                    for i, near in zip(at.tolist(), (base + _nearest(x, centers, overlap)).tolist(), strict=True):
                        mine[i] += near
                    base += len(centers)
            row = np.repeat(np.arange(len(units)), [len(x) for x in mine])
            part = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([part.column("label"), pa.array([s for x in mine for s in x], pa.int64()), *(part.column(x) for x in ("did", "copies", "raw"))], names=["label", "shard", "did", "copies", "raw"])

    return route


def _deal(block: int):
    """A row for each pair of blocks of its shard that a vector is in; ``n`` is the shard's size."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            did, shard, n = (ordering.numbers(batch, x).tolist() for x in ("did", "shard", "n"))
            row, i, j, own = [], [], [], []
            for k in range(batch.num_rows):
                blocks = -(-n[k] // block)
                mine = _mix1(did[k] ^ _mix1(shard[k] + 77)) % blocks
                for other in range(blocks):
                    row.append(k)
                    i.append(min(mine, other))
                    j.append(max(mine, other))
                    own.append(mine)
            part = batch.take(pa.array(row, pa.int64())).drop_columns(["n"])
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x, pa.int32()) for x in (i, j, own))], names=[*part.schema.names, "i", "j", "own"])

    return deal


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, ...], pa.Table]]:
    """The rows of each (label, shard, i, j); they come sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [ordering.numbers(batch, x) for x in ("label", "shard", "i", "j")]
        first, size = ordering.group_bounds(keys)
        for lo, n in zip(first.tolist(), size.tolist(), strict=True):
            key = tuple(int(x[lo]) for x in keys)
            if key != last:
                if held:
                    yield last, pa.Table.from_batches(held).combine_chunks()
                held, last = [], key
            held.append(batch.slice(lo, n))
    if held:
        yield last, pa.Table.from_batches(held).combine_chunks()


def _by_width(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of vectors of one length, and the vectors."""
    units = [unpacked(x) for x in table.column("raw").to_pylist()]
    width = np.array([len(x) for x in units])
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        yield at, np.stack([units[k] for k in at])


# the graph


def robust_pruned_lists(unit: np.ndarray) -> np.ndarray:
    """The neighbours of each vector, nearest first; the vector itself fills up short lists.

    Of the nearest candidates one is kept if no neighbour kept before it is nearer to it, by
    the factor ``ALPHA``, than the vector is.
    """
    m = len(unit)
    k = min(CANDIDATES, m - 1)
    own = np.arange(m)
    picked = np.repeat(own[:, None], DEGREE, axis=1)
    if k < 1:
        return picked
    near, distance = np.zeros((m, k), np.int64), np.zeros((m, k))
    for lo in range(0, m, 256):
        away = np.sqrt(np.maximum(0.0, 2 - 2 * (unit[lo : lo + 256] @ unit.T)))
        away[np.arange(len(away)), own[lo : lo + 256]] = np.inf
        some = np.argpartition(away, k - 1, axis=1)[:, :k] if k < m - 1 else np.argsort(away, axis=1)[:, :k]
        some = np.take_along_axis(some, np.argsort(np.take_along_axis(away, some, 1), axis=1, kind="stable"), 1)
        near[lo : lo + 256], distance[lo : lo + 256] = some, np.take_along_axis(away, some, 1)
    alive, at = np.ones(near.shape, bool), np.arange(m)
    between = np.zeros((m, k, k), np.float32)  # distances of a vector's candidates from each other
    for lo in range(0, m, 256):
        held = unit[near[lo : lo + 256]].astype(np.float32)
        between[lo : lo + 256] = np.sqrt(np.maximum(0.0, 2 - 2 * (held @ held.transpose(0, 2, 1))))
    between[:, np.arange(k), np.arange(k)] = 0
    for r in range(min(DEGREE, k)):
        some = alive.any(1)
        if not some.any():
            break
        first = alive.argmax(1)
        picked[some, r] = near[some, first[some]]
        alive &= ALPHA * between[at, first] > distance
        alive[at, first] = False
    return picked


def _short(did: np.ndarray) -> np.ndarray:
    """What lists know a vector by; two that agree make a needless step of the search, no more."""
    x = did.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(27))) >> np.uint64(32)).astype(np.uint32)


def _build(threshold: float):
    """Adjacency lists of each shard: all neighbours, and the ids of those that may be on the way to a link."""
    angle = math.acos(min(1.0, max(-1.0, threshold)))
    bound = math.cos(min(math.pi, 2 * REACH * angle))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, table in _cells(batches):
            did = ordering.numbers(table, "did")
            for at, unit in _by_width(table):
                if len(at) < 2:
                    continue
                lists, mine = robust_pruned_lists(unit), did[at]
                known = _short(mine)[lists]
                close = np.einsum("id,ikd->ik", unit, unit[lists]) >= bound
                close &= lists != np.arange(len(at))[:, None]
                near = [mine[x[c]].tobytes() for x, c in zip(lists, close, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), key[0])), pa.array(mine), pa.array([x.tobytes() for x in known], pa.binary()), pa.array(near, pa.binary())], names=["label", "did", "list", "near"])

    return build


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lists of each vector as one."""
    for batch in batches:
        out = {}
        for name, kind in (("lists", np.uint32), ("nears", np.int64)):
            out[name] = [np.unique(np.frombuffer(b"".join(x or ()), kind)).tobytes() for x in batch.column(name).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("did"), pa.array(out["lists"], pa.binary()), pa.array(out["nears"], pa.binary())], names=["label", "did", "list", "near"])


def _explode_near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        near = [np.frombuffer(x, np.int64) for x in batch.column("near").to_pylist()]
        row = np.repeat(np.arange(len(near)), [len(x) for x in near])
        if len(row):
            yield pa.RecordBatch.from_arrays([batch.column("did").take(pa.array(row)), pa.array(np.concatenate(near))], names=["did", "x"])


# the search


def range_search(unit: np.ndarray, links: list[np.ndarray], threshold: float, beam: int = BEAM, reach: float = REACH, seed: int = 0) -> np.ndarray:
    """Which vectors each one finds within the threshold, in a graph of lists and their reverse.

    Greedy steps from the medoid and the vector's own place, then the range expands from all that
    lies within ``reach`` times the threshold's angle. Cosines are computed for what is met alone,
    in single precision, and in double precision where they come near the threshold.
    """
    m = len(unit)
    rng = np.random.default_rng(seed)
    a = np.repeat(np.arange(m), [len(x) for x in links])
    b = np.concatenate(links) if m else a
    far = rng.integers(0, m, m * FAR)
    a, b = np.concatenate([a, b, np.repeat(np.arange(m), FAR), far]), np.concatenate([b, a, far, np.repeat(np.arange(m), FAR)])
    graph = np.zeros((m, m), bool)
    graph[a, b] = True
    np.fill_diagonal(graph, False)
    edge_of, edge_to = np.nonzero(graph)
    first = np.searchsorted(edge_of, np.arange(m + 1))
    wide = math.cos(min(math.pi, reach * math.acos(min(1.0, max(-1.0, threshold)))))
    rows, short = np.arange(m), unit.astype(np.float32)
    cosine = np.full((m, m), -3.0, np.float32)  # of what has been met

    def meet(q: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Looks at the neighbours of x for the queries q; returns the new pairs as places in the matrix."""
        size = first[x + 1] - first[x]
        to = edge_to[np.repeat(first[x] - np.cumsum(size) + size, size) + np.arange(size.sum())]
        flat = np.repeat(q, size) * m + to
        flat = np.unique(flat[cosine.ravel()[flat] == -3.0])
        for lo in range(0, len(flat), 1 << 15):
            part = flat[lo : lo + (1 << 15)]
            cosine.ravel()[part] = np.einsum("id,id->i", short[part // m], short[part % m])
        return flat

    medoid = int((unit @ unit.sum(0)).argmax())
    cosine[:, medoid] = short @ short[medoid]
    cosine[rows, rows] = 1.0
    waiting = np.full((m, m), -3.0, np.float32)
    waiting[rows, rows] = cosine[rows, rows]
    waiting[:, medoid] = cosine[:, medoid]
    done = np.zeros((m, m), bool)
    for _ in range(beam):
        best = waiting.argmax(1)
        go = rows[waiting[rows, best] > -3.0]
        if not len(go):
            break
        done[go, best[go]] = True
        waiting[go, best[go]] = -3.0
        new = meet(go, best[go])
        waiting.ravel()[new] = cosine.ravel()[new]
    while True:
        q, x = np.nonzero((cosine >= wide) & ~done)
        if not len(q):
            break
        for lo in range(0, len(q), 1 << 16):
            done[q[lo : lo + (1 << 16)], x[lo : lo + (1 << 16)]] = True
            meet(q[lo : lo + (1 << 16)], x[lo : lo + (1 << 16)])
    found = np.zeros((m, m), bool)
    q, x = np.nonzero(cosine >= threshold - 1e-4)
    for lo in range(0, len(q), 1 << 15):
        i, j = q[lo : lo + (1 << 15)], x[lo : lo + (1 << 15)]
        found[i, j] = np.einsum("id,id->i", unit[i], unit[j]) >= threshold
    found |= found.T
    np.fill_diagonal(found, False)
    return found


def _counted_before(shard: int, inside: list[np.ndarray], around: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each earlier shard: the rows that are its own, and all that it holds; their pairs count there."""
    own: dict[int, list[int]] = {}
    held: dict[int, list[int]] = {}
    for k, (x, y) in enumerate(zip(inside, around, strict=True)):
        for s in x[x < shard].tolist():
            own.setdefault(s, []).append(k)
            held.setdefault(s, []).append(k)
        for s in y[y < shard].tolist():
            held.setdefault(s, []).append(k)
    for s, rows in own.items():
        yield np.array(rows), np.array(held[s])


def _search(threshold: float):
    schema = pa.schema([("did", pa.int64()), ("links", pa.int64()), ("b", pa.int64())])

    def cell(shard: int, i: int, j: int, table: pa.Table) -> pa.RecordBatch | None:
        did, copies, own, member = (ordering.numbers(table, x) for x in ("did", "copies", "own", "member"))
        lists = [np.frombuffer(x, np.uint32) for x in table.column("list").to_pylist()]
        inside, around = ([np.frombuffer(x, np.int64) for x in table.column(c).to_pylist()] for c in ("inside", "around"))
        found = np.zeros((len(did), len(did)), bool)
        for at, unit in _by_width(table):
            short = _short(did[at])
            order = np.argsort(short, kind="stable")
            place, links = short[order], []
            for k in at.tolist():
                hit = np.searchsorted(place, lists[k])
                ok = (hit < len(place)) & (place[np.minimum(hit, len(place) - 1)] == lists[k])
                links.append(order[hit[ok]])
            found[np.ix_(at, at)] = range_search(unit, links, threshold, seed=shard)
        found &= member[:, None] | member[None, :]  # both of another shard: counted there
        for mine, all_there in _counted_before(shard, inside, around):
            found[np.ix_(mine, all_there)] = False
            found[np.ix_(all_there, mine)] = False
        if i != j:
            found &= own[:, None] != own[None, :]
        links = found @ copies
        some = np.flatnonzero(links)
        if not len(some):
            return None
        edges, left = [], np.ones(len(did), bool)
        for start in some.tolist():  # a spanning tree of each local component
            if not left[start]:
                continue
            left[start] = False
            todo = [start]
            while todo:
                x = todo.pop()
                new = np.flatnonzero(found[x] & left)
                left[new] = False
                edges += [(x, y) for y in new.tolist()]
                todo += new.tolist()
        a, b = np.array(edges, np.int64).reshape(-1, 2).T
        return pa.RecordBatch.from_arrays([pa.array(np.append(did[some], did[a])), pa.array(np.append(links[some], np.zeros(len(a), np.int64))), pa.array([None] * len(some) + did[b].tolist(), pa.int64())], schema=schema)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, table in _cells(batches):
            if table.num_rows > 1 and (got := cell(key[1], key[2], key[3], table)) is not None:
                yield got

    return search


def _pack_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sent = {n: [np.array(sorted(x or ()), np.int64).tobytes() for x in batch.column(n).to_pylist()] for n in ("inside", "around")}
        names = [n for n in batch.schema.names if n not in sent]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *(pa.array(x, pa.binary()) for x in sent.values())], names=[*names, *sent])


def _in_cells(rows: DataFrame, sizes: DataFrame, schema: str) -> DataFrame:
    """Rows dealt to the block pairs of their shards and sorted by them."""
    key = F.struct("label", "shard").alias("k")
    met = rows.withColumn("k", key).join(sizes.select(key, "n"), "k").drop("k")
    return met.mapInArrow(_deal(BLOCK), schema).repartition("label", "shard", "i", "j").sortWithinPartitions("label", "shard", "i", "j", "did")


def _links(standing: Table, sets: list[list[np.ndarray]], threshold: float) -> Table:
    """did and its number of links (b null), or a link (did, b) of a spanning forest."""
    nodes = ["label", "did", "copies", "raw"]
    routed = standing.read().select(*nodes).mapInArrow(_route(sets, OVERLAP), PLACED)
    sizes = Table(routed.groupBy("label", "shard").agg(F.count("*").alias("n")), "sizes")
    cells = _in_cells(routed, sizes.read(), PLACED + ", i int, j int, own int")
    lists = cells.mapInArrow(_build(threshold), LISTS)
    united = lists.groupBy("label", "did").agg(F.collect_list("list").alias("lists"), F.collect_list("near").alias("nears")).mapInArrow(_unite, LISTS)
    graph = Table(united, "graph")
    # a vector that a list names is needed, if it is near, in all shards of the list's owner
    inside = Table(routed.groupBy("did").agg(F.collect_set("shard").alias("inside")), "inside")
    steps = graph.read().filter(F.length("near") > 0).select("did", "near").mapInArrow(_explode_near, "did long, x long")
    both = steps.unionByName(steps.select(F.col("x").alias("did"), F.col("did").alias("x"))).distinct()
    there = both.join(inside.read(), "did").select("x", F.explode("inside").alias("s")).distinct()
    halo = there.join(inside.read().select(F.col("did").alias("x"), "inside"), "x").filter(~F.array_contains("inside", F.col("s"))).groupBy("x").agg(F.collect_set("s").alias("around"))
    known = inside.read().join(halo.withColumnRenamed("x", "did"), "did", "left")
    flat = standing.read().select(*nodes).join(known, "did").join(graph.read().select("did", "list"), "did", "left").withColumn("list", F.coalesce("list", F.lit(b"")))
    places = F.concat(F.transform("inside", lambda s: F.struct(s.alias("shard"), F.lit(True).alias("member"))), F.transform(F.coalesce("around", F.array().cast("array<bigint>")), lambda s: F.struct(s.alias("shard"), F.lit(False).alias("member"))))
    spread = flat.withColumn("at", places)
    packed_rows = spread.select(*nodes, "list", "at", "inside", "around").mapInArrow(_pack_shards, "label long, did long, copies long, raw binary, list binary, at array<struct<shard: long, member: boolean>>, inside binary, around binary")
    loaded = packed_rows.withColumn("at", F.explode("at")).select("label", "at.shard", "did", "copies", "raw", "at.member", "inside", "around", "list")
    dealt = _in_cells(loaded, sizes.read(), "label long, shard long, did long, copies long, raw binary, member boolean, inside binary, around binary, list binary, i int, j int, own int")
    found = Table(dealt.mapInArrow(_search(threshold), LINKS), "links")
    ordering.drop([sizes, graph, inside])
    return found


# the audit


def _count_true(sample: list[tuple[int, int, bytes]], threshold: float):
    """Links of the sampled vectors among the rows of a task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(sample), np.int64)
        held: dict[tuple[int, int], list[int]] = {}
        units = [unpacked(raw) for _, _, raw in sample]
        for k, (label, _, _) in enumerate(sample):
            held.setdefault((label, len(units[k])), []).append(k)
        dids = np.array([d for _, d, _ in sample])
        for batch in batches:
            label, did, copies = (ordering.numbers(batch, x) for x in ("label", "did", "copies"))
            for at, x in _by_width(pa.Table.from_batches([batch])) if batch.num_rows else ():
                for value in np.unique(label[at]).tolist():
                    asked = held.get((value, x.shape[1]))
                    if asked:
                        rows = np.flatnonzero(label[at] == value)
                        hit = np.stack([units[k] for k in asked]) @ x[rows].T >= threshold
                        hit &= dids[asked][:, None] != did[at][rows][None, :]
                        n[asked] += hit @ copies[at][rows]
        yield pa.RecordBatch.from_arrays([pa.array(dids), pa.array(n)], names=["did", "n"])

    return count


def audited_recall(standing: Table, found: Table, threshold: float, rows: int = AUDITED) -> float:
    """The share of links of ``rows`` vectors, held against all others, that the search has found."""
    picked = standing.read().orderBy(F.xxhash64("v1", F.lit(9)), "did").limit(rows).select("label", "did", "raw").collect()
    sample = [(r["label"], r["did"], bytes(r["raw"])) for r in picked]
    if not sample:
        return 1.0
    true = standing.read().select("label", "did", "copies", "raw").mapInArrow(_count_true(sample, threshold), "did long, n long").groupBy("did").agg(F.sum("n").alias("n"))
    links = found.read().filter("b IS NULL").groupBy("did").agg(F.sum("links").alias("links"))
    all_links, seen = true.join(links, "did", "left").agg(F.sum("n"), F.sum(F.least("n", F.coalesce("links", F.lit(0))))).first()
    return seen / all_links if all_links else 1.0


def near_duplicate_vectors(embeddings: DataFrame, threshold: float = THRESHOLD, shard: int = SHARD) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row.

    Rows with one label link if their cosine, in double precision, reaches the threshold. Vectors
    that are null, zero, or hold null or non-finite components, and rows without a label, link
    with nothing; vectors of different lengths do not link. Equal vectors are one in the
    search and count as often as they are there. Rows that share a vec_id are one node of a
    component; a null vec_id is a node of its own value. Empty tables give an empty result;
    other columns are not looked at, whatever their names.

    The method is that of this module's head. A link counts in the first shard that holds both
    sides, one of them as its own; shards send numbers of links and spanning trees. Shards
    grow in number with the data, up to ``MAX_CENTERS`` a set and label; what is larger than
    ``BLOCK`` is searched by pairs of blocks, all of which meet.
    """
    spark = embeddings.sparkSession
    ship(spark)
    own = embeddings.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("did"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    ready = Table(own.mapInArrow(_prepare, "did long, label long, v1 long, v2 long, raw binary"), "vectors")
    keys = ["label", "v1", "v2"]
    grouped, below = ordering.equal_groups(ordering.ranged(ready.read(), keys, ["did"]), keys, ["did"], [3], "copies", keep_single=True)
    named = grouped.select(*keys, "did", F.col("n3").alias("copies"), F.col("h3_did").alias("head"), "raw")
    members = Table(named.select("did", "copies", "head", F.col("raw").isNotNull().alias("some")), "members")
    standing = Table(named.filter("raw IS NOT NULL AND did = head").dropDuplicates(keys).select("label", "did", "copies", "raw", "v1"), "standing")
    ordering.drop([*below, ready])
    n, labels = standing.read().agg(F.count("*"), F.approx_count_distinct("label")).first()
    k = max(1, min(MAX_CENTERS, math.ceil(n * OVERLAP / (shard * max(1, labels)))))
    picked = standing.read().orderBy(F.xxhash64("v1"), "did").limit(min(8 * k, 4 * k + 4096) * SETS).select("raw").collect()  # MAX_CENTERS bounds them
    rows = [unpacked(bytes(r["raw"])) for r in picked]
    least = SETS
    for attempt in range(ATTEMPTS):
        found = _links(standing, center_sets(rows, k, threshold, least), threshold)
        if attempt == ATTEMPTS - 1 or audited_recall(standing, found, threshold) >= AUDIT_RECALL:
            break
        found.drop()
        least = min(MAX_SETS, 3 * max(least, SETS))
    standing.drop()
    edges = found.read().filter("b IS NOT NULL").select(F.col("did").alias("a"), "b")
    # equal vectors link too: their ids meet at the smallest
    edges = edges.unionByName(members.read().filter("some AND did <> head").select(F.col("did").alias("a"), F.col("head").alias("b")))
    label = components(edges, "vectors")
    links = found.read().filter("b IS NULL").groupBy("did").agg(F.sum("links").alias("links"))
    known = Table(label.withColumnRenamed("node", "did").join(links, "did", "full").select(apart("did").alias("k"), "links", "component"), "labels")
    by_head = members.read().withColumn("k", apart("head")).join(known.read(), "k", "left")
    n_links = F.when(F.col("some"), F.coalesce("links", F.lit(0)) + F.col("copies") - 1).otherwise(0)
    component = F.when(F.col("some"), F.coalesce("component", "head")).otherwise(F.col("did"))
    clean = lambda c: F.when(c != NO_ID, c)
    return by_head.select(clean(F.col("did")).alias("vec_id"), n_links.cast("long").alias("n_links"), clean(component).alias("component_id"), (F.col("did") == component).alias("kept"))
