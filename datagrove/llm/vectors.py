"""Operator 8: near-duplicate vectors by a pivot-permutation index.

Pivots are vectors of a bounded sample (least hash first), filled up with random ones, and kept APART reaches (largest
distances of a link) from each other, so a dense group has few of them. A vector is described by its nearest pivots: all
whose cell a vector within reach may lie in, if they are PREFIX at most, else the PREFIX nearest. The first kind misses no
link: whatever is within reach stands in the list of its own nearest pivot, which is one of them. An inverted list holds, for
each label and pivot, the vectors that have the pivot in their prefix. All pairs of a list are compared by cosine in double
precision; a link counts in the list of the first pivot that its ends share. The number of pivots follows the number of
vectors up to MAX_PIVOTS, so lists stay short; long lists are dealt into blocks, and pairs of blocks are compared in tasks
of their own. Links between two vectors of the second kind that share no pivot are missed.

Equal vectors of a label are one node. Links are counted and joined inside the blocks: no table of all pairs is made.
Vectors that are null, zero or hold null or non-finite components, and rows with a null label, link with nothing. Rows
that share an id are one node; rows with a null id link with nothing and have a null component. Vectors of different
lengths never link.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, written
from .components import components, forest

MIN_PIVOTS, MAX_PIVOTS, PREFIX, SHARED = 128, 2048, 8, 1
APART, SAMPLE_ROWS = 3, 4
LIST_ROWS, BLOCK_ROWS = 1500, 1024
_NONE = 0xFFFF
_RNG_SEED = 8


def _unit(values) -> np.ndarray | None:
    if values is None or any(v is None for v in values):
        return None
    x = np.array(values, float)
    if not len(x) or not np.isfinite(x).all():
        return None
    top = np.abs(x).max()
    if not top:
        return None
    x = x / top
    return x / np.sqrt(x @ x)


def _checked(rows: DataFrame) -> DataFrame:
    """vec_id, label and, for vectors that can link, dims, key and the unit vector."""

    def run(batches):
        for batch in batches:
            for ids, labels, vectors in slices(batch, ["vec_id", "label", "embedding"], 1024):
                units = [_unit(v) if i is not None and l is not None else None for i, l, v in zip(ids, labels, vectors, strict=True)]
                raw = [None if u is None else (u + 0.0).astype("<f8").tobytes() for u in units]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(labels, pa.string()), pa.array([None if u is None else len(u) for u in units], pa.int32()), pa.array([None if r is None else xxhash.xxh3_128_digest(r) for r in raw], pa.binary()), pa.array(raw, pa.binary())],
                    ["vec_id", "label", "dims", "key", "unit"],
                )

    return rows.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast("array<double>")).mapInArrow(run, "vec_id long, label string, dims int, key binary, unit binary")


def _apart(have: np.ndarray, more: np.ndarray, reach: float, count: int) -> np.ndarray:
    """have and those of more that keep their distance from all taken before, count at most."""
    out = np.concatenate([have, np.zeros((max(0, count - len(have)), more.shape[1]))])
    n, most = len(have), 1 - min(APART * reach, 1.0) ** 2 / 2
    for v in more:
        if n >= count:
            break
        if not n or (out[:n] @ v).max() <= most:
            out[n] = v
            n += 1
    return out[:n]


def _pivots(nodes: DataFrame, count: int, reach: float) -> dict[int, np.ndarray]:
    """By length of vector: up to count vectors of a sample, apart from each other."""
    sample = nodes.orderBy(F.xxhash64("key"), "key").limit(SAMPLE_ROWS * count).select("dims", "unit").collect()
    out: dict[int, list] = {}
    for r in sample:
        out.setdefault(r.dims, []).append(np.frombuffer(r.unit, "<f8"))
    return {d: _apart(np.zeros((0, d)), np.array(v), reach, count) for d, v in out.items()}


def _fill(pivots: dict[int, np.ndarray], dims: int, count: int, reach: float) -> np.ndarray:
    """The pivots of a length, with random ones where the sample has fewer than count."""
    have = pivots.get(dims, np.zeros((0, dims)))
    if len(have) < count:
        more = np.random.default_rng(_RNG_SEED).normal(size=(count - len(have), dims))
        have = _apart(have, more / np.linalg.norm(more, axis=1)[:, None], reach, count)
    return have


def _prefixes(x: np.ndarray, pivots: np.ndarray, gaps: np.ndarray, reach: float) -> np.ndarray:
    """PREFIX pivots of each vector, _NONE where it needs fewer; gaps: distances of the pivots."""
    dots = x @ pivots.T
    order = np.argsort(-dots, axis=1, kind="stable")[:, :PREFIX]
    near = np.full((len(x), PREFIX), _NONE, "<u2")
    near[:, : order.shape[1]] = order
    # A vector within reach may be nearer to another pivot than to first only if the plane between both is within reach.
    first = order[:, 0]
    needed = dots[np.arange(len(x)), first][:, None] - dots <= reach * gaps[first] + 1e-9
    for k in np.flatnonzero(needed.sum(1) <= PREFIX):
        some = np.flatnonzero(needed[k])
        near[k] = _NONE
        near[k, : len(some)] = some[np.argsort(-dots[k, some], kind="stable")]
    return near


def _postings(nodes: DataFrame, pivots: dict[int, np.ndarray], count: int, reach: float) -> DataFrame:
    """A row for each node and pivot of its prefix; prefix holds all of them, nearest first."""

    def run(batches):
        filled: dict = {}
        for batch in batches:
            for node, label, dims, size, unit in slices(batch, ["node", "label", "dims", "size", "unit"], 1024):
                rows = [[] for _ in range(7)]
                for d in set(dims):
                    some = [k for k, v in enumerate(dims) if v == d]
                    x = np.frombuffer(b"".join(unit[k] for k in some), "<f8").reshape(-1, d)
                    if d not in filled:
                        own = _fill(pivots, d, count, reach)
                        filled[d] = own, np.sqrt(np.maximum(2 - 2 * own @ own.T, 0))
                    for k, p in zip(some, _prefixes(x, *filled[d], reach), strict=True):
                        for pivot in p[p != _NONE].tolist():
                            for column, value in zip(rows, (label[k], d, pivot, node[k], size[k], p.tobytes(), unit[k]), strict=True):
                                column.append(value)
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], ["label", "dims", "pivot", "node", "size", "prefix", "unit"])

    return nodes.mapInArrow(run, "label string, dims int, pivot int, node long, size long, prefix binary, unit binary")


def _block_links(threshold: float, shared: int):
    """For each pair of blocks: links of each node within it, and the least node it hangs together with."""

    def of(pivot, i, j, dims, side, node, size, prefix, unit):
        own = np.arange(len(node)) if i == j else np.flatnonzero(side == i)
        other = own if i == j else np.flatnonzero(side == j)
        x = np.frombuffer(b"".join(unit), "<f8").reshape(-1, dims)
        p = np.frombuffer(b"".join(prefix), "<u2").reshape(-1, PREFIX)
        a, b = np.nonzero((x[own] @ x[other].T >= threshold) & (node[own][:, None] != node[other]))
        if i == j:
            keep = a < b
            a, b = a[keep], b[keep]
        a, b = own[a], other[b]
        keep = np.zeros(len(a), bool)
        for at in range(0, len(a), 1 << 16):
            left, right = p[a[at : at + (1 << 16)]], p[b[at : at + (1 << 16)]]
            both, first = np.zeros(len(left), np.int64), np.full(len(left), _NONE)
            for k in range(PREFIX):
                same = (right == left[:, k, None]).any(1) & (left[:, k] != _NONE)
                both += same
                first = np.where(same, np.minimum(first, left[:, k]), first)
            keep[at : at + (1 << 16)] = (both >= shared) & (first == pivot)
        a, b = a[keep], b[keep]
        links = np.bincount(a, size[b], len(node)) + np.bincount(b, size[a], len(node))
        star = forest(node[a].tolist(), node[b].tolist())
        for k in np.flatnonzero(links):
            yield int(node[k]), int(links[k]), star[int(node[k])]

    def run(batches):
        held: list = []

        def groups(rows, last):
            start = 0
            for k in range(1, len(rows) + 1):
                if k == len(rows) or rows[k][:5] != rows[start][:5]:
                    if k < len(rows) or last:
                        g = rows[start:k]
                        label, dims, pivot, i, j = g[0][:5]
                        side, node, size = (np.array([r[c] for r in g]) for c in (5, 6, 7))
                        yield from of(pivot, i, j, dims, side, node, size, [r[8] for r in g], [r[9] for r in g])
                        start = k
            held[:] = rows[start:]

        for batch in batches:
            rows = held + list(zip(*[c.to_pylist() for c in batch.columns], strict=True))
            found = list(groups(rows, False))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["node", "links", "root"])
        found = list(groups(list(held), True)) if held else []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["node", "links", "root"])

    return run


def near_duplicates(rows: DataFrame, threshold: float = 0.98, shared: int = SHARED) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of (vec_id, embedding, label)."""
    checked = written(_checked(rows), "vectors")
    groups = checked.where("key is not null").groupBy("label", "dims", "key").agg(F.min(F.struct("vec_id", "unit")).alias("f"), F.count(F.lit(1)).alias("size"))
    nodes = written(groups.select("label", "dims", "key", F.col("f.vec_id").alias("node"), "size", "f.unit"), "nodes")
    count = min(MAX_PIVOTS, max(MIN_PIVOTS, nodes.count() * PREFIX // LIST_ROWS))
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    pivots = _pivots(nodes, count, reach)
    postings = written(_postings(nodes, pivots, count, reach), "postings")
    lists = postings.groupBy("label", "dims", "pivot").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    dealt = postings.join(lists, ["label", "dims", "pivot"]).withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("label", "dims", "pivot", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "node", "size", "prefix", "unit")
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(1 << 20, nodes.count() * PREFIX // 20_000))
    sorted_ = dealt.repartition(parts, "label", "dims", "pivot", "i", "j").sortWithinPartitions("label", "dims", "pivot", "i", "j", "side", "node")
    linked = written(sorted_.mapInArrow(_block_links(threshold, shared), "node long, links long, root long"), "links")
    edges = linked.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    same = checked.where("key is not null").join(nodes.select("label", "dims", "key", "node", "size"), ["label", "dims", "key"]).select("vec_id", "node", F.col("size").alias("same"), "label", "dims", "key").dropDuplicates()
    counts = linked.groupBy(F.col("node").alias("of")).agg(F.sum("links").alias("links"))
    labels = components(edges)
    found = same.join(counts, F.col("node") == F.col("of"), "left").join(labels.withColumnRenamed("node", "in"), F.col("node") == F.col("in"), "left")
    found = found.select(F.col("label").alias("l"), F.col("dims").alias("d"), F.col("key").alias("k"), F.col("vec_id").alias("v"), (F.coalesce("links", F.lit(0)) + F.col("same") - 1).alias("n"), F.coalesce("component", "node").alias("c"))
    out = checked.join(found, (F.col("label") == F.col("l")) & (F.col("dims") == F.col("d")) & (F.col("key") == F.col("k")) & (F.col("vec_id") == F.col("v")), "left")
    component = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id").isNull() | (component == F.col("vec_id"))).alias("kept"))
