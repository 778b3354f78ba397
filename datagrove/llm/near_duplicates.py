"""Operator 10: MinHash near-duplicates with an LSH forest.

Texts are lower-cased (A-Z) and cut into words; a text's set are its distinct shingles of words (with fewer words the whole
sequence as one; without words the set is empty and linked with nothing). Equal sets are one node. A node's signature has
HASHES minima. Each of TREES trees orders the nodes by their signature from another place on; nodes that share a prefix of
DEPTHS[0] values form a region, and a region with more than REGION nodes is cut at a greater depth, each as deep as it
needs. Inside a region, nodes stand in signature order; candidates are the neighbours by longest common prefix and the
pairs whose signatures agree enough. In regions of over ALL_PAIRS nodes a node brings its BEST best partners and its
neighbours only.

Candidates are confirmed on the full sets, the most alike first: a first round tests each node's FIRST best partners, then
components grow, and a second round tests all candidates whose ends are still in different components, so links that the
result depends on are never skipped. Then regions of over ALL_PAIRS nodes at DEPTHS[0] that hold several components, whatever
their size and however deep they were cut, are gone through once more: all their pairs of different components whose
signatures agree enough are compared on the full sets, in blocks to which the sets travel. The members of a region's largest component are not compared with each other.

Rows that share an id are one node. Rows with a null id link with nothing and have a null component. Null texts are empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, parts_for, slices, written
from .components import components
from .word_ids import lean

HASHES, TREES, DEPTHS = 64, 16, (4, 8, 12, 16)
REGION = 1024
ALL_PAIRS, BEST, FIRST = 48, 8, 2
#: Agreement of signatures from which a pair is tested: 3.6 standard deviations under 0.8.
MARGIN = 0.18
#: Shingles of a block of a region that is gone through whole, about.
BLOCK_SHINGLES = 2_000_000
BROADCAST_ROWS = 100_000
SALTS = 16
_RNG = np.random.default_rng(20)
_A = _RNG.integers(1, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, HASHES, np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Shingles:
    """Sorted distinct 64-bit shingle hashes of texts."""

    def __init__(self, words: int):
        self.words = words

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        raw = b"".join(map(xxhash.xxh3_64_digest, words))
        h = np.frombuffer(raw, "<u8")
        k = min(self.words, len(words))
        out = np.full(len(words) - k + 1, np.uint64(k), np.uint64)
        for i in range(k):
            out = (out ^ h[i : len(h) - k + 1 + i]) * _MIX
            out ^= out >> np.uint64(29)
        return np.unique(out)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The minima (uint32) of sets that aren't empty."""
    out = np.zeros((len(sets), HASHES), "<u4")
    for at in range(0, len(sets), 32):
        some = sets[at : at + 32]
        x, n = np.concatenate(some), np.array([len(s) for s in some])
        starts = np.cumsum(n) - n
        for k in range(HASHES):
            out[at : at + 32, k] = np.minimum.reduceat(((x * _A[k] + _B[k]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def signed(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n (shingles), key (of the set) and sig (null for empty sets) of each row."""

    def run(batches):
        shingles = Shingles(words)
        for batch in batches:
            for keys, texts in slices(batch, ["doc_id", "text"]):
                sets = [shingles.of(t) for t in texts]
                full = [s for s in sets if len(s)]
                sigs = iter(signatures(full) if full else [])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([next(sigs).tobytes() if len(s) else None for s in sets], pa.binary())],
                    ["doc_id", "n", "key", "sig"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), "doc_id long, n long, key binary, sig binary")


def _tree_rows(nodes: DataFrame, with_sig: bool) -> DataFrame:
    """A row for each node and tree: the region's key at each depth, and the signature's low bytes in the tree's order."""
    names = [f"k{d}" for d in DEPTHS] + (["node", "n", "sig", "tree"] if with_sig else [])

    def run(batches):
        for batch in batches:
            for nodes_, sizes, sigs in slices(batch, ["node", "n", "sig"], 2048):
                full = np.frombuffer(b"".join(sigs), "<u4").reshape(-1, HASHES)
                for t in range(TREES):
                    turned = np.roll(full, -t * HASHES // TREES, axis=1) & np.uint32(255)
                    h, columns = np.full(len(full), np.uint64(t + 1)) * _MIX, []
                    for d in range(DEPTHS[-1]):
                        h = (h ^ turned[:, d]) * _MIX
                        h ^= h >> np.uint64(31)
                        if d + 1 in DEPTHS:
                            columns.append(pa.array(h.view(np.int64)))
                    if with_sig:
                        low = turned.astype(np.uint8)
                        columns += [pa.array(nodes_, pa.int64()), pa.array(sizes, pa.int64()), pa.array([r.tobytes() for r in low], pa.binary()), pa.array(np.full(len(full), t, np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, names)

    kinds = ", ".join(f"k{d} long" for d in DEPTHS) + (", node long, n long, sig binary, tree int" if with_sig else "")
    return nodes.select("node", "n", "sig").mapInArrow(run, kinds)


def _crowded(nodes: DataFrame) -> DataFrame:
    """key and count of the regions at DEPTHS[0] whose pairs are not all candidates."""
    counts = _tree_rows(nodes, False).groupBy(F.col(f"k{DEPTHS[0]}").alias("key")).count()
    return written(counts.where(F.col("count") > min(ALL_PAIRS, REGION)), "crowded")


def _small(df: DataFrame, rows: int) -> DataFrame:
    """df, broadcast if it has few rows."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _regions(nodes: DataFrame, crowded: DataFrame) -> DataFrame:
    """The rows of _tree_rows with the key of the region they are compared in."""
    rows, counted, levels = _tree_rows(nodes, True), _tree_rows(nodes, False), []
    for d in DEPTHS:
        if levels:  # only what was too large a depth above
            above, large = levels[-1]
            counted = counted.join(large.select(F.col("key").alias("over")), F.col(f"k{above}") == F.col("over"), "left_semi")
            large = written(counted.groupBy(F.col(f"k{d}").alias("key")).count().where(F.col("count") > REGION), "regions")
        else:
            large = crowded.where(F.col("count") > REGION)
        n = large.count()
        if not n:
            break
        levels.append((d, _small(large, n)))
    region = F.col(f"k{DEPTHS[min(len(levels), len(DEPTHS) - 1)]}")
    for d, large in reversed(levels):
        rows = rows.join(large.select(F.col("key").alias(f"l{d}"), F.col("count").alias(f"c{d}")), F.col(f"k{d}") == F.col(f"l{d}"), "left")
        region = F.when(F.col(f"l{d}").isNull(), F.col(f"k{d}")).otherwise(region)
    if len(levels) < len(DEPTHS):
        return rows.select(region.alias("region"), "node", "n", "sig")
    # Too large at the greatest depth: these agree in all of it. They are dealt into chunks, and one node stands in each chunk.
    last = DEPTHS[-1]
    chunks = F.ceil(F.coalesce(F.col(f"c{last}"), F.lit(1)) / REGION)
    dealt = rows.select(region.alias("whole"), F.when(region == F.col(f"l{last}"), chunks).otherwise(1).alias("chunks"), "node", "n", "sig")
    first = dealt.where("chunks > 1").groupBy("whole", "chunks").agg(F.min(F.struct("node", "n", "sig")).alias("f"))
    first = first.select("whole", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("c"), "f.*")
    own = dealt.withColumn("c", F.pmod(F.xxhash64("node"), F.col("chunks"))).select("whole", "c", "node", "n", "sig")
    both = own.unionByName(first).dropDuplicates(["whole", "c", "node"])
    return both.select(F.when(F.col("c") == 0, F.col("whole")).otherwise(F.xxhash64("whole", "c")).alias("region"), "node", "n", "sig")


def _pairs_in(node, n, sig, least: float, share: float):
    """Candidates of one region, whose rows are in signature order: places and agreement."""
    g, out = len(node), []
    for at in range(0, g, 128):
        agree = np.stack([(sig[k] == sig).sum(1) for k in range(at, min(g, at + 128))])
        small, big = np.minimum(n[at : at + 128, None], n), np.maximum(n[at : at + 128, None], n)
        ok = (agree >= least * HASHES) & (small >= share * big - 1e-9) & (node[at : at + 128, None] != node)
        if g > ALL_PAIRS:
            score = np.where(ok, agree, -1)
            best = np.argpartition(-score, BEST, axis=1)[:, :BEST]
            keep = np.zeros_like(ok)
            np.put_along_axis(keep, best, True, axis=1)
            k = np.arange(len(ok))
            keep[k, np.minimum(at + k + 1, g - 1)] = True
            ok &= keep
        i, j = np.nonzero(ok)
        out.append((i + at, j, agree[i, j]))
    return [np.concatenate(c) for c in zip(*out, strict=True)]


def _candidates(regions: DataFrame, parts: int, least: float, share: float) -> DataFrame:
    """a < b and agreement (of HASHES) of each pair that shares a region and may be alike enough."""

    def emit(region, node, n, sig):
        starts = np.flatnonzero(np.concatenate([[True], region[1:] != region[:-1]]))
        sizes = np.diff(np.append(starts, len(region)))
        two = starts[sizes == 2]
        found = [(two, two + 1, (sig[two] == sig[two + 1]).sum(1))]
        keep = (found[0][2] >= least * HASHES) & (np.minimum(n[two], n[two + 1]) >= share * np.maximum(n[two], n[two + 1]) - 1e-9) & (node[two] != node[two + 1])
        found = [tuple(c[keep] for c in found[0])]
        for s, g in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            i, j, agree = _pairs_in(node[s : s + g], n[s : s + g], sig[s : s + g], least, share)
            found.append((i + s, j + s, agree))
        i, j, agree = [np.concatenate(c) for c in zip(*found, strict=True)]
        a, b = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
        _, once = np.unique(np.stack([a, b], 1), axis=0, return_index=True) if len(a) else (None, np.zeros(0, int))
        return pa.RecordBatch.from_arrays([pa.array(a[once]), pa.array(b[once]), pa.array(agree[once].astype(np.int32))], ["a", "b", "agree"])

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)] + [np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, HASHES)]
            held = now if held is None else [np.concatenate(c) for c in zip(held, now, strict=True)]
            cut = int(np.searchsorted(held[0], held[0][-1]))  # the last region may go on
            if cut:
                yield emit(*[c[:cut] for c in held])
                held = [c[cut:] for c in held]
        if held is not None:
            yield emit(*held)

    dealt = regions.repartition(parts, "region").sortWithinPartitions("region", "sig", "node")
    return dealt.select("region", "node", "n", "sig").mapInArrow(lean(run), "a long, b long, agree int").groupBy("a", "b").agg(F.max("agree").alias("agree"))


def _sets(docs: DataFrame, nodes: DataFrame, words: int, repeated: bool) -> DataFrame:
    """node and its full set, of the nodes named; repeated: whether ids may have several rows."""

    def run(batches):
        shingles = Shingles(words)
        for batch in batches:
            for keys, texts in slices(batch, ["doc_id", "text"]):
                sets = [shingles.of(t) for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary())], ["node", "shingles"])

    nodes = _small(nodes, nodes.count())
    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).join(nodes, F.col("doc_id") == F.col("node"), "left_semi")
    out = wanted.mapInArrow(lean(run), "node long, shingles binary")
    return out.dropDuplicates(["node", "shingles"]) if repeated else out


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with linked: 100 * intersection >= percent * union, on the full sets, each of which travels to its pairs once."""

    def alike(x: np.ndarray, y: np.ndarray) -> bool:
        both = len(x) + len(y) - len(np.union1d(x, y))
        return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)

    def run(batches):
        for batch in batches:
            for part in (batch.slice(k, 128) for k in range(0, batch.num_rows, 128)):
                linked = []
                for ends in part.column(2).to_pylist():
                    left, right = ([np.frombuffer(e["shingles"], "<u8") for e in ends if e["side"] == side] for side in (0, 1))
                    linked.append(any(alike(x, y) for x in left for y in right))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    ends = pairs.select(F.col("a").alias("of"), "a", "b", F.lit(0).alias("side")).unionAll(pairs.select(F.col("b").alias("of"), "a", "b", F.lit(1).alias("side")))
    if pairs.count() <= BROADCAST_ROWS:
        ends = F.broadcast(ends)
    full = sets.join(ends, F.col("node") == F.col("of")).groupBy("a", "b").agg(F.collect_list(F.struct("side", "shingles")).alias("ends"))
    return full.mapInArrow(run, "a long, b long, linked boolean")


def _blocks(nodes: DataFrame, crowded: DataFrame, moved: DataFrame) -> DataFrame | None:
    """Rows of crowded regions (node, n, sig, comp) of several components, once for each pair of blocks they are compared in.
    moved: component of the nodes that have another one than themselves. Blocks hold members of the region's largest
    component, or others; two of the first kind are not compared. side: 0 or 1, or 2 where a block is compared with itself."""
    within = crowded.count()
    if not within:
        return None
    rows = _tree_rows(nodes, True).select(F.col(f"k{DEPTHS[0]}").alias("region"), "tree", "node", "n", "sig")
    rows = rows.join(_small(crowded.select("key"), within), F.col("region") == F.col("key"), "left_semi")
    rows = written(rows.join(moved, F.col("node") == F.col("in"), "left").select("region", "tree", "node", "n", "sig", F.coalesce("component", "node").alias("comp")), "crowds")
    held = rows.groupBy("region", "comp").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"))
    held = held.groupBy("region").agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("comps"), F.sum("n").alias("all"), F.max(F.struct("rows", "comp", "n")).alias("m"))
    blocks = lambda rows, n: F.greatest(F.ceil(rows / REGION), F.ceil(n / BLOCK_SHINGLES)).cast("long")
    held = held.where(F.col("comps") > 1).select(F.col("region").alias("at"), F.col("m.comp").alias("main"), blocks(F.col("rows") - F.col("m.rows"), F.col("all") - F.col("m.n")).alias("others"), blocks(F.col("m.rows"), F.col("m.n")).alias("mains"))
    held = written(held, "regions")
    n = held.count()
    if not n:
        return None
    rows = rows.join(_small(held, n), F.col("region") == F.col("at"))
    is_main = F.col("comp") == F.col("main")
    own = F.when(is_main, F.col("others") + F.pmod(F.xxhash64("node"), F.col("mains"))).otherwise(F.pmod(F.xxhash64("node"), F.col("others")))
    rows = rows.withColumn("own", own).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.when(is_main, F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1)))
    side = F.when(F.col("own") == F.col("o"), 2).otherwise((F.col("own") > F.col("o")).cast("int"))
    return rows.select(F.xxhash64("region", F.least("own", "o"), F.greatest("own", "o")).alias("block"), side.alias("side"), "tree", "node", "n", "comp", "sig")


def _in_blocks(rows: DataFrame, parts: int, of, schema: str) -> DataFrame:
    """of(rows of one block, as columns) for each block of rows."""

    def run(batches):
        held: list = []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and held[-1][0] != row[0]:
                    yield from of(*zip(*held, strict=True))
                    held = []
                held.append(row)
        if held:
            yield from of(*zip(*held, strict=True))

    return rows.repartition(parts, "block").sortWithinPartitions("block", "side", "node").mapInArrow(run, schema)


def _open_pairs(side, tree, node, n, comp, sig, least: float, share: float):
    """Of each row of a block on side 0 (or 2), in turn: its place and those it may be alike, in another component and in no region of an earlier tree."""
    own, other = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    for k in own.tolist():
        same = sig[other] == sig[k]
        some = (comp[other] != comp[k]) & (node[other] != node[k]) & (same.sum(1) >= least * HASHES)
        some &= np.minimum(n[other], n[k]) >= share * np.maximum(n[other], n[k]) - 1e-9
        if some.any():
            places = other[some]
            trees = np.roll(same[some], int(tree[k]) * HASHES // TREES, axis=1).reshape(-1, TREES, HASHES // TREES)[:, :, : DEPTHS[0]].all(2)
            places = places[trees.argmax(1) == tree[k]]
            yield k, places[places > k] if side[k] == 2 else places


def _links_between(docs: DataFrame, nodes: DataFrame, crowded: DataFrame, moved: DataFrame, parts: int, words: int, percent: int) -> DataFrame | None:
    """Links (a, b) that join different components (comp) of nodes, of whole regions."""
    cut = percent / 100
    blocks = _blocks(nodes, crowded, moved)
    if blocks is None:
        return None

    def arrays(side, tree, node, n, comp, sig):
        return (*(np.array(c, np.int64) for c in (side, tree, node, n, comp)), np.frombuffer(b"".join(sig), np.uint8).reshape(-1, HASHES))

    def open_rows(block, *columns):
        keep = set()
        for k, places in _open_pairs(*arrays(*columns), cut - MARGIN, cut):
            if len(places):
                keep.update([k, *places.tolist()])
        if keep:
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([c[k] for k in sorted(keep)], t) for c, t in zip((block, *columns), kinds, strict=True)], ["block", "side", "tree", "node", "n", "comp", "sig"])

    def linked(block, side, tree, node, n, comp, sig, shingles):
        sets = [np.frombuffer(s, "<u8") for s in shingles]
        ids, place = np.unique(np.concatenate(sets), return_inverse=True)
        size = np.array([len(s) for s in sets])
        starts = np.cumsum(size) - size
        has, root, out = np.zeros(len(ids), np.int64), {}, []

        def find(x):
            while (up := root.setdefault(x, x)) != x:
                root[x] = x = root[up]
            return x

        for k, places in _open_pairs(*arrays(side, tree, node, n, comp, sig), cut - MARGIN, cut):
            places = [p for p in places.tolist() if find(comp[p]) != find(comp[k])]
            if not places:
                continue
            mine = place[starts[k] : starts[k] + size[k]]
            has[mine] = 1
            for p in places:
                if find(comp[p]) == find(comp[k]):
                    continue
                both = int(has[place[starts[p] : starts[p] + size[p]]].sum())
                if both and 100 * both >= percent * (size[k] + size[p] - both):
                    out.append((node[k], node[p]))
                    root[find(comp[p])] = find(comp[k])
            has[mine] = 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    rows = written(_in_blocks(blocks, parts, open_rows, "block long, side int, tree int, node long, n long, comp long, sig binary"), "blocks")
    if rows.isEmpty():
        return None
    sets = _sets(docs, rows.select("node").distinct(), words, True).withColumnRenamed("node", "of")
    full = rows.join(sets, F.col("node") == F.col("of")).drop("of")
    links = written(_in_blocks(full, parts, linked, "a long, b long"), "between")
    discard(rows)
    return links


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row."""
    rows = written(signed(docs, words), "signatures")
    known = rows.where("doc_id is not null and n > 0")
    groups = known.groupBy("key").agg(F.min(F.struct("doc_id", "n", "sig")).alias("f")).select("f.n", "f.sig", F.col("f.doc_id").alias("node"))
    nodes = written(groups, "nodes")
    parts = parts_for(docs)
    cut = percent / 100
    crowded = _crowded(nodes)
    found = written(_candidates(_regions(nodes, crowded), parts, cut - MARGIN, cut), "candidates")
    # Equal sets under several ids hang together by their least id. Many copies of one set are dealt over SALTS tasks.
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt")
    lows = known.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    lows = lows.select("key", "low", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    same = known.select("key", "doc_id", salt).join(lows, ["key", "salt"]).where("low < doc_id").select(F.col("low").alias("a"), F.col("doc_id").alias("b")).distinct()
    same = written(same, "copies")
    links = None
    if not found.isEmpty():
        repeated = not known.groupBy("doc_id").count().where("count > 1").isEmpty()
        sets = written(_sets(docs, found.select(F.col("a").alias("node")).unionAll(found.select("b")).distinct(), words, repeated), "sets")
        ends = found.select("*", F.col("a").alias("at")).unionAll(found.select("*", F.col("b").alias("at")))
        ranked = ends.withColumn("r", F.row_number().over(Window.partitionBy("at").orderBy(F.desc("agree"), "a", "b"))).where(F.col("r") <= FIRST)
        best = written(ranked.select("a", "b").distinct(), "best")
        first = written(_confirmed(best, sets, percent), "tested")
        links = first.where("linked").select("a", "b")
        labels, rest = components(links), found.join(first.select("a", "b"), ["a", "b"], "left_anti")
        for end in ("a", "b"):
            rest = rest.join(labels.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}")), end, "left")
        rest = written(rest.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b"), "rest")
        wanted = rest.select(F.col("a").alias("node")).unionAll(rest.select("b")).distinct()
        if wanted.count() <= BROADCAST_ROWS:
            wanted = F.broadcast(wanted)
        links = links.unionAll(written(_confirmed(rest, sets.join(wanted, "node", "left_semi"), percent), "tested").where("linked").select("a", "b"))
        discard(sets)
    edges = same if links is None else same.unionAll(links)
    merged = components(edges) if links is not None or not same.isEmpty() else None
    if merged is None:
        moved = nodes.select(F.col("node").alias("in"), F.col("node").alias("component")).limit(0)
    else:
        moved = written(merged.where("node <> component").select(F.col("node").alias("in"), "component"), "moved")
        if moved.count() <= BROADCAST_ROWS:
            moved = F.broadcast(moved)
    more = _links_between(docs, nodes, crowded, moved, parts, words, percent)
    if more is not None and not more.isEmpty():
        merged = components(edges.unionAll(more))
    out = rows.select("doc_id", F.col("n").alias("n_shingles"))
    if merged is None:
        out = out.withColumn("component_id", F.col("doc_id"))
    else:
        out = out.join(merged, F.col("doc_id") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))
