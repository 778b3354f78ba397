import math
import random

import numpy as np

from datagrove.llm import components, hamming, vectors


def brute(rows, threshold=0.98):
    unit = [vectors._unit(v) if k is not None and l is not None else None for k, v, l in rows]
    links, edges = [0] * len(rows), []
    for i in range(len(rows)):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                links[i] += 1
                links[j] += 1
                edges.append((rows[i][0], rows[j][0]))
    root = components.forest(*zip(*edges, strict=True)) if edges else {}
    return [(k, n, root.get(k, k), k is None or root.get(k, k) == k) for (k, *_), n in zip(rows, links, strict=True)]


def test_groups(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows, k = [], 0
    for group in range(12):
        base = rng.normal(size=32)
        for _ in range(rng.integers(1, 40)):
            rows.append((k := k + 1, (base + rng.normal(size=32) * 0.08).tolist(), int(group % 3)))
    rows += [(k + n, rows[0][1], rows[0][2]) for n in range(1, 9)] + [(5000, None, 1), (5001, [0.0] * 32, 1), (5002, [1.0, None] + [0.0] * 30, 1), (5003, [math.nan] * 32, 1), (5004, rows[0][1], None), (None, rows[0][1], rows[0][2]), (5005, [1.0, 2.0], 1), (5006, [2.0, 4.0], 1), (5007, [], 1), (5008, [1e300] * 32, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "'x' as node", "1 as key").repartition(3)
    want = sorted(brute(rows), key=str)
    got = sorted(map(tuple, vectors.near_duplicates(df).collect()), key=str)
    found, there = sum(r[1] for r in got), sum(r[1] for r in want)
    assert len(got) == len(want) and 0.9 * there <= found <= there
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 8)
    assert sorted(map(tuple, vectors.near_duplicates(df).collect()), key=str) == got
    assert vectors.near_duplicates(df.limit(0)).collect() == []


def test_dense_group(spark):
    """A third of the rows in one group of unequal near copies: no link within it is missed."""
    rng = np.random.default_rng(7)
    base = rng.normal(size=64)
    rows = [(k, (base + rng.normal(size=64) * 0.1).tolist(), "a") for k in range(2000)] + [(2000 + k, rng.normal(size=64).tolist(), "a") for k in range(4000)]
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = (x @ x.T >= 0.98).sum(1) - 1
    got = {r.vec_id: r.n_links for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").repartition(4)).collect()}
    assert want.sum() > 2_000_000 and [got[k] for k in range(len(rows))] == want.tolist()


def test_top_k(spark, monkeypatch):
    rng = random.Random(6)
    centre = rng.getrandbits(64)
    codes = [(k, rng.getrandbits(64)) for k in range(300)] + [(300 + k, centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))) for k in range(60)] + [(400 + k, centre) for k in range(40)]
    signed = [(k, c - (1 << 64) if c >> 63 else c) for k, c in codes] + [(None, 5), (999, None)]
    df = spark.createDataFrame(signed, "id long, code long")
    monkeypatch.setattr(hamming, "BLOCK_CODES", 90)
    monkeypatch.setattr(hamming, "CHUNK_QUERIES", 3)
    got = {}
    for r in hamming.top_k(df, df.where("id % 50 = 0"), 10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.distance, r.vec_id))
    for q, c in codes:
        if q % 50 == 0:
            want = sorted(((c ^ o).bit_count(), k) for k, o in codes if k != q)[:10]
            assert sorted(got[q]) == [(n + 1, d, k) for n, (d, k) in enumerate(want)]
    few = hamming.top_k(df.limit(3), df.limit(3), 10).collect()
    assert len(few) == 6 and hamming.top_k(df.limit(0), df.limit(0)).collect() == []
