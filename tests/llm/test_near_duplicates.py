import random
import re

import pytest

from datagrove.llm import components, near_duplicates


def brute(rows, words, percent):
    sets = []
    for k, t, *_ in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    root = {k: k for k, *_ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = {}
    for i, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(i)
    for pair in {(i, j) for l in where.values() for i in l for j in l if i < j}:
        i, j = pair
        both = len(sets[i] & sets[j])
        if 100 * both >= percent * len(sets[i] | sets[j]) and rows[i][0] is not None and rows[j][0] is not None:
            a, b = find(rows[i][0]), find(rows[j][0])
            root[max(a, b)] = min(a, b)
    return sorted((k, len(s), find(k) if k is not None else None, k is None or find(k) == k) for (k, *_), s in zip(rows, sets, strict=True)) if all(r[0] is not None for r in rows) else {(k, len(s), find(k) if k is not None else None, k is None or find(k) == k) for (k, *_), s in zip(rows, sets, strict=True)}


@pytest.mark.parametrize("words", [2, 5])
def test_table(spark, words):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(map(tuple, near_duplicates.near_duplicates(docs, words).collect()))
    assert got == brute(rows, words, 80)


def test_edges(spark, monkeypatch):
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(500)]
    rows = [(k, " ".join(rng.choice(vocabulary) for _ in range(40)), "s", "n") for k in range(40)]
    base = rows[3][1].split()
    for k in range(60):  # a group of near copies, and of equal ones
        w = list(base)
        if k % 3:
            w[rng.randrange(40)] = rng.choice(vocabulary)
        rows.append((100 + k, " ".join(w), "s", "n"))
    rows += [(300, "ONE", "", ""), (301, "one\t", "", ""), (302, "", "", ""), (303, None, None, None), (300, "ONE", "", ""), (None, rows[0][1], "", ""), (304, "x y " * 20_000, "", ""), (305, "x y " * 20_000, "", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, node string")
    got = {tuple(r) for r in near_duplicates.near_duplicates(df, 2).collect()}
    assert got == set(brute(rows, 2, 80))
    for name, value in (("REGION", 8), ("ALL_PAIRS", 4), ("BEST", 2)):
        monkeypatch.setattr(near_duplicates, name, value)
    assert {tuple(r) for r in near_duplicates.near_duplicates(df, 2).collect()} == set(brute(rows, 2, 80))
    assert near_duplicates.near_duplicates(df.limit(0), 2).collect() == []


def test_weak_link_to_dense_group(spark):
    """Documents whose only links lead to a few members of a dense group, which have nearer partners themselves."""
    rng = random.Random(5)
    base, rows = [f"w{k}" for k in range(400)], []
    for k in range(500):
        w = list(base)
        for at in rng.sample(range(400), 24):
            w[at] = f"v{rng.randrange(10**9)}"
        rows.append((k, " ".join(w)))
    for k in range(40):  # near one member only
        w = rows[k][1].split()
        for at in rng.sample(range(400), 41):
            w[at] = f"u{rng.randrange(10**9)}"
        rows.append((1000 + k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, near_duplicates.near_duplicates(df, 1).collect())) == brute(rows, 1, 80)


def test_regions_forced_deep(spark, monkeypatch):
    """Pairs at 0.8 to 0.85 of templated texts are found whatever the size from which regions are cut deeper."""
    rng = random.Random(11)
    rows = []
    for k in range(120):
        own = [f"t{n}" for n in range(240)] + [f"d{k}x{n}" for n in range(60)]
        for side in range(2):
            w = list(own)
            for at in rng.sample(range(300), 14):
                w[at] = f"u{rng.randrange(10**9)}"
            rows.append((2 * k + side, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(near_duplicates, "REGION", 8)
    got = sorted(map(tuple, near_duplicates.near_duplicates(df, 1).collect()))
    want = brute(rows, 1, 80)
    assert 40 < sum(r[3] for r in want) < len(rows) - 40 and got == want


def test_one_boilerplate_family(spark):
    """1,600 documents that share most of their words: pairs at 0.818, all others at 0.695."""
    rows = []
    for k in range(800):
        own = [f"t{n}" for n in range(82)] + [f"d{k}x{n}" for n in range(8)]
        rows += [(2 * k + side, " ".join(own + [f"u{k}y{side}z{n}" for n in range(10)])) for side in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = near_duplicates.near_duplicates(df, 1).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(k, k - k % 2) for k in range(1600)}


def test_components(spark, monkeypatch):
    rng = random.Random(9)
    edges = [(k, k + 1) for k in range(100, 160)] + [(5, 300 + k) for k in range(50)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(90)]
    want = components.forest(*zip(*edges, strict=True))
    for at_once in (components.EDGES_AT_ONCE, 30):
        monkeypatch.setattr(components, "EDGES_AT_ONCE", at_once)
        got = components.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()
        assert len(got) == len({r.node for r in got})
        got = dict(map(tuple, got))
        assert got == {k: v for k, v in want.items() if k in got} and all(want[k] == k for k in want.keys() - got.keys())
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []
