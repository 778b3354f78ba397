import random

import numpy as np

from datagrove.llm import suffix_dedup

L = suffix_dedup.LENGTH


def brute(rows):
    first = {}
    for k, t in rows:
        b, k = (t or "").encode(), suffix_dedup.LAST_ID if k is None else k
        for i in range(len(b) - L + 1):
            s = b[i : i + L]
            first[s] = min(k, first.get(s, k))
    out = []
    for k, t in rows:
        b, own = (t or "").encode(), suffix_dedup.LAST_ID if k is None else k
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - L + 1):
            if first[b[i : i + L]] < own:
                gone[i : i + L] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((k, len(b), int(gone.sum()), spans, np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return sorted(out, key=str)


def got(df):
    return sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.deduplicate(df).collect()], key=str)


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert got(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_edges(spark, monkeypatch):
    rng = random.Random(1)
    text = lambda n: "".join(rng.choice("abcé ") for _ in range(n))
    shared = [text(n) for n in (48, 50, 51, 90, 300)]
    rows = [(k, text(rng.randrange(80)) + rng.choice(shared) + text(rng.randrange(80)) + rng.choice(shared)) for k in rng.sample(range(1000), 60)]
    rows += [(2000, "a" * 500), (2001, "a" * 120), (2002, "ab" * 100), (2003, "ba" * 100), (1, None), (2, ""), (2000, "a" * 60), (None, "a" * 70), (None, rows[0][1]), (2004, "x" * 49)]
    rows += [rows[3], (3000, rows[5][1]), (3001, rows[5][1]), (3002, "é" * 40), (3003, "é" * 40 + "b")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, batch int, kept string").repartition(3)
    want = brute(rows)
    assert got(df) == want
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 300)
    assert got(df) == want
    monkeypatch.setattr(suffix_dedup, "HOT", 5)
    assert got(df) == want
    assert got(df.limit(0)) == []


def test_merge():
    rng = random.Random(3)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(50, 120))) for _ in range(30)] + [b"ab" * 40, b"ba" * 50, b"a" * 100]
    owners = np.array([rng.randrange(9) for _ in strings])
    for s, found in zip(strings, suffix_dedup.least_owner(strings, owners), strict=True):
        for i, least in enumerate(found.tolist()):
            assert least == min(o for t, o in zip(strings, owners.tolist(), strict=True) if s[i : i + L] in t)


def test_merge_takes_few_sorts(monkeypatch):
    """A block's cost is its sorts and deals; depths that STEP divides or not, codes of over 16 bits."""
    rng, calls, argsort = random.Random(5), [], np.argsort
    strings = [bytes(rng.choice(b"abcdefgh ") for _ in range(rng.randrange(50, 90))) for _ in range(700)]
    strings += [s[:30] + strings[k + 1][:40] for k, s in enumerate(strings[:200])]
    owners = np.array([rng.randrange(500) for _ in strings])
    monkeypatch.setattr(np, "argsort", lambda *a, **k: calls.append(1) or argsort(*a, **k))
    found = suffix_dedup.least_owner(strings, owners)
    assert len(calls) <= 14  # 33 when each step dealt by two symbols
    first = {}
    for s, o in zip(strings, owners.tolist(), strict=True):
        for i in range(len(s) - L + 1):
            first[s[i : i + L]] = min(o, first.get(s[i : i + L], o))
    for s, least in zip(strings, found, strict=True):
        assert least.tolist() == [first[s[i : i + L]] for i in range(len(s) - L + 1)]
    for depth in (3, 8, 13, 24):
        texts = [np.frombuffer(b"\0".join(strings[k::2]) + b"\0", np.uint8) + np.uint8(1) for k in range(2)]
        shards = [suffix_dedup.Shard(*codes, depth) for codes in zip(*suffix_dedup._codes(texts, depth), strict=True)]
        inter, block = suffix_dedup.merge(shards, depth)
        met = [np.lib.stride_tricks.sliding_window_view(np.resize(t, len(t) + depth - 1), depth)[s.suffixes] for t, s in zip(texts, shards, strict=True)]
        merged = np.empty((len(inter), depth), np.uint8)
        for k, m in enumerate(met):
            merged[inter == k] = m
        steps = (merged[1:] != merged[:-1]).any(1)
        assert (np.diff(block) == steps).all() and all(a.tobytes() <= b.tobytes() for a, b in zip(merged[:-1], merged[1:], strict=True))
    wide = np.random.default_rng(1).integers(0, 200_000, 300_000)
    assert (suffix_dedup._stable(wide) == argsort(wide, kind="stable")).all()
