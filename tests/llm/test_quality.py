import zlib

import pytest

from datagrove.llm import quality

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    scored = quality.score(docs.select("doc_id", "text"), quality.train(docs, labels))
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    good = [r.score for r in rows if r.quality == 1]
    bad = [r.score for r in rows if r.quality == 0]
    auc = sum(g > b for g in good for b in bad) / len(good) / len(bad)
    right = sum(r.predicted == r.quality for r in rows) / len(rows)
    print(auc, right, len(rows))
    assert auc > 0.9 and right > 0.9


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "x", 5.0), (2, "", "y", None), (2, "", "y", None), (None, "a b", "z", 1.0), (4, "w " * 50_000, "q", 2.0)], "doc_id long, text string, `score` string, `y` double")
    labels = spark.createDataFrame([(4, 1, 0), (2, None, 1), (None, 1, 1)], "doc_id long, quality int, y int")
    rows = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 5 == 0) for r in rows)
    assert {r.score for r in quality.score(docs, quality.train(docs, labels.limit(0))).collect()} == {0.5}
    assert quality.score(docs.limit(0), quality.train(docs, labels)).collect() == []


@pytest.mark.parametrize("text", ["A b!! c", "", "x"])
def test_dot_product(spark, text):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    import numpy as np

    w = np.random.default_rng(0).normal(size=(1 << quality.BITS) + 1).astype("<f4")
    slots = np.concatenate(quality.features(quality.WordHashes().of([text])[0]))
    want = 1 / (1 + np.exp(-(w[-1] + quality.SCALE * w[slots].sum() / max(1, len(slots)))))
    assert abs(quality.score(docs, w).first().score - want) < 1e-4


def test_hashes_of_arrow_texts():
    """Many texts at once give the hashes of each one's pieces; the table of pieces met lately stays bounded."""
    import numpy as np
    import pyarrow as pa

    texts = ["Two words", None, "", "　THE end\x1cx_y!! ", *(f"A{k} b{k}, CC{k}" for k in range(200)), "two Words"]
    words = quality.WordHashes()
    words.met.entries = 50
    for some in (texts, texts[:3], texts[-4:]):
        hashes, n = words.of(pa.array(some, pa.string()))
        want = [b"".join(map(quality.WordHashes._of, (t or "").split())) for t in some]
        assert hashes.tobytes() == b"".join(want) and n.tolist() == [len(w) // 4 for w in want] and len(words.met.words) <= 50
    assert np.array_equal(*(words.of([t])[0] for t in ("Two  words", "two\nWords")))
