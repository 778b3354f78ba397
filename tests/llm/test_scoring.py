import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from datagrove.llm import fused, scoring

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute(rows):
    out, counts, n = [], Counter(), 0
    split = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) for _, t in rows]
    for (k, _), words in zip(rows, split, strict=True):
        if zlib.crc32(b"" if k is None else str(k).encode()) % 7 != 2:
            counts.update(words)
            counts[None] += 1
    n, v = sum(counts.values()), len(counts)
    for (k, _), words in zip(rows, split, strict=True):
        c = [counts[w] for w in [*words, None]]
        out.append((k, zlib.crc32(b"" if k is None else str(k).encode()) % 7 == 2, len(c), sum(x > 0 for x in c), n, sum(math.log10((x + 1) / (n + v + 1)) for x in c)))
    return out


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = {r.doc_id: r for r in scoring.score(docs, PATH).collect()}
    for want in brute([(r.doc_id, r.text) for r in docs.collect()]):
        r = got[want[0]]
        assert tuple(r)[:5] == want[:5] and abs(r.base_score - want[5]) < 1e-6 * abs(want[5])
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_attention_carries_the_score(spark):
    """Trained on all training documents; without the attention's output the held-out score falls by over a tenth."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    chunks = scoring.chunks(docs, PATH, 49407)
    model = scoring.fit(chunks, 49407)
    got = [scoring.Chunk.read(r.data) for r in chunks.collect()]
    held = [c.sequences(49407, np.flatnonzero(~c.training)) for c in got]
    score = lambda: sum(model.log10(*h).sum() for h in held) / sum((h[1] - 1).sum() for h in held)
    whole = score()
    trained = model.layer.weights["V"]
    model.layer = scoring.Layer(model.layer.weights | {"V": np.zeros_like(trained)})
    print("log10 an id:", whole, "without attention:", score())
    assert score() < 1.1 * whole
    windows = [scoring._unpack(r.windows, "<u4")[0] for r in chunks.where("windows is not null").collect()]
    steps = sum((c.sequences(49407, np.flatnonzero(c.training))[1] - 1).sum() for c in got)
    assert 0.5 < sum(map(len, windows)) * scoring.TRAIN_EVERY / steps < 2  # grows with the corpus


def test_gradients(model):
    """Against differences of the loss."""
    rng = np.random.default_rng(4)
    layer = scoring.Layer({k: rng.normal(0, 0.3, v.shape) for k, v in model.layer.weights.items()})
    layer.mask = lambda: np.where(np.tri(scoring.WINDOW, dtype=bool), layer.weights["R"][np.maximum(np.arange(scoring.WINDOW)[:, None] - np.arange(scoring.WINDOW), 0)], -1e9)
    x, y = rng.integers(0, 9, (3, scoring.WINDOW)), rng.integers(0, scoring.CLASSES, (3, scoring.WINDOW))
    m = np.arange(scoring.WINDOW) < np.array([[32], [7], [20]])

    def loss():
        w = layer.weights
        h = w["E"][x]
        s = (h @ w["Q"]) @ (h @ w["K"]).transpose(0, 2, 1) * scoring.WIDTH**-0.5 + layer.mask()
        s = np.exp(s - s.max(2, keepdims=True))
        g = s / s.sum(2, keepdims=True) @ (h @ w["V"]) @ w["U"] + w["b"]
        g -= np.log(np.exp(g).sum(2, keepdims=True))
        return -(np.take_along_axis(g, y[..., None], 2)[..., 0] * m).sum() / m.sum()

    grads = layer.gradients(x, y, m)
    for name in ("Q", "K", "V", "U", "R", "b", "E"):
        at = tuple(rng.integers(0, n) for n in grads[name].shape)
        where = (np.unique(x)[at[0]], *at[1:]) if name == "E" else at
        before, step = layer.weights[name][where], 1e-5
        layer.weights[name][where] = before + step
        up = loss()
        layer.weights[name][where] = before - step
        down = loss()
        layer.weights[name][where] = before
        assert abs((up - down) / (2 * step) - grads[name][at]) < 1e-4 * max(1, abs(grads[name][at])), name


def test_very_long_word(spark):
    """A word of 300 kB, of more ids than two bytes count, and the documents after it."""
    rows = [(1, "日本" * 50_000), (3, "a b"), (4, "c")]
    got = {r.doc_id: r for r in scoring.score(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), PATH).collect()}
    assert all(math.isfinite(r.score) for r in got.values()) and got[1].score < 20 * got[3].score
    chunk = scoring.Chunk.read(scoring.chunks(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), PATH, 49407).first().data)
    flat, n = chunk.sequences(49407, np.array([1, 2]))
    assert n.tolist() == [4, 3] and len(set(flat.tolist())) == 4


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "ünï \x1c cöde <|endoftext|>"), (5, "long words " * 20_000)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, chunk string, windows string")
    got = sorted([tuple(r)[:5] + (round(r.base_score, 6), math.isfinite(r.score)) for r in scoring.score(df, PATH).collect()], key=str)
    assert got == sorted([(*r[:5], round(r[5], 6), True) for r in brute(rows)], key=str)
    assert scoring.score(df.limit(0), PATH).collect() == []


@pytest.fixture(scope="module")
def model():
    rng, end = np.random.default_rng(0), 120
    counts = rng.integers(0, 50, end + 1)
    place = np.full(end + 1, scoring.TOP)
    place[:90] = np.arange(90)
    follows = np.zeros((scoring.TOP + 1, scoring.TOP + 1), np.int64)
    follows[:90, :90] = rng.integers(0, 20, (90, 90))
    made = scoring.Model(counts, place, follows, end)
    made.layer.train(rng.integers(0, end, (40, scoring.WINDOW + 1)).astype("<u4"), made.class_of)
    return made


def test_probabilities_add_up(model):
    for n in (1, 2, 40, 70):
        before = np.concatenate([[120], np.arange(n) % 100])
        base = model.log10(before, np.array([len(before)]))[0]
        total = sum(10 ** (model.log10(np.append(before, k), np.array([len(before) + 1]))[0] - base) for k in range(121))
        assert abs(total - 1) < 1e-3


def test_each_id_once_and_causal(model):
    ids = np.random.default_rng(1).integers(0, 120, 300)
    n = np.array([300])
    whole = model.log10(ids, n)[0]
    longer = model.log10(np.append(ids, [3, 4]), np.array([302]))[0]
    steps = [model.log10(ids[:k], np.array([k]))[0] for k in range(1, 301)]
    assert abs(steps[-1] - whole) < 1e-3 and longer < whole and (np.diff(steps) < 0).all()
    both = model.log10(np.concatenate([ids, ids[:50]]), np.array([300, 50]))
    assert abs(both[0] - whole) < 1e-3 and abs(both[1] - steps[49]) < 1e-3


def test_all_windows_train(spark):
    """Each id of each training document is predicted in one window, and each window trains in one round."""
    rows = [(k, "the cat sat on a mat " * (k % 40), "x") for k in range(300)] + [(None, "one two", "x"), (301, None, "x")]
    table = scoring.chunks(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(2), PATH, 49407)
    for r in table.collect():
        chunk, windows = scoring.Chunk.read(r.data), scoring._unpack(r.windows, "<u4")[0].reshape(-1, scoring.WINDOW + 1)
        ids, n = chunk.sequences(49407, np.flatnonzero(chunk.training))
        firsts = np.isin(np.arange(len(ids)), np.cumsum(n) - n)
        assert (windows[:, 1:][windows[:, 1:] != scoring._NONE] == ids[~firsts]).all()
        assert (windows[:, 1:] != scoring._NONE).sum() == (n - 1).sum()
        parts = [scoring.of_round(np.arange(len(windows)), k) for k in range(scoring.ROUNDS)]
        assert sorted(np.concatenate(parts).tolist()) == list(range(len(windows)))


def test_round_trains_on_its_windows(spark):
    """The average of a round, by training in this process; the table stays in one part, so there is one trainer."""
    rows = [(k, f"word{k % 7} the cat sat on a mat " * (k % 30), "x") for k in range(200)]
    table = scoring.chunks(spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1), PATH, 49407)
    made = scoring.fit(table, 49407)
    start = scoring.Layer({k: np.random.default_rng(1).normal(0, 0.1, v.shape).astype("<f4") for k, v in made.layer.weights.items()})
    windows = table.select("windows")
    got = scoring.averaged(windows, start, made.class_of, 1).weights
    own = scoring.Layer({k: v.copy() for k, v in start.weights.items()})
    for r in windows.collect():
        own.train(scoring.of_round(scoring._unpack(r.windows, "<u4")[0].reshape(-1, scoring.WINDOW + 1), 1), made.class_of)
    for k, v in own.weights.items():
        assert np.abs(got[k] - v).max() < 1e-3


def test_pairs_by_words(spark):
    """What follows each other, counted by distinct words, is what the sequences of training documents hold."""
    rows = [(k, [" the cat sat\x85 \x85", "", None, "\n a \x0b", "\x85", "thethe  the CAT!"][k % 6]) for k in range(40)]
    df, end = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), 49407
    chunk = scoring.Chunk.read(scoring.chunks(df, PATH, end).first().data)
    place = np.arange(end + 1) % 7
    inside, times, across = chunk.pairs(place, end, 7)
    got = np.bincount(across, minlength=49) + np.bincount(inside, times, 49)
    want, wanted = np.zeros(49), np.flatnonzero(chunk.training)
    for k in wanted:
        ids, _ = chunk.sequences(end, np.array([k]))
        np.add.at(want, place[ids[:-1]] * 7 + place[ids[1:]], 1)
    assert len(wanted) < 40 and (got == want).all()


def test_training_is_plain_adam(model):
    """Distinct ids are told apart once a step and hand over their embeddings; the weights are those of Adam written out, in double precision."""
    rng = np.random.default_rng(6)
    windows = rng.integers(0, 40, (3 * scoring.BATCH - 5, scoring.WINDOW + 1)).astype("<u4")
    windows[4, 9:] = windows[70, 2:] = scoring._NONE
    start, class_of, calls = {k: rng.normal(0, 0.1, v.shape).astype("<f4") for k, v in model.layer.weights.items()}, model.class_of, []

    class Watched(scoring.Layer):
        def gradients(self, x, y, m, of_ids=None, own=None):
            ids, at = of_ids
            assert (np.unique(x) == ids).all() and (ids[at] == x.reshape(-1)).all() and (own == self.weights["E"][ids]).all()
            calls.append(len(x))
            return super().gradients(x, y, m, of_ids, own)

    got = Watched({k: v.copy() for k, v in start.items()})
    got.train(windows, class_of)
    assert calls == [scoring.BATCH, scoring.BATCH, scoring.BATCH - 5]
    layer = scoring.Layer({k: v.astype(float) for k, v in start.items()})
    first, second = ({k: np.zeros(v.shape) for k, v in start.items()} for _ in range(2))
    order = np.random.default_rng(3).permutation(len(windows))
    for step, at in enumerate(range(0, len(order), scoring.BATCH), 1):
        some = windows[order[at : at + scoring.BATCH]]
        x, there = np.where(some[:, :-1] == scoring._NONE, 0, some[:, :-1]).astype(np.int64), some[:, 1:] != scoring._NONE
        for name, d in layer.gradients(x, class_of[np.where(there, some[:, 1:], 0)], there).items():
            rows = np.unique(x) if name == "E" else slice(None)
            first[name][rows] = 0.9 * first[name][rows] + 0.1 * d
            second[name][rows] = 0.99 * second[name][rows] + 0.01 * d * d
            rate = 0.01 * (1 - at / len(order)) / (1 - 0.9**step)
            layer.weights[name][rows] -= rate * first[name][rows] / (np.sqrt(second[name][rows] / (1 - 0.99**step)) + 1e-8)
    for k, v in layer.weights.items():
        assert np.quantile(np.abs(got.weights[k] - v), 0.99) < 1e-3, k


def test_fused_gradients(model, monkeypatch):
    """In onnxruntime and in numpy, in single precision: those of double precision, with places outside of texts and scores cut at their limits."""
    rng = np.random.default_rng(8)
    x, y = rng.integers(0, 40, (5, scoring.WINDOW)), rng.integers(0, scoring.CLASSES, (5, scoring.WINDOW))
    m = np.arange(scoring.WINDOW) < np.array([[32], [7], [20], [0], [32]])
    for size in (0.3, 3):
        weights = {k: rng.normal(0, size, v.shape) for k, v in model.layer.weights.items()}
        single = scoring.Layer({k: v.astype("<f4") for k, v in weights.items()})
        want = scoring.Layer({k: v.astype("<f4").astype(float) for k, v in weights.items()}).gradients(x, y, m)
        assert fused.gradients(scoring.WINDOW, scoring.WIDTH, scoring.STEEPEST, scoring.MOST) is not None
        by_fused = single.gradients(x, y, m)
        with monkeypatch.context() as patched:
            patched.setattr(fused, "gradients", lambda *_: None)
            by_numpy = single.gradients(x, y, m)
        for k, v in want.items():
            assert by_fused[k].dtype == by_numpy[k].dtype == np.float32
            for got in (by_fused[k], by_numpy[k]):
                assert got.shape == v.shape and np.abs(got - v).max() < 1e-3 * max(1e-2, np.abs(v).max()), k


def test_fused_scores(model, monkeypatch):
    """In onnxruntime and in numpy: those of one id after the other, in double precision; several texts, short and long."""
    rng, w = np.random.default_rng(9), {k: v.astype(float) for k, v in model.layer.weights.items()}
    n = np.array([2, 3, 33, 9, 70, 26, 25, 24, 2])
    ids = rng.integers(0, 121, n.sum())
    want = []
    for text in np.split(ids, np.cumsum(n)[:-1]):
        total = 0.0
        for k in range(len(text) - 1):
            window = max(0, k // scoring.STRIDE * scoring.STRIDE - (scoring.WINDOW - scoring.STRIDE))
            h, after = w["E"][text[window : k + 1]], text[k + 1]
            s = np.exp((h[-1] @ w["Q"]) @ (h @ w["K"]).T * scoring.WIDTH**-0.5 + w["R"][k - window - np.arange(len(h))])
            logits = s / s.sum() @ (h @ w["V"]) @ w["U"] + w["b"]
            last, p, c = model.place[text[k]], model.place[after], model.class_of[after]
            inner = model.log_after[last, p] if p < scoring.TOP else model.log_rest[last, c] + model.log_share[after]
            total += logits[c] - np.log(np.exp(logits).sum()) + inner
        want.append(total / math.log(10))
    assert fused.class_logs(scoring.WIDTH, scoring.WINDOW - scoring.STRIDE, scoring.STEEPEST, scoring.MOST) is not None
    assert np.abs(model.log10(ids, n) - want).max() < 1e-3
    monkeypatch.setattr(fused, "class_logs", lambda *_: None)
    assert np.abs(model.log10(ids, n) - want).max() < 1e-3


def test_hashes_of_words():
    """Of words of all lengths, also with zero bytes, no two are alike, and a word's hash is the same wherever it stands."""
    rng = np.random.default_rng(10)
    words = sorted({"".join(map(chr, rng.integers(97, 123, n))) for n in rng.integers(1, 100, 20_000)} | {"", "\0", "a", "a\0", "a\0\0", "日本" * 40, "x" * 64, "x" * 65})
    whole = scoring._hashes(pa.array(words))
    assert len(np.unique(whole)) == len(words) and scoring._hashes(pa.array([], pa.string())).tolist() == []
    assert (scoring._hashes(pa.array(words[700:])) == whole[700:]).all() and (scoring._hashes(pa.array(words)[31:90]) == whole[31:90]).all()
    assert scoring._hashes(pa.array(words[-1:])) == whole[-1]


def test_following_counts(spark):
    """What follows each other, summed over several chunks and tasks, is what the sequences hold; few messages carry it."""
    rows = [(k, " ".join(f"w{(k * 7 + i * i) % 90}" for i in range(k % 60))) for k in range(300)]
    table = scoring.chunks(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), PATH, 49407)
    place = np.arange(49408) * 31 % (scoring.TOP + 1)
    want, chunks = np.zeros((scoring.TOP + 1, scoring.TOP + 1), np.int64), [scoring.Chunk.read(r.data) for r in table.collect()]
    for chunk in chunks:
        for k in np.flatnonzero(chunk.training):
            ids, _ = chunk.sequences(49407, np.array([k]))
            np.add.at(want, (place[ids[:-1]], place[ids[1:]]), 1)
    assert (np.bincount(place, scoring.id_counts(table, 49407), scoring.TOP + 1) == want.sum(0)).all()  # each id but the first end follows one
    assert len(chunks) == 3 and (scoring.following_counts(table, place, 49407) == want).all()
    assert -(-(scoring.TOP + 1) // scoring.ROWS_TOGETHER) < 200 and scoring.ROWS_TOGETHER * (scoring.TOP + 1) <= 1 << 16
