import functools
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from datagrove.llm import packing, token_files

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    words = ["the", "Cat", "Ünïcode", "don't", "99", "á", "\x1c", "\n", "　", "x" * 300, "<|endoftext|>", "日本語", "\u2122", "a\u2122b", "İ,", "don't!!", "x',", "\u2260", "a\u0338.", "é.#", "\u0308x", "\u00a0"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(60))), rng.choice(["s0", "s0", "s0", "s1", None, "s2"]), "extra") for k in range(300)]
    rows += [(7, "again", "s0", "x"), (7, "again", "s0", "x"), (None, None, None, None), (400, "", "s1", ""), (401, "word " * 9000, "s2", "")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, part string").repartition(5)


@functools.cache
def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def ids_of(text, end):
    return tokenizer().encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_files(spark, docs, tmp_path):
    images = token_files.write(docs, PATH)
    got = sorted(map(tuple, token_files.read(images).collect()), key=lambda r: r[1])
    want, at = [], 0
    for k, text, *_ in sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or "")):
        ids = ids_of(text, 1)
        want.append((k, at, len(ids), crc(ids)))
        at += len(ids)
    assert got == want
    saved = token_files.save_files(images, str(tmp_path)).collect()
    assert sum(token_files.Image(open(r.path, "rb").read()).docs for r in saved) == docs.count()


@pytest.mark.parametrize("bits", [False, True])
def test_image(bits):
    rng = np.random.default_rng(1)
    ids = [rng.integers(0, top, n).astype("<u4") for top, n in ((9, 5), (70_000, 1000), (1 << 31, 777), (1, 3))]
    image = token_files.Image(token_files.pack_image([1, None, 5, 6], ids, bits=bits, block=100))
    flat = np.concatenate(ids)
    assert image.doc_ids == [1, None, 5, 6] and (image.range(0, len(flat)) == flat).all() and (image.range(150, 333) == flat[150:333]).all()


def test_packing(spark, docs):
    rows = packing.pack(packing.tokens(docs, PATH), window=256).collect()
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_window[r.sequence_id].append(r)
    total = 0
    for r in docs.collect():
        ids = ids_of(r.text, 2)
        total += len(ids)
        if r.doc_id == 7:
            continue
        at = 0
        for p in sorted(by_doc[r.doc_id], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == crc(ids[at : at + p.length])
            at += p.length
        assert at == len(ids)
    assert sorted(by_window) == list(range(-(-total // 256)))
    whole = defaultdict(int)
    for r in rows:
        whole[r.source] += r.length
    for w, pieces in by_window.items():
        at, share = 0, defaultdict(int)
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
            share[p.source] += p.length
        assert at == (256 if w < max(by_window) else total - 256 * w)
        assert all(abs(share[s] - at * n / total) < 2 for s, n in whole.items())
    few = packing.pack(packing.tokens(docs, PATH), window=256, max_queues=2).collect()
    assert sum(r.length for r in few) == total and len({(r.sequence_id, r.offset) for r in few}) == len(few)
    assert packing.pack(packing.tokens(docs.limit(0), PATH)).collect() == []


def test_schedule():
    rng = random.Random(1)
    for _ in range(60):
        tokens = [rng.choice([1, 2, 5, 40, 700]) for _ in range(rng.randrange(1, 7))]
        weights = rng.choice([None, [rng.randrange(0, 4) for _ in tokens]])
        s, before = packing.Schedule(tokens, weights), [0] * len(tokens)
        for x in range(s.total + 1):
            now = s.given(x)
            assert sum(now) == x and all(a <= b <= t for a, b, t in zip(before, now, tokens, strict=True))
            before = now
    assert packing.Schedule([100, 100], [3, 1]).given(40) == [30, 10]


def test_weights(spark, docs):
    """Fractional weights, and a weight for a source that is not among the largest."""
    stored = packing.tokens(docs, PATH)
    held = {r.source: r.n for r in stored.groupBy("source").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()}
    small = min(held, key=held.get)
    big = max(held, key=held.get)
    rows = packing.pack(stored, window=64, weights={small: 0.7, big: 0.3}, max_queues=1).collect()
    share = defaultdict(int)
    for r in rows:
        if r.sequence_id < 4:
            share[r.source] += r.length
    assert abs(share[small] - 0.7 * 256) <= 2 and abs(share[big] - 0.3 * 256) <= 2
    assert sum(r.length for r in rows) == sum(held.values())


def test_many_sources(spark):
    rows = spark.range(4000).selectExpr("id doc_id", "concat('s', id % 2000) source", "repeat('word ', int(id % 7)) text")
    got = packing.pack(packing.tokens(rows, PATH), window=128).collect()
    assert sum(r.length for r in got) == sum(k % 7 + 1 for k in range(4000))
    ends = defaultdict(int)
    for r in got:
        ends[r.sequence_id] += r.length
    assert all(ends[k] == 128 for k in range(len(ends) - 1))


def test_word_ids_of_unspaced_text():
    from datagrove.llm.word_ids import WordIds

    words = WordIds(PATH)
    rng = random.Random(2)
    texts = ["".join(rng.choice("日本語xyz") for _ in range(50_000)), "a b", "x" * 70_000]
    for t, ids in zip(texts, words.of(texts), strict=True):
        assert np.frombuffer(ids, words.kind).tolist() == tokenizer().encode(t, add_special_tokens=False).ids
    words.of(["a"])
    assert max(map(len, words.cache.new)) <= 64


def test_word_ids_of_arrow_texts():
    """Texts come as Arrow arrays, are cut into runs, and the table of words met lately stays bounded."""
    import pyarrow as pa

    from datagrove.llm.word_ids import WordIds

    words, rng = WordIds(PATH), random.Random(4)
    words.cache.entries = 50
    texts = ["".join(rng.choice("aeé'!.,́ \x1c™ \tTHE") for _ in range(rng.randrange(80))) for _ in range(300)] + [None, "", " \n"]
    for kind in (pa.string(), pa.large_string()):
        for some in (texts, texts[:7], []):
            got = words.of(pa.array(some, kind))
            assert [np.frombuffer(ids, words.kind).tolist() for ids in got] == [ids_of(t, 0)[:-1] for t in some]
            assert len(words.cache.words) <= 50
