import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from datagrove.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    bpe = byte_bpe.ByteBPE.from_file(PATH, public_tokenizers.PATTERN)
    return bpe, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


def brute(theirs, text):
    ids = theirs.encode_ordinary(text)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(theirs.decode_bytes(ids)).hexdigest()


def test_random_texts(both):
    rng = random.Random(5)
    for _ in range(400):
        text = "".join(rng.choice(["a", "the", "'s", "n't", " ", "  ", "\n", "\t", "é", "ß", "日本", "12", "!", "\x1c", " ", "　", "<|endoftext|>", "aaaa"]) for _ in range(rng.randrange(40)))
        assert both[0].digests([text])[0] == brute(both[1], text), repr(text)


def test_very_long_match(both):
    text = "ab" * 20_000 + "c" * 30_000 + " " * 3_000
    assert both[0].digests([text])[0] == brute(both[1], text)


def test_frames(spark, both):
    df = spark.createDataFrame([(1, "the cat", "x"), (1, "the cat", "x"), (None, None, None), (3, "", "y")], "doc_id long, text string, t string")
    rows = sorted(map(tuple, byte_bpe.digests(df, PATH, public_tokenizers.PATTERN).collect()), key=str)
    assert rows == sorted([(k, *brute(both[1], t or "")) for k, t, _ in df.collect()], key=str)
    ids = byte_bpe.encode(df, PATH, public_tokenizers.PATTERN)
    assert sorted(bytes(r.decoded) for r in byte_bpe.decode(ids, PATH, public_tokenizers.PATTERN).collect()) == [b"", b"", b"the cat", b"the cat"]
    assert byte_bpe.digests(df.limit(0), PATH, public_tokenizers.PATTERN).collect() == []


def naive(ranks, data):
    """The least rank, leftmost, again and again."""
    parts = [data[k : k + 1] for k in range(len(data))]
    while found := [(ranks[parts[k] + parts[k + 1]], k) for k in range(len(parts) - 1) if parts[k] + parts[k + 1] in ranks]:
        k = min(found)[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return [ranks[p] for p in parts]


def test_any_order_of_ranks():
    """Vocabularies whose merges may call for lower ranks than their own."""
    rng = random.Random(7)
    for _ in range(60):
        tokens = sorted({bytes(rng.choice(b"abc") for _ in range(rng.randrange(2, 6))) for _ in range(40)})
        rng.shuffle(tokens)
        ranks = {t: k for k, t in enumerate([b"a", b"b", b"c", *tokens])}
        bpe = byte_bpe.ByteBPE(ranks, ".+")
        matches = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 30))) for _ in range(20)]
        ids, counts = bpe.merge(matches)
        assert ids.tolist() == [i for m in matches for i in naive(ranks, m)]
        assert counts.tolist() == [len(naive(ranks, m)) for m in matches]


def test_unspaced_texts_stay_out_of_the_caches(both):
    rng = random.Random(8)
    texts = ["".join(rng.choice("日本語文字列xyz") for _ in range(20_000)) for _ in range(20)]
    assert both[0].digests(texts) == [brute(both[1], t) for t in texts]
    both[0].digests(["a"])
    assert max(map(len, [*both[0].ids.new, *both[0].words.new])) <= 64
