"""Each stage on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, against the operators."""

import random

import pytest

import corpus_pipeline
from datagrove.llm import language, near_duplicates, quality, suffix_dedup

SF = "/root/testdata/sf0.001"
EXTRA = ["row", "kept", "score", "n_bytes", "n_removed", "predicted", "held_out", "key"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(6)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    words = rows[0][1].split()
    base = " ".join(rng.choice(words) + str(k) for k in range(120))
    rows += [(9001, None, "en", "s", None), (9002, "", "en", "s", 0), (None, base, "en", "s", 1), (9003, base, "en", "s", 1), (9004, base, "en", "s", 1), (9004, base, "en", "s", 1)]
    rows += [(9005, "plain words of the text " * 4000, None, None, 1), (9006, "x" * 40_000, "en", "s", 1)]
    wide = [(*r, *[f"{name}-{k}" for name in EXTRA]) for k, r in enumerate(rows)]
    return spark.createDataFrame(wide, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in EXTRA)).repartition(3).cache()


def ids(df):
    return sorted(str(r.row) for r in df.select("row").collect())


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_columns_and_empty_tables(spark, docs, name, stage):
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns
    before = {r.row: r for r in docs.collect()}
    for r in out.collect():
        assert tuple(r)[5:] == tuple(before[r.row])[5:]
        assert name == "suffix-array dedup" or tuple(r) == tuple(before[r.row])
    assert stage(spark, docs.limit(0), SF).collect() == []


def test_decisions(spark, docs):
    plain = docs.select("doc_id", "text", "lang", "source", "row")
    good = quality.score(plain, quality.train(plain, spark.read.parquet(f"{SF}/labels.parquet"))).where("score >= 0.3")
    assert ids(corpus_pipeline.quality_classifier(spark, docs, SF)) == ids(good)
    kept = language.identify(language.from_documents(plain.drop("row"))).where("kept")
    stays = {r.doc_id for r in kept.select("doc_id").collect()}
    found = corpus_pipeline.language_id(spark, docs, SF).collect()
    assert {r.doc_id for r in found} == stays and 9001 not in stays and 9002 not in stays and len(found) == kept.count()
    least = {r.doc_id for r in near_duplicates.near_duplicates(plain, 5, 80).where("kept").collect()}
    found = corpus_pipeline.minhash_near_dedup(spark, docs, SF)
    assert {r.doc_id for r in found.collect()} == least and 9003 in least and 9004 not in least and None in least


def test_suffixes(spark, docs):
    """Only passages of an earlier document go."""
    cut = {r.row: r.text for r in corpus_pipeline.suffix_array_dedup(spark, docs, SF).collect()}
    before = {r.row: r for r in docs.collect()}
    whole = {r.row: bytes(r.kept) for r in suffix_dedup.deduplicate(docs.select("doc_id", "text", "row")).collect()}
    assert cut.keys() == before.keys() == whole.keys()
    assert all(cut[k] == v.decode("utf-8", "ignore") for k, v in whole.items())
    assert [cut[k] for k, r in before.items() if r.doc_id == 9004] == ["", ""]


def test_whole(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and all(r.length > 0 for r in rows)
    ends = {}
    for r in rows:
        ends[r.sequence_id] = ends.get(r.sequence_id, 0) + r.length
    assert all(n == 4096 for k, n in ends.items() if k < max(ends))
