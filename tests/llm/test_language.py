import random

from datagrove.llm import language

SF = "/root/testdata/sf0.01"


def test_agrees_with_declared(spark):
    rows = language.from_documents(spark.read.parquet(f"{SF}/documents.parquet")).unionByName(language.from_pages(spark.read.parquet(f"{SF}/pages.parquet")))
    got = language.identify(rows).collect()
    assert len(got) == 1250
    docs = [r for r in got if r.doc_id is not None]
    assert sum(r.language == r.declared for r in docs) >= 0.99 * len(docs) and sum(r.kept for r in docs) >= 0.99 * len(docs)
    pages = [r for r in got if r.page_id is not None]
    assert sum(r.language == r.text_language for r in pages) >= 0.9 * len(pages)


def test_evidence_moves_short_texts(spark):
    rows = [(k, None, "en", None, "a.x.com", "x.com", "the house and the garden of this man with that") for k in range(60)]
    rows += [(100 + k, None, "de", None, "b.x.com", "x.com", "das haus und der garten von diesem mann mit der") for k in range(60)]
    rows += [(200, None, None, None, "b.x.com", "x.com", "ok"), (201, None, None, None, "a.x.com", "x.com", "ok"), (202, None, "de", None, None, None, ""), (203, None, None, None, None, None, None), (203, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, page_id long, declared string, suffix string, host string, domain string, text string")
    got = {r.doc_id: r for r in language.identify(df).collect()}
    assert got[200].language == "de" and got[201].language == "en" and got[202].language == "de" and not got[202].kept and not got[203].kept
    assert language.identify(df.limit(0)).collect() == []
    assert {r.kept for r in language.identify(df.where("doc_id = 203")).collect()} == {False}


def test_rare_and_many_languages(spark):
    """70 languages, one of them with under 0.1% of the declared rows."""
    rng = random.Random(3)
    words = [["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(12)] for _ in range(70)]
    rows = [(k, None, f"l{k % 69:02d}", None, None, None, " ".join(rng.choices(words[k % 69], k=12))) for k in range(69 * 60)]
    rows += [(10_000 + k, None, "l69", None, None, None, " ".join(rng.choices(words[69], k=12))) for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, page_id long, declared string, suffix string, host string, domain string, text string")
    got = language.identify(df).collect()
    assert len(got) == len(rows) and sum(r.language == r.declared for r in got) >= 0.99 * len(rows)
    assert {(r.language, r.kept) for r in got if r.declared == "l69"} == {("l69", True)}


def test_page_evidence(spark):
    df = spark.createDataFrame([(1, "https://u@m.a.example.org:8/fr/p?q", '<html class="x" lang="FR-be"><script>if (a<b) {}</script><p>Un  mot</p>'), (2, None, None), (3, "junk", "<html>")], "page_id long, url string, html string")
    rows = {r.page_id: r for r in language.from_pages(df).collect()}
    assert (rows[1].declared, rows[1].suffix, rows[1].host, rows[1].domain, rows[1].text) == ("fr", "/fr", "m.a.example.org", "example.org", "Un mot")
    assert rows[2].declared is None and rows[2].suffix is None and rows[3].host is None


def test_tags(spark):
    """en-US and en are one language, an empty tag is none; ties, repeated rows and clashing columns don't matter."""
    rows = [(k, "the house and the garden", lang, "s", "x") for k, lang in enumerate(["en-US", "en", "", None, "EN"] * 4)] + [(3, "the house and the garden", None, "s", "x")]
    rows += [(100, "word " * 40_000, "de", "t", "x"), (101, None, "de", "t", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, language string")
    evidence = language.from_documents(docs)
    assert language.languages(evidence) == ["de", "en"]
    got = language.identify(evidence).collect()
    assert len(got) == len(rows) and {r.language for r in got if r.doc_id < 100} == {"en"} and not next(r for r in got if r.doc_id == 101).kept


def test_two_hundred_languages(spark):
    """Rare languages stay candidates, by brute force over the same evidence."""
    import math
    from collections import Counter

    rng = random.Random(3)
    words = {l: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(5)] for l in range(200)}
    rows = [(k, " ".join(rng.choice(words[k % 200]) for _ in range(30)), f"l{k % 200:03d}", "s") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.text_language for r in language.identify(language.from_documents(docs)).collect()}
    slots = {k: language._trigrams([t])[0].tolist() for k, t, _, _ in rows}
    counts, whole = Counter(), Counter()
    for k, _, l, _ in rows:
        counts.update((l, s) for s in slots[k])
        whole[l] += len(slots[k])
    for k, *_ in rows[:40]:
        ll = {l: sum(math.log((counts[l, s] + 0.5) / (whole[l] + 0.5 * language.SLOTS)) for s in slots[k]) for l in whole}
        assert got[k] == max(ll, key=ll.get) == rows[k][2]
