"""Retrieval over documents with benchmark passages as queries, and its measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval
from ..sources.tables import table
from .registry import query

_POSTED = r"(SELECT docid, term, count(*) AS tf FROM (SELECT CAST(doc_id AS VARCHAR) AS docid, unnest(regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM documents) GROUP BY 1, 2)"
_ASKED = r"(SELECT qid, term, count(*) AS qtf FROM (SELECT CAST(item_id AS VARCHAR) AS qid, unnest(regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM benchmark) GROUP BY 1, 2)"
_RAW, _LOWER = _POSTED.format("text"), _POSTED.format("lower(text)")
_QRAW, _QLOWER = _ASKED.format("text"), _ASKED.format("lower(text)")
_IDF = f"""(SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER () ELSE raw END AS idf FROM (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM {_RAW} GROUP BY 1), (SELECT count(*) AS n FROM documents)))"""


def _posted(spark, d, lower=False):
    return retrieval.postings(table(spark, d, "documents"), "doc_id", "text", lower)


def _asked(spark, d, lower=False):
    return retrieval.postings(table(spark, d, "benchmark"), "item_id", "text", lower).toDF("qid", "term", "qtf")


@query("bm25_stats", f"SELECT term, df, round(idf, 6) AS idf FROM {_IDF}")
def bm25_stats(spark, d):
    return retrieval.corpus_stats(_posted(spark, d), table(spark, d, "documents").count())[0].select("term", "df", F.round("idf", 6).alias("idf"))


_BM25 = f"""(WITH p AS (SELECT * FROM {_RAW}), l AS (SELECT docid, sum(tf) AS len FROM p GROUP BY 1), a AS (SELECT sum(len) / (SELECT count(*) FROM documents) AS avgdl FROM l),
    s AS (SELECT qid, docid, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl))), 6) AS score FROM {_QRAW} q JOIN {_IDF} USING (term) JOIN p USING (term) JOIN l USING (docid), a GROUP BY 1, 2)
    SELECT qid, docid, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS INT) AS rank FROM s QUALIFY rank <= 20)"""


def _bm25(spark, d, k=20):
    return retrieval.bm25(_posted(spark, d), table(spark, d, "documents").count(), _asked(spark, d), k)


@query("bm25_topk", f"SELECT * FROM {_BM25}")
def bm25_topk(spark, d):
    return _bm25(spark, d)


_TFIDF = f"""(WITH p AS (SELECT * FROM {_LOWER}), i AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM p GROUP BY 1),
    w AS (SELECT docid, term, tf * idf AS w FROM p JOIN i USING (term)), n AS (SELECT docid, sqrt(sum(w * w)) AS n FROM w GROUP BY 1),
    q AS (SELECT qid, term, qtf * idf AS w FROM {_QLOWER} JOIN i USING (term)), m AS (SELECT qid, sqrt(sum(w * w)) AS m FROM q GROUP BY 1),
    s AS (SELECT qid, docid, round(dot / (n * m), 6) AS score FROM (SELECT qid, docid, sum(q.w * w.w) AS dot FROM q JOIN w USING (term) GROUP BY 1, 2) JOIN n USING (docid) JOIN m USING (qid))
    SELECT qid, docid, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS INT) AS rank FROM s QUALIFY rank <= 20)"""


@query("tfidf_topk", f"SELECT * FROM {_TFIDF}")
def tfidf_topk(spark, d):
    return retrieval.tfidf(_posted(spark, d, True), table(spark, d, "documents").count(), _asked(spark, d, True))


@query("two_stage_rerank", f"SELECT qid, docid, CAST(row_number() OVER (PARTITION BY qid ORDER BY n_chars, docid) AS INT) AS rank FROM (SELECT qid, docid FROM {_BM25}) JOIN documents ON CAST(doc_id AS VARCHAR) = docid QUALIFY rank <= 5")
def two_stage_rerank(spark, d):
    """The best 20 by BM25, ordered anew by a second score (here the shortest first), and the best 5 of them."""
    length = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("docid"), (-F.col("n_chars")).alias("score"))
    return retrieval.top(_bm25(spark, d).select("qid", "docid").join(length, "docid"), 5).select("qid", "docid", "rank")


#: A document is relevant (2) where it holds the passage's first 60 characters, and (1) in English where its id is divisible by the passage's id plus 3.
_QRELS = "(SELECT qid, docid, max(rel) AS rel FROM (SELECT CAST(item_id AS VARCHAR) AS qid, CAST(doc_id AS VARCHAR) AS docid, 2 AS rel FROM benchmark b, documents d WHERE contains(d.text, left(b.text, 60)) UNION ALL SELECT CAST(item_id AS VARCHAR), CAST(doc_id AS VARCHAR), 1 FROM benchmark, documents WHERE lang = 'en' AND doc_id % (item_id + 3) = 0) GROUP BY 1, 2)"


def _qrels(spark, d):
    passages = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("qid"), "item_id", F.substring("text", 1, 60).alias("start"))
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("docid"), "doc_id", "lang", "text")
    # A passage's start names documents by its longest inner word; contains decides. Starts without one are gone through as a query set.
    words = lambda c: F.split(c, " ")
    inner = F.slice(words(F.col("start")), 2, F.greatest(F.size(words(F.col("start"))) - 2, F.lit(0)))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    keyed = passages.withColumn("key", F.nullif(longest, F.lit("")))
    found = docs.select("docid", F.explode(F.array_distinct(words(F.col("text")))).alias("key")).join(keyed.where("key is not null").select("qid", "start", "key"), "key")
    holds = docs.select("docid", "text").join(found.select("docid", "qid", "start"), "docid").where(F.col("text").contains(F.col("start")))
    rest = docs.join(keyed.where("key is null"), F.col("text").contains(F.col("start")))
    holds = holds.select("qid", "docid").unionAll(rest.select("qid", "docid")).withColumn("rel", F.lit(2))
    last = docs.agg(F.coalesce(F.max("doc_id"), F.lit(0)).alias("last"))
    step = F.col("item_id") + 3
    multiples = passages.join(F.broadcast(last)).select("qid", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"), step)).alias("doc_id"))  # last is one row
    other = docs.where("lang = 'en'").join(multiples, "doc_id").select("qid", "docid", F.lit(1).alias("rel"))
    return holds.unionAll(other).groupBy("qid", "docid").agg(F.max("rel").alias("rel"))


def _measured(k):
    ratio = lambda a, b: f"CASE WHEN {b} > 0 THEN round({a} / {b}, 6) ELSE 0 END"
    return f"""(WITH q AS (SELECT * FROM {_QRELS}), r AS (SELECT qid, docid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid DESC) AS rank FROM {_BM25}),
        j AS (SELECT r.qid, rank, coalesce(rel, 0) AS rel, sum(CASE WHEN coalesce(rel, 0) > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY r.qid ORDER BY rank) AS hits FROM r LEFT JOIN q USING (qid, docid) WHERE rank <= {k}),
        s AS (SELECT qid, sum(CASE WHEN rel > 0 THEN 1 ELSE 0 END) AS h, sum(CASE WHEN rel > 0 THEN hits / rank ELSE 0 END) AS ap, sum(rel / log2(rank + 1)) AS dcg, max(CASE WHEN rel > 0 THEN 1 / rank ELSE 0 END) AS rr FROM j GROUP BY 1),
        i AS (SELECT qid, sum(CASE WHEN rel > 0 THEN 1 ELSE 0 END) AS relevant, sum(CASE WHEN n <= {k} THEN rel / log2(n + 1) ELSE 0 END) AS idcg FROM (SELECT qid, rel, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, docid) AS n FROM q) GROUP BY 1)
        SELECT qid, round(h / {k}, 6) AS p, {ratio('h', 'relevant')} AS recall, {ratio('ap', 'relevant')} AS ap, {ratio('dcg', 'idcg')} AS ndcg, round(rr, 6) AS rr FROM s JOIN i USING (qid))"""


@query("retrieval_metrics", f"SELECT k, round(avg(p), 5) AS p, round(avg(recall), 5) AS recall, round(avg(ap), 5) AS map, round(avg(ndcg), 5) AS ndcg FROM (SELECT 5 AS k, * FROM {_measured(5)} UNION ALL SELECT 10, * FROM {_measured(10)}) GROUP BY k")
def retrieval_metrics(spark, d):
    run, qrels = _bm25(spark, d).select("qid", "docid", "score").persist(), _qrels(spark, d).persist()  # 20 rows a query; judged pairs
    means = [F.round(F.avg(c), 5).alias(n) for c, n in (("p", "p"), ("recall", "recall"), ("ap", "map"), ("ndcg", "ndcg"))]
    both = retrieval.measures(run, qrels, 5).withColumn("k", F.lit(5)).unionByName(retrieval.measures(run, qrels, 10).withColumn("k", F.lit(10)))
    return both.groupBy("k").agg(*means)


@query("mrr_at_k", f"SELECT qid, rr FROM {_measured(10)}")
def mrr_at_k(spark, d):
    return retrieval.measures(_bm25(spark, d).select("qid", "docid", "score"), _qrels(spark, d), 10).select("qid", "rr")


@query("cosine_topk", """
    WITH v AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings),
    s AS (SELECT q.vec_id AS query_id, r.vec_id, round(list_cosine_similarity(q.e, r.e), 5) AS score FROM v q, v r WHERE q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id)
    SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s QUALIFY rank <= 5""")
def cosine_topk(spark, d):
    """The stated queries (ids divisible by 50) against all vectors."""
    from pyspark.sql import Window

    norm = lambda e: F.sqrt(F.aggregate(e, F.lit(0.0), lambda s, v: s + v * v))
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e")).withColumn("n", norm(F.col("e")))
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("e").alias("q"), F.col("n").alias("qn"))
    dot = F.aggregate(F.zip_with("q", "e", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    scored = rows.join(asked, F.col("vec_id") != F.col("query_id")).select("query_id", "vec_id", F.round(dot / (F.col("qn") * F.col("n")), 5).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where("rank <= 5")
