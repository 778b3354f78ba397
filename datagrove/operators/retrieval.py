"""Ranked retrieval with an inverted index, and retrieval measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens

K1, B, EPSILON = 1.5, 0.75, 0.25


def postings(corpus: DataFrame, id_col: str, text_col: str, lower: bool = False) -> DataFrame:
    """docid, term and tf."""
    text = F.lower(text_col) if lower else F.col(text_col)
    terms = corpus.select(F.col(id_col).cast("string").alias("docid"), F.explode(tokens(text)).alias("term"))
    return terms.groupBy("docid", "term").agg(F.count(F.lit(1)).alias("tf"))


def corpus_stats(posted: DataFrame, size: int | Column) -> tuple[DataFrame, DataFrame]:
    """term, df and idf; and docid and len. Terms in more than half of the documents get EPSILON of the mean idf."""
    df = posted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    raw = df.withColumn("raw", F.log(F.lit(size) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    idf = raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))  # mean is one row
    return idf, posted.groupBy("docid").agg(F.sum("tf").alias("len"))


def top(scored: DataFrame, k: int) -> DataFrame:
    """qid, docid and score of the k best; ties to the lesser docid."""
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "docid")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def bm25(posted: DataFrame, size: int, queries: DataFrame, k: int = 20) -> DataFrame:
    """qid, docid, score (6 places) and rank of the k best documents with a term of the query; queries are (qid, term, qtf).

    Only postings of the queries' terms are joined and scored.
    """
    idf, length = corpus_stats(posted, size)
    average = length.agg((F.sum("len") / F.lit(size)).alias("avgdl"))
    hits = queries.join(idf, "term").join(posted, "term").join(length, "docid").crossJoin(F.broadcast(average))  # one row
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))
    return top(hits.groupBy("qid", "docid").agg(F.round(F.sum(part), 6).alias("score")), k)


def tfidf(posted: DataFrame, size: int, queries: DataFrame, k: int = 20) -> DataFrame:
    """qid, docid, score (cosine of smoothed tf-idf vectors, 6 places) and rank of the k best."""
    idf = posted.groupBy("term").agg((F.log((1 + F.lit(size)) / (1 + F.count(F.lit(1)))) + 1).alias("idf"))
    weights = posted.join(idf, "term").select("docid", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norms = weights.groupBy("docid").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    asked = queries.join(idf, "term").select("qid", "term", (F.col("qtf") * F.col("idf")).alias("q"))
    length = asked.groupBy("qid").agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("qnorm"))
    dots = asked.join(weights, "term").groupBy("qid", "docid").agg(F.sum(F.col("q") * F.col("w")).alias("dot"))
    scored = dots.join(norms, "docid").join(length, "qid")
    return top(scored.select("qid", "docid", F.round(F.col("dot") / (F.col("norm") * F.col("qnorm")), 6).alias("score")), k)


def measures(run: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """qid, p, recall, ap, ndcg and rr at k of each query in both; ties of score go to the greater docid."""
    judged = run.join(qrels.select("qid").distinct(), "qid", "left_semi")
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("docid"))
    ranked = judged.withColumn("rank", F.row_number().over(order)).join(qrels, ["qid", "docid"], "left").withColumn("rel", F.coalesce("rel", F.lit(0))).where(F.col("rank") <= k)
    so_far = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = ranked.withColumn("hit", (F.col("rel") > 0).cast("int")).withColumn("hits", F.sum("hit").over(so_far))
    gain = F.col("rel") / F.log2(F.col("rank") + 1)
    seen = ranked.groupBy("qid").agg(F.sum("hit").alias("h"), F.sum(F.col("hit") * F.col("hits") / F.col("rank")).alias("ap"), F.sum(gain).alias("dcg"), F.max(F.col("hit") / F.col("rank")).alias("rr"))
    best = Window.partitionBy("qid").orderBy(F.desc("rel"), "docid")
    ideal = qrels.withColumn("rank", F.row_number().over(best))
    ideal = ideal.groupBy("qid").agg(F.sum((F.col("rel") > 0).cast("int")).alias("relevant"), F.sum(F.when(F.col("rank") <= k, gain).otherwise(0.0)).alias("idcg"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6)).otherwise(0.0)
    return seen.join(ideal, "qid").select("qid", F.round(F.col("h") / k, 6).alias("p"), ratio("h", "relevant").alias("recall"), ratio("ap", "relevant").alias("ap"), ratio("dcg", "idcg").alias("ndcg"), F.round("rr", 6).alias("rr"))


def t_test(rows: DataFrame, group: str, value: str, one: str, two: str) -> DataFrame:
    """t of the two-sample test with pooled variance, the means and the sample deviations."""
    stats = rows.where(F.col(group).isin(one, two)).groupBy().agg(*[f(F.when(F.col(group) == g, F.col(value))).alias(f"{n}{k}") for k, g in ((1, one), (2, two)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / (F.col("n1") + F.col("n2") - 2)
    return stats.select(F.round("m1", 6).alias("mean1"), F.round("m2", 6).alias("mean2"), F.round(F.sqrt("v1"), 6).alias("std1"), F.round(F.sqrt("v2"), 6).alias("std2"), F.round((F.col("m1") - F.col("m2")) / F.sqrt(pooled * (1 / F.col("n1") + 1 / F.col("n2"))), 6).alias("t"))


def multilabel(pairs: DataFrame) -> DataFrame:
    """micro and macro precision, recall and F1 of (label, truth, predicted), 0 or 1 each."""
    by = pairs.groupBy("label").agg(*[F.sum((F.col("truth") == t) .cast("long") * (F.col("predicted") == p).cast("long")).alias(n) for n, t, p in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0))])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    by = by.select("*", p.alias("p"), r.alias("r"), ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f"))
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    return by.agg(*[F.round(c, 6).alias(n) for n, c in (("micro_p", ratio(tp, tp + fp)), ("micro_r", ratio(tp, tp + fn)), ("micro_f1", ratio(2 * tp, 2 * tp + fp + fn)), ("macro_p", F.avg("p")), ("macro_r", F.avg("r")), ("macro_f1", F.avg("f")))])


def subset_measures(pairs: DataFrame, item: str) -> DataFrame:
    """One row: the share of items whose labels are all right, and the share of labels that are wrong (Hamming loss), of
    (item, label, truth, predicted)."""
    wrong = (F.col("truth") != F.col("predicted")).cast("int")
    by = pairs.groupBy(item).agg(F.max(wrong).alias("any"), F.sum(wrong).alias("wrong"), F.count(F.lit(1)).alias("n"))
    return by.agg(F.round(F.avg(1 - F.col("any")), 6).alias("subset_accuracy"), F.round(F.sum("wrong") / F.sum("n"), 6).alias("hamming_loss"))
