"""Counts, statistics and aggregates over graphs, labels and events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph, retrieval
from ..sources.tables import table
from .registry import query


@query("predicate_stats", "SELECT coalesce(event_type, 'total') AS predicate, count(*) AS n FROM events GROUP BY ROLLUP (event_type)")
def predicate_stats(spark, d):
    return table(spark, d, "events").rollup("event_type").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("event_type", F.lit("total")).alias("predicate"), "n")


@query("term_stats", """
    WITH t AS (SELECT 'customer' AS kind, CAST(o_custkey AS VARCHAR) AS term FROM orders UNION ALL SELECT 'order', CAST(o_orderkey AS VARCHAR) FROM orders UNION ALL SELECT 'literal', o_orderpriority FROM orders)
    SELECT kind, count(DISTINCT term) AS n FROM t GROUP BY kind""")
def term_stats(spark, d):
    orders = table(spark, d, "orders")
    terms = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("term")) for k, c in (("customer", "o_custkey"), ("order", "o_orderkey"), ("literal", "o_orderpriority"))])
    return orders.select(F.explode(terms).alias("t")).select("t.*").groupBy("kind").agg(F.countDistinct("term").alias("n"))


@query("label_counts", "SELECT name AS label, count(*) AS n FROM (SELECT unnest(['quality', 'toxic']) AS name, unnest([quality, toxic]) AS v FROM labels) WHERE v = 1 GROUP BY name")
def label_counts(spark, d):
    names = F.array_compact(F.array(F.when(F.col("quality") == 1, "quality"), F.when(F.col("toxic") == 1, "toxic")))
    return table(spark, d, "labels").select(F.explode(names).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("label_binarise", "SELECT doc_id, CASE WHEN quality = 1 THEN 1 ELSE 0 END AS is_quality, CASE WHEN toxic = 1 THEN 1 ELSE 0 END AS is_toxic FROM labels")
def label_binarise(spark, d):
    names = F.array_compact(F.array(F.when(F.col("quality") == 1, "quality"), F.when(F.col("toxic") == 1, "toxic")))
    return table(spark, d, "labels").withColumn("names", names).select("doc_id", *[F.array_contains("names", n).cast("int").alias(f"is_{n}") for n in ("quality", "toxic")])


def _edges(spark, d):
    """lineitem as edges: orders to parts, with duplicates."""
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.lit("order").alias("type"), F.col("l_quantity").alias("weight"))


@query("node_degree", "SELECT node, count(*) AS degree FROM (SELECT l_partkey AS node FROM lineitem UNION ALL SELECT l_suppkey FROM lineitem) GROUP BY node")
def node_degree(spark, d):
    return graph.degrees(_edges(spark, d))


@query("adjacency_sum", "SELECT l_partkey AS src, l_suppkey AS dst, sum(l_quantity) AS weight FROM lineitem GROUP BY 1, 2")
def adjacency_sum(spark, d):
    return graph.adjacency(_edges(spark, d))


@query("edge_type_counts", "SELECT l_returnflag AS type, count(*) AS n FROM lineitem GROUP BY 1")
def edge_type_counts(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("type")).agg(F.count(F.lit(1)).alias("n"))


@query("mode_tiebreak", """
    SELECT user_id, event_type AS mode FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type DESC) AS r
    FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2)) WHERE r = 1""")
def mode_tiebreak(spark, d):
    counts = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("user_id").agg(F.max_by("event_type", F.struct("n", "event_type")).alias("mode"))


@query("ttest_two_sample", """
    WITH s AS (SELECT count(*) FILTER (event_type = 'view') AS n1, avg(value) FILTER (event_type = 'view') AS m1, var_samp(value) FILTER (event_type = 'view') AS v1,
        count(*) FILTER (event_type = 'click') AS n2, avg(value) FILTER (event_type = 'click') AS m2, var_samp(value) FILTER (event_type = 'click') AS v2 FROM events)
    SELECT round(m1, 6) AS mean1, round(m2, 6) AS mean2, round(sqrt(v1), 6) AS std1, round(sqrt(v2), 6) AS std2, round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)), 6) AS t FROM s""")
def ttest_two_sample(spark, d):
    return retrieval.t_test(table(spark, d, "events"), "event_type", "value", "view", "click")


_PREDICTED = "(SELECT 'quality' AS label, quality AS truth, CASE WHEN doc_id % 5 < 4 THEN 1 ELSE 0 END AS predicted FROM labels UNION ALL SELECT 'toxic', toxic, CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END FROM labels)"


@query("multilabel_metrics", f"""
    WITH c AS (SELECT label, sum(truth * predicted) AS tp, sum((1 - truth) * predicted) AS fp, sum(truth * (1 - predicted)) AS fn FROM {_PREDICTED} GROUP BY label),
    r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r, CASE WHEN tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f FROM c)
    SELECT round(sum(tp) / (sum(tp) + sum(fp)), 6) AS micro_p, round(sum(tp) / (sum(tp) + sum(fn)), 6) AS micro_r, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS micro_f1,
        round(avg(p), 6) AS macro_p, round(avg(r), 6) AS macro_r, round(avg(f), 6) AS macro_f1 FROM r""")
def multilabel_metrics(spark, d):
    labels = table(spark, d, "labels")
    one = labels.select(F.lit("quality").alias("label"), F.col("quality").alias("truth"), (F.col("doc_id") % 5 < 4).cast("int").alias("predicted"))
    two = labels.select(F.lit("toxic").alias("label"), F.col("toxic").alias("truth"), (F.col("doc_id") % 7 == 0).cast("int").alias("predicted"))
    return retrieval.multilabel(one.unionAll(two))


@query("subset_measures", """
    SELECT round(avg(CAST(w1 + w2 = 0 AS INT)), 6) AS subset_accuracy, round(sum(w1 + w2) / (2 * count(*)), 6) AS hamming_loss
    FROM (SELECT CAST(quality <> CASE WHEN doc_id % 5 < 4 THEN 1 ELSE 0 END AS INT) AS w1, CAST(toxic <> CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS INT) AS w2 FROM labels)""")
def subset_measures(spark, d):
    labels = table(spark, d, "labels")
    one = labels.select("doc_id", F.lit("quality").alias("label"), F.col("quality").alias("truth"), (F.col("doc_id") % 5 < 4).cast("int").alias("predicted"))
    two = labels.select("doc_id", F.lit("toxic").alias("label"), F.col("toxic").alias("truth"), (F.col("doc_id") % 7 == 0).cast("int").alias("predicted"))
    return retrieval.subset_measures(one.unionAll(two), "doc_id")


@query("argmax_class", """
    SELECT vec_id, CAST(k - 1 AS INT) AS class FROM (SELECT vec_id, k, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, k) AS r
    FROM (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS k, unnest(embedding) AS v FROM embeddings)) WHERE r = 1""")
def argmax_class(spark, d):
    """The first of the greatest class scores."""
    scores = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", (F.array_position(scores, F.array_max(scores)) - 1).cast("int").alias("class"))


@query("masked_mean_pool", """
    SELECT label, CAST(i AS INT) AS dim, round(avg(CAST(embedding[i] AS DOUBLE)) FILTER (vec_id % 3 > 0), 6) AS mean FROM embeddings, range(1, 65) t(i) GROUP BY label, i""")
def masked_mean_pool(spark, d):
    rows = table(spark, d, "embeddings").select("label", "vec_id", F.posexplode("embedding").alias("i", "v"))
    mean = F.avg(F.when(F.col("vec_id") % 3 > 0, F.col("v").cast("double")))
    return rows.groupBy("label", (F.col("i") + 1).alias("dim")).agg(F.round(mean, 6).alias("mean"))


@query("sheet_row_features", """
    SELECT c_custkey AS row, CAST((CASE WHEN v1 IN ('', 'N/A') THEN 1 ELSE 0 END) + (CASE WHEN v2 IN ('', 'N/A') THEN 1 ELSE 0 END) + (CASE WHEN v3 IN ('', 'N/A') THEN 1 ELSE 0 END) AS BIGINT) AS n_none,
        round(CASE WHEN (v1 NOT IN ('', 'N/A')) OR (v3 NOT IN ('', 'N/A')) THEN (CASE WHEN v2 NOT IN ('', 'N/A') THEN 1 ELSE 0 END) / ((CASE WHEN v1 NOT IN ('', 'N/A') THEN 1 ELSE 0 END) + (CASE WHEN v2 NOT IN ('', 'N/A') THEN 1 ELSE 0 END) + (CASE WHEN v3 NOT IN ('', 'N/A') THEN 1 ELSE 0 END)) END, 6) AS numeric_ratio
    FROM (SELECT c_custkey, c_name AS v1, CASE WHEN c_custkey % 4 = 0 THEN 'N/A' ELSE CAST(c_nationkey AS VARCHAR) END AS v2, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS v3 FROM customer)""")
def sheet_row_features(spark, d):
    """Empty cells and the share of numbers of each row of a melted sheet."""
    from ..functions.text import is_number_cell

    rows = table(spark, d, "customer")
    values = F.array("c_name", F.when(F.col("c_custkey") % 4 == 0, "N/A").otherwise(F.col("c_nationkey").cast("string")), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment")))
    cells = rows.select(F.col("c_custkey").alias("row"), F.explode(values).alias("value"))
    none = F.col("value").isin("", "...", ". . .", "--", "N/A") | F.col("value").isNull()
    number = (~none & is_number_cell(F.col("value"))).cast("int")
    return cells.groupBy("row").agg(F.sum(none.cast("long")).alias("n_none"), F.round(F.sum(number) / F.nullif(F.sum((~none).cast("int")), F.lit(0)), 6).alias("numeric_ratio"))


@query("early_stop", """
    SELECT user_id, min(event_id) AS best FROM (SELECT user_id, event_id, value, max(value) OVER (PARTITION BY user_id) AS top FROM events) WHERE value = top GROUP BY user_id""")
def early_stop(spark, d):
    """The first step with the best value."""
    return table(spark, d, "events").withColumn("top", F.max("value").over(Window.partitionBy("user_id"))).where("value = top").groupBy("user_id").agg(F.min("event_id").alias("best"))
