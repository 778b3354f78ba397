"""Samples, splits, runs and graph profiles over the star schema and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import sane_url
from ..operators import graph, samples, units
from ..sources.tables import table
from .graphs import _EDGES, _edges
from .registry import query

_PLACE = "CAST(('0x' || substr(md5({0} || ':{1}'), 1, 6)) AS BIGINT)"


@query("query_split", f"SELECT item_id, CASE WHEN {_PLACE.format('CAST(item_id AS VARCHAR)', 7)} % 100 < 80 THEN 'train' ELSE 'val' END AS split FROM benchmark")
def query_split(spark, d):
    return samples.split(table(spark, d, "benchmark"), "item_id", 7).select("item_id", "split")


@query("cross_validation", f"SELECT count(*) AS folds, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS std FROM (SELECT avg(c_acctbal) AS m FROM customer GROUP BY {_PLACE.format('CAST(c_custkey AS VARCHAR)', 1)} % 5)")
def cross_validation(spark, d):
    return samples.cross_validated(samples.folds(table(spark, d, "customer"), "c_custkey", 5, 1), "fold", "c_acctbal")


@query("grid_search", "SELECT event_type, CAST(bucket AS INT) AS bucket, last FROM (SELECT event_type, user_id % 2 AS bucket, arg_max(value, event_id) AS last FROM events GROUP BY 1, 2) ORDER BY last DESC, event_type, bucket LIMIT 1")
def grid_search(spark, d):
    rows = table(spark, d, "events").withColumn("bucket", (F.col("user_id") % 2).cast("int"))
    return samples.best_setting(rows, ["event_type", "bucket"], "event_id", "value")


_NIDS = "(SELECT node_type, local_id, row_number() OVER (ORDER BY t, local_id) - 1 AS nid FROM (SELECT 'region' AS node_type, CAST(r_regionkey AS BIGINT) AS local_id, 1 AS t FROM region UNION ALL SELECT 'nation', n_nationkey, 2 FROM nation UNION ALL SELECT 'customer', c_custkey, 3 FROM customer))"


def _nids(spark, d):
    keys = [table(spark, d, t).select(F.lit(t).alias("node_type"), F.col(k).cast("long").alias("local_id")) for t, k in (("region", "r_regionkey"), ("nation", "n_nationkey"), ("customer", "c_custkey"))]
    return graph.dense_ids(keys[0].unionAll(keys[1]).unionAll(keys[2]), ["region", "nation", "customer"])


@query("corpus_by_node_id", f"SELECT nid, coalesce(r_name, n_name, c_name) AS text FROM {_NIDS} LEFT JOIN region ON node_type = 'region' AND local_id = r_regionkey LEFT JOIN nation ON node_type = 'nation' AND local_id = n_nationkey LEFT JOIN customer ON node_type = 'customer' AND local_id = c_custkey")
def corpus_by_node_id(spark, d):
    parts = {t: table(spark, d, t).select(F.col(k).alias("local_id"), F.col(n).alias("text")) for t, k, n in (("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name"), ("customer", "c_custkey", "c_name"))}
    return samples.united_corpus(parts, _nids(spark, d))


@query("qrels_by_node_id", f"SELECT o_orderkey AS qid, nid AS docid, CAST(o_orderkey % 3 AS INT) AS rel FROM orders JOIN {_NIDS} ON node_type = 'customer' AND local_id = o_custkey")
def qrels_by_node_id(spark, d):
    grades = table(spark, d, "orders").select(F.col("o_orderkey").alias("qid"), F.col("o_custkey").alias("docid"), (F.col("o_orderkey") % 3).cast("int").alias("rel"))
    return samples.rekeyed(grades, "docid", _nids(spark, d).where("node_type = 'customer'")).select("qid", "docid", "rel")


_SPLIT = f"CASE WHEN {_PLACE.format('CAST(o_custkey AS VARCHAR)', 3)} % 100 < 80 THEN 'train' ELSE 'val' END"


@query("flat_samples", f"SELECT qid, split, candidate, label, CASE WHEN split = 'train' THEN md5(CAST(qid AS VARCHAR) || ':2025') ELSE lpad(CAST(qid AS VARCHAR), 20, '0') END AS place FROM (SELECT o_custkey AS qid, {_SPLIT} AS split, o_orderpriority AS candidate, max(CAST(o_orderkey % 2 AS INT)) AS label FROM orders GROUP BY 1, 2, 3)")
def flat_samples(spark, d):
    grades = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("qid"), F.col("o_orderpriority").alias("candidate")).agg(F.max((F.col("o_orderkey") % 2).cast("int")).alias("label"))
    nested = grades.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("candidate", "label"))).alias("rels"))
    return samples.flat(samples.split(nested, "qid", 3), 2025)


@query("pair_samples", "SELECT qid, docid, count(DISTINCT context) AS contexts, max(CAST(drel * rel > 0 AS INT)) AS label FROM (SELECT o_custkey AS docid, o_orderstatus AS context, CAST(o_orderkey % 4 AS INT) AS drel FROM orders) JOIN (SELECT c_nationkey AS qid, c_custkey AS docid, CAST(c_custkey % 3 AS INT) AS rel FROM customer) USING (docid) GROUP BY 1, 2")
def pair_samples(spark, d):
    pairs = table(spark, d, "orders").selectExpr("o_custkey docid", "o_orderstatus context", "int(o_orderkey % 4) drel")
    return samples.pair_samples(pairs, table(spark, d, "customer").selectExpr("c_nationkey qid", "c_custkey docid", "int(c_custkey % 3) rel"))


@query("padded_sequences", "SELECT user_id, list_aggregate([CASE WHEN i <= len(s) THEN CAST(s[i] AS VARCHAR) ELSE '-1' END FOR i IN range(1, 13)], 'string_agg', ',') AS seq FROM (SELECT user_id, list(event_id ORDER BY event_id) AS s FROM events GROUP BY 1)")
def padded_sequences(spark, d):
    rows = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("s"))
    return rows.select("user_id", F.array_join(F.transform(samples.padded(F.col("s"), 12, F.lit(-1).cast("long")), lambda v: v.cast("string")), ",").alias("seq"))


@query("full_sequences", "SELECT user_id FROM events GROUP BY 1 HAVING count(*) >= 5")
def full_sequences(spark, d):
    rows = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("s"))
    filled = rows.withColumn("s", samples.padded(F.col("s"), 5, F.lit(-1).cast("long")))
    return samples.without_padding(filled, "s", -1).select("user_id")


@query("average_path_length", "SELECT round(avg(n + 1), 6) AS mean_length FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)")
def average_path_length(spark, d):
    return samples.mean_length(table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("edges")), "edges")


@query("nonzero_class", "SELECT o_orderkey, CAST(o_orderkey % 4 AS INT) AS class FROM orders WHERE o_orderkey % 4 <> 0")
def nonzero_class(spark, d):
    return samples.nonzero_class(table(spark, d, "orders").selectExpr("o_orderkey", "int(o_orderkey % 4) class"), "class")


@query("encoder_text", r"SELECT item_id, array_to_string(regexp_split_to_array(trim(regexp_replace('find ' || text || ' [SEP] ' || CAST(item_id AS VARCHAR), '[ \t\n\r\f\v]+', ' ', 'g')), ' ')[1:30], ' ') AS text FROM benchmark")
def encoder_text(spark, d):
    return table(spark, d, "benchmark").select("item_id", samples.encoder_text(F.lit("find"), F.array("text"), F.col("item_id").cast("string"), 30).alias("text"))


@query("title_text", "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 5 > 0 THEN c_name END, '') || ' ' || coalesce(CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END, '') AS text FROM customer")
def title_text(spark, d):
    return table(spark, d, "customer").select("c_custkey", samples.title_text(F.expr("CASE WHEN c_custkey % 5 > 0 THEN c_name END"), F.expr("CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END")).alias("text"))


@query("prediction_lines", "SELECT vec_id, coalesce((SELECT string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) FROM range(0, len(embedding)) t(i) WHERE embedding[i + 1] > 0.1), '') AS line FROM embeddings")
def prediction_lines(spark, d):
    cells = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("place", "v"))
    return samples.prediction_line(cells.withColumn("one", (F.col("v") > F.lit(0.1).cast("double")).cast("int")), "vec_id", "place", "one")


_SCORED = "(SELECT c_nationkey AS qid, c_custkey AS docid, {0} AS score, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY {0} DESC, c_custkey) AS INT) AS rank FROM customer)"


def _run(spark, d, score: str, k: int):
    return samples.as_run(table(spark, d, "customer").selectExpr("c_nationkey qid", "c_custkey docid", f"{score} score"), k)


@query("run_of_candidates", f"SELECT * FROM {_SCORED.format('c_acctbal')} WHERE rank <= 7")
def run_of_candidates(spark, d):
    return _run(spark, d, "c_acctbal", 7)


@query("runs_compared", f"SELECT qid, round(sum(CAST(a AND b AS INT)) / 10.0, 6) AS shared FROM (SELECT qid, docid, bool_or(s = 1) AS a, bool_or(s = 2) AS b FROM (SELECT qid, docid, 1 AS s FROM {_SCORED.format('c_acctbal')} WHERE rank <= 10 UNION ALL SELECT qid, docid, 2 FROM {_SCORED.format('abs(c_acctbal)')} WHERE rank <= 10) GROUP BY 1, 2) GROUP BY 1")
def runs_compared(spark, d):
    return samples.compared(_run(spark, d, "c_acctbal", 10), _run(spark, d, "abs(c_acctbal)", 10), 10)


@query("run_filled", """
    WITH s AS (SELECT c_nationkey AS qid, c_custkey AS docid, c_acctbal AS score, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer WHERE c_acctbal > 9500),
    a AS (SELECT n_nationkey AS qid, c_custkey AS docid, coalesce(score, 0) AS score FROM nation CROSS JOIN customer LEFT JOIN s ON s.qid = n_nationkey AND s.docid = c_custkey AND n <= 20)
    SELECT qid, docid, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS INT) AS rank FROM a QUALIFY rank <= 20""")
def run_filled(spark, d):
    """The best customers over 9,500 of each nation, filled with customers of score 0."""
    found = samples.as_run(table(spark, d, "customer").where("c_acctbal > 9500").selectExpr("c_nationkey qid", "c_custkey docid", "c_acctbal score"), 20)
    return samples.filled(found, table(spark, d, "customer").selectExpr("c_custkey docid"), table(spark, d, "nation").selectExpr("n_nationkey qid"), 20)


@query("fill_empty_urls", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'http://none/' || CAST(page_id AS VARCHAR) ELSE url END AS url FROM pages")
def fill_empty_urls(spark, d):
    rows = table(spark, d, "pages").selectExpr("page_id", "CASE page_id % 6 WHEN 0 THEN '' WHEN 3 THEN NULL ELSE url END url")
    return samples.fill_empty(rows, "url", F.concat(F.lit("http://none/"), F.col("page_id").cast("string"))).select("page_id", "url")


@query("sane_urls", "SELECT page_id, CASE WHEN page_id % 4 > 0 THEN url ELSE '' END AS url FROM pages")
def sane_urls(spark, d):
    return table(spark, d, "pages").select("page_id", sane_url(F.when(F.col("page_id") % 4 > 0, F.concat(F.lit(" "), "url")).otherwise(F.concat(F.lit("see "), "url"))).alias("url"))


@query("metadata_by_filename", "SELECT lower(source) AS source, max(doc_id) AS doc_id FROM documents GROUP BY 1")
def metadata_by_filename(spark, d):
    return samples.by_filename(table(spark, d, "documents").select(F.upper("source").alias("source"), "doc_id"), "source", "doc_id")


@query("unique_names", "SELECT DISTINCT source FROM documents WHERE source IS NOT NULL")
def unique_names(spark, d):
    return samples.unique_names(table(spark, d, "documents"), "source")


@query("phrase_rows", "SELECT user_id, '[\"' || string_agg(DISTINCT event_type, '\",\"' ORDER BY event_type) || '\"]' AS phrases FROM events WHERE value > 50 GROUP BY 1")
def phrase_rows(spark, d):
    rows = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_set(F.when(F.col("value") > 50, F.col("event_type")))).alias("p"))
    return samples.phrase_rows(rows, "user_id", "p")


@query("unit_coercion", "SELECT count(*) FILTER (conv_id IS NOT NULL) AS items, count(*) FILTER (n = 0) AS empty, CAST(0 AS BIGINT) AS skipped FROM (SELECT conv_id, count(DISTINCT trim(text)) FILTER (turn > 1 AND trim(text) <> '') AS n FROM conversations GROUP BY 1)")
def unit_coercion(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.when(F.col("turn") > 1, F.col("text")).otherwise(" ")).alias("u"))
    return units.coerced(rows, "conv_id", "u")[1]


@query("pairs_by_similarity", "SELECT a.c_custkey AS id1, b.c_custkey AS id2, CAST(row_number() OVER (ORDER BY abs(a.c_acctbal - b.c_acctbal), a.c_custkey, b.c_custkey) AS INT) AS place FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND a.c_custkey < b.c_custkey ORDER BY 3 LIMIT 20")
def pairs_by_similarity(spark, d):
    """The 20 most alike pairs, in order."""
    from pyspark.sql import Window

    first = samples.closest_pairs(table(spark, d, "customer").selectExpr("c_custkey id", "c_acctbal v", "c_nationkey", "c_mktsegment"), ["c_nationkey", "c_mktsegment"], 20)
    return first.select("id1", "id2", F.row_number().over(Window.orderBy(F.asc_nulls_last("gap"), "id1", "id2")).alias("place"))


@query("type_codes", f"SELECT 'theme' AS type, CAST(0 AS INT) AS code UNION ALL SELECT type, CAST(row_number() OVER (ORDER BY f, type) AS INT) FROM (SELECT type, min(src) AS f FROM {_EDGES} WHERE type <> 'theme' GROUP BY 1)")
def type_codes(spark, d):
    return graph.type_codes(spark.createDataFrame([("theme", 0)], "type string, code int"), _edges(spark, d), "src")


@query("profile_edges", f"SELECT DISTINCT src, dst, type FROM {_EDGES} WHERE type IN ('dump', 'publish', 'theme')")
def profile_edges(spark, d):
    return graph.profile(_edges(spark, d), ["metadata"]).select("src", "dst", "type")


@query("similarity_edges", "WITH p AS (SELECT a.n_name AS id1, b.n_name AS id2, CAST(a.n_nationkey + b.n_nationkey AS DOUBLE) / 50 AS j FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name) SELECT id1 AS src, id2 AS dst, 'content_sim' AS type, j AS weight FROM p WHERE j > 0.5 UNION ALL SELECT id2, id1, 'content_sim', j FROM p WHERE j > 0.5")
def similarity_edges(spark, d):
    a, b = (table(spark, d, "nation").selectExpr(f"n_name id{k}", "n_regionkey", f"n_nationkey n{k}") for k in (1, 2))
    return graph.similarity_edges(a.join(b, "n_regionkey").where("id1 < id2").selectExpr("id1", "id2", "CAST(n1 + n2 AS DOUBLE) / 50 AS j_sim"), "content_sim", 0.5)


@query("edges_between_types", f"SELECT type, CAST(sum(CASE WHEN left(src, 1) = 'n' THEN 1 ELSE -1 END) AS BIGINT) AS n FROM (SELECT src, dst, type FROM {_EDGES} UNION ALL SELECT dst, src, 'back' FROM {_EDGES} WHERE type = 'theme') WHERE left(src, 1) || left(dst, 1) IN ('nr', 'rn') GROUP BY 1")
def edges_between_types(spark, d):
    edges = _edges(spark, d).select("src", "dst", "type")
    both = edges.unionAll(edges.where("type = 'theme'").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("back").alias("type")))
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("node_type", F.substring("node", 1, 1))
    return graph.between_types(both, nodes, "n", "r")


@query("self_loops", f"SELECT src, dst FROM {_EDGES} WHERE src <> dst UNION ALL SELECT DISTINCT n, n FROM (SELECT src AS n FROM {_EDGES} UNION SELECT dst FROM {_EDGES})")
def self_loops(spark, d):
    edges = _edges(spark, d)
    return graph.with_self_loops(edges, edges.select(F.explode(F.array("src", "dst")).alias("node")))


@query("union_graph", f"SELECT DISTINCT src, dst FROM {_EDGES}")
def union_graph(spark, d):
    return _edges(spark, d).select("src", "dst").distinct()
