"""Scans, filters, joins, windows and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import graph
from ..sources import sinks, tables
from ..sources.tables import table
from .registry import query


@query("scan_project", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def scan_project(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")


@query("filter_in_list", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus <> ''")
def filter_in_list(spark, d):
    return table(spark, d, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (F.col("o_orderstatus") != "")).select("o_orderkey", "o_orderpriority")


@query("pending_rows", "SELECT o_orderkey FROM orders WHERE nullif(o_orderstatus, 'O') IS NULL")
def pending_rows(spark, d):
    return table(spark, d, "orders").where(F.nullif("o_orderstatus", F.lit("O")).isNull()).select("o_orderkey")


@query("distinct_ids", "SELECT DISTINCT o_custkey FROM orders")
def distinct_ids(spark, d):
    return table(spark, d, "orders").select("o_custkey").distinct()


@query("concat_len_filter", "SELECT c_custkey FROM customer WHERE length(c_name || nullif(c_mktsegment, 'BUILDING') || CAST(c_nationkey AS VARCHAR)) > 0")
def concat_len_filter(spark, d):
    whole = F.concat("c_name", F.nullif("c_mktsegment", F.lit("BUILDING")), F.col("c_nationkey").cast("string"))
    return table(spark, d, "customer").where(F.length(whole) > 0).select("c_custkey")


@query("coalesce_label", "SELECT c_custkey, coalesce(nullif(CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END, ''), nullif(CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_name END, '')) AS label FROM customer")
def coalesce_label(spark, d):
    label, other = F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment")), F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.col("c_name"))
    return table(spark, d, "customer").select("c_custkey", F.coalesce(F.nullif(label, F.lit("")), F.nullif(other, F.lit(""))).alias("label"))


@query("props_unpivot", "SELECT c_custkey AS node, property, value FROM (SELECT c_custkey, unnest(['c_name', 'c_mktsegment', 'c_nationkey']) AS property, unnest([c_name, nullif(c_mktsegment, 'BUILDING'), CAST(c_nationkey AS VARCHAR)]) AS value FROM customer) WHERE value <> ''")
def props_unpivot(spark, d):
    rows = table(spark, d, "customer").withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("BUILDING")))
    return graph.properties(rows, "c_custkey", ["c_name", "c_mktsegment", "c_nationkey"])


@query("join_metadata_aug", "SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)")
def join_metadata_aug(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id")


@query("left_join_keywords", "SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), '') AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def left_join_keywords(spark, d):
    found = table(spark, d, "labels").select("doc_id", F.col("quality").cast("string"))
    return table(spark, d, "documents").select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit("")).alias("quality"))


@query("enrich_corpus", """
    WITH t AS (SELECT o_custkey, string_agg(o_orderpriority, ' ' ORDER BY o_orderpriority) AS themes FROM (SELECT DISTINCT o_custkey, o_orderpriority FROM orders) GROUP BY o_custkey)
    SELECT c_custkey, c_name || chr(10) || coalesce(n_name, ' ') || chr(10) || coalesce(themes, '') AS text FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN t ON o_custkey = c_custkey""")
def enrich_corpus(spark, d):
    themes = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), " ").alias("themes"))
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"), "left").join(themes, F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.select("c_custkey", X.node_text(F.col("c_name"), F.coalesce("n_name", F.lit(" ")), F.coalesce("themes", F.lit(""))).alias("text"))


@query("triple_verbalise", """
    SELECT n_regionkey AS file_id, string_agg(CAST(n_nationkey AS VARCHAR) || ' ' || n_name || ' ' || coalesce(r_name, ''), chr(10) ORDER BY n_nationkey) AS text
    FROM nation LEFT JOIN region ON r_regionkey = n_regionkey AND r_regionkey <> 2 GROUP BY n_regionkey""")
def triple_verbalise(spark, d):
    """A triple of terms for each nation; one join per position, a missing term is empty."""
    triples = table(spark, d, "nation").select(F.col("n_regionkey").alias("file_id"), F.col("n_nationkey").alias("s"), F.col("n_regionkey").alias("o"), F.col("n_name").alias("p"))
    terms = table(spark, d, "region").where("r_regionkey <> 2").select(F.col("r_regionkey").alias("term_id"), F.col("r_name").alias("label"))
    said = triples.join(terms, F.col("o") == F.col("term_id"), "left").select("file_id", "s", F.concat(F.col("s").cast("string"), F.lit(" "), "p", F.lit(" "), F.coalesce("label", F.lit(""))).alias("line"))
    return said.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", "line"))), lambda x: x["line"]), "\n").alias("text"))


@query("edge_id_mapping", """
    WITH v AS (SELECT 'nation' AS t, CAST(n_nationkey AS BIGINT) AS k FROM nation UNION ALL SELECT 'customer', c_custkey FROM customer),
    m AS (SELECT t, k, row_number() OVER (ORDER BY t DESC, k) - 1 AS nid FROM v)
    SELECT a.nid AS src, b.nid AS dst FROM customer JOIN m a ON a.t = 'customer' AND a.k = c_custkey JOIN m b ON b.t = 'nation' AND b.k = c_nationkey""")
def edge_id_mapping(spark, d):
    customer, nation = table(spark, d, "customer"), table(spark, d, "nation")
    vertices = nation.select(F.lit("nation").alias("node_type"), F.col("n_nationkey").cast("long").alias("local_id")).unionAll(customer.select(F.lit("customer"), "c_custkey"))
    ids = graph.dense_ids(vertices, ["nation", "customer"])
    one, two = (ids.where(F.col("node_type") == t).select(F.col("local_id").alias(f"{t}_id"), F.col("nid").alias(n)) for t, n in (("customer", "src"), ("nation", "dst")))
    return customer.join(one, F.col("c_custkey") == F.col("customer_id")).join(two, F.col("c_nationkey") == F.col("nation_id")).select("src", "dst")


@query("all_pairs_theta", "SELECT a.n_nationkey AS id1, b.n_nationkey AS id2, CAST(levenshtein(a.n_name, b.n_name) AS INT) AS distance FROM nation a, nation b WHERE a.n_nationkey < b.n_nationkey")
def all_pairs_theta(spark, d):
    a, b = (table(spark, d, "nation").select(F.col("n_nationkey").alias(f"id{k}"), F.col("n_name").alias(f"name{k}")) for k in (1, 2))
    return a.join(b, F.col("id1") < F.col("id2")).select("id1", "id2", F.levenshtein("name1", "name2").alias("distance"))


@query("pair_features", "SELECT a.vec_id AS id1, b.vec_id AS id2, CAST(len(list_concat(a.embedding, b.embedding)) AS INT) AS width, round(list_sum([CAST(a.embedding[i] AS DOUBLE) * CAST(b.embedding[i] AS DOUBLE) FOR i IN range(1, 65)]), 6) AS dot FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def pair_features(spark, d):
    a, b = (table(spark, d, "embeddings").select(F.col("vec_id").alias(f"id{k}"), F.col("embedding").alias(f"e{k}")) for k in (1, 2))
    dot = F.aggregate(F.zip_with("e1", "e2", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return a.join(b, F.col("id2") == F.col("id1") + 1).select("id1", "id2", F.size(F.concat("e1", "e2")).alias("width"), F.round(dot, 6).alias("dot"))


@query("anti_join_resume", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join_resume(spark, d):
    return sinks.pending(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@query("semi_join_type", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def semi_join_type(spark, d):
    wanted = table(spark, d, "nation").where("n_regionkey = 1")
    return table(spark, d, "customer").join(wanted, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select("c_custkey")


@query("semi_join_judged", "SELECT doc_id, lang FROM documents WHERE EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id AND quality = 1)")
def semi_join_judged(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").where("quality = 1"), "doc_id", "left_semi")


_OFFSETS = "(SELECT type, n, CAST(coalesce(sum(n) OVER (ORDER BY type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS shift FROM (SELECT n_regionkey AS type, count(*) AS n FROM nation GROUP BY 1))"


@query("node_type_offsets", f"SELECT * FROM {_OFFSETS}")
def node_type_offsets(spark, d):
    return graph.type_offsets(table(spark, d, "nation").select(F.col("n_regionkey").alias("type")))


@query("range_join_type", f"SELECT n_nationkey, type FROM nation JOIN {_OFFSETS} o ON n_nationkey >= shift AND n_nationkey < shift + n")
def range_join_type(spark, d):
    nation = table(spark, d, "nation")
    types = graph.type_offsets(nation.select(F.col("n_regionkey").alias("type")))  # a row for each type
    return nation.join(F.broadcast(types), (F.col("n_nationkey") >= F.col("shift")) & (F.col("n_nationkey") < F.col("shift") + F.col("n"))).select("n_nationkey", "type")


@query("dense_node_ids", """
    SELECT t AS node_type, k AS local_id, row_number() OVER (ORDER BY o, k) - 1 AS nid
    FROM (SELECT 'region' AS t, 1 AS o, r_regionkey AS k FROM region UNION ALL SELECT 'nation', 2, n_nationkey FROM nation)""")
def dense_node_ids(spark, d):
    vertices = table(spark, d, "nation").select(F.lit("nation").alias("node_type"), F.col("n_nationkey").alias("local_id")).unionAll(table(spark, d, "region").select(F.lit("region"), "r_regionkey"))
    return graph.dense_ids(vertices, ["region", "nation"])


@query("consecutive_run", """
    SELECT user_id, min(event_id) AS first_run FROM (SELECT user_id, event_id, event_type AS a, lead(event_type) OVER w AS b, lead(event_type, 2) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
    WHERE a = b AND b = c GROUP BY user_id""")
def consecutive_run(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    runs = table(spark, d, "events").select("user_id", "event_id", "event_type", F.lead("event_type").over(w).alias("b"), F.lead("event_type", 2).over(w).alias("c"))
    return runs.where("event_type = b and b = c").groupBy("user_id").agg(F.min("event_id").alias("first_run"))


@query("upsert_latest", """
    SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY fresh DESC, event_id DESC) AS r
    FROM (SELECT user_id, event_type, event_id, CASE WHEN event_id % 10 < 3 THEN 1 ELSE 0 END AS fresh FROM events)) WHERE r = 1""")
def upsert_latest(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_type", "event_id")
    return sinks.upsert(rows.where("event_id % 10 >= 3"), rows.where("event_id % 10 < 3"), ["user_id", "event_type"], "event_id")


@query("update_fill", "SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), d.lang) AS state FROM documents d LEFT JOIN labels l USING (doc_id)")
def update_fill(spark, d):
    found = table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("state"))
    return sinks.fill(table(spark, d, "documents").select("doc_id", F.col("lang").alias("state")), found, "doc_id", "state")


@query("fold_union", """
    SELECT qid, docid, rel FROM (SELECT *, row_number() OVER (PARTITION BY qid, docid ORDER BY fold DESC) AS r
    FROM (SELECT user_id AS qid, event_id % 50 AS docid, CAST(max(event_id) % 3 AS INT) AS rel, event_id % 5 AS fold FROM events GROUP BY 1, 2, 4)) WHERE r = 1""")
def fold_union(spark, d):
    """Judgements of several folds; a later fold's wins."""
    rows = table(spark, d, "events").groupBy(F.col("user_id").alias("qid"), (F.col("event_id") % 50).alias("docid"), (F.col("event_id") % 5).alias("fold")).agg((F.max("event_id") % 3).cast("int").alias("rel"))
    last = Window.partitionBy("qid", "docid").orderBy(F.desc("fold"))
    return rows.withColumn("r", F.row_number().over(last)).where("r = 1").select("qid", "docid", "rel")


@query("qrels_parse", "SELECT CAST(doc_id AS VARCHAR) AS qid, 'd' || CAST(doc_id % 7 AS VARCHAR) AS docid, quality AS rel FROM labels")
def qrels_parse(spark, d):
    k = F.col("doc_id").cast("string")
    lines = table(spark, d, "labels").select(F.concat(k, F.lit(" d"), (F.col("doc_id") % 7).cast("string"), F.lit(" L"), F.col("quality").cast("string")).alias("value"))
    return tables.qrels(lines, "space")


@query("qrels_nested", "SELECT lang, '{' || string_agg('\"' || CAST(doc_id AS VARCHAR) || '\":' || CAST(quality AS VARCHAR), ',' ORDER BY doc_id) || '}' AS judged FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def qrels_nested(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id")
    entries = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "quality"))), lambda e: F.struct(e["doc_id"].cast("string").alias("key"), e["quality"].alias("value")))
    return rows.groupBy("lang").agg(F.to_json(F.map_from_entries(entries)).alias("judged"))


@query("binarise_labels", "SELECT event_id, CASE WHEN event_id % 4 > 0 THEN 1 ELSE 0 END AS rel FROM events")
def binarise_labels(spark, d):
    return table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 4 > 0, 1).otherwise(0).alias("rel"))


@query("tsv_patterns", "SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS item_id, o_orderpriority AS unit FROM orders")
def tsv_patterns(spark, d):
    lines = table(spark, d, "orders").groupBy("o_custkey").agg(F.concat(F.col("o_custkey").cast("string"), F.lit("\t"), F.array_join(F.collect_list("o_orderpriority"), " , ")).alias("value")).select("value")
    broken = spark.range(3).select(F.concat(F.lit("no tab "), F.col("id").cast("string")).alias("value"))
    return tables.patterns(lines.unionAll(broken))
