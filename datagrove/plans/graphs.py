"""Graph assembly and traversal over the star schema: regions, nations, customers, orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from ..sources.tables import table
from .registry import query


def _edges(spark, d):
    """customer -> nation (publish), nation -> region (theme), order -> customer (dump)."""
    cn = table(spark, d, "customer").selectExpr("'c' || c_custkey AS src", "'n' || c_nationkey AS dst", "'publish' AS type", "1.0D AS weight")
    nr = table(spark, d, "nation").selectExpr("'n' || n_nationkey AS src", "'r' || n_regionkey AS dst", "'theme' AS type", "1.0D AS weight")
    oc = table(spark, d, "orders").selectExpr("'o' || o_orderkey AS src", "'c' || o_custkey AS dst", "'dump' AS type", "1.0D AS weight")
    return cn.unionAll(nr).unionAll(oc)


_EDGES = """(SELECT 'c' || CAST(c_custkey AS VARCHAR) AS src, 'n' || CAST(c_nationkey AS VARCHAR) AS dst, 'publish' AS type, CAST(1 AS DOUBLE) AS weight FROM customer
    UNION ALL SELECT 'n' || CAST(n_nationkey AS VARCHAR), 'r' || CAST(n_regionkey AS VARCHAR), 'theme', CAST(1 AS DOUBLE) FROM nation
    UNION ALL SELECT 'o' || CAST(o_orderkey AS VARCHAR), 'c' || CAST(o_custkey AS VARCHAR), 'dump', CAST(1 AS DOUBLE) FROM orders)"""


@query("graph_edge_view", f"SELECT * FROM {_EDGES} WHERE type <> 'dump'")
def graph_edge_view(spark, d):
    return _edges(spark, d).where("type <> 'dump'")


_TRIPLES = f"SELECT 'x:' || src AS s, CASE type WHEN 'publish' THEN 'dct:publisher' WHEN 'theme' THEN 'dcat:theme' ELSE 'dcat:distribution' END AS p, 'x:' || dst AS o FROM {_EDGES} WHERE left(dst, 1) <> 'r'"


def _uri(c):
    return F.when(~F.col(c).startswith("r"), F.concat(F.lit("x:"), c))


@query("edge_triples", _TRIPLES)
def edge_triples(spark, d):
    """Regions have no address here, so their edges drop out."""
    return graph.edge_triples(_edges(spark, d), _uri("src"), _uri("dst"))


@query("triples_all", f"""
    SELECT DISTINCT s, p, o FROM (SELECT 'x:c' || CAST(c_custkey AS VARCHAR) AS s, 'rdf:type' AS p, 'base:Customer' AS o FROM customer
    UNION ALL SELECT 'x:c' || CAST(c_custkey AS VARCHAR), 'p:' || property, value FROM (SELECT c_custkey, unnest(['c_name', 'c_mktsegment']) AS property, unnest([c_name, c_mktsegment]) AS value FROM customer) UNION ALL {_TRIPLES})""")
def triples_all(spark, d):
    customer = table(spark, d, "customer").withColumn("s", F.concat(F.lit("x:c"), F.col("c_custkey").cast("string")))
    kinds = customer.select("s", F.lit("rdf:type").alias("p"), F.lit("base:Customer").alias("o"))
    properties = graph.properties(customer, "s", ["c_name", "c_mktsegment"]).select(F.col("node").alias("s"), F.concat(F.lit("p:"), "property").alias("p"), F.col("value").alias("o"))
    return kinds.unionAll(properties).unionAll(edge_triples(spark, d)).distinct()


@query("rethreshold_graph", f"SELECT DISTINCT s, p, o FROM (SELECT * FROM ({_TRIPLES}) WHERE p <> 'dct:publisher' UNION ALL SELECT 'x:c' || CAST(c_custkey AS VARCHAR), 'dct:publisher', 'x:n' || CAST(c_nationkey AS VARCHAR) FROM customer WHERE c_acctbal >= 5000)")
def rethreshold_graph(spark, d):
    """The triples of one predicate are replaced by pairs over a threshold."""
    pairs = table(spark, d, "customer").where("c_acctbal >= 5000").selectExpr("'x:c' || c_custkey AS s", "'dct:publisher' AS p", "'x:n' || c_nationkey AS o")
    return edge_triples(spark, d).where("p <> 'dct:publisher'").unionAll(pairs).distinct()


@query("symmetric_edges", f"SELECT src, dst, type, weight FROM {_EDGES} UNION ALL SELECT dst, src, type, weight FROM {_EDGES}")
def symmetric_edges(spark, d):
    return graph.symmetric(_edges(spark, d))


@query("typed_inverse_edges", f"SELECT src, dst, CASE type WHEN 'publish' THEN 3 WHEN 'theme' THEN 5 ELSE 6 END AS code FROM {_EDGES} UNION ALL SELECT dst, src, CASE type WHEN 'publish' THEN 4 ELSE 7 END FROM {_EDGES} WHERE type <> 'theme'")
def typed_inverse_edges(spark, d):
    """Publish edges have an inverse code of their own, theme edges go one way, dump edges are 6 and back 7."""
    edges = _edges(spark, d)
    code = F.when(F.col("type") == "publish", 3).when(F.col("type") == "theme", 5).otherwise(6)
    back = F.when(F.col("type") == "publish", 4).otherwise(7)
    return edges.select("src", "dst", code.alias("code")).unionAll(edges.where("type <> 'theme'").select(F.col("dst").alias("src"), F.col("src").alias("dst"), back.alias("code")))


@query("edge_feature_codes", """
    WITH e AS (SELECT CAST(n_nationkey AS INT) AS u, CAST(n_regionkey AS INT) AS v, max(n_nationkey % 3) AS k FROM nation GROUP BY 1, 2)
    SELECT u, v, CAST(k AS INT) AS code FROM e UNION ALL SELECT n, n, 3 FROM (SELECT u AS n FROM e UNION SELECT v FROM e) WHERE (n, n) NOT IN (SELECT (u, v) FROM e)
    UNION ALL SELECT v, u, CAST(k + 4 AS INT) FROM e WHERE u <> v AND (v, u) NOT IN (SELECT (u, v) FROM e)""")
def edge_feature_codes(spark, d):
    """Edges keep their last code, nodes get a loop (3) and edges a way back (code + 4) where there is none."""
    edges = table(spark, d, "nation").groupBy(F.col("n_nationkey").alias("u"), F.col("n_regionkey").alias("v")).agg(F.max(F.col("n_nationkey") % 3).cast("int").alias("code"))
    nodes = edges.select(F.explode(F.array("u", "v")).alias("u")).distinct()
    loops = nodes.select("u", F.col("u").alias("v"), F.lit(3).alias("code")).join(edges, ["u", "v"], "left_anti")
    back = edges.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v"), (F.col("code") + 4).alias("code")).join(edges, ["u", "v"], "left_anti")
    return edges.unionByName(loops).unionByName(back)


@query("subgraph_types", f"SELECT * FROM {_EDGES} WHERE type = 'publish'")
def subgraph_types(spark, d):
    edges = _edges(spark, d)
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("nid")).distinct().withColumn("type", F.substring("nid", 1, 1))
    return graph.subgraph(nodes, edges, ["c", "n"])[1]


@query("metapath_counts", "SELECT 'r' || CAST(n_regionkey AS VARCHAR) AS \"start\", 'c' || CAST(o_custkey AS VARCHAR) AS \"end\", CAST(count(*) AS DOUBLE) AS weight FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN orders o2 ON o2.o_custkey = c_custkey AND orders.o_orderkey = o2.o_orderkey GROUP BY 1, 2".replace(" JOIN orders o2 ON o2.o_custkey = c_custkey AND orders.o_orderkey = o2.o_orderkey", ""))
def metapath_counts(spark, d):
    """Regions and customers, weighted by the orders of the customer: region, nation, customer, order and back."""
    edges = _edges(spark, d)
    return graph.metapath(edges, [("theme", True), ("publish", True), ("dump", True), ("dump", False)])


@query("metapath_instances", "SELECT 'o' || CAST(o_orderkey AS VARCHAR) || '>c' || CAST(o_custkey AS VARCHAR) || '>n' || CAST(c_nationkey AS VARCHAR) || '>r' || CAST(n_regionkey AS VARCHAR) AS path FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def metapath_instances(spark, d):
    return graph.metapath_instances(_edges(spark, d), [("dump", False), ("publish", False), ("theme", False)]).select(F.array_join("path", ">").alias("path"))


@query("degree_norm_propagate", f"""
    WITH e AS (SELECT * FROM {_EDGES}), o AS (SELECT src, count(*) AS n FROM e GROUP BY 1), i AS (SELECT dst, count(*) AS n FROM e GROUP BY 1), nodes AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
    y AS (SELECT e.dst, sum(length(e.src) * CASE type WHEN 'publish' THEN 0.5 WHEN 'theme' THEN 2.0 ELSE 1.0 END / sqrt(o.n)) AS y FROM e JOIN o ON o.src = e.src GROUP BY 1)
    SELECT node, round(coalesce(y / sqrt(i.n), 0), 6) AS value FROM nodes LEFT JOIN y ON y.dst = node LEFT JOIN i ON i.dst = node""")
def degree_norm_propagate(spark, d):
    edges = _edges(spark, d)
    values = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("x", F.length("node").cast("double"))
    return graph.propagate(edges, values, {"publish": 0.5, "theme": 2.0, "dump": 1.0}).select("node", F.round("value", 6).alias("value"))


@query("neighbor_sequence", f"""
    WITH e AS (SELECT src, dst FROM {_EDGES} UNION SELECT dst, src FROM {_EDGES}), h0 AS (SELECT 'n' || CAST(n_nationkey AS VARCHAR) AS node, 0 AS hop, 'n' || CAST(n_nationkey AS VARCHAR) AS v, '' AS key FROM nation),
    s1 AS (SELECT node, 1 AS hop, dst AS v, md5(dst || ':0') AS key FROM h0 JOIN e ON src = v), h1 AS (SELECT * FROM s1 QUALIFY row_number() OVER (PARTITION BY node ORDER BY key, v) <= 20),
    s2 AS (SELECT node, 2 AS hop, dst AS v, key || md5(dst || ':0') AS key FROM h1 JOIN e ON src = v), h2 AS (SELECT * FROM s2 QUALIFY row_number() OVER (PARTITION BY node ORDER BY key, v) <= 20),
    w AS (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2)
    SELECT node, string_agg(v, ',' ORDER BY n) AS seq FROM (SELECT node, v, row_number() OVER (PARTITION BY node ORDER BY hop, key, v) AS n FROM w) WHERE n <= 20 GROUP BY node""")
def neighbor_sequence(spark, d):
    """Breadth-first sequences of 20 nodes from every nation, each step's in the order of a seeded md5."""
    edges = graph.symmetric(_edges(spark, d)).select("src", "dst")
    starts = table(spark, d, "nation").selectExpr("'n' || n_nationkey AS node")
    return graph.neighbours(edges, starts, 20, 2).select("node", F.array_join("seq", ",").alias("seq"))


_RING = "(SELECT n_nationkey % 7 AS u, (n_nationkey * 3 + 1) % 7 AS v FROM nation UNION SELECT n_nationkey % 7, (n_nationkey + 1) % 7 FROM nation)"


@query("k_shortest_paths", f"""
    WITH RECURSIVE e AS (SELECT DISTINCT CAST(u AS INT) AS u, CAST(v AS INT) AS v FROM {_RING}),
    p AS (SELECT u AS src, v AS last, [u, v] AS path FROM e WHERE u <> v UNION ALL SELECT p.src, e.v, list_append(p.path, e.v) FROM p JOIN e ON e.u = p.last WHERE NOT list_contains(p.path, e.v) AND len(p.path) < 5),
    r AS (SELECT src, last AS dst, array_to_string(path, '-') AS path, row_number() OVER (PARTITION BY src, last ORDER BY len(path), array_to_string(path, '-')) AS n FROM p)
    SELECT src, dst, path FROM r WHERE n <= 3 AND src < dst""")
def k_shortest_paths(spark, d):
    k = F.col("n_nationkey")
    edges = table(spark, d, "nation").select(F.explode(F.array(F.struct((k % 7).alias("u"), ((k * 3 + 1) % 7).alias("v")), F.struct((k % 7).alias("u"), ((k + 1) % 7).alias("v")))).alias("e")).selectExpr("e.u AS src", "e.v AS dst").distinct()
    nodes = edges.select("src").distinct()
    pairs = nodes.join(nodes.withColumnRenamed("src", "dst"), F.col("src") < F.col("dst"))
    return graph.shortest_paths(edges, pairs, 3, 4).select("src", "dst", F.array_join(F.col("path").cast("array<string>"), "-").alias("path"))
