"""Typed graphs as tables: vertices (node_type, local_id), edges (src, dst, type, weight), triples (s, p, o, o_kind)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The predicate of each edge type.
PREDICATES = {"Replica": "base:replica", "Subset": "base:subset", "Variant": "base:variant", "Version": "base:version", "dump": "dcat:distribution", "publish": "dct:publisher", "theme": "dcat:theme", "content": "base:dataOverlap", "pattern": "base:schemaOverlap"}


def properties(rows: DataFrame, node: str, names: list[str]) -> DataFrame:
    """node, property and value of every column that isn't NULL or empty."""
    pairs = F.array(*[F.struct(F.lit(n).alias("property"), F.col(n).cast("string").alias("value")) for n in names])
    return rows.select(F.col(node).alias("node"), F.explode(pairs).alias("p")).select("node", "p.property", "p.value").where("value <> ''")


#: Ids of a block, of a block of blocks and so on, as bits.
_BLOCK_BITS = 16


def dense_ids(vertices: DataFrame, order: list[str]) -> DataFrame:
    """vertices (node_type, local_id: an integer) with nid, consecutive over the types in the order given; NULL ids come last.

    Ids fall into blocks by their leading bits, so where a row goes depends on its id alone, however often a plan is run. Numbers run
    within a block; a block starts after the lesser ones of its block of blocks, and so on up to the type. No task holds all rows, not
    even all of one type.
    """
    place = F.array_position(F.array(*[F.lit(o) for o in order]), F.col("node_type"))
    up = lambda c: F.shiftright(c, _BLOCK_BITS)
    rows = vertices.select("node_type", "local_id", place.alias("t"), up(F.col("local_id").cast("long")).alias("b0"))
    levels = [rows.groupBy("t", "b0").agg(F.count(F.lit(1)).alias("n"))]
    for k in range(1, 4):
        levels.append(levels[-1].groupBy("t", up(F.col(f"b{k - 1}")).alias(f"b{k}")).agg(F.sum("n").alias("n")))
    types = levels[-1].groupBy("t").agg(F.sum("n").alias("n"))  # a row a type
    starts = types.select("t", (F.sum("n").over(Window.orderBy("t")) - F.col("n")).alias("start"))
    for k in reversed(range(4)):
        block, above = f"b{k}", [F.col("t"), up(F.col(f"b{k}"))] if k < 3 else [F.col("t")]
        before = F.sum("n").over(Window.partitionBy(*above).orderBy(F.asc_nulls_last(block))) - F.col("n")
        level = levels[k].select(F.col("t").alias("lt"), F.col(block).alias("lb"), before.alias("before"))
        same = F.col("lt").eqNullSafe(F.col("t"))
        if k < 3:
            same = same & up(F.col("lb")).eqNullSafe(F.col(f"b{k + 1}"))
        starts = level.join(starts, same).select(F.col("lt").alias("t"), F.col("lb").alias(block), (F.col("start") + F.col("before")).alias("start"))
    within = F.row_number().over(Window.partitionBy("t", "b0").orderBy(F.asc_nulls_last("local_id"))) - 1
    starts = starts.toDF("lt", "lb", "start")
    numbered = rows.withColumn("r", within).join(starts, F.col("lt").eqNullSafe(F.col("t")) & F.col("lb").eqNullSafe(F.col("b0")))
    return numbered.select("node_type", "local_id", (F.col("start") + F.col("r")).alias("nid"))


def type_offsets(nodes: DataFrame) -> DataFrame:
    """type, n and shift (the nodes of lesser types)."""
    sizes = nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    return sizes.withColumn("shift", F.sum("n").over(Window.orderBy("type")) - F.col("n"))


def symmetric(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")]))


def adjacency(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def edge_triples(edges: DataFrame, src_uri: Column, dst_uri: Column) -> DataFrame:
    """s, p, o of edges whose type has a predicate and whose ends have addresses."""
    predicate = F.element_at(F.create_map(*[F.lit(x) for kv in PREDICATES.items() for x in kv]), F.col("type"))
    return edges.select(src_uri.alias("s"), predicate.alias("p"), dst_uri.alias("o")).where("s is not null and p is not null and o is not null")


def subgraph(nodes: DataFrame, edges: DataFrame, types: list) -> tuple[DataFrame, DataFrame]:
    """The nodes (nid, type) of some types and the edges between them."""
    kept = nodes.where(F.col("type").isin(*types))
    ids = kept.select("nid")
    inside = edges.join(ids, edges.src == ids.nid, "left_semi").join(ids, edges.dst == ids.nid, "left_semi")
    return kept, inside


def metapath(edges: DataFrame, types: list[tuple]) -> DataFrame:
    """start, end and weight (sum over paths of the product of weights) along edge types; (type, True) goes backwards.

    Weights are added up after every step, so paths with equal ends don't multiply.
    """
    out = None
    for kind, back in types:
        step = adjacency(edges.where(F.col("type") == kind).select(F.col("dst" if back else "src").alias("src"), F.col("src" if back else "dst").alias("dst"), "weight"))
        if out is None:
            out = step.toDF("start", "end", "weight")
        else:
            step = step.toDF("mid", "to", "w")
            out = out.join(step, F.col("end") == F.col("mid")).groupBy("start", F.col("to").alias("end")).agg(F.sum(F.col("weight") * F.col("w")).alias("weight"))
    return out


def metapath_instances(edges: DataFrame, types: list[tuple]) -> DataFrame:
    """path, the nodes along the edge types, of each way through the graph."""
    out = None
    for kind, back in types:
        step = edges.where(F.col("type") == kind).select(F.col("dst" if back else "src").alias("u"), F.col("src" if back else "dst").alias("v")).distinct()
        if out is None:
            out = step.select(F.array("u", "v").alias("path"))
        else:
            out = out.join(step, F.element_at("path", -1) == F.col("u")).select(F.concat("path", F.array("v")).alias("path"))
    return out


def propagate(edges: DataFrame, values: DataFrame, weights: dict) -> DataFrame:
    """One step of degree-normalised propagation: node and value of every node of values (node, x)."""
    out_degree = edges.groupBy(F.col("src").alias("u")).agg(F.count(F.lit(1)).alias("out"))
    in_degree = edges.groupBy(F.col("dst").alias("v")).agg(F.count(F.lit(1)).alias("inn"))
    weight = F.lit(0.0)
    for kind, w in weights.items():
        weight = F.when(F.col("type") == kind, F.lit(float(w))).otherwise(weight)
    sent = edges.join(out_degree, F.col("src") == F.col("u")).join(values, F.col("src") == F.col("node"))
    got = sent.groupBy("dst").agg(F.sum(F.col("x") * weight / F.sqrt("out")).alias("y")).join(in_degree, F.col("dst") == F.col("v"))
    got = got.select("dst", (F.col("y") / F.sqrt("inn")).alias("y"))
    return values.join(got, F.col("node") == F.col("dst"), "left").select("node", F.coalesce("y", F.lit(0.0)).alias("value"))


def neighbours(edges: DataFrame, starts: DataFrame, length: int, hops: int, seed: int = 0) -> DataFrame:
    """node and seq: the start and nodes met breadth-first, each step's in the order of a seeded hash, cut to length."""
    out = starts.select("node", F.lit(0).alias("hop"), F.col("node").alias("at"), F.lit("").alias("key"))
    frontier = out
    for hop in range(1, hops + 1):
        order = F.concat("key", F.md5(F.concat(F.col("dst").cast("string"), F.lit(f":{seed}"))))
        frontier = frontier.join(edges.select("src", "dst").distinct(), F.col("at") == F.col("src")).select("node", F.lit(hop).alias("hop"), F.col("dst").alias("at"), order.alias("key"))
        first = Window.partitionBy("node").orderBy("key", "at")
        frontier = frontier.withColumn("r", F.row_number().over(first)).where(F.col("r") <= length).drop("r")
        out = out.unionAll(frontier)
    ordered = out.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("hop", "key", "at"))).alias("all"))
    return ordered.select("node", F.slice(F.transform("all", lambda s: s["at"]), 1, length).alias("seq"))


def shortest_paths(edges: DataFrame, pairs: DataFrame, k: int = 25, depth: int = 4) -> DataFrame:
    """src, dst and path of the k shortest simple paths of up to depth edges between pairs (src, dst); ties by the path.

    Paths grow a step at a time and end at their target; equal ends are left out. Depth and k bound the result.
    """
    step = edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).distinct()
    open_ = pairs.where("src <> dst").select("src", "dst", F.array("src").alias("path"))
    found = None
    for _ in range(depth):
        grown = open_.join(step, (F.element_at("path", -1) == F.col("u")) & ~F.array_contains("path", F.col("v"))).select("src", "dst", F.concat("path", F.array("v")).alias("path"), (F.col("v") == F.col("dst")).alias("there"))
        ends = grown.where("there").drop("there")
        found = ends if found is None else found.unionAll(ends)
        open_ = grown.where("not there").drop("there")
    best = Window.partitionBy("src", "dst").orderBy(F.size("path"), F.array_join(F.transform("path", lambda v: v.cast("string")), "-"))
    return found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")


def type_codes(known: DataFrame, edges: DataFrame, order: str) -> DataFrame:
    """type and code: known ones stay, new types are numbered on by their first place in order. One row a type."""
    new = edges.groupBy("type").agg(F.min(order).alias("first")).join(known, "type", "left_anti")
    start = known.agg(F.coalesce(F.max("code") + 1, F.lit(0)).alias("start"))
    numbered = new.withColumn("r", F.row_number().over(Window.orderBy("first", "type")) - 1)
    return known.select("type", "code").unionAll(numbered.join(F.broadcast(start)).select("type", (F.col("start") + F.col("r")).cast("int")))  # start is one row


def similarity_edges(pairs: DataFrame, kind: str, threshold: float) -> DataFrame:
    """Edges of both directions between pairs (id1, id2, j_sim) above a threshold."""
    kept = pairs.where(F.col("j_sim") > threshold).select(F.col("id1").alias("src"), F.col("id2").alias("dst"), F.lit(kind).alias("type"), F.col("j_sim").alias("weight"))
    return symmetric(kept)


#: The edge types that each source profile adds.
PROFILES = {"base": ("dump", "metadata"), "metadata": ("publish", "theme"), "content": ("content_sim", "pattern_sim", "keyphrase_sim")}


def profile(edges: DataFrame, names: list[str]) -> DataFrame:
    """The edges of the types of some profiles, base always among them; equal edges once."""
    kinds = [k for name in dict.fromkeys(["base", *names]) for k in PROFILES[name]]
    return edges.where(F.col("type").isin(*kinds)).distinct()


def between_types(edges: DataFrame, nodes: DataFrame, head: str, tail: str) -> DataFrame:
    """type and n of the edges from nodes (node, node_type) of one type to those of another; backward ones count as negative."""
    h, t = (nodes.select(F.col("node").alias(f"{e}_node"), F.col("node_type").alias(f"{e}_type")) for e in ("src", "dst"))
    typed = edges.join(h, F.col("src") == F.col("src_node")).join(t, F.col("dst") == F.col("dst_node"))
    sign = F.when((F.col("src_type") == head) & (F.col("dst_type") == tail), 1).when((F.col("src_type") == tail) & (F.col("dst_type") == head), -1)
    return typed.withColumn("sign", sign).where("sign is not null").groupBy("type").agg(F.sum(F.col("sign").cast("long")).alias("n"))


def with_self_loops(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges (src, dst) without their self loops, and one self loop a node."""
    return edges.select("src", "dst").where("src <> dst").unionAll(nodes.select(F.col("node").alias("src"), F.col("node").alias("dst")).distinct())
