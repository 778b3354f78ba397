"""Writers and table upkeep: CSV, triples, node and link files, upsert, fill, resume."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """old and new rows with one row a key: the new one of greatest order, else the old one."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    latest = Window.partitionBy(*keys).orderBy(F.desc("__new"), F.desc(order))
    return both.withColumn("__n", F.row_number().over(latest)).where("__n = 1").drop("__n", "__new")


def fill(rows: DataFrame, found: DataFrame, key: str, column: str) -> DataFrame:
    """rows with the found values where there are some; of several for a key the greatest."""
    new = found.groupBy(key).agg(F.max(column).alias("__found"))
    return rows.join(new, key, "left").withColumn(column, F.coalesce("__found", column)).drop("__found")


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return rows.join(done.select(key).distinct(), key, "left_anti")


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with header, also for an empty table."""
    (rows if rows.take(1) else rows.coalesce(1)).write.mode("overwrite").option("header", True).csv(path)


def write_ntriples(triples: DataFrame, path: str) -> None:
    """Lines of (s, p, o, o_kind): o is an IRI or a literal."""
    quoted = F.concat(F.lit('"'), F.replace(F.replace(F.replace("o", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))
    o = F.when(F.col("o_kind") == "literal", quoted).otherwise(F.concat(F.lit("<"), F.col("o"), F.lit(">")))
    triples.select(F.concat(F.lit("<"), "s", F.lit("> <"), "p", F.lit("> "), o, F.lit(" ."))).write.mode("overwrite").text(path)


def node_lines(nodes: DataFrame) -> DataFrame:
    """'id TAB name TAB type [TAB floats]' of nodes (id, name, type, attr)."""
    attr = F.array_join(F.transform("attr", lambda v: F.format_string("%.6f", v.cast("double"))), ",")
    return nodes.select(F.concat_ws("\t", F.col("id").cast("string"), "name", F.col("type").cast("string"), attr).alias("value"))


def link_lines(links: DataFrame) -> DataFrame:
    """'head TAB tail TAB type TAB weight', by type."""
    ordered = links.orderBy("type", "head", "tail")
    return ordered.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in ("head", "tail", "type", "weight")]).alias("value"))


def write_json(rows: DataFrame, path: str) -> None:
    """A JSON object a line."""
    rows.write.mode("overwrite").json(path)


def json_map(rows: DataFrame, key: str, value: str) -> DataFrame:
    """One JSON object a key: 'key' and 'json' of its values, a map of nested dumps."""
    return rows.groupBy(key).agg(F.to_json(F.array_sort(F.collect_set(value))).alias("json"))


def query_lines(queries: DataFrame) -> DataFrame:
    """'id TAB text' of queries (qid, text); tabs and line ends in a text become spaces."""
    return queries.select(F.concat_ws("\t", F.col("qid").cast("string"), F.regexp_replace("text", r"[\t\r\n]+", " ")).alias("value"))
