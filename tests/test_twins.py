"""Queries against their SQL twins on odd rows."""

import duckdb
import pytest

from datagrove.plans import registry


def both(spark, folder, name, **tables):
    """Rows of a query over these tables, by Spark and by its SQL."""
    duck = duckdb.connect()
    for table, rows in tables.items():
        rows.write.parquet(f"{folder}/{table}.parquet")
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    got = registry.QUERIES[name](spark, str(folder))
    want = duck.sql(f"SELECT {', '.join(got.columns)} FROM ({registry.ORACLE_SQL[name]})").fetchall()
    return sorted(map(repr, map(tuple, got.collect()))), sorted(map(repr, want))


@pytest.mark.parametrize("name", ["sentence_units", "unit_counts"])
def test_repeated_documents(spark, tmp_path, name):
    """Rows of one doc_id, or of none, share sentences."""
    rows = [(1, "a. b. a"), (1, "b! c"), (2, "a"), (2, "a"), (None, "x. y"), (None, "x"), (3, None), (4, " . ")]
    got, want = both(spark, tmp_path, name, documents=spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == want


@pytest.mark.parametrize("kind", ["long", "int", "double", "float", "decimal(20,2)", "string"])
def test_qrels_of_key_types(spark, tmp_path, kind):
    """Orders hold their customers' keys in another type; some have none, several or an unknown one."""
    fixed = {"region": spark.range(2).selectExpr("int(id) r_regionkey"), "nation": spark.range(3).selectExpr("int(id * 5) n_nationkey")}
    customers = spark.createDataFrame([(k,) for k in (5, 9, 9, 70000, -3, None)], "c_custkey long")
    orders = spark.createDataFrame([(1, 5), (2, 9), (3, 70000), (-4, -3), (6, 77), (None, 5), (7, None)], "o_orderkey long, k long")
    orders = orders.selectExpr("o_orderkey", f"cast(k as {kind}) o_custkey")
    got, want = both(spark, tmp_path, "qrels_by_node_id", customer=customers, orders=orders, **fixed)
    assert got == want and len(got) == 6
