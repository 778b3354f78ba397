"""Small fixtures: edge cases of functions, units, graphs, measures, sources and sinks."""

import math

import pytest
from pyspark.sql import functions as F

from datagrove.functions import text as X
from datagrove.operators import graph, overlap, retrieval, samples, units
from datagrove.sources import sinks, tables
from datagrove.streaming import resume


def values(spark, column, *rows):
    """The column over rows of strings a and b."""
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, a string, b string")
    return [r.v for r in df.select("k", column.alias("v")).orderBy("k").collect()]


def test_titles(spark):
    a, b = F.col("a"), F.col("b")
    assert values(spark, X.edit_ratio(a, b), ("", " "), ("ab c", "ABC"), ("abcd", "abxx"), (None, "x")) == [0.0, 0.0, 0.5, None]
    assert values(spark, X.is_replica(a, b), ("", "x"), ("", ""), ("Road map", "road map 2010"), ("abc", "xyz")) == [False, True, True, False]
    assert values(spark, X.is_version(a, b), ("Data v1.0", "Data v2.0"), ("Data", "Data"), ("Data version 3", "Data")) == [True, False, True]
    assert values(spark, X.same_prefix(a, b), ("Roads: north", "Roads: south"), ("Roads: north", "Lakes: north"), ("a: b: c", "a: b: d")) == [True, False, False]
    assert values(spark, X.relation(F.lit("1"), a, F.lit("2"), b, F.lit(4)), ("abcdefgh", "zyxwvuts"), ("same", "same")) == ["Derived", "Replica"]
    assert values(spark, X.relation(F.lit("1"), a, F.lit("2"), b, F.lit(1)), ("abcdefgh", "zyxwvuts")) == [None]


def test_texts(spark):
    a = F.col("a")
    assert values(spark, X.digits_or_marks(a), ("", ""), ("12.5%", ""), ("a1", "")) == [True, True, False]
    assert values(spark, X.clean_text(a), (" x 12 y \n\n 9 9 \nz", "")) == ["x y\nz"]
    assert values(spark, X.long_date(a), ("March 3, 2015", ""), ("March 03, 2015", ""), ("soon", ""), ("", "")) == ["2015-03-03", "2015-03-03", None, None]
    assert values(spark, X.bare_id(a), ("DATASET_00000120", ""), ("DATASET_0", ""), (None, "")) == ["120", "0", None]
    assert values(spark, X.uris(a), ("http://a/ b", ""), ("http://a,\nx http://b", ""), ("no scheme", "")) == [["http://a/%20b"], ["http://a", "http://b"], []]
    assert values(spark, X.sentences(a), ("A. B! A.日本。", ""), (None, "")) == [["A", "B", "日本"], None]
    assert values(spark, X.tokens(a), ("Über a 12_x", "")) == [["Über", "12_x"]]


def test_units(spark):
    docs = spark.createDataFrame([("1", '{"b": {"x": [1, true]}, "a": null, "e": {}}'), ("2", "[1.0]"), ("3", ""), ("4", "{broken"), ("5", None)], "id string, c string")
    of = lambda kind: sorted(map(tuple, units.parsed_units(docs, "id", "c", kind).collect()))
    assert of("json_content") == [("1", "a=None"), ("1", "b.x.[0]=1"), ("1", "b.x.[1]=True"), ("2", "[0]=1.0")]
    assert of("json_paths") == [("1", "a"), ("1", "b"), ("1", "b.x"), ("1", "b.x.[0]"), ("1", "b.x.[1]"), ("1", "e"), ("2", "[0]")]
    units.register(spark)
    assert [r.unit for r in spark.sql("SELECT * FROM json_units('{\"a\": 1}')").collect()] == ["a=1"]


def test_similarity(spark):
    rows = [(i, u) for i, s in {"10": "abcd", "9": "bcde", "x": "abcd", "y": "z", "w": "zq"}.items() for u in s]
    df = spark.createDataFrame(rows + rows[:2], "item_id string, unit string")
    assert sorted(map(tuple, overlap.exact_pairs(df, 0.5).collect())) == [("10", "9", 0.6), ("10", "x", 1.0), ("9", "x", 0.6), ("w", "y", 0.5)]
    assert [tuple(r) for r in overlap.minhash_pairs(df, 0.9).collect()] == [("10", "x", 1.0)]
    assert overlap.exact_pairs(df.limit(0)).collect() == []


def test_minhash_estimates(spark):
    df = spark.createDataFrame([(i, f"u{k}") for i, (lo, hi) in {"a": (0, 300), "b": (100, 400), "c": (0, 300)}.items() for k in range(lo, hi)], "item_id string, unit string")
    signed = overlap.signatures(df)
    pairs = spark.createDataFrame([("a", "b"), ("a", "c")], "id1 string, id2 string")
    got = {(r.id1, r.id2): r.j_sim for r in overlap.estimated(pairs, signed).collect()}
    assert abs(got["a", "b"] - 0.5) <= 0.18 and got["a", "c"] == 1.0


def test_paths(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 1), (4, 5), (1, 2)], "src int, dst int")
    pairs = spark.createDataFrame([(1, 5), (5, 1), (1, 1)], "src int, dst int")
    assert [tuple(r.path) for r in graph.shortest_paths(edges, pairs, 25, 4).orderBy("path").collect()] == [(1, 2, 4, 5), (1, 3, 4, 5)]
    seq = graph.neighbours(edges, spark.createDataFrame([(1,), (5,)], "node int"), 4, 3).collect()
    assert {r.node: len(r.seq) for r in seq} == {1: 4, 5: 1} and all(r.seq[0] == r.node for r in seq)


def test_measures(spark):
    run = spark.createDataFrame([("q", d, s) for d, s in zip("abcde", (5.0, 4.0, 4.0, 2.0, 1.0), strict=True)] + [("unjudged", "a", 1.0)], "qid string, docid string, score double")
    qrels = spark.createDataFrame([("q", "a", 1), ("q", "c", 2), ("q", "z", 1), ("q", "b", 0)], "qid string, docid string, rel int")
    r = retrieval.measures(run, qrels, 5).collect()
    assert len(r) == 1
    ideal = 2 + 1 / math.log2(3) + 1 / 2
    assert (r[0].p, r[0].recall, r[0].ap, r[0].rr) == (0.4, 0.666667, 0.666667, 1.0) and abs(r[0].ndcg - (1 + 2 / math.log2(3)) / ideal) < 1e-6


@pytest.mark.parametrize("parts", [1, 6])
def test_partitions_do_not_matter(spark, parts):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(parts)
    found = overlap.exact_pairs(units.sentence_units(docs, "doc_id", "text"), 0.5)
    assert found.count() == 18


def test_sources(spark, tmp_path):
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "lines.json").write_text('{"a": 1}\n{"a": 2}\n')
    (tmp_path / "array.json").write_text('[{"a": 1}, {"a": 3}]')
    (tmp_path / "one.json").write_text('{"a":\n 4}')
    (tmp_path / "t.csv").write_text("id, b ,\n01,x,\n02,y,\n")
    assert sorted(r.a for r in tables.json_records(spark, str(tmp_path / "array.json"), "a int").collect()) == [1, 3]
    assert sorted(r.a for r in tables.json_records(spark, str(tmp_path / "j"), "a int").collect()) == [1, 2]
    assert tables.csv_header(spark, str(tmp_path / "t.csv")) == ["b", "id"]
    assert [r.id for r in tables.csv_rows(spark, str(tmp_path / "t.csv"), "id string, b string, c string").collect()] == ["01", "02"]
    lines = spark.createDataFrame([("q\t0\td1\t2",), ("bad",)], "value string")
    assert [tuple(r) for r in tables.qrels(lines).collect()] == [("q", "d1", 2)]
    node = spark.createDataFrame([("1\tn\t0",), ("2\tm\t1\t0.5,1.5",), ("x",)], "value string")
    assert [tuple(r) for r in tables.nodes(node).collect()] == [(1, "n", 0, None), (2, "m", 1, [0.5, 1.5]), (None, None, None, None)]


def test_sinks(spark, tmp_path):
    triples = spark.createDataFrame([("s", "p", 'a "b"\n', "literal"), ("s", "p", "o", "iri")], "s string, p string, o string, o_kind string")
    sinks.write_ntriples(triples, str(tmp_path / "nt"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "nt")).collect()) == ['<s> <p> "a \\"b\\"\\n" .', "<s> <p> <o> ."]
    sinks.write_csv(triples.limit(0), str(tmp_path / "csv"))
    assert [r.value for r in spark.read.text(str(tmp_path / "csv")).collect()] == ["s,p,o,o_kind"]
    nodes = spark.createDataFrame([(1, "n", 0, [0.5])], "id long, name string, type int, attr array<double>")
    assert sinks.node_lines(nodes).first().value == "1\tn\t0\t0.500000"


def test_stream(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in ([(1, "a", 1), (2, "b", 1)], [(1, "c", 2)]):
        spark.createDataFrame(rows, "k int, v string, t int").write.mode("append").parquet(source)
        resume.absorb(spark, source, "k int, v string, t int", target, str(tmp_path / "cp"), ["k"], "t").awaitTermination()
    assert sorted((r.k, r.v) for r in spark.read.parquet(f"{target}/v=1").collect()) == [(1, "c"), (2, "b")]


def test_more_sources(spark, tmp_path):
    """Encodings, quoted headers, JSON of each form side by side, N-Triples, queries, DOCX, repeated found keys."""
    import zipfile

    (tmp_path / "latin.csv").write_bytes("id,b\n1,é\n".encode("latin-1"))
    (tmp_path / "utf.csv").write_text('"a,b", c ,\nx,y,\n')
    assert [r.b for r in tables.csv_rows(spark, str(tmp_path / "latin.csv"), "id string, b string").collect()] == ["é"]
    assert tables.csv_header(spark, str(tmp_path / "utf.csv")) == ["a,b", "c"]
    (tmp_path / "j").mkdir()
    for name, text in {"one": '{"a":\n 4}', "lines": '{"a": 1}\n{"a": 2}\n', "array": '[{"a": 5},\n {"a": 6}]', "empty": "", "broken": "{x"}.items():
        (tmp_path / "j" / f"{name}.json").write_text(text)
    assert sorted(str(r.a) for r in tables.json_records(spark, str(tmp_path / "j"), "a int").collect()) == ["1", "2", "4", "5", "6", "None"]
    lines = spark.createDataFrame([('<s> <p> "a \\"b\\"\\n\\\\n"@en .',), ("<s> <p> <o> . # c",), ("_:b <p> _:c .",), ("# no",), ("<s> <p> .",)], "value string")
    assert sorted(map(tuple, tables.ntriples(lines).collect())) == [("_:b", "p", "_:c", "blank"), ("s", "p", 'a "b"\n\\n', "literal"), ("s", "p", "o", "iri")]
    asked = spark.createDataFrame([("q1\tsome text\tmore",), ("bad",)], "value string")
    assert [tuple(r) for r in tables.queries(asked).collect()] == [("q1", "some text\tmore")]
    assert [r.value for r in sinks.query_lines(tables.queries(asked)).collect()] == ["q1\tsome text more"]
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>a </w:t></w:r><w:r><w:t>b</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>c</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "x.docx").write_bytes(b"no zip")
    assert sorted(str(r.content) for r in tables.docx(spark, str(tmp_path / "*.docx")).collect()) == ["None", "a b\n\nc"]
    rows = spark.createDataFrame([("k", ""), ("l", "old")], "k string, v string")
    found = spark.createDataFrame([("k", "x"), ("k", "y")], "k string, v string")
    assert sorted(map(tuple, sinks.fill(rows, found, "k", "v").collect())) == [("k", "y"), ("l", "old")]
    link = spark.createDataFrame([("1\t2\t0\t0.5",), ("1\tx\t0\t?",)], "value string")
    assert sorted(map(str, tables.links(link).collect())) == sorted(["Row(head=1, tail=2, type=0, weight=0.5)", "Row(head=1, tail=None, type=0, weight=None)"])
    assert [r.value for r in sinks.link_lines(tables.links(link).where("tail is not null")).collect()] == ["1\t2\t0\t0.5"]
    sinks.write_json(rows, str(tmp_path / "dump"))
    assert tables.json_records(spark, str(tmp_path / "dump"), "k string, v string").count() == 2
    assert sinks.json_map(rows, "k", "v").where("k = 'l'").first().json == '["old"]'


def test_addresses(spark):
    a = F.col("a")
    assert values(spark, X.download_urls(a), ('["http://x/o\'brien"]', ""), ("['http://a', 'http://b']", ""), ('"http://q"', ""), ("none", "")) == [["http://x/o'brien"], ["http://a", "http://b"], ["http://q"], []]
    assert values(spark, X.with_scheme(a), ("http://a", ""), ("a.b", "")) == ["http://a", "https://a.b"]


def test_xml(spark):
    """Tails stand under the child they follow; names lose their namespace; deep files have no limit."""
    docs = spark.createDataFrame([("1", '<r xmlns:n="u" n:k="v">t<c> x </c>tail<c/>two</r>'), ("2", "<a>" * 3000 + "</a>" * 3000), ("3", "<broken")], "id string, c string")
    of = lambda kind: sorted(r.unit for r in units.parsed_units(docs.where("id <> '2'"), "id", "c", kind).collect())
    assert of("xml_content") == ["r/c/tail=tail", "r/c/tail=two", "r/c=x", "r=t", "r[@k]=v"]
    assert of("xml_paths") == ["r", "r/c", "r[@k]"]
    assert units.parsed_units(docs.where("id = '2'"), "id", "c", "xml_paths").count() == 3000
    made, counts = units.coerced(spark.createDataFrame([("1", ["b", " b ", "", None]), ("2", []), ("3", None), (None, ["x"])], "id string, u array<string>"), "id", "u", include_empty=True)
    assert sorted(map(str, made.collect())) == ["Row(item_id='1', unit='b')", "Row(item_id='2', unit=None)"] and tuple(counts.first()) == (2, 1, 2)


def test_similarity_of_frequent_units(spark, monkeypatch):
    """Sets of a few units that are all frequent are compared in blocks, members of a class once."""
    import random

    rng = random.Random(5)
    sets = {str(i): frozenset(rng.sample("abcdefg", rng.randint(2, 6))) for i in range(90)}
    df = spark.createDataFrame([(i, u) for i, s in sets.items() for u in s] + [("90", None), (None, "a")], "item_id string, unit string")
    monkeypatch.setattr(overlap, "FEW_PAIRS", 0)
    monkeypatch.setattr(overlap, "BLOCK", 16)
    for threshold in (1.0, 0.5, 0.3):
        want = {(i, k, len(sets[i] & sets[k]) / len(sets[i] | sets[k])) for i in sets for k in sets if i < k and len(sets[i] & sets[k]) / len(sets[i] | sets[k]) >= threshold}
        found = overlap.exact_pairs(df, threshold)
        assert sorted(map(tuple, found.collect())) == sorted(want)
    assert "CartesianProduct" in found._jdf.queryExecution().toString() or "BroadcastNestedLoopJoin" in found._jdf.queryExecution().toString()


@pytest.fixture
def many_parts(spark):
    """Small shuffles keep their partitions, as large ones do."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_dense_ids_of_many_parts(spark, many_parts):
    """Numbers are consecutive in the order of type and id, though the rows are dealt more than once; sparse and negative ids too."""
    b = spark.range(0, 300_000, numPartitions=7).select(F.lit("b").alias("node_type"), (F.col("id") * 3).alias("local_id"))
    rest = spark.createDataFrame([("a", -(1 << 60)), ("a", -1), ("a", 5), ("a", 1 << 40), ("a", (1 << 63) - 1)], "node_type string, local_id long")
    got = graph.dense_ids(b.unionAll(rest), ["a", "b"])
    assert [r.nid for r in got.where("node_type = 'a'").orderBy("local_id").collect()] == [0, 1, 2, 3, 4]
    assert got.where("node_type = 'b'").agg(F.count_if(F.col("nid") == 5 + F.col("local_id") / 3)).first()[0] == 300_000


def test_rekeyed_by_dense_ids(spark, many_parts):
    """Grades get the ids of their documents, though only one type of the ids is asked for."""
    nodes = spark.range(0, 200_000, numPartitions=5).select(F.lit("c").alias("node_type"), F.col("id").alias("local_id"))
    ids = graph.dense_ids(spark.createDataFrame([("a", 7), ("a", 9)], "node_type string, local_id long").unionAll(nodes), ["a", "c"])
    grades = spark.range(0, 200_000, 13).select(F.col("id").alias("qid"), F.col("id").alias("docid"))
    got = samples.rekeyed(grades, "docid", ids.where("node_type = 'c'"))
    assert got.agg(F.count_if(F.col("docid") == F.col("qid") + 2), F.count(F.lit(1))).first()[:] == (15385, 15385)


def test_closest_pairs(spark):
    """Against all pairs: equal values, NULL, NaN and infinite ones, gaps that are rounded to equal numbers; many equal values are no matter."""
    import itertools
    import random

    rng = random.Random(3)
    inf, nan = float("inf"), float("nan")
    cases = {
        "equal": [float(rng.randrange(4)) for _ in range(120)], "odd": [None, 1.5, nan, inf, inf, -inf, None, 2.0, nan], "number": [rng.random() for _ in range(150)],
        "rounded": [1e17, *[float(n) for n in rng.sample(range(8), 8)]], "one": [1.0], "no": [],
    }
    for name, values in cases.items():
        rows = [(k, v, k % 2) for k, v in enumerate(values)]
        gap = lambda v, w: None if v is None or w is None else abs(v - w)
        pairs = [(a[0], b[0], gap(a[1], b[1])) for a, b in itertools.combinations(rows, 2) if a[2] == b[2]]
        pairs.sort(key=lambda p: (p[2] is None, p[2] != p[2], p[2] if p[2] is not None and p[2] == p[2] else 0, p[:2]))
        for k in (3, 20):
            got = samples.closest_pairs(spark.createDataFrame(rows, "id long, v double, g int"), ["g"], k)
            assert [tuple(map(repr, r)) for r in got.collect()] == [tuple(map(repr, p)) for p in pairs[:k]], name
    many = spark.range(0, 40_000).selectExpr("id", "double(id % 2) v", "1 g")
    assert [tuple(r) for r in samples.closest_pairs(many, ["g"], 3).collect()] == [(0, 2, 0.0), (0, 4, 0.0), (0, 6, 0.0)]


def twin_texts():
    """Texts whose ends, digits and spaces differ by engine: v at an end, vertical tab, no-break space, wide space, digits of other scripts."""
    return ["v vab v. A\x0b b\x0bv", "\xa0x\xa0 y　. \x0bz\x0b", "v <b>٣٤ 12 v</b>\x0b w  ", "a  \n\nb\x0b\x0bc\tv\n \t\nv", "v", "vv. v. .", " ٣. 5\x85", ""]


def twin_rows(spark, tmp_path, name, table, id_col, text_col):
    """Rows of a query over these texts, by Spark and by its SQL."""
    import duckdb

    from datagrove.plans import registry

    rows = spark.createDataFrame(list(enumerate(twin_texts())), f"{id_col} long, {text_col} string")
    rows.write.parquet(str(tmp_path / f"{table}.parquet"))
    got = registry.QUERIES[name](spark, str(tmp_path))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    columns = ", ".join(got.columns)
    return sorted(map(tuple, got.collect())), sorted(duck.sql(f"SELECT {columns} FROM ({registry.ORACLE_SQL[name]})").fetchall())


def test_twin_of_minhash_signature(spark, tmp_path):
    got, want = twin_rows(spark, tmp_path, "minhash_signature", "documents", "doc_id", "text")
    assert got == want


def test_twin_of_sentence_units(spark, tmp_path):
    got, want = twin_rows(spark, tmp_path, "sentence_units", "documents", "doc_id", "text")
    assert got == want


def test_twin_of_strip_tags(spark, tmp_path):
    got, want = twin_rows(spark, tmp_path, "strip_tags", "pages", "page_id", "html")
    assert got == want


def test_twin_of_merge_paragraphs(spark, tmp_path):
    got, want = twin_rows(spark, tmp_path, "merge_paragraphs", "documents", "doc_id", "text")
    assert got == want
