from datagrove.operators import headers, learning


def test_headers(spark):
    simple = [["name", "year"], ["Ann", "1999"], ["Bob", "2001"]]
    complex_ = [["Report of things", "", ""], ["", "", ""], ["region", "area of land", ""], ["", "square km", "people"], ["North", "120.5", "1000"], ["South", "99.1", "2000"], ["West", "50.0", "3000"]]
    assert headers.header_rows(simple, [False] * 3) == [0]
    assert 2 in headers.header_rows(complex_, [False] * 7) and 4 not in headers.header_rows(complex_, [False] * 7)
    assert headers.header_column(simple) == ["name", "Ann", "Bob"] and headers.header_column([["1.5", "a"], ["2.25", "b"]]) == []
    assert headers.mode([1, 1, 2, 2, 0]) == 2
    rows = [("f", 0, r, c, v, False) for r, line in enumerate(simple) for c, v in enumerate(line)] + [("g", 0, 0, 0, "alone", True), ("f", 0, 0, 3, "beyond the gap", False)]
    got = headers.units(spark.createDataFrame(rows, "file_id string, sheet int, row int, col int, value string, bold boolean")).collect()
    assert {tuple(r) for r in got} >= {("f", "name"), ("f", "year")} and not any(r.item_id == "g" for r in got)


def test_models(spark):
    rows = spark.createDataFrame([(k, ("river lake water" if k % 2 else "stock bond market") + f" w{k % 5}", ["env"] if k % 2 else ["econ"], [float(k % 2), 1.0], k % 2 + 1) for k in range(60)], "k int, text string, labels array<string>, x array<double>, c int")
    parts = learning.split(rows, "k")
    assert 0 < parts.where("held_out").count() < 60
    words, models = learning.theme_model(rows, "text", "labels", ["econ", "env"], trees=2)
    assert all(r.themes == r.labels for r in learning.predict_themes(rows, words, models).collect())
    assert all(r["class"] == r.c for r in learning.predict_pairs(rows, "x", learning.pair_model(rows, "x", "c", [1, 2], trees=2)).collect())
