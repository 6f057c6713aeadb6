"""Smaller analyses and the command line."""

from pyspark.sql import functions as F

from querymill import cli
from querymill.operators import analysis as Y
from querymill.operators import mining as D
from querymill.operators import stats as S
from querymill.operators.metrics import empirical_cdf
from querymill.operators.skew import order_statistics


def test_command_line(spark, sf, tmp_path):
    p = tmp_path / "q.txt"
    p.write_text("# a comment\nчайник grukbame белый\n\n", encoding="utf-8")
    cli.main([str(p), sf, str(tmp_path / "out.json")])
    got = spark.read.json(str(tmp_path / "out.json")).collect()
    assert [(r.query, r.colors) for r in got] == [("чайник grukbame белый", "белый")]


def test_typed_and_first_key(spark):
    df = spark.createDataFrame([("kx1134", "size", 0.9), ("2 кг", "size", 0.9), ("2 кг", "size", 0.1), ("", "size", 0.1)], "t string, top string, p double")
    assert [r[0] for r in df.select(Y.typed(F.col("t"), F.col("top"), F.col("p"))).collect()] == ["UNKNOWN", "size", "weight", "other"]
    m = spark.createDataFrame([({3: "a", 5: "b"}, 2, 6), ({3: "a"}, 4, 4), ({}, 0, 3)], "m map<int,string>, s int, e int")
    assert [r[0] for r in m.select(Y.first_key(F.col("m"), F.col("s"), F.col("e"))).collect()] == [3, None, None]


def test_bag_cosine(spark):
    df = spark.createDataFrame([(["a", "a", "b"], ["a"]), ([], ["a"]), (["c"], ["a"])], "a array<string>, b array<string>")
    assert [round(r[0], 6) for r in df.select(Y.bag_cosine(F.col("a"), F.col("b"))).collect()] == [0.894427, 0.0, 0.0]


def test_quantiles_with_nulls_and_ties(spark):
    rows = [("a", x) for x in (1.0, 1.0, 1.0, 4.0, None, float("nan"))] + [(None, 2.0), ("c", None)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(3)
    got = {r.g: (r.n, r.q0, r.q1) for r in order_statistics(df, ["g"], "x", [0.5, 0.9]).collect()}
    assert {k: (n, q, round(z, 6)) for k, (n, q, z) in got.items()} == {"a": (4, 1.0, 3.1), None: (1, 2.0, 2.0)}
    d = {r.g: (r.n, r.q50, r.high) for r in S.describe(spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0)], "g string, x double"), "x", ["g"]).collect()}
    assert d == {"a": (2, 2.0, 3.0), None: (1, 5.0, 5.0)}
    c = {r.x: r.cdf for r in empirical_cdf(spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("b", 9.0)], "g string, x double"), ["g"], "x").collect()}
    assert c == {1.0: 0.0, 2.0: 0.5, 9.0: 0.0}


def test_empty_tables(spark):
    q = spark.createDataFrame([], "query string")
    assert {r.share for r in Y.pattern_coverage(q, F.col("query")).collect()} == {None}
    assert S.missing_profile(q, ["query"]).first().share_missing is None
    assert D.coverage_by_support(spark.createDataFrame([], "phrase string, n long"), [2]).first().covered is None
    assert S.stratified_split(spark.createDataFrame([], "c string, i int"), "c", ["i"], 0.2).count() == 0
    assert S.capped_classes(spark.createDataFrame([], "c string, i int"), "c", ["i"], [("x", 0.2, 5)]).count() == 0
