"""Selection of models, thresholds and learning curves."""

import pytest
from pyspark.sql import functions as F

from querymill.functions import attributes as A
from querymill.operators import selection as Z


def brute_f1(rows):
    labels = {a for a, _ in rows} | {b for _, b in rows}
    f = [2 * sum(a == b == x for a, b in rows) / (sum(a == x for a, _ in rows) + sum(b == x for _, b in rows)) for x in labels]
    return round(sum(f) / len(f), 6), round(sum(a == b for a, b in rows) / len(rows), 6)


def test_macro_f1(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "UNKNOWN"), ("b", "a"), ("a", "a")]
    r = Z.macro_f1(spark.createDataFrame([("m", *x) for x in rows], "model string, t string, p string"), ["model"], "t", "p").collect()[0]
    assert (r.macro_f1, r.accuracy, r.n) == (*brute_f1(rows), 6)


def test_tau_has_a_floor_and_ties_go_to_coverage(spark):
    df = spark.createDataFrame([("a", "a", 0.95), ("b", "b", 0.58), ("b", "a", 0.5), ("a", "a", 0.4)], "y string, top string, p1 double")
    got = {r.tau: r for r in Z.choose_tau(df, "y", "top", "p1").collect()}
    assert [t for t, r in got.items() if r.chosen] == [0.55] and got[0.35].coverage == 1.0 and got[0.9].coverage == 0.25
    assert Z.choose_tau(df.limit(0), "y", "top", "p1").count() == 0


@pytest.mark.parametrize("kind", [{}, {"one_vs_rest": True, "steps": 5}, {"balanced": True}])
def test_models_learn_and_ignore_nulls(spark, kind):
    rows = [(f"чайник {i}", "kettle") for i in range(12)] + [(f"laptop {i}", "computer") for i in range(8)] + [(None, "kettle"), ("", "computer"), ("x", None)]
    df = spark.createDataFrame(rows, "text string, label string")
    m = Z.TextModel(Z.QUERY_LAYOUTS["words+char"], features=256, least=1, **kind).fit(df)
    got = {r.text: r for r in m.predict(spark.createDataFrame([("чайник 99",), ("laptop 99",), (None,), ("слово " * 5000,)], "text string"), top=2).collect()}
    assert got["чайник 99"].top == "kettle" and got["laptop 99"].top == "computer" and len(got) == 4
    assert all(abs(sum(x.p for x in r.ranked) - 1) < 1e-6 and r.ranked[0].p >= r.ranked[1].p for r in got.values())


def test_selection_takes_the_best(spark):
    df = spark.createDataFrame([(f"чайник {i}", "kettle", "x") for i in range(10)] + [(f"laptop {i}", "computer", "x") for i in range(10)], "text string, label string, other string")
    models = {"blind": Z.TextModel([("other", "word", 1, 1)], features=64, least=1), "char": Z.TextModel(Z.QUERY_LAYOUTS["char"], features=256, least=1)}
    best, report = Z.select_model(models, df, df)
    assert best == "char" and {r.model: r.chosen for r in report.collect()} == {"char": True, "blind": False}


def test_curve_grows(spark):
    df = spark.range(400).withColumnRenamed("id", "k")
    parts = Z.learning_curve(lambda part: part, df, [0.25, 0.5, 1.0], "k")
    sets = [{r.k for r in p.collect()} for _, _, p in parts]
    assert sets[0] < sets[1] < sets[2] and len(sets[2]) == 400 and [n for _, n, _ in parts] == [len(x) for x in sets]


def test_pattern_spans_have_their_offsets(spark):
    text = "чайник 1,7 л 2200 вт wi-fi, 10-20 см и full hd 5 шт"
    got = spark.createDataFrame([(text,), ("без чисел lte",), (None,), ("",)], "t string").select("t", A.pattern_spans(F.col("t")).alias("s")).collect()
    cut = {r.t: [(x.kind, r.t[x.start : x.end]) for x in r.s] for r in got if r.t}
    assert ("volume", "1,7 л") in cut[text] and ("power", "2200 вт") in cut[text] and ("connectivity", "wi-fi") in cut[text] and ("size", "10-20 см") in cut[text] and ("quantity", "5 шт") in cut[text] and ("resolution_standard", "full hd") in cut[text]
    assert cut["без чисел lte"] == [("connectivity", "lte")]
