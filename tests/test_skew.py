"""Exact summaries of hot keys."""

import random
from collections import defaultdict
from statistics import median

from querymill.operators.skew import heavy_keys, key_summaries

SCHEMA = "k string, j string, x double, n long, rank int, chunk string"


def brute(rows, col):
    out = defaultdict(list)
    for r in rows:
        if r[col]:
            out[r[col]].append(r[2])
    return out


def test_hot_key_over_many_partitions_and_chunks(spark):
    rnd = random.Random(1)
    rows = [("hot" if rnd.random() < 0.6 else f"k{rnd.randrange(50)}", rnd.choice(["a", "", None]), rnd.choice([None, rnd.randrange(2000) / 4, 7.0]), i, 1, "c") for i in range(6000)]
    got = {(r.field, r.key_value): r for r in key_summaries(spark.createDataFrame(rows, SCHEMA).repartition(6), ["k", "j"], ["x"], chunk_rows=100).collect()}
    for col, name in ((0, "k"), (1, "j")):
        want = brute(rows, col)
        assert {k for f, k in got if f == name} == set(want)
        for key, values in want.items():
            v = [x for x in values if x is not None]
            r = got[name, key]
            assert (r.n_rows, r.x_n, r.x_sum, r.x_min, r.x_median, r.x_max) == (len(values), len(v), sum(v), min(v), median(v), max(v))


def test_nulls_ties_repeats_and_clashing_names(spark):
    rows = [("a", None, None, 1, 1, "c"), ("a", None, None, 1, 1, "c"), ("b", None, 2.0, 1, 1, "c"), ("b", None, 2.0, 1, 1, "c"), ("", None, 3.0, 1, 1, "c"), (None, None, 3.0, 1, 1, "c"), ("n", None, float("nan"), 1, 1, "c")]
    got = {r.key_value: r for r in key_summaries(spark.createDataFrame(rows, SCHEMA), ["k"], ["x"]).collect()}
    assert set(got) == {"a", "b", "n"}
    assert (got["a"].n_rows, got["a"].x_n, got["a"].x_median) == (2, 0, None)
    assert (got["b"].n_rows, got["b"].x_median, got["b"].x_sum) == (2, 2.0, 4.0)
    assert (got["n"].n_rows, got["n"].x_n) == (1, 0)


def test_empty_table(spark):
    assert key_summaries(spark.createDataFrame([], SCHEMA), ["k"], ["x"]).count() == 0


def test_long_key_and_share(spark):
    rows = [("y" * 50_000, None, 1.0, 1, 1, "c")] * 3 + [(f"k{i}", None, 1.0, 1, 1, "c") for i in range(97)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [r.key_value for r in heavy_keys(key_summaries(df, ["k"], ["x"]), df.count()).collect()] == ["y" * 50_000]


def test_ranks_of_a_hot_key(spark):
    from pyspark.sql import functions as F

    from querymill.operators.skew import ranked_within

    rnd = random.Random(2)
    rows = [("hot" if rnd.random() < 0.7 else rnd.choice(["a", None]), float(rnd.randrange(40)), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, x double, i int").repartition(7)
    got = {(r.k, r.i): (r["rank"], r.n) for r in ranked_within(df, ["k"], [F.col("x"), F.col("i")], "rank", "n").collect()}
    for key in ("hot", "a", None):
        own = sorted((x, i) for k, x, i in rows if k == key)
        assert [got[key, i] for _, i in own] == [(n + 1, len(own)) for n in range(len(own))]
    assert ranked_within(df.limit(0), ["k"], [F.col("x")]).count() == 0


def test_salted_join_is_the_plain_join(spark):
    from querymill.operators.skew import salted_join

    rnd = random.Random(3)
    rows = spark.createDataFrame([("hot" if rnd.random() < 0.5 else rnd.choice(["a", "b", None, ""]), i, {"m": i}) for i in range(3000)], "k string, i int, m map<string,int>")
    side = spark.createDataFrame([("hot", 1), ("hot", 2), ("a", 3), (None, 4), ("z", 5)], "k string, v int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = salted_join(rows, side, ["k"], how, salts=7, least=500).drop("m")
        assert sorted(got.collect(), key=str) == sorted(rows.join(side, "k", how).drop("m").collect(), key=str)
    assert salted_join(rows.limit(0), side, ["k"]).count() == 0
    assert salted_join(rows, side.limit(0), ["k"], "left", least=500).count() == 3000


def test_numbering_streams_over_batches():
    import pandas as pd

    from querymill.operators.skew import _number

    rnd = random.Random(5)
    for _ in range(60):
        rows = [("f", f"k{k}", "m", rnd.choice([float("nan"), float(i)]), rnd.randrange(1, 4), 3) for k in range(rnd.randrange(1, 6)) for i in range(rnd.randrange(1, 7))]
        df = pd.DataFrame(rows, columns=["field", "key_value", "measure", "value", "n", "pid"])
        cuts = sorted(rnd.randrange(len(rows) + 1) for _ in range(3))
        got = pd.concat(list(_number(iter([df.iloc[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]))), ignore_index=True)
        own = df["n"].where(df["value"].notna(), 0)
        by = own.groupby(df["key_value"], sort=False)
        assert got["key_value"].tolist() == df["key_value"].tolist() and got["n"].tolist() == df["n"].tolist()
        assert got["local_end"].tolist() == by.cumsum().tolist() and got["local_total"].tolist() == by.transform("sum").tolist()
        keys = df["key_value"].tolist()
        assert got["edge"].tolist() == [1 if k == keys[0] else 2 if k == keys[-1] else 0 for k in keys]
