"""Multi-select against sorting."""

import math
import random

import pytest
from pyspark.sql import functions as F

from querymill.llm.percentiles import ValueStore, delivered_once

SHARES = [0.0, 0.5, 0.9, 0.95, 0.99, 1.0]


@pytest.mark.parametrize("few", [100_000, 100])
def test_groups_unions_ties_and_hot_group(spark, few, monkeypatch):
    monkeypatch.setattr("querymill.llm.percentiles.FEW", few)  # also with values written anew
    rnd = random.Random(8)
    rows = [("hot" if rnd.random() < 0.6 else rnd.choice(["b", None]), f"d{rnd.randrange(3)}", rnd.choice([None, float("nan"), 1.0, 1.0, rnd.gauss(0, 1), rnd.random() * 1e9]), 1) for _ in range(4000)]
    rows += [("one", "d0", 5.0, 1), ("same", "d0", 2.0, 1), ("same", "d0", 2.0, 1), ("none", "d0", None, 1), ("one", "d0", float("inf"), 1)]
    store = ValueStore(spark.createDataFrame(rows, "suite string, day string, value double, target int").repartition(5), ["suite", "day"])
    groups = {g: [g] for g in store.sizes} | {("hot", "d0+d1"): [("hot", "d0"), ("hot", "d1")], ("void", "x"): [("void", "x")]}
    got = store.percentiles(groups, SHARES, block=7)
    for name, members in groups.items():
        v = sorted(r[2] for r in rows if (r[0], r[1]) in members and r[2] is not None and abs(r[2]) < math.inf)
        for q in SHARES:
            if v:
                assert got[name, q] == v[max(0, math.ceil(q * len(v)) - 1)]
            else:
                assert (name, q) not in got


@pytest.mark.parametrize("e", [0.02, 0.1])
def test_rank_error(spark, e):
    v = [float(i * i % 9973) for i in range(3000)]
    store = ValueStore(spark.createDataFrame([("g", x) for x in v], "g string, value double").repartition(4), ["g"])
    got = store.percentiles({("g",): [("g",)]}, [0.5], rank_error=e)[("g",), 0.5]
    v.sort()
    low, high = sum(x < got for x in v), sum(x <= got for x in v)
    assert low - e * len(v) <= len(v) / 2 <= high + e * len(v)


def test_no_values_and_too_many_groups(spark):
    empty = spark.createDataFrame([], "g string, value double")
    assert ValueStore(empty, ["g"]).percentiles({}, [0.5]) == {}
    with pytest.raises(ValueError, match="base groups"):
        ValueStore(spark.createDataFrame([("a", 1.0), ("b", 1.0)], "g string, value double"), ["g"], max_groups=1)


def test_each_call_once(spark):
    s = "call_id long, row_id long, suite string, ok boolean, server_ms double, side string"
    rows = [(1, 2, "a", True, 5.0, "x"), (1, 1, "a", True, 7.0, "x"), (2, 3, "a", False, 1.0, "x"), (3, 4, "a", None, 1.0, "x"), (4, 5, None, True, None, "x"), (4, 6, "b", True, 9.0, "x")]
    got = delivered_once(spark.createDataFrame(rows, s), {"server": "server_ms"}, ["suite"], F.col("ok")).collect()
    assert sorted((r.suite, r.value) for r in got) == [("a", 7.0), ("b", 9.0)]
