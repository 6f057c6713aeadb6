"""Readers, writers, staging and streams."""

import os

from pyspark.sql import functions as F

from querymill.operators.stats import latest
from querymill.sources import readers as R
from querymill.sources.tables import shared_dir, stage
from querymill.streaming import windows as W


def test_missing_lines_and_phrases(spark, tmp_path):
    assert R.lines(spark, str(tmp_path / "none")).count() == 0
    p = str(tmp_path / "phrases")
    R.write_phrases(spark.createDataFrame([("G-Pro",), ("g pro",), ("Чайник",), ("",), (None,)], "c string"), "c", p)
    assert [r.phrase for r in R.lines(spark, p).collect()] == ["чайник", "g pro"]


def test_upsert_keeps_the_last_write(spark, tmp_path):
    p, s = str(tmp_path / "store"), "index int, v string, ts int"
    R.upsert(spark, spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], s), p, ["index"], ["ts"])
    R.upsert(spark, spark.createDataFrame([(2, "d", 5), (3, "e", 1)], s), p, ["index"], ["ts"])
    want = [(1, "b"), (2, "d"), (3, "e")]
    assert sorted((r["index"], r["v"]) for r in R.stored(spark, p, s).collect()) == want
    # a version that a crash left unfinished is none, and the next upsert writes over it
    spark.createDataFrame([(9, "x", 9)], s).write.json(f"{p}/v2")
    os.remove(f"{p}/v2/_SUCCESS")
    assert sorted((r["index"], r["v"]) for r in R.stored(spark, p, s).collect()) == want
    R.upsert(spark, spark.createDataFrame([(4, "f", 1)], s), p, ["index"], ["ts"])
    assert sorted((r["index"], r["v"]) for r in R.stored(spark, p, s).collect()) == [*want, (4, "f")]
    assert sorted(x for x in os.listdir(p) if x.startswith("v")) == ["v1", "v2"]
    assert R.stored(spark, str(tmp_path / "none"), s).count() == 0


def test_csv_mark_and_log(spark, tmp_path):
    p = str(tmp_path / "csv")
    R.write_csv(spark.createDataFrame([(1, "чай, \"x\"")], "a int, b string"), p)
    assert [tuple(r) for r in R.read_csv(spark, p, "a int, b string").collect()][0][0] == 1
    q = str(tmp_path / "log")
    for i in range(2):
        R.append_log(spark.createDataFrame([(i,)], "i int"), q)
    assert spark.read.json(q).count() == 2


def test_stage_is_shared_and_read_back(spark):
    df = stage(spark.range(10), "x")
    assert df.count() == 10 and df.inputFiles()[0].removeprefix("file://").removeprefix("file:").startswith(shared_dir(spark).removeprefix("file://").removeprefix("file:"))


def test_latest_with_ties_is_total(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (2, None, "c")], "k int, o int, v string")
    assert sorted((r.k, r.v) for r in latest(df, ["k"], ["o"]).collect()) == [(1, "b"), (2, "c")]


def test_late_events_are_dropped(spark, tmp_path):
    s = "ts timestamp, event_type string, value double"
    d = str(tmp_path / "in")
    spark.sql("SELECT timestamp'2024-01-01 00:10:00' ts, 'a' event_type, 1.0D value UNION ALL SELECT timestamp'2024-01-01 05:00:00', 'a', 1.0D").coalesce(1).write.parquet(d)
    out = W.drained(W.tumbling(spark.readStream.schema(s).parquet(d), "1 hour", "10 minutes", ["event_type"]))
    assert [(r.start.hour, r.n) for r in out.collect()] == [(0, 1)]


def test_last_write_of_a_stream(spark, tmp_path):
    d = str(tmp_path / "in")
    for i in range(3):
        spark.createDataFrame([(1, i, f"v{i}"), (2, -i, f"w{i}")], "k int, o int, v string").coalesce(1).write.mode("append").parquet(d)
    src = spark.readStream.schema("k int, o int, v string").option("maxFilesPerTrigger", 1).parquet(d)
    assert sorted((r.k, r.v) for r in W.latest(src, ["k"], F.col("o"), ["v"]).collect()) == [(1, "v2"), (2, "w0")]


def test_last_write_goes_on_after_a_restart(spark, tmp_path):
    d, out, s = str(tmp_path / "in"), str(tmp_path / "out"), "k int, o int, v string"
    read = lambda: W.latest(spark.readStream.schema(s).parquet(d), ["k"], F.col("o"), ["v"], out)
    spark.createDataFrame([(1, 5, "old"), (2, 1, "x")], s).write.parquet(d)
    assert sorted((r.k, r.v) for r in read().collect()) == [(1, "old"), (2, "x")]
    spark.createDataFrame([(1, 4, "late"), (2, 2, "y")], s).write.mode("append").parquet(d)
    assert sorted((r.k, r.v) for r in read().collect()) == [(1, "old"), (2, "y")]
    assert sorted((r.k, r.v) for r in read().collect()) == [(1, "old"), (2, "y")]


def test_offers_at_any_depth(spark, tmp_path):
    one = '{"@id": 7, "vendor": "B", "model": "M", "price": 10.50, "name": null}'
    for i, text in enumerate([f'{{"a": [{{"b": {{"offers": {{"offer": [{one}]}}}}}}]}}', f"[{one}, 3]", f'{{"offer": {one}}}', "{}", "no json", f'{{"offers": [{one}], "x": {{"offers": []}}}}']):
        (tmp_path / f"{i}.json").write_text(text)
    got = R.catalog_offers(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [("7", "M", "B", None, None, "10.50")] * 4


def test_journal(spark, tmp_path):
    p = str(tmp_path / "journal")
    R.write_journal(spark.createDataFrame([("a|b\nc", None, 3)], "q string, w string, n int"), p)
    assert [r.value for r in spark.read.text(p).collect()] == ["| a\\|b c |  | 3 |"]


def test_staged_tables_can_be_dropped(spark):
    from querymill.sources.tables import drop_staged

    f = stage(spark.range(3), "gone").inputFiles()[0].removeprefix("file://")
    assert os.path.exists(f) and drop_staged(spark) >= 1 and not os.path.exists(f) and drop_staged(spark) == 0


def test_csv_keeps_every_value(spark, tmp_path):
    p = str(tmp_path / "csv")
    values = [None, "", " a ", "a\nb", "a\r\nb", "\r", 'a"b', '"', "\\", 'a\\"b', 'x"\\', ",", " x", "  ", '"\n,"', "null"]
    R.write_csv(spark.createDataFrame(list(enumerate(values)), "a int, b string"), p)
    assert {r.a: r.b for r in R.read_csv(spark, p, "a int, b string").collect()} == dict(enumerate(values))
