"""Typed names mapped to a reference list."""

import pytest
from pyspark.sql import functions as F

from querymill.llm.entities import Reference, allowed, deletions

NAMES = [(1, "Pésogrirt"), (2, "Moretrund Line"), (3, "RAT"), (4, "Rönbenox Line"), (5, "Chileklo"), (6, None), (7, "")]


@pytest.fixture(scope="module")
def reference(spark):
    names = spark.createDataFrame(NAMES, "entry_id long, name string")
    return Reference(names, spark.createDataFrame([(4, "рон бэнокс"), (4, None)], "entry_id long, alias string"))


FORMS = [
    ("PÉSOGRIRT", 1), ("песогрирт", 1), ("pesogrrt", 1), ("pevsogrrirt", 1), ("зуыщпкшке", 1), ("gtcjuhbhn", 1), ("pes ogrirt", 1), ("peso-grirt ltd", 1), ("ｐｅｓｏｇｒｉｒｔ", 1), ("peѕоgrіrt", 1), ("«Pésogrirt» (Корея)", 1),
    ("moretrund", 2), ("мор етрунд line", 2), ("vjh tnheyl", 2), ("чайник mometund line 5 кг", 2), ("rat.", 3), ("рат", 3), ("бренд ронбэнокс", 4), ("чилекло", 5), ("cdileklo", 5),
    ("line", None), ("ratt", None), ("смартфон", None), ("вентилятор черный robot mop", None), ("12345", None), ("???", None), ("", None), (None, None),
]


def test_forms(spark, reference):
    got = reference.match(spark.createDataFrame([(t, 9, "x") for t, _ in FORMS], "text string, entry_id long, token string")).collect()
    assert {r.text: r.entry_id for r in got} == {t: e for t, e in FORMS if e is not None}


def test_best_of_several_and_repeats(spark, reference):
    long = "слово " * 20_000 + "pesogrirt"
    rows = spark.createDataFrame([("moretrund line rat",), ("moretrund line rat",), (long,)], "text string")
    got = {r.text: r.entry_id for r in reference.match(rows).collect()}
    assert got == {"moretrund line rat": 3, long: 1} or got == {"moretrund line rat": 2, long: 1}
    assert reference.match(rows.limit(0)).count() == 0


def test_empty_reference(spark):
    r = Reference(spark.createDataFrame([], "entry_id long, name string"))
    assert r.match(spark.createDataFrame([("pesogrirt",)], "text string")).count() == 0


def test_deletions_meet_within_the_edits(spark):
    df = spark.createDataFrame([("moretrund", "mnretrknd"), ("abcdef", "abXdef")], "a string, b string")
    r = df.select(F.arrays_overlap(deletions(F.col("a"), allowed(F.col("a"))), deletions(F.col("b"), allowed(F.col("b"))))).collect()
    assert all(x[0] for x in r)


SHORT = [(1, "LG"), (2, "360"), (3, "Marlow Kitchenaid"), (4, "3M"), (5, "Жубэльт"), (6, "Quantel Robomix Deepsea")]


@pytest.fixture(scope="module")
def short(spark):
    return Reference(spark.createDataFrame(SHORT, "entry_id long, name string"), spark.createDataFrame([(6, "глубина")], "entry_id long, alias string"))


SHORT_FORMS = [
    ("LG", 1), ("lg", 1), ("LG телевизор", 1), ("lgg", None), ("360", 2), ("камера 360", 2), ("3600", None), ("361", None), ("kitchenaid", 3), ("marlow", 3), ("marlo", None), ("marlo kitchenaid", 3), ("marlow kitchenad", 3), ("marlov kitchenaid", 3), ("3m", 4), ("3 M скотч", 4),
    ("жубэльт", 5), (";e,'kmn", 5), ("чайник ;e,'kmn, белый", 5), ("robomix", None), ("robomix deepsea", 6), ("глубина", 6), ("x" * 40_000, None), ("ъ" * 40_000 + " lg", 1),
]


def test_short_numeric_and_damaged_tokens(spark, short):
    got = short.match(spark.createDataFrame([(t,) for t, _ in SHORT_FORMS], "text string")).collect()
    assert {r.text[:30]: r.entry_id for r in got} == {t[:30]: e for t, e in SHORT_FORMS if e is not None}


def test_ids_do_not_depend_on_how_files_are_split(spark, short, tmp_path):
    names = ["marlow", "lg", "360", "жубэльт", "robomix deepsea"]
    rows = [(f"{names[i % 5]} модель{i}x", SHORT_ID[names[i % 5]]) for i in range(2000)]
    spark.createDataFrame(rows, "text string, want long").repartition(7).write.parquet(str(tmp_path / "t"))
    old = spark.conf.get("spark.sql.files.minPartitionNum", None)
    try:
        for n in ("1", "13"):
            spark.conf.set("spark.sql.files.minPartitionNum", n)
            texts = spark.read.parquet(str(tmp_path / "t"))
            matched = short.match(texts)
            spark.conf.set("spark.sql.files.minPartitionNum", "5")
            got = {r.text: r.entry_id for r in matched.collect()}
            assert got == dict(rows)
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum") if old is None else spark.conf.set("spark.sql.files.minPartitionNum", old)


SHORT_ID = {"marlow": 3, "lg": 1, "360": 2, "жубэльт": 5, "robomix deepsea": 6}
