"""Plain forms: the distributed operator against the database and the scalar form."""

import random
import unicodedata

from pyspark.sql import functions as F

from querymill.functions.chars import plain
from querymill.llm.lookalikes import plain_forms, plain_rows

SCHEMA = "tab string, row_id long, text string, clean string, id long"


def forms(spark, texts):
    return {r.text: r.clean for r in plain_forms(spark.createDataFrame([("t", i, t, "x", 7) for i, t in enumerate(texts)], SCHEMA)).collect()}


def test_kinds(spark):
    want = {
        "cмартфон": "смартфон", "ｆｕｌｌ　ｗｉｄｔｈ ５": "full width 5", "чай​ник": "чайник", "café": "café", "чайник": "чайник",
        "Tecһ": "Tech", "a‑b": "a-b", "a  b\t": "a  b\t", "нοутбук": "ноутбук", "​": "", "한": "한", "ﬁ½": "fi1⁄2",
    }
    assert forms(spark, [*want, "обычный", "plain", "", None]) == want


def test_marks_are_ordered_and_recomposed_like_the_database(spark):
    rnd = random.Random(5)
    marks = [chr(c) for c in range(0x300, 0x34F)]
    texts = ["".join(rnd.choice(["a", "o", "e", "s", "Z", "и", "ü", "ặ", "가", "ᄀ", "ᅡ", "ᆨ", "1"]) + "".join(rnd.choice(marks) for _ in range(rnd.randrange(4))) for _ in range(5)) for _ in range(300)]
    got = forms(spark, texts)
    for t in texts:
        want = unicodedata.normalize("NFKC", t)
        # letters of two alphabets in one word are a matter of their own
        if plain(t) == want:
            assert got.get(t, t) == want
        assert got.get(t, t) == plain(t)


def test_equals_the_scalar_form(spark):
    rnd = random.Random(6)
    letters = "aбcdеёfgнаоxyАВCкМοіѕａｂé -​ 1́"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 14))) for _ in range(500)]
    got = forms(spark, texts)
    assert {t: plain(t) for t in texts if plain(t) != t} == got


def test_rows_repeats_long_and_empty(spark):
    long = "слово " * 20_000 + "cмартфон"
    rows = [("t", 1, "cм", None, 1), ("t", 1, "cм", None, 1), ("t", 2, None, None, 1), ("t", 3, "", None, 1), (None, None, long, None, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r.tab, r.row_id, len(r.clean)) for r in plain_rows(df).collect()), key=str)
    assert got == sorted([("t", 1, 2), ("t", 1, 2), (None, None, len(long))], key=str)
    assert plain_rows(df.where(F.lit(False))).count() == 0
