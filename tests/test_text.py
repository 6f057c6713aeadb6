"""String and tag functions on literal rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from querymill.functions import bio as B
from querymill.functions import text as T
from querymill.functions.attributes import attribute_type, canonical_subtype
from querymill.functions.chars import fold, plain
from querymill.functions.udf import common_subsequence, indel_ratio, similarity, weighted, weighted_edit


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("r")).first().r


@pytest.mark.parametrize(
    ("f", "text", "want"),
    [
        (T.parted_units, "128гб", "128 гб"),
        (T.norm_key, " Наушники Logitech G-Pro_X ", "наушники logitech g pro x"),
        (T.basic_clean, "55×60", "55x60"),
        (T.one_script, "аsus", "asus"),
        (T.one_script, "cамсунг", "самсунг"),
        (T.one_script, "asus", "asus"),
        (T.word_shape, "iPhone15", "xXxd"),
        (T.other_layout, "gtcjuhbhn", "песогрирт"),
        (T.latin_view, "сасе", "cace"),
        (T.norm_key, None, None),
        (T.norm_key, "", ""),
        (canonical_subtype, "heigh", "size"),
        (canonical_subtype, "plug", "plug"),
        (canonical_subtype, None, "other"),
        (attribute_type, "16 г", "memory_storage"),
        (attribute_type, "1920x1080", "resolution_exact"),
        (attribute_type, "4k", "resolution_standard"),
        (attribute_type, "2 кг", "weight"),
        (attribute_type, "5 g", "other"),
        (attribute_type, "белая", "color"),
        (attribute_type, None, "other"),
    ],
)
def test_literals(spark, f, text, want):
    assert one(spark, text, f) == want


def test_token_spans_cut_the_text(spark):
    text = "g-pro x/se 16гб, «чай» 😀 1.5"
    got = one(spark, text, T.token_spans)
    assert [text[r.start : r.end] for r in got] == [r.token for r in got]
    assert [(r.token, r.start, r.end) for r in one(spark, "g-pro x/se 16 гб", T.token_spans)] == [("g-pro", 0, 5), ("x/se", 6, 10), ("16", 11, 13), ("гб", 14, 16)]


def test_masks(spark):
    df = spark.createDataFrame([("abc def ghi", [(0, 3), (8, 11)])], "t string, s array<struct<start:int,end:int>>")
    assert df.select(T.masked(F.col("t"), F.col("s"), "<x>")).first()[0] == "<x> def <x>"
    assert df.select(T.masked(F.col("t"), F.array().cast("array<struct<start:int,end:int>>"), "<x>")).first()[0] == "abc def ghi"


@pytest.mark.parametrize(
    ("tags", "orphans", "want"),
    [
        (["I-ATTR", "B-BRAND", "I-BRAND", "I-ATTR"], False, [("BRAND", 1, 3)]),
        (["I-A", "B-A", "I-A", "I-A"], True, [("A", 0, 1), ("A", 1, 4)]),
        ([], False, []),
        (["O"], False, []),
        (["B-A", "B-A"], False, [("A", 0, 1), ("A", 1, 2)]),
    ],
)
def test_spans(spark, tags, orphans, want):
    got = spark.createDataFrame([(tags,)], "t array<string>").select(B.spans(F.col("t"), orphans)).first()[0]
    assert [(r.label, r.start, r.end) for r in got] == want


def test_token_accuracy_and_merge(spark):
    df = spark.createDataFrame([(["B", "I", "O"], ["B", "O"])], "a array<string>, b array<string>")
    assert df.select(B.token_accuracy(F.col("a"), F.col("b"))).first()[0] == 0.5
    s = spark.createDataFrame([([("A", 0, 2)], [("B", 1, 3), ("C", 5, 6), ("D", 5, 7)])], f"a {B.SPAN}, b {B.SPAN}")
    assert [(r.label) for r in s.select(B.merged(F.col("a"), F.col("b"))).first()[0]] == ["A", "C"]


def test_edit_measures(spark):
    assert weighted("гь", "гб") == 0.5 and weighted("abc", "abc") == 0 and weighted("", "abc") == 3
    rnd = random.Random(3)
    for _ in range(200):
        a, b = ("".join(rnd.choice("abвгь") for _ in range(rnd.randrange(8))) for _ in range(2))
        d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (x != y))
        assert d[-1][-1] / 2 <= weighted(a, b) <= d[-1][-1]
        assert common_subsequence(a, b) <= min(len(a), len(b))
    r = spark.createDataFrame([("гь", "гб"), (None, "x"), ("", "")], "a string, b string").select(weighted_edit("a", "b"), similarity("a", "b"), indel_ratio("a", "b")).collect()
    assert list(r[0]) == [0.5, 0.75, 50.0] and list(r[1]) == [None] * 3 and list(r[2]) == [0.0, 0.0, 100.0]


def test_plain_is_idempotent_and_keeps_plain_text():
    for t in ("чaйник", "ｆｕｌｌ　ｗｉｄｔｈ", "пылесо​с", "café", "Tecһ", "нοутбук", "a‑b", "день\tи  ночь ", "", "é", "x̆"):
        assert plain(plain(t)) == plain(t)
        assert not re.search("[\u200b\u00a0\ufeff\u03bf]", plain(t))
    assert plain("Обычный text 12, ё!") == "Обычный text 12, ё!"
    assert (plain("cмартфон"), plain("пыле­сос"), plain("ㅤ"), plain(None)) == ("смартфон", "пылесос", "", "")
    assert fold("Pésogrirt Ёй") == "pesogrirt ей"


def test_near_brands_against_brute_force(spark, sf):
    import re

    from querymill.plans.text import near_brands
    from querymill.sources.tables import table

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    words = sorted({w.lower() for r in table(spark, sf, "brands").collect() for w in re.findall("[a-zA-Z]{5,}", r.brand or "")})
    want = {(a, b, d) for a in words for b in words if a < b and abs(len(a) - len(b)) <= 2 and (d := edits(a, b)) <= 5}
    assert any(a[:2] != b[:2] for a, b, _ in want) and {tuple(r) for r in near_brands(spark, sf).collect()} == want
