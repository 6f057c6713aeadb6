"""Units: the graph, the parser and the operator."""

from fractions import Fraction

import pytest

from querymill.functions.chars import plain
from querymill.operators.units import BASES, EDGES, SPELLINGS, ConversionGraph, quantities, stated_quantities


def found(text):
    return [(u, float(v)) for u, v in quantities(plain(text).lower())]


def test_shortest_compositions_and_offsets():
    g = ConversionGraph(EDGES, BASES)
    assert g.to_base["TB"] == ("storage", 1024 * 1024, 0)
    assert g.to_base["inch"] == ("length", 25400, 0)
    t = ConversionGraph([("F", "C", "5/9", "-160/9"), ("C", "K", "1", "273.15")], {"temperature": "K"})
    _, f, o = t.to_base["F"]
    assert f * 32 + o == Fraction("273.15")
    back = ConversionGraph([("C", "F", "9/5", "32"), ("C", "K", "1", "273.15")], {"temperature": "K"})
    assert back.to_base["F"] == t.to_base["F"]


def test_inconsistent_cycle_and_lost_unit():
    with pytest.raises(ValueError, match="contradicts"):
        ConversionGraph([("m", "cm", "100", "0"), ("cm", "mm", "10", "0"), ("m", "mm", "1001", "0")], {"length": "mm"})
    with pytest.raises(ValueError, match="reaches no base"):
        ConversionGraph([("a", "b", "2", "0")], {"length": "mm"})


def test_every_spelling_once(spark):
    assert ConversionGraph(EDGES, BASES).table(spark, SPELLINGS).count() == sum(len(w.split()) for w in SPELLINGS.values())
    with pytest.raises(ValueError, match="two units"):
        ConversionGraph(EDGES, BASES).table(spark, {"g": "g", "kg": "g"})


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("чайник 1,7 л 2200вт", [("л", 1.7), ("вт", 2200.0)]),
        ("10 000 мА·ч", [("ма·ч", 10000.0)]),
        ("от 5 до 7 кг", [("кг", 5.0), ("кг", 7.0)]),
        ("60x90×120 см", [("см", 60.0), ("см", 90.0), ("см", 120.0)]),
        ("3/4 дюйма", [("дюйма", 0.75)]),
        ("12/256 гиг", [("гиг", 12.0), ("гиг", 256.0)]),
        ("двадцать пять кг", [("кг", 25.0)]),
        ("полтора метра", [("метра", 1.5)]),
        ("3 тыс ватт", [("ватт", 3000.0)]),
        ("220 в синий", [("в", 220.0)]),
        ("3 в 1", []),
        ("5g и 4k", []),
        ("200 g", [("g", 200.0)]),
        ("kt7084g бренд", []),
        ("usb 3.0 win 11 скидка 15%", []),
        ("15 с подсветкой до 5000 руб", []),
        ("24'' 15.6\"", [("''", 24.0), ("\"", 15.6)]),
        ("５００ вaтт", [("ватт", 500.0)]),
        ("2 квт·ч", []),
        ("1  500\tвт", [("вт", 1500.0)]),
        ("win 11 450 мл", [("мл", 450.0)]),
        ("55 / 200 вт", [("вт", 200.0)]),
        ("3 в 1 500 вт", [("вт", 500.0)]),
        ("5 - 7 kg", [("kg", 5.0), ("kg", 7.0)]),
        ("", []),
    ],
)
def test_quantities(text, want):
    assert found(text) == want


def test_operator_on_odd_rows(spark):
    rows = [("t", 1, "1 кг и 1000 г", 9), ("t", 1, "1 кг и 1000 г", 9), ("t", 2, None, 9), ("t", 3, "", 9), ("t", 6, "9" * 400 + " кг", 9), ("t", 4, "слово " * 20_000 + "2 гб", 9), (None, 5, "0,5 дюйма", 9)]
    df = spark.createDataFrame(rows, "tab string, row_id long, text string, num int")
    got = sorted(map(tuple, stated_quantities(df).collect()), key=str)
    assert got == sorted([("t", 1, "mass", 1000), ("t", 4, "storage", 2048), (None, 5, "length", 12700)], key=str)
    assert stated_quantities(df.limit(0)).count() == 0


def test_number_words_with_odd_letters_are_read(spark):
    texts = ["двa литра", "п​олтора метра", "ｏne kg", "два литра", "слово"]
    got = stated_quantities(spark.createDataFrame([("t", i, x) for i, x in enumerate(texts)], "tab string, row_id long, text string"))
    assert sorted((r.row_id, r.dim, r.base_value) for r in got.collect()) == [(0, "volume", 2000), (1, "length", 1500000), (2, "mass", 1000), (3, "volume", 2000)]
