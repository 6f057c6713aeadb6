"""Prediction by partial matching, segments and cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from querymill.llm import languages as L
from tests.conftest import SF


def slow_bits(samples, data, order):
    """Bits of every byte under one language, straight from counts."""
    text = b" " * L.ORDER + b"  ".join(samples) + b" "
    counts = {}
    for i in range(L.ORDER, len(text)):
        for k in range(order + 1):
            c = counts.setdefault(text[i - k : i], {})
            c[text[i]] = c.get(text[i], 0) + 1
    out = []
    for i in range(L.ORDER, len(data)):
        bits = 0.0
        for k in range(order, -1, -1):
            c = counts.get(data[i - k : i])
            if c is None:
                continue
            n, d = sum(c.values()), len(c)
            if data[i] in c:
                bits += np.log2((n + d) / c[data[i]])
                break
            bits += np.log2((n + d) / d)
        else:
            bits += 8.0
        out.append(bits)
    return out


def test_code_lengths_are_exact():
    a, b = [b"banana bandana", b"nab a can"], [b"xylophone phone", "чай и чайник".encode()]
    trees = L.ContextTrees([a, b])
    data = b" " * L.ORDER + "banana phone чай zzz 123".encode()
    got = trees.code_lengths(np.frombuffer(data, np.uint8))
    for i, s in enumerate((a, b)):
        assert np.allclose(got[:, i], slow_bits(s, data, L.ORDER), atol=1e-3)


def test_assign_is_optimal():
    rnd = np.random.default_rng(3)
    for _ in range(50):
        costs, ends = rnd.random((6, 2)).astype(np.float32) * 60, rnd.random(6) < 0.4
        got = L.assign(costs, ends)

        def value(p, costs=costs, ends=ends):
            return sum(costs[t, p[t]] for t in range(6)) + sum((L.SWITCH_END if ends[t] else L.SWITCH_INSIDE) for t in range(5) if p[t] != p[t + 1])

        best = min(value([i >> t & 1 for t in range(6)]) for i in range(64))
        assert value(got) == pytest.approx(best, abs=1e-3)


@pytest.fixture(scope="module")
def trees(spark):
    return L.train(spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet"))


TEXTS = {
    1: "Этот чайник быстро нагревается и не мешает спать. Крышка закрывается туго.",
    2: "This kettle heats up quickly and does not wake the kids. The lid closes too tightly.",
    3: "Цей чайник швидко нагрівається, тому повертати не стали. Кришка зачиняється туго.",
    4: "Бұл шәйнек тез қызады әрі күтімі оңай. Жеткізу кешікті.",
    5: "Этот чайник быстро нагревается. Крышка закрывается туго. The lid closes too tightly. This kettle is worth the money. Но возвращать не стали.",
    6: "Этот ноутбук MORETRUND Line XK123 стоит своих денег, поэтому возвращать не стали.",
    7: None, 8: "", 9: " \n ", 10: "12 345 6",
}


def test_segments_and_cases(spark, trees):
    df = spark.createDataFrame([(i, t, "ru", "x") for i, t in TEXTS.items()], "doc_id long, text string, lang string, confidence string")
    parts = L.segments(df, trees).collect()
    by = {}
    for r in sorted(parts, key=lambda r: (r.doc_id, r.start_word)):
        by.setdefault(r.doc_id, []).append(r)
    assert {i: [r.lang for r in by[i]] for i in (1, 2, 3, 4, 5, 6)} == {1: ["ru"], 2: ["en"], 3: ["uk"], 4: ["kk"], 5: ["ru", "en", "ru"], 6: ["ru"]}
    assert not {7, 8, 9} & set(by) and len(by[10]) == 1
    assert all(0 <= r.confidence <= 1 for r in parts)
    assert all(sum(r.n_words for r in by[i]) == len(TEXTS[i].split()) for i in by)
    langs = L.document_languages(L.segments(df, trees)).join(df.select("doc_id", F.col("lang").alias("label")), "doc_id")
    cases = {r.doc_id: r.case for r in L.mislabelled(langs, F.col("label")).collect()}
    assert [cases[i] for i in (1, 2, 3, 5, 6)] == [False, True, True, True, False]


def test_labels(spark):
    rows = [(1, "ru", None), (2, "ru", ""), (3, "ru", "UND"), (4, "ru", "RU-ru"), (5, "de", "ger"), (6, "en", "english")]
    df = spark.createDataFrame([(i, x, 3, 10, 1.0, 1.0, True, y) for i, x, y in rows], "doc_id long, lang string, n_sentences long, n_chars long, share double, confidence double, main boolean, label string")
    assert {r.doc_id: r.case for r in L.mislabelled(df, F.col("label")).collect()} == {1: True, 2: True, 3: True, 4: False, 5: True, 6: False}


def test_held_out_accuracy(spark, trees):
    """Labels are mostly right, so agreement on labelled one-language documents must be high."""
    d = spark.read.parquet(f"{SF}/documents.parquet").where(F.length("lang") == 2)
    m = L.document_languages(L.segments(d, trees)).where("main").join(d.select("doc_id", F.lower("lang").alias("label")), "doc_id").where(F.col("label").isin(L.LANGUAGES))
    assert m.agg(F.avg((F.col("lang") == F.col("label")).cast("int"))).first()[0] > 0.85


def test_long_text_and_nothing(spark, trees):
    df = spark.createDataFrame([(1, TEXTS[1] * 3000)], "doc_id long, text string")
    assert [(r.lang, r.n_words) for r in L.segments(df, trees).collect()] == [("ru", len((TEXTS[1] * 3000).split()))]
    assert L.segments(df.limit(0), trees).count() == 0
    with pytest.raises(ValueError, match="no labelled text"):
        L.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
