"""Term counts and copies against brute force."""

import random
import re
from collections import Counter, defaultdict

from querymill.llm.copies import collapse
from querymill.llm.frequency import marked, term_counts

SCHEMA = "id long, sku long, q string, n string, term string, words string, count long"


def words(t):
    return re.findall(r"[^\W_]+", t.lower())


def some(n=400):
    rnd = random.Random(4)
    parts = ["Чай", "чай", "B-2", "2 b", "ё", "É", "x_y", "горячий"]
    hot = [(i, 1, rnd.choice(["Чай B-2", "b 2, чай!", "чай  2 b"]), None, "z", None, 1) for i in range(n // 3)]
    rest = [(1000 + i, rnd.choice([1, 2, None]), rnd.choice([None, "", " ".join(rnd.choices(parts, k=rnd.randrange(5)))]), rnd.choice([None, "", "имя имя №5"]), "z", None, 1) for i in range(n)]
    return hot + rest


def test_term_counts(spark):
    rows = some()
    got = term_counts(spark.createDataFrame(rows, SCHEMA).repartition(5), ["q", "n"]).collect()
    for k, f in ((2, "q"), (3, "n")):
        n, held = Counter(), Counter()
        for r in rows:
            w = words(r[k] or "")
            n.update(w)
            held.update(set(w))
        assert {r.term: (r.n, r.n_records) for r in got if r.field == f} == {t: (n[t], held[t]) for t in n}
    order = sorted(got, key=lambda r: r.term_id)
    assert [r.term_id for r in order] == list(range(len(got)))
    assert [(r.field, r.term) for r in order] == sorted(((r.field, r.term) for r in got), key=lambda x: (x[0].encode(), x[1].encode()))


def test_marks_and_nothing(spark):
    c = spark.createDataFrame([("q", 0, "a", 2, 2), ("q", 1, "b", 3, 2), ("q", 2, "c", 3, 1)], "field string, term_id long, term string, n long, n_records long")
    assert {r.term: r.mark for r in marked(c, 100).collect()} == {"a": "rare", "b": "common", "c": None}
    assert term_counts(spark.createDataFrame([], SCHEMA), ["q"]).count() == 0
    long = spark.createDataFrame([(1, 1, "слово " * 30_000, None, None, None, None)], SCHEMA)
    assert [(r.n, r.n_records) for r in term_counts(long, ["q"]).collect()] == [(30_000, 1)]


def test_copies_with_and_without_hot_keys(spark):
    rows = some()
    want = defaultdict(set)
    for r in rows:
        if r[1] is not None:
            want[r[1], tuple(sorted(words(r[2] or "")))].add(r[0])
    df = spark.createDataFrame(rows + rows[:5], SCHEMA)
    for hot in (3, 20, 10_000):
        records, copies = collapse(df, "id", "q", ["sku"], hot_rows=hot, salts=4)
        assert sorted(map(tuple, records.collect())) == sorted((min(g), len(g)) for g in want.values())
        assert sorted(map(tuple, copies.collect())) == sorted((min(g), i) for g in want.values() for i in g if i != min(g))


def test_copies_of_nothing_and_nulls(spark):
    r, c = collapse(spark.createDataFrame([], SCHEMA), "id", "q", ["sku"])
    assert (r.count(), c.count()) == (0, 0)
    df = spark.createDataFrame([(None, 1, "a", None, None, None, None), (5, None, "a", None, None, None, None), (6, 1, None, None, None, None, None), (7, 1, "!", None, None, None, None)], SCHEMA)
    r, c = collapse(df, "id", "q", ["sku"])
    assert [tuple(x) for x in c.collect()] == [(6, 7)] and [tuple(x) for x in r.collect()] == [(6, 2)]
