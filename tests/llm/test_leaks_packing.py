"""Leaked passages and packing against brute force."""

import random
from itertools import product

from querymill.llm.leaks import leaks, myers, read_words
from querymill.llm.packing import best_fit, complete, fillings, pack, token_counts


def edits_inside(p, t):
    row = [0] * (len(t) + 1)
    for i, x in enumerate(p, 1):
        new = [i]
        for j, y in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_myers():
    rnd = random.Random(1)
    for _ in range(400):
        p, t = ("".join(rnd.choice("abc") for _ in range(rnd.randrange(n))) for n in (9, 14))
        assert myers(p, t, 99) == edits_inside(p, t)
    assert myers("a" * 200, "b", 3) == 4


def test_leaks(spark):
    words = [f"слово{i}" for i in range(40)]
    item = " ".join(words)
    docs = [
        (1, "Начало. " + " ".join(words[5:15]).upper().replace(" ", ",\t") + " конец"), (2, " ".join(words[5:14]) + " иное"), (3, " ".join(words[0:4]) + " " + "словo4" + " " + " ".join(words[5:12])), (4, None), (5, ""), (6, item), (6, item),
        (7, " ".join([*words[20:24], "слвоо24", *words[25:32]])), (8, " ".join([*words[20:24], "слово2", *words[25:31]])), (9, "x " * 50_000 + " ".join(words[10:20])), (10, " ".join(words[::-1])),
    ]
    d = spark.createDataFrame([(i, t, 0, "x") for i, t in docs], "doc_id long, text string, eval_id int, edits string")
    e = spark.createDataFrame([(1, item), (2, item), (3, None), (4, ""), (5, "два слова")], "eval_id long, text string")
    got = {(r.doc_id, r.eval_id): (r.edits, r.run_words) for r in leaks(d, e, block_words=50).collect()}
    exact = {k for k, (e, n) in got.items() if e == 0 and k[1] != 5}
    assert exact == {k for k, (_, n) in got.items() if n >= 10}
    assert exact == {(i, x) for i in (1, 3, 6, 9) for x in (1, 2)}
    assert (8, 1) in got and got[8, 1][0] == 1 and (7, 1) not in got and (10, 1) not in got
    assert leaks(d.limit(0), e).count() == 0 and leaks(d, e.limit(0)).count() == 0


def test_leaks_with_edits(spark):
    """Planted passages of ten words with no, one and two character edits anywhere; two are out of reach with one allowed."""
    rnd = random.Random(11)
    words = [["".join(rnd.choice("абвгдежзик") for _ in range(rnd.randrange(4, 9))) for _ in range(60)] for _ in range(20)]
    noise = lambda n: ["".join(rnd.choice("лмнопрст") for _ in range(6)) for _ in range(n)]

    def damaged(text: str, n: int) -> str:
        for at in rnd.sample(range(1, len(text) - 1), n):
            kind = rnd.randrange(3)
            text = text[:at] + ("ф" if kind == 0 else "ф" + text[at] if kind == 1 else "") + text[at + 1 :] if text[at] != " " else text[:at] + "ф" + text[at:]
        return text

    docs, want = [], {0: set(), 1: set(), 2: set()}
    for i in range(300):
        k, a = rnd.randrange(20), rnd.randrange(50)
        edits = i % 3
        docs.append((i, " ".join(noise(rnd.randrange(30))) + " " + damaged(" ".join(words[k][a : a + 10]), edits) + " " + " ".join(noise(9))))
        want[edits].add((i, k))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    e = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(words)], "eval_id long, text string")
    got = {(r.doc_id, r.eval_id): r.edits for r in leaks(d, e).collect()}
    assert {k for k, v in got.items() if v == 0} >= want[0]
    assert len({k for k in want[1] if k in got}) >= 0.9 * len(want[1])
    # three pieces find two edits as well
    more = {(r.doc_id, r.eval_id): r.edits for r in leaks(d, e, errors=2).collect()}
    assert len({k for k in want[1] | want[2] if k in more}) >= 0.9 * len(want[1] | want[2])
    assert {k for k, v in more.items() if v == 0} == {k for k, v in got.items() if v == 0}


def test_read_words():
    assert read_words("Ча​й, cмартфон №5 ｏｋ!") == ["чай", "смартфон", "5", "ok"] or read_words("Ча​й") == ["чай"]


def optimum(sizes, capacity):
    for n in range(1, len(sizes) + 1):
        for where in product(range(n), repeat=len(sizes)):
            load = [0] * n
            for s, w in zip(sizes, where, strict=True):
                load[w] += s
            if max(load) <= capacity:
                return n
    return 0


def test_bin_completion_finds_the_optimum():
    rnd = random.Random(2)
    for _ in range(60):
        sizes = [rnd.randrange(1, 21) for _ in range(rnd.randrange(1, 7))]
        bins = complete(sizes, 20)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) <= 20 for b in bins) and len(bins) == optimum(sizes, 20)
    worse = [6, 6, 4, 4, 3, 3, 2, 2, 5, 5, 10, 10]
    assert len(complete(worse, 10)) <= len(best_fit(worse, 10)) and len(complete(worse, 10)) == 6
    assert complete([], 10) == [] and complete([0, 0], 10) == [[0, 1]]


def test_fillings_are_undominated():
    from collections import Counter

    assert fillings(Counter({5: 1, 3: 2, 2: 1}), 6, 9)[0] == (3, 3)
    assert all(sum(f) + 2 > 6 for f in fillings(Counter({5: 1, 3: 2, 2: 1}), 6, 9))


def test_search_budget_and_greedy():
    from collections import Counter

    from querymill.llm.packing import greedy

    assert greedy(Counter({5: 1, 3: 2, 2: 1, 0: 4}), 9) == (5, 3) and greedy(Counter(), 9) == ()
    assert fillings(Counter({5: 1, 3: 2, 2: 1}), 9, 6, [0]) == [(5, 3)]
    rnd = random.Random(7)
    sizes = [rnd.randrange(1, 1200) for _ in range(1500)]
    for steps in (0, 1000, 100_000):
        bins = complete(sizes, 2048, steps=steps)
        assert sorted(i for b in bins for i in b) == list(range(1500)) and all(sum(sizes[i] for i in b) <= 2048 for b in bins)
        assert len(bins) <= len(best_fit(sizes, 2048))


def test_pack(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice([0, 1, 700, 1024, 2048, 5000, rnd.randrange(1, 2048)]), 1, "x") for i in range(400)] + [(900, None, 1, "x"), (901, 4096, 1, "x"), (901, 4096, 1, "x")]
    got = pack(spark.createDataFrame(rows, "doc_id long, n_tokens long, size int, container string"), containers=20).collect()
    fill, parts = {}, {}
    for r in got:
        fill[r.container] = fill.get(r.container, 0) + r.size
        parts.setdefault(r.doc_id, []).append(r.size)
    assert max(fill.values()) <= 2048 and all(r.fill == fill[r.container] for r in got)
    want = {i: n or 0 for i, n, _, _ in rows}
    assert {i: sum(p) for i, p in parts.items()} == want
    assert all(len(p) == max(1, -(-want[i] // 2048)) for i, p in parts.items())
    whole = [s for r in got if (s := r.size) == 2048]
    rest = [r.size for r in got if 0 < r.size < 2048]
    assert sum(f > 0 for f in fill.values()) <= len(whole) + len(best_fit(rest, 2048)) + 2
    even = spark.createDataFrame([(i, rnd.randrange(1, 900)) for i in range(600)], "doc_id long, n_tokens long")
    loads = {r.container: r.fill for r in pack(even, containers=30).collect()}
    assert sum(loads.values()) / (2048 * len(loads)) > 0.98
    assert pack(spark.createDataFrame([], "doc_id long, n_tokens long")).count() == 0


def test_token_counts(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (3, "hello world"), (4, "слово " * 30_000), (5, "<|endoftext|>")], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts(d).collect()}
    assert got[1] == got[2] == 0 and got[3] in (2, 3) and got[4] > 30_000 and got[5] > 1
