"""Spelling, labels, facts, metrics, markov, learned parts on small rows."""

import collections
import functools
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from querymill.functions.attributes import COLORS
from querymill.functions.udf import weighted
from querymill.operators import cascade, clicks, facts, labeler, markov, metrics, mining, ml, quality, silver, spell, stats
from querymill.plans import analysis
from querymill.plans import cascade as plan


def test_vote(spark):
    rows = [("q", "A", 0), ("q", "B", 1), ("q", "B", 3), ("q", "C", None)][:3]
    r = clicks.brand_vote(spark.createDataFrame([("q", "q", b, p) for _, b, p in rows], "query_norm string, query_raw string, brand string, pos int")).first()
    assert (r.click_brand, r.confidence, r.n_clicks, r.n_brands, r.runner_up, r.weight_margin) == ("A", 0.571429, 3, 2, "B", 0.142857)


@pytest.mark.parametrize(("p", "m", "top", "want"), [(0.5, 0.05, "X", "NO_BRAND"), (0.5, 0.2, "X", "X"), (0.25, 0.2, "UNKNOWN", "NO_BRAND"), (0.1, 0.0, "NO_BRAND", "NO_BRAND")])
def test_reject(spark, p, m, top, want):
    assert spark.createDataFrame([(top, p, m)], "t string, p double, m double").select(metrics.reject(F.col("t"), F.col("p"), F.col("m"))).first()[0] == want


def test_split_sizes(spark):
    rows = [(c, i) for c, n in (("a", 1), ("b", 2), ("c", 12), ("d", 13)) for i in range(n)]
    s = stats.stratified_split(spark.createDataFrame(rows, "c string, i int"), "c", ["i"], 0.2)
    assert {r.c: r.n for r in s.groupBy("c").agg(F.count_if(F.col("part") == "val").alias("n")).collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_markov_predictors(spark):
    t = spark.createDataFrame([("bigram", "a|b", "x", 1), ("bigram", "b|c", "y", 3), ("unit", "z", "u", 2)], "tab string, key string, type string, n long")
    s = spark.createDataFrame([("1", ["a", "b", "c"]), ("2", ["5", "z"]), ("3", ["q"]), ("4", [])], "id string, t array<string>")
    votes = {r.id: (r.type, r.prob) for r in markov.predict_votes(s, t).collect()}
    assert votes == {"1": ("y", 0.75), "2": ("u", 0.0), "3": ("unknown", 0.0), "4": ("unknown", 0.0)}
    assert {r.id: r.type for r in markov.predict_first(s, t).collect()} == {"1": "x", "2": "u", "3": None, "4": None}


def test_prf(spark):
    s = "row_id int, label string, start int, end int"
    gold = spark.createDataFrame([(1, "BRAND", 0, 1), (1, "ATTR", 1, 2)], s)
    pred = spark.createDataFrame([(1, "BRAND", 0, 1), (1, "ATTR", 1, 3)], s)
    got = {r.label: r.f1 for r in metrics.prf(metrics.span_counts(gold, pred, ["start", "end"])).collect()}
    assert got == {"BRAND": 1.0, "ATTR": 0.0, "MICRO": 0.5, "MACRO": 0.5}


def test_spell(spark):
    vocabulary = spark.createDataFrame([(w,) for w in ("телефон", "электроинструменты", "samsung")], "w string")
    aliases = spark.createDataFrame([("Sony", "сони")], "canon string, alias string")
    q = spark.createDataFrame([(1, "телфон 16гь сони"), (2, "16 гь"), (3, None), (4, ""), (5, "cамсунг"), (6, "123")], "id int, query string")
    got = {r.id: r.fixed for r in spell.fix_queries(q, vocabulary, aliases).collect()}
    assert got == {1: "телефон 16 гб sony", 2: "16 гб", 4: "", 5: "самсунг", 6: "123"}


def test_fuzzy_stage_misses_no_pair(spark):
    words = ["электроинструмент", "электриинстркменты", "эдектрлинструмннты", "телефрн", "телевон", "samsubg", "sansunh", "нога"]
    known = ["электроинструменты", "телефон", "samsung", "нога"]
    got = {r.t: r.to for r in spell.best_candidates(spark.createDataFrame([(w,) for w in words], "t string"), spark.createDataFrame([(w,) for w in known], "w string")).collect()}
    want = {}
    for t in words:
        best = sorted((-(1 - weighted(t, w) / max(len(t), len(w))), w) for w in known if abs(len(t) - len(w)) <= 2 and weighted(t, w) <= max(1.0, len(t) * 0.34))
        if best and -best[0][0] >= 0.8:
            want[t] = best[0][1]
    assert got == want


def test_labels_and_facts(spark):
    df = lambda *x: spark.createDataFrame([(v,) for v in x], "name string")
    phrases = labeler.dictionary({"brand": df("APPLE", "Apple", "Красный Октябрь"), "category": df("чайник", "apple"), "model": df("air 2", "15")})
    assert {(r.kind, r.canonical) for r in phrases.where("kind <> 'genre'").collect()} == {("brand", "Apple"), ("brand", "Красный Октябрь"), ("category", "чайник"), ("model", "air 2")}
    q = spark.createDataFrame([(1, "Чайник apple air 2 белый 2 кг для дачи"), (2, None), (3, "красный октябрь")], "id int, query string")
    rows = labeler.label(q, phrases)
    assert {r.id: r.tags for r in rows.collect()} == {1: ["B-CATEGORY", "B-BRAND", "B-MODEL", "I-MODEL", "B-ATTR", "B-ATTR", "I-ATTR", "O", "B-ATTR"], 3: ["B-BRAND", "I-BRAND"]}
    f = {r.id: r for r in labeler.structured(labeler.entities(rows), phrases).collect()}
    assert (f[1].brand, f[1].category, f[1].model) == ("Apple", "чайник", "air 2")
    assert f[1].attributes["weight"] == ["2 кг"] and f[3].brand == "Красный Октябрь"


def test_extract_and_rank(spark):
    d = facts.phrases(spark.createDataFrame([("Brand#2",)], "n string"), "brand", "n").unionByName(facts.phrases(spark.createDataFrame([("ring",)], "n string"), "category", "n"))
    q = spark.createDataFrame([(1, "brand#2 ring"), (2, ""), (3, None)], "id long, query string")
    f = facts.extract(q, d)
    assert [(r.id, r.brand, r.category) for r in f.collect()] == [(1, "Brand#2", "ring")]
    items = spark.createDataFrame([(7, "small ring", "Brand#2", 1.0), (8, "blue bolt", "Brand#4", 1.0), (9, None, None, None)], "sku_id long, name string, brand string, price double")
    r = facts.rank(f, items).collect()
    assert [(x.sku_id, x.score, x.why, x.match) for x in r] == [(7, 6.46066, "brand+category", 1.0)]
    assert facts.rank(f, items.limit(0)).count() == 0


@pytest.mark.parametrize(("w", "top", "least"), [(facts.NATIVE, 30, 0.15), (facts.SIMPLE, 12, 0.05)])
def test_rank_in_blocks_is_exact(spark, monkeypatch, w, top, least):
    rnd = np.random.default_rng(3)
    pick = lambda n, words: " ".join(rnd.choice(words, n))
    words = ["ring", "bolt", "x1", "x2", "red", "blue", "acme", "pro"]
    items = [(i, pick(int(rnd.integers(1, 7)), words), ["acme", "acme pro", "zed"][i % 3]) for i in range(150)]
    asked = [(i, ["acme", "acme pro", None][i % 3], pick(i % 2 + 1, words[:2]) if i % 4 else None, "x1" if i % 5 == 0 else None, ["red"] if i % 2 else ["blue", "red"]) for i in range(30)]
    f = spark.createDataFrame(asked, "id int, brand_text string, category string, model string, colors array<string>")
    monkeypatch.setattr(facts, "FACTS", 7)
    monkeypatch.setattr(facts, "KINDS", 40)
    want = set()
    for i, brand, category, model, colors in asked:
        own = [*(category or "").split(), *(model or "").split(), *colors]
        scores = []
        for sku, name, b in items:
            t, held = name.split(), lambda p, name=name: p is not None and f" {p} " in f" {name} "
            common = sum(x in t for x in own) if len(own) > len(set(own)) else len({*own} & {*t})
            s = (w["brand"] if brand and (b == brand or held(brand)) else w["other"] if brand else 0.0) + w["category"] * (bool({*(category or "").split()} & {*t}) if w["any_token"] else held(category)) + w["model"] * held(model)
            s = round(s + w["attribute"] * sum(map(held, colors)) + w["cosine"] * (common / (len(own) ** 0.5 * len(t) ** 0.5)), 6)
            if s > least:
                scores.append((-s, sku))
        want |= {(i, sku, -s, n) for n, (s, sku) in enumerate(sorted(scores)[:top], 1)}
    catalog = spark.createDataFrame(items, "sku_id int, name string, brand string")
    assert {(r.id, r.sku_id, r.score, r.rn) for r in facts.rank(f, catalog, top, least, w).collect()} == want


def test_ranking_shuffles_neither_tokens_nor_ngrams(spark):
    n = 3000
    d = facts.phrases(spark.createDataFrame([("acme",)], "n string"), "brand", "n").unionByName(facts.phrases(spark.createDataFrame([("ring",)], "n string"), "category", "n"))
    q = spark.range(n).select("id", F.format_string("acme ring a%d b%d c%d d%d e%d f%d", *["id"] * 6).alias("query"))
    items = spark.range(n).select(F.col("id").alias("sku_id"), F.format_string("ring g%d h%d i%d j%d k%d l%d", *["id"] * 6).alias("name"), F.lit("Acme").alias("brand"))

    def written(group, run):
        sc = spark.sparkContext
        sc.setJobGroup(group, group)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            out = run()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
            sc.setLocalProperty("spark.jobGroup.id", None)
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        store, tracker = sc._jsc.sc().statusStore(), sc.statusTracker()
        stages = {i for j in tracker.getJobIdsForGroup(group) for i in tracker.getJobInfo(j).stageIds}
        return out, sum(store.lastStageAttempt(i).shuffleWriteRecords() for i in stages)

    got, rows = written("ngrams", lambda: facts.extract(q, d).collect())
    assert len(got) == n and {(r.brand, r.category) for r in got} == {("acme", "ring")} and 0 < rows < 12 * n
    one = spark.createDataFrame([(1, "acme", "ring", None, [])], "id int, brand_text string, category string, model string, colors array<string>")
    got, rows = written("tokens", lambda: facts.rank(one, items, top=5).collect())
    assert [r.sku_id for r in sorted(got, key=lambda r: r.rn)] == [0, 1, 2, 3, 4] and 0 < rows < 2 * n
    assert facts.rank(one.limit(0), items).count() == 0 and facts.extract(q.limit(1), d.limit(0)).first().brand is None


def test_blocks_are_bounded_and_few():
    assert facts._blocks(0, 0, 12) == (1, 1) and facts._blocks(500, 300, 12) == (1, 1)
    assert facts._blocks(27_000, 369_000, 12) == (4, 3)
    assert facts._blocks(360_000, 900_000, 12) == (11, 7)


def test_fills(spark):
    q = spark.createDataFrame([(1, "чайник samsng b7"), (2, "xxsamsungyy"), (3, None), (4, "")], "id int, query string")
    n = spark.createDataFrame([("Samsung",), ("Sam",)], "name string")
    assert [(r.id, r.name) for r in cascade.fuzzy_fill(q, n).collect()] == [(1, "Samsung")]
    assert [(r.id, r.name) for r in cascade.substring_fill(q, n).collect()] == [(2, "Samsung")]


def test_corruption_keeps_words(spark):
    q = spark.createDataFrame([(i, "телефон samsung 16 гб белый") for i in range(50)] + [(99, None)], "id int, query string")
    rows = cascade.corrupted(q).collect()
    assert len(rows) == 50 and all(len(r.query.split(" ")) == 5 for r in rows) and any(r.n_changed for r in rows)
    assert sorted(rows) == sorted(cascade.corrupted(q.repartition(3)).collect())


def test_viterbi_and_tagger(spark):
    rnd = np.random.default_rng(1)
    scores, moves = rnd.normal(size=(5, 3)), rnd.normal(size=(3, 3))
    paths = [[int(c) for c in np.base_repr(i, 3).zfill(5)] for i in range(3**5)]
    value = lambda p: sum(scores[i][p[i]] for i in range(5)) + sum(moves[p[i], p[i + 1]] for i in range(4))
    assert ml.viterbi(scores, moves) == max(paths, key=value)
    rows = [(i, ["чайник", "asus", "белый"] if i % 2 else ["asus", "pro", "чайник"], ["B-C", "B-B", "O"] if i % 2 else ["B-B", "I-B", "B-C"]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, tokens array<string>, tags array<string>")
    got = {r.id: r.pred for r in ml.Tagger(features=256).fit(df).predict(df.select("id", "tokens")).collect()}
    assert all(got[i] == t for i, _, t in rows)


def test_tagger_reads_its_sentences_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def told(x):
        seen.add(1)
        return x

    df = spark.createDataFrame([(i, ["asus", "pro"], ["B-B", "O"]) for i in range(40)], "id long, tokens array<string>, tags array<string>")
    model = ml.Tagger(features=64, rows=30).fit(df.coalesce(1).withColumn("id", F.udf(told, "long")("id")))
    assert model.tags == ["B-B", "O"] and seen.value == 40


def test_classifier_counts_repeats_and_leaves_undrawn_classes(spark):
    rows = [("aa", "x", 1.0)] * 6 + [("bb", "y", 1.0), ("cc", "y", 1.0), ("dd", "z", 1.0), ("ee", "w", 1.0)]
    df = spark.createDataFrame(rows, "text string, label string, weight double")
    assert ml.BrandClassifier(features=64, rows=5).fit(df).labels == ["w", "x", "y", "z"]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        few = ml.BrandClassifier(features=64, rows=2).fit(df)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    first = sorted({(t, c) for t, c, _ in rows}, key=lambda r: hashlib.md5(r[0].encode()).hexdigest())[:2]
    assert few.labels == sorted({c for _, c in first})
    assert {r.text: r.top for r in few.predict(df).collect() if (r.text, r.label) in first} == dict(first)


def test_attribute_report_with_undrawn_classes(spark, monkeypatch, tmp_path):
    spans = ["16 гб", "белый", "2 кг", "1920x1080", "4k", "сталь"]
    rows = [(i, f"чайник {t}", [(t, "ATTR", [7, 7 + len(t)]), ("чайник", "CATEGORY", [0, 6])]) for i in range(240) for t in [spans[i % 6]]]
    spark.createDataFrame(rows, "item_id long, query string, entities array<struct<text:string,label:string,span:array<int>>>").write.parquet(f"{tmp_path}/benchmark.parquet")
    monkeypatch.setattr(ml, "BrandClassifier", functools.partial(ml.BrandClassifier, features=64, rows=2))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.label: r.support for r in analysis.attribute_classifier_report(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    held = collections.Counter(i % 6 for i in range(240) if hashlib.md5(f"{i}|7".encode()).hexdigest() < "4")
    types = ["memory_storage", "color", "weight", "resolution_exact", "resolution_standard", "other"]
    assert {k: n for k, n in got.items() if n} == {types[i]: n for i, n in held.items()}


def many_spans(spark, folder):
    """A benchmark of 70,000 different spans and 4,000 times one of another type, whose digest is behind most of theirs; gives the times it is held out."""
    color = max(COLORS, key=lambda c: hashlib.md5(c.encode()).hexdigest())
    q = spark.range(39_000).select(F.col("id").alias("item_id"), F.when(F.col("id") < 35_000, F.concat("id", F.lit(" гб"))).otherwise(color).alias("s"))
    e = F.array(F.struct(F.col("s").alias("text"), F.lit("ATTR").alias("label"), F.array(F.lit(7), F.length("s") + 7).alias("span")))
    q.select("item_id", F.concat(F.lit("чайник "), "s").alias("query"), e.alias("entities")).write.parquet(f"{folder}/benchmark.parquet")
    return sum(hashlib.md5(f"{i}|7".encode()).hexdigest() < "4" for i in range(35_000, 39_000))


def test_attribute_classifier_is_fitted_on_all_spans(spark, monkeypatch, tmp_path):
    held = many_spans(spark, tmp_path)
    monkeypatch.setattr(ml, "BrandClassifier", functools.partial(ml.BrandClassifier, features=256))
    got = analysis.attribute_classifier(spark, str(tmp_path)).groupBy("label", "top").count().collect()
    assert {(r.label, r.top): r["count"] for r in got if "color" in (r.label, r.top)} == {("color", "color"): held}


def test_attribute_report_counts_types_of_a_model_of_all_spans(spark, monkeypatch, tmp_path):
    held = many_spans(spark, tmp_path)
    monkeypatch.setattr(ml, "BrandClassifier", functools.partial(ml.BrandClassifier, features=256))
    got = {r.label: r for r in analysis.attribute_classifier_report(spark, str(tmp_path)).collect()}
    assert (got["color"].support, got["color"].predicted, got["color"].tp, got["color"].f1) == (held, held, held, 1.0)


def test_tagger_is_fitted_on_all_sentences(spark):
    last = max(range(24_000), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    rare = F.col("id") == last
    df = spark.range(24_000).select("id", F.when(rare, F.array(F.lit("x1"), F.lit("x2"))).otherwise(F.array(F.lit("asus"), F.lit("pro"), F.lit("y"))).alias("tokens"), F.when(rare, F.array(F.lit("B-M"), F.lit("I-M"))).otherwise(F.array(F.lit("B-B"), F.lit("I-B"), F.lit("O"))).alias("tags"))
    model = ml.Tagger(features=64).fit(df)
    assert model.tags == ["B-B", "B-M", "I-B", "I-M", "O"]
    counts = np.ones((5, 5))
    counts[0, 2] += 23_999
    counts[2, 4] += 23_999
    counts[1, 3] += 1
    assert np.allclose(np.where(model.moves > -1e9, model.moves, 0), np.where(model.moves > -1e9, np.log(counts / counts.sum(1, keepdims=True)), 0))


def test_cascade_brands_are_fitted_on_all_labelled_rows(spark, monkeypatch):
    names = ["Acme"] * 300 + ["Rare"] * 19 + ["NO_BRAND"] * 500 + ["UNKNOWN"] * 400 + [None] * 5
    rows = [(f"query {i}", b, 0.5) for i, b in enumerate(names)] + [("q", "Acme", 0.5), ("q" * 121, "Acme", 0.5)]
    df = spark.createDataFrame(rows, "query_norm string, brand string, confidence double").selectExpr("*", "1 AS n_clicks", "true AS brand_in_query", "CAST(NULL AS string) AS alias_canon")
    monkeypatch.setattr(plan, "_evidence", lambda *_: df)
    monkeypatch.setattr(silver, "assigned", lambda x: x)
    asked = []

    class Seen:
        def fit(self, train):
            asked.extend(train.collect())

    monkeypatch.setattr(ml, "BrandClassifier", Seen)
    plan._classifier(spark, "")
    # training_set leaves 200 of NO_BRAND and 150 of UNKNOWN, the least it may cut to, and no class of 19 rows
    weights = {"Acme": (300, 0.5 * 300), "NO_BRAND": (500, 200.0), "UNKNOWN": (400, 0.9 * 150)}
    assert {b: (sum(r.label == b for r in asked), pytest.approx(sum(r.weight for r in asked if r.label == b))) for b in {r.label for r in asked}} == weights
    assert {r.text for r in asked} == {q for q, b, _ in rows if b in weights and 2 <= len(q) <= 120}


def test_serving_set_weighs_as_training_set_cuts(spark):
    rows = [(f"query {i}", b, 0.5, 1, True, None) for i, b in enumerate(["Acme"] * 2000 + ["NO_BRAND"] * 900 + ["UNKNOWN"] * 700)]
    df = spark.createDataFrame(rows, "query_norm string, brand string, confidence double, n_clicks int, brand_in_query boolean, alias_canon string")
    got, cut = ({r.brand: r.w for r in f(df).groupBy("brand").agg(F.sum("sample_weight").alias("w")).collect()} for f in (silver.serving_set, silver.training_set))
    assert got == pytest.approx(cut) and silver.serving_set(df).count() == 3600 > silver.training_set(df).count()


def test_nearest_is_exact(spark):
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(120, 8))
    rows = [(i, [float(v) for v in x[i]], "z") for i in range(120)] + [(500, None, "z"), (501, [0.0] * 8, "z")]
    got = ml.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string"), k=3, block=2).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in (0, 50, 100):
        s = np.round(u @ u[q], 5)
        want = [i for i in sorted(range(120), key=lambda i: (-s[i], i)) if i != q][:3]
        assert [r.vec_id for r in sorted(got, key=lambda r: r.rn) if r.query_id == q] == want


def test_audit_and_mining_of_nothing(spark):
    c = spark.createDataFrame([], "query string, sku_brand_name string, sku_name string, sku_price double, sku_position int")
    assert {r.n for r in quality.audit(c).collect()} == {0}
    assert mining.brands(c, "sku_brand_name").count() == 0
    assert silver.assigned(spark.createDataFrame([], "category_only boolean, alias_canon string, alias_in_top boolean, brand_in_query boolean, in_top boolean, confidence double, n_clicks long, n_brands long, click_brand string")).count() == 0


def test_word_vectors_count_over_all_texts(spark):
    t = spark.range(24_000).select(F.format_string("w%d n%d", F.floor(F.col("id") / 5), "id").alias("text"))
    assert {r.word for r in ml.word_vectors(t, size=2).collect()} == {f"w{i}" for i in range(4800)}


def test_cascade_asks_tagger_and_typer(spark):
    one = lambda rows, s: spark.createDataFrame(rows, s)

    class Tagger:
        def predict(self, df):
            return df.select("id", F.transform("tokens", lambda t: F.when(t == "зоргатрон", "B-BRAND").when(t == "сталь", "B-ATTR").when(t == "чайник", "B-MODEL").otherwise("O")).alias("pred"))

    class Typer:
        def predict(self, df):
            return df.withColumn("top", F.lit("material")).withColumn("p1", F.when(F.col("text") == "сталь", 0.9).otherwise(0.2))

    lists = {"brand": one([("Bosch",)], "name string"), "category": one([("чайник",)], "name string"), "model": one([("qwe",)], "name string")}
    words = one([("зоргатрон",), ("чайник",), ("сталь",), ("bosch",)], "w string")
    q = one([(1, "чайник зоргатрон сталь 16 гб"), (2, "bosch чайник")], "id int, query string")
    out = cascade.extract(q, labeler.dictionary(lists), words, one([("Sony", "сони")], "canon string, alias string"), one([("Bosch",)], "name string"), None, Tagger(), Typer())
    got = {r.id: (r.brand, r.brand_source, r.category, r.model, r.attributes) for r in out.collect()}
    assert got == {1: ("зоргатрон", "tagger", "чайник", None, {"material": ["сталь"], "memory_storage": ["16 гб"]}), 2: ("Bosch", "rules", "чайник", None, None)}
