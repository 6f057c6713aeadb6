"""Queries of the cascade and what belongs to it."""

from __future__ import annotations

from pyspark.sql import functions as F

from querymill.functions import bio as B
from querymill.functions.text import norm_key
from querymill.operators import cascade as X
from querymill.operators import labeler as L
from querymill.operators import metrics as M
from querymill.operators import ml
from querymill.operators import silver as V
from querymill.plans.clicks import _SP
from querymill.plans.learned import _sentences
from querymill.plans.pipelines import _evidence, labelled, lists, vocabulary
from querymill.plans.registry import CORE
from querymill.sources.tables import stage, table


def queries(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "query")


def names(spark, sf):
    return table(spark, sf, "brands").select(F.col("brand").alias("name"))


@CORE.add()
def fuzzy_brand(spark, sf):
    """The brand of the best ratio of 92 or more with a run of tokens."""
    return X.fuzzy_fill(queries(spark, sf), names(spark, sf))


@CORE.add(
    f"SELECT id, name FROM (SELECT q.id, b.brand AS name, row_number() OVER (PARTITION BY q.id ORDER BY length(b.k) DESC, b.brand) AS rn FROM (SELECT item_id AS id, trim(regexp_replace(translate(lower(query), 'ё', 'е'), '{_SP}', ' ', 'g')) AS k FROM benchmark WHERE query <> '') q JOIN (SELECT brand, trim(regexp_replace(translate(lower(brand), 'ё', 'е'), '{_SP}', ' ', 'g')) AS k FROM brands) b ON length(b.k) >= 4 AND contains(q.k, b.k)) WHERE rn = 1"
)
def substring_brand(spark, sf):
    """The longest brand that the query holds anywhere."""
    return X.substring_fill(queries(spark, sf), names(spark, sf))


@CORE.add()
def preprocessed(spark, sf):
    """Cleaned text, tokens, hints and spans of every query."""
    models = lists(spark, sf)["model"].select(norm_key(F.col("name")).alias("phrase"))
    protected = names(spark, sf).select(norm_key(F.col("name")).alias("phrase")).where("phrase LIKE '% %'")
    return X.preprocess(queries(spark, sf), models, protected)


@CORE.add()
def preprocessing_effect(spark, sf):
    """Shares of queries with a model span, a protected span and a glued unit."""
    p = preprocessed(spark, sf).join(queries(spark, sf), "id")
    rate = lambda c: F.round(F.avg(c.cast("int")), 6)
    return p.agg(rate(F.size("model_spans") > 0).alias("model"), rate(F.size("protected_spans") > 0).alias("protected"), rate(F.col("query").rlike(r"(?U)\d[^\W\d_]{1,4}\b")).alias("glued"))


def _classifier(spark, sf):
    rows = V.serving_set(V.assigned(_evidence(spark, sf)))
    return ml.BrandClassifier().fit(rows.select(F.col("query_norm").alias("text"), F.col("brand").alias("label"), F.col("sample_weight").alias("weight")))


def _typer(spark, sf):
    rows = attribute_rows(spark, sf).select(F.col("span_text").alias("text"), F.col("type").alias("label"), F.lit(1.0).alias("weight"))
    return ml.BrandClassifier().fit(rows)


def _cascade(spark, sf, classifier=None, tagger=None, typer=None):
    phrases = L.dictionary(lists(spark, sf))
    return X.extract(queries(spark, sf), phrases, vocabulary(spark, sf), table(spark, sf, "spell_aliases"), names(spark, sf), classifier, tagger, typer)


@CORE.add()
def cascade_facts(spark, sf):
    """Facts of every query by the whole cascade, with the stage that gave the brand."""
    return _cascade(spark, sf, _classifier(spark, sf), ml.Tagger().fit(_sentences(spark, sf)), _typer(spark, sf))


@CORE.add()
def cascade_debug(spark, sf):
    """Tags before and after the sequence tagger, and which layers changed a query."""
    rules = labelled(spark, sf)[0].select("id", F.col("tokens.token").alias("tokens"), F.col("tags").alias("rule_tags"))
    model = ml.Tagger().fit(_sentences(spark, sf))
    pred = model.predict(rules.select("id", "tokens"))
    j = rules.join(pred, "id", "left")
    return j.select("id", F.array_join("rule_tags", " ").alias("rule_tags"), F.array_join("pred", " ").alias("model_tags"), F.exists("rule_tags", lambda t: t != "O").alias("rules_fired"), (F.array_join("rule_tags", " ") != F.array_join("pred", " ")).alias("model_differs"))


@CORE.add()
def cascade_stages(spark, sf):
    """F1 of spans by stage of the cascade on held-out queries: rules, and rules with the sequence tagger where they leave room."""
    gold = _sentences(spark, sf).withColumn("h", F.md5(F.col("id").cast("string")))
    model = ml.Tagger().fit(gold.where("h >= '4'").drop("h"))
    test = stage(gold.where("h < '4'").drop("h"), "held")
    rules = labelled(spark, sf)[0].select("id", F.col("tokens.token").alias("rule_tokens"), "tags")
    j = test.select("id", "tokens", F.col("tags").alias("gold")).join(rules, "id", "left").join(model.predict(test), "id", "left")
    same = F.col("rule_tokens") == F.col("tokens")
    r = F.when(same, B.spans(F.col("tags"))).otherwise(F.array().cast(B.SPAN))
    j = stage(j.select("id", B.spans(F.col("gold")).alias("g"), r.alias("r"), B.merged(r, B.spans(F.col("pred"))).alias("m")), "stages")
    g = j.select(F.col("id").alias("row_id"), F.inline("g"))
    out = [M.prf(M.span_counts(g, j.select(F.col("id").alias("row_id"), F.inline(c)), ["start", "end"])).withColumn("stage", F.lit(s)) for c, s in (("r", "rules"), ("m", "rules+tagger"))]
    return out[0].unionByName(out[1])


@CORE.add()
def attribute_rows(spark, sf):
    """Attribute spans with masked texts, and with the unit's other spelling."""
    return X.attribute_rows(table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "query", "entities"))


@CORE.add()
def corrupted_queries(spark, sf):
    """Queries damaged word by word."""
    return X.corrupted(queries(spark, sf))


@CORE.add()
def highlighted_queries(spark, sf):
    """Queries cut at their entities into labelled pieces."""
    spans = F.transform("entities", lambda e: F.struct(e["label"].alias("label"), e["span"][0].alias("start"), e["span"][1].alias("end")))
    h = table(spark, sf, "benchmark").where("query <> ''").select("item_id", F.posexplode(X.highlighted(F.col("query"), F.coalesce(spans, F.array().cast(B.SPAN)))).alias("nth", "p"))
    return h.select("item_id", "nth", "p.text", "p.label")


@CORE.add()
def relabel_diff(spark, sf):
    """Pairs of benchmark and rule label of the same text, the fifteen most frequent."""
    gold = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.explode("entities").alias("e")).select("id", F.lower("e.text").alias("text"), F.col("e.label").alias("gold"))
    rule = L.entities(labelled(spark, sf)[0]).select("id", F.lower("text").alias("text"), F.col("label").alias("rule"))
    return gold.join(rule, ["id", "text"]).groupBy("gold", "rule").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "gold", "rule").limit(15)


@CORE.add()
def labeler_variants(spark, sf):
    """The labeler with and without the mined models: share of queries without entities, with a model, and how many get more model spans."""
    all_, _ = labelled(spark, sf)
    own = lists(spark, sf)
    bare = L.label(queries(spark, sf), L.dictionary({k: v for k, v in own.items() if k != "model"}))
    n = lambda tags, kind: F.size(F.filter(tags, lambda t: t.startswith(kind)))
    j = all_.select("id", F.col("tags").alias("a")).join(bare.select("id", F.col("tags").alias("b")), "id")
    rate = lambda c: F.round(F.avg(c.cast("int")), 6)
    return j.agg(F.count(F.lit(1)).alias("n"), rate(n("a", "B-") == 0).alias("empty_with"), rate(n("b", "B-") == 0).alias("empty_without"), rate(n("a", "B-MODEL") > 0).alias("model_with"), rate(n("b", "B-MODEL") > 0).alias("model_without"), F.count_if(n("a", "B-MODEL") > n("b", "B-MODEL")).alias("more_models"))
