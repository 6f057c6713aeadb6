"""Queries of the learned operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from querymill.functions import bio as B
from querymill.functions import text as T
from querymill.operators import metrics as M
from querymill.operators import ml
from querymill.plans.pipelines import _evidence
from querymill.operators import selection as Z
from querymill.operators import silver as V
from querymill.plans.registry import CORE
from querymill.sources.tables import stage, table

_GRAMS = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({c}), '\\s+'), lambda w: w <> ''), lambda w: flatten(list_transform([2, 3, 4], lambda n: list_transform(generate_series(1, length(w) + 2 - n + 1), lambda i: substring(' ' || w || ' ', i::INT, n)))))))".replace("list_distinct(", "(", 1)


@CORE.add(
    f"""WITH r AS (SELECT brand_id AS id, unnest({_GRAMS.format(c='brand')}) AS term FROM brands), q AS (SELECT item_id AS id, unnest({_GRAMS.format(c='brand')}) AS term FROM benchmark WHERE brand <> ''),
i AS (SELECT term, ln((1 + (SELECT count(DISTINCT id) FROM r)) / (1 + count(DISTINCT id))) + 1 AS idf FROM r GROUP BY 1),
rw AS (SELECT id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY id)) AS w FROM (SELECT id, term, count(*) AS tf FROM r GROUP BY 1, 2) JOIN i USING (term)),
qw AS (SELECT id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY id)) AS w FROM (SELECT id, term, count(*) AS tf FROM q GROUP BY 1, 2) JOIN i USING (term)),
s AS (SELECT qw.id, rw.id AS ref_id, round(sum(qw.w * rw.w), 5) AS score FROM qw JOIN rw USING (term) GROUP BY 1, 2)
SELECT id, arg_min(ref_id, (-score, ref_id)) AS ref_id, max(score) AS score FROM s GROUP BY 1"""
)
def tfidf_retrieval(spark, sf):
    """The nearest brand of every typed one by character TF-IDF."""
    q = table(spark, sf, "benchmark").where("brand <> ''").select(F.col("item_id").alias("id"), F.col("brand").alias("text"))
    return ml.retrieve(q, table(spark, sf, "brands").select(F.col("brand_id").alias("id"), F.col("brand").alias("text")))


@CORE.add(
    "SELECT query_id, vec_id, score, rn::INT AS rn FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)) WHERE rn <= 10"
)
def embedding_topk(spark, sf):
    """The ten nearest vectors of every fiftieth one."""
    return ml.nearest(table(spark, sf, "embeddings"))


@CORE.add()
def brand_classifier(spark, sf):
    """Predictions of the validation part with and without the reject policy."""
    rows = V.training_set(V.assigned(_evidence(spark, sf))).select(F.col("query_norm").alias("text"), F.col("brand").alias("label"), F.col("sample_weight").alias("weight"), "part")
    rows = stage(rows, "training")
    model = ml.BrandClassifier().fit(rows.where("part = 'train'"))
    p = model.predict(rows.where("part = 'val'"))
    return p.select("text", "label", "top", F.round("p1", 6).alias("p1"), F.round("margin", 6).alias("margin"), M.reject(F.col("top"), F.col("p1"), F.col("margin")).alias("policy"))


@CORE.add()
def brand_calibration(spark, sf):
    """Coverage and accuracy of the classifier over thresholds."""
    return M.threshold_sweep(brand_classifier(spark, sf), F.col("p1"), F.col("top") == F.col("label"), [0.3, 0.42, 0.55, 0.7, 0.9])


def _sentences(spark, sf):
    """Benchmark queries with tokens and the tags of their entities."""
    b = table(spark, sf, "benchmark").where("query IS NOT NULL").select(F.col("item_id").alias("id"), T.token_spans(F.col("query")).alias("t"), "entities")

    def tag(x):
        hit = F.filter("entities", lambda e: (e["span"][0] < x["end"]) & (x["start"] < e["span"][1]))
        e = F.get(hit, F.lit(0))
        return F.when(F.size(hit) > 0, F.concat(F.when(x["start"] <= e["span"][0], "B-").otherwise("I-"), e["label"])).otherwise("O")

    return b.select("id", F.col("t.token").alias("tokens"), F.transform("t", tag).alias("tags"))


@CORE.add()
def viterbi_tags(spark, sf):
    """Tags of held-out queries by the sequence tagger."""
    s = _sentences(spark, sf).withColumn("h", F.md5(F.col("id").cast("string")))
    model = ml.Tagger().fit(s.where("h >= '4'").drop("h"))
    return model.predict(s.where("h < '4'").drop("h"))


@CORE.add()
def viterbi_prf(spark, sf):
    """Precision, recall and F1 of the sequence tagger on held-out queries."""
    gold = _sentences(spark, sf)
    pred = viterbi_tags(spark, sf)
    g = gold.join(pred.select("id"), "id", "left_semi").select(F.col("id").alias("row_id"), F.inline(B.spans(F.col("tags"))))
    return M.prf(M.span_counts(g, pred.select(F.col("id").alias("row_id"), F.inline(B.spans(F.col("pred")))), ["start", "end"]))


@CORE.add()
def relevance_auc(spark, sf):
    """Quality of the relevance classifier on held-out labels."""
    c = table(spark, sf, "candidates_to_label")
    return ml.relevance(c.select(F.col("cand_id").alias("id"), "query", F.col("sku_name").alias("name"), F.col("sku_brand_name").alias("brand"), "label"))


@CORE.add()
def embedding_plane(spark, sf):
    """Vectors on their first two principal components."""
    return ml.principal(table(spark, sf, "embeddings"))


@CORE.add()
def word_vectors(spark, sf):
    """Vectors of the words of queries."""
    return ml.word_vectors(table(spark, sf, "benchmark").select(F.col("query").alias("text")))


# ---- choices: the models, the threshold, the amount of labels

def _spans_to_type(spark, sf):
    from querymill.operators.cascade import attribute_rows

    rows = attribute_rows(table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "query", "entities")).withColumnRenamed("type", "label")
    return stage(rows.withColumn("h", F.md5(F.concat_ws("|", "id", "start"))), "spans")


def _attribute_models():
    models = {name: Z.TextModel(blocks) for name, blocks in Z.LAYOUTS.items()}
    models["one_vs_rest"] = Z.TextModel(Z.LAYOUTS["span"], one_vs_rest=True, steps=10)
    return models


@CORE.add()
def attribute_model_selection(spark, sf):
    """Macro-F1 of the feature layouts and losses for attribute types on held-out spans, and which is chosen."""
    rows = _spans_to_type(spark, sf)
    return Z.select_model(_attribute_models(), rows.where("h >= '4'"), rows.where("h < '4' AND NOT is_aug"))[1]


def _typed_spans(spark, sf, top=1):
    rows = _spans_to_type(spark, sf)
    model = Z.TextModel(Z.LAYOUTS["span+words"]).fit(rows.where("h >= '4'"))
    return stage(model.predict(rows.where("h < '4' AND NOT is_aug").select("id", "start", "span_text", "label"), top), "typed")


@CORE.add()
def attribute_tau(spark, sf):
    """The threshold from which on an attribute's type is taken, from the held-out spans."""
    return Z.choose_tau(_typed_spans(spark, sf), "label", "top", "p1")


@CORE.add()
def attribute_top5(spark, sf):
    """The five likeliest types of every held-out span."""
    p = _typed_spans(spark, sf, 5).select("id", "start", "span_text", F.posexplode("ranked").alias("rn", "x"))
    return p.select("id", "start", "span_text", "rn", F.col("x.label").alias("type"), F.round("x.p", 6).alias("p"))


@CORE.add()
def brand_model_selection(spark, sf):
    """Macro-F1 of the brand models on the validation part, and which is chosen."""
    rows = V.training_set(V.assigned(_evidence(spark, sf))).select(F.col("query_norm").alias("text"), F.col("brand").alias("label"), "part")
    rows = stage(rows, "training")
    q = Z.QUERY_LAYOUTS
    models = {"char": Z.TextModel(q["char"]), "balanced_char": Z.TextModel(q["char"], balanced=True), "words+char": Z.TextModel(q["words+char"]), "one_vs_rest_char": Z.TextModel(q["char"], one_vs_rest=True, steps=5)}
    return Z.select_model(models, rows.where("part = 'train'"), rows.where("part = 'val'"))[1]


@CORE.add()
def tagger_learning_curve(spark, sf):
    """F1 of the sequence tagger on held-out queries, fitted on growing parts of the others."""
    gold = stage(_sentences(spark, sf).withColumn("h", F.md5(F.col("id").cast("string"))), "gold")
    held = gold.where("h < '4'")
    g = held.select(F.col("id").alias("row_id"), F.inline(B.spans(F.col("tags"))))
    out = None
    for share, n, pred in Z.learning_curve(lambda part: ml.Tagger().fit(part.drop("h")).predict(held), gold.where("h >= '4'"), [0.25, 0.5, 1.0], "id"):
        p = M.prf(M.span_counts(g, pred.select(F.col("id").alias("row_id"), F.inline(B.spans(F.col("pred")))), ["start", "end"])).withColumn("share", F.lit(share)).withColumn("n_train", F.lit(n))
        out = p if out is None else out.unionByName(p)
    return out


@CORE.add(
    """WITH x AS (SELECT label::VARCHAR AS y, (sku_position <= 2)::INT::VARCHAR AS top, confidence AS p1 FROM candidates_to_label WHERE label IS NOT NULL AND confidence IS NOT NULL AND sku_position IS NOT NULL),
t AS (SELECT y, CASE WHEN p1 >= tau THEN top ELSE 'UNKNOWN' END AS p, tau FROM x, (SELECT unnest([0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9])::DOUBLE AS tau)),
c AS (SELECT tau, l, count_if(y = l) AS a, count_if(p = l) AS b, count_if(y = l AND p = l) AS h FROM t, (SELECT unnest(['0', '1', 'UNKNOWN']) AS l) GROUP BY 1, 2),
f AS (SELECT tau, round(avg(2 * h / (a + b)) FILTER (WHERE a + b > 0), 6) AS macro_f1, round(sum(h) / sum(a), 6) AS accuracy FROM c GROUP BY 1),
g AS (SELECT f.*, coverage FROM f JOIN (SELECT tau, round(avg((p <> 'UNKNOWN')::INT), 6) AS coverage FROM t GROUP BY 1) USING (tau))
SELECT *, tau >= 0.55 AND row_number() OVER (PARTITION BY tau >= 0.55 ORDER BY macro_f1 DESC, coverage DESC, tau) = 1 AS chosen FROM g"""
)
def label_tau(spark, sf):
    """The threshold for the confidence of labels against the position of the click."""
    c = table(spark, sf, "candidates_to_label").where("label IS NOT NULL AND confidence IS NOT NULL AND sku_position IS NOT NULL")
    rows = c.select(F.col("label").cast("string").alias("y"), (F.col("sku_position") <= 2).cast("int").cast("string").alias("top"), F.col("confidence").alias("p1"))
    return Z.choose_tau(rows, "y", "top", "p1")
