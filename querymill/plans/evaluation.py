"""Queries of evaluation: spans, classes, latency, thresholds, analysis of errors."""

from __future__ import annotations

from pyspark.sql import functions as F

from querymill.operators import facts as X
from querymill.operators import metrics as M
from querymill.plans.facts import FACTS_SQL, dictionary, queries
from querymill.plans.registry import CORE
from querymill.plans.text import _TAGGED, _spans_sql, tagged
from querymill.functions import bio as B
from querymill.sources.tables import table

_PRF = """per AS (SELECT label, round(p, 6) AS p, round(r, 6) AS r, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM (SELECT label, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM (SELECT label, tp, fp, fn FROM c UNION ALL SELECT 'MICRO', sum(tp), sum(fp), sum(fn) FROM c)))
SELECT * FROM per UNION ALL SELECT 'MACRO', round(avg(p), 5), round(avg(r), 5), round(avg(f1), 5) FROM per WHERE label <> 'MICRO'"""


def _counts_sql(gold: str, pred: str, key: str) -> str:
    return f"g AS (SELECT DISTINCT row_id, label, {key} FROM ({gold})), p AS (SELECT DISTINCT row_id, label, {key} FROM ({pred})), c AS (SELECT label, count_if(a AND b)::BIGINT AS tp, count_if(a IS NULL)::BIGINT AS fp, count_if(b IS NULL)::BIGINT AS fn FROM (SELECT label, g.a, p.b FROM (SELECT *, true AS a FROM g) g FULL JOIN (SELECT *, true AS b FROM p) p USING (row_id, label, {key})) GROUP BY label)"


@CORE.add("WITH " + _counts_sql(f"SELECT item_id AS row_id, label, start, \"end\" FROM ({_spans_sql('a', False)})", f"SELECT item_id AS row_id, label, start, \"end\" FROM ({_spans_sql('b', False)})", 'start, "end"') + ", " + _PRF)
def span_prf(spark, sf):
    """Precision, recall and F1 of tagged spans by token offsets."""
    t = tagged(spark, sf)
    gold = t.select(F.col("item_id").alias("row_id"), F.inline(B.spans(F.col("gold"))))
    pred = t.select(F.col("item_id").alias("row_id"), F.inline(B.spans(F.col("pred"))))
    return M.prf(M.span_counts(gold, pred, ["start", "end"]))


_GOLD_TEXT = "SELECT item_id AS row_id, e.label AS label, lower(e.text) AS text FROM (SELECT item_id, unnest(entities) AS e FROM benchmark) WHERE e.label IN ('BRAND', 'CATEGORY')"
_PRED_TEXT = "SELECT id AS row_id, 'BRAND' AS label, brand_text AS text FROM facts WHERE brand_text IS NOT NULL UNION ALL SELECT id, 'CATEGORY', category FROM facts WHERE category IS NOT NULL"


@CORE.add(f"WITH {FACTS_SQL}, " + _counts_sql(_GOLD_TEXT, _PRED_TEXT, "text") + ", " + _PRF)
def facts_prf(spark, sf):
    """Precision, recall and F1 of extracted brands and categories against the benchmark, by text."""
    gold = table(spark, sf, "benchmark").select(F.col("item_id").alias("row_id"), F.explode("entities").alias("e")).select("row_id", "e.label", F.lower("e.text").alias("text")).where("label IN ('BRAND', 'CATEGORY')")
    f = X.extract(queries(spark, sf), dictionary(spark, sf))
    pred = f.select(F.col("id").alias("row_id"), F.inline(F.array(F.struct(F.lit("BRAND").alias("label"), F.col("brand_text").alias("text")), F.struct(F.lit("CATEGORY").alias("label"), F.col("category").alias("text"))))).where("text IS NOT NULL")
    return M.prf(M.span_counts(gold, pred, ["text"]))


@CORE.add(f"SELECT a.tag AS gold, b.tag AS pred, count(*) AS n FROM {_TAGGED.replace('{seed}', 'a')} a JOIN {_TAGGED.replace('{seed}', 'b')} b USING (item_id, pos) GROUP BY 1, 2")
def tag_confusion(spark, sf):
    """Confusion of tags."""
    return tagged(spark, sf).select(F.inline(F.arrays_zip("gold", "pred"))).groupBy("gold", "pred").agg(F.count(F.lit(1)).alias("n"))


_PAIRS = f"(SELECT a.tag AS t, b.tag AS p FROM {_TAGGED.replace('{seed}', 'a')} a JOIN {_TAGGED.replace('{seed}', 'b')} b USING (item_id, pos))"
_REPORT = f"SELECT label, support, predicted, tp, round(CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted) ELSE 0 END, 6) AS f1 FROM (SELECT label, sum(s)::BIGINT AS support, sum(q)::BIGINT AS predicted, sum(h)::BIGINT AS tp FROM (SELECT t AS label, 1 AS s, 0 AS q, (t = p)::INT AS h FROM {_PAIRS} UNION ALL SELECT p, 0, 1, 0 FROM {_PAIRS}) GROUP BY label)"


def _pairs(spark, sf):
    return tagged(spark, sf).select(F.inline(F.arrays_zip(F.col("gold").alias("t"), F.col("pred").alias("p"))))


@CORE.add(_REPORT)
def class_report(spark, sf):
    """Support, predictions and F1 of each class."""
    return M.class_report(_pairs(spark, sf), "t", "p")


@CORE.add(f"SELECT round(sum(tp) / sum(support), 6) AS accuracy, round(avg(CASE WHEN support > 0 THEN f1 END), 5) AS macro_f1, round(sum(f1 * support) / sum(support), 5) AS weighted_f1 FROM ({_REPORT})")
def class_overall(spark, sf):
    """Accuracy, macro and weighted F1."""
    return M.overall(M.class_report(_pairs(spark, sf), "t", "p"))


@CORE.add("SELECT round(avg((lower(brand) = lower(b))::INT), 6) AS brand_accuracy, count(*) AS n FROM (SELECT x.brand, e.text AS b FROM (SELECT brand, unnest(entities) AS e FROM benchmark) x WHERE e.label = 'BRAND' AND x.brand <> '')")
def brand_accuracy(spark, sf):
    """Typed brand against the brand span, case aside, over rows with both."""
    e = table(spark, sf, "benchmark").where("brand <> ''").select("brand", F.explode("entities").alias("e")).where("e.label = 'BRAND'")
    return e.agg(F.round(F.avg((F.lower("brand") == F.lower("e.text")).cast("int")), 6).alias("brand_accuracy"), F.count(F.lit(1)).alias("n"))


@CORE.add("SELECT coalesce(label, 'ALL') AS grp, count(*) AS n, round(avg((length(text) >= 6)::INT), 6) AS agreement FROM (SELECT e.label AS label, e.text AS text FROM (SELECT unnest(entities) AS e FROM benchmark)) GROUP BY ROLLUP (label)")
def label_agreement_rollup(spark, sf):
    """A rate per entity label and over all, by rollup."""
    e = table(spark, sf, "benchmark").select(F.explode("entities").alias("e")).select("e.label", "e.text")
    return M.rollup_agreement(e, "label", F.length("text") >= 6)


_LAT = "count(*) AS n, round(avg(server_ms), 4) AS mean, round(stddev_pop(server_ms), 4) AS sd, min(server_ms) AS low, max(server_ms) AS high, round(quantile_cont(server_ms, 0.5), 4) AS p50, round(quantile_cont(server_ms, 0.9), 4) AS p90, round(quantile_cont(server_ms, 0.95), 4) AS p95, round(quantile_cont(server_ms, 0.99), 4) AS p99, quantile_cont(server_ms, 0.95) <= 100 AS within"


@CORE.add(f"SELECT suite, {_LAT} FROM latency_sla_rows WHERE ok AND server_ms IS NOT NULL GROUP BY suite")
def latency_sla(spark, sf):
    """Latency per suite and whether its 95th percentile is within the limit."""
    return M.latency_summary(table(spark, sf, "latency_sla_rows").where("ok"), ["suite"], "server_ms", 100.0)


@CORE.add("SELECT suite, run_day, count(*) AS n, round(avg(ok::INT), 6) AS success, round(avg((server_ms < 100)::INT), 6) AS under_limit, round(1000.0 / avg(server_ms), 4) AS per_second FROM latency_sla_rows GROUP BY 1, 2")
def throughput(spark, sf):
    """Success rate, share under the limit and calls a second of one client."""
    ms = F.col("server_ms")
    return table(spark, sf, "latency_sla_rows").groupBy("suite", "run_day").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("ok").cast("int")), 6).alias("success"), F.round(F.avg((ms < 100).cast("int")), 6).alias("under_limit"), F.round(F.try_divide(F.lit(1000.0), F.avg(ms)), 4).alias("per_second"))


@CORE.add("SELECT suite, run_day, row_id, round(percent_rank() OVER (PARTITION BY suite, run_day ORDER BY server_ms), 6) AS cdf FROM latency_sla_rows WHERE ok AND server_ms IS NOT NULL")
def latency_cdf(spark, sf):
    """Empirical distribution of the latency within each suite and day."""
    df = table(spark, sf, "latency_sla_rows").where("ok AND server_ms IS NOT NULL").select("suite", "run_day", "row_id", "server_ms")
    return M.empirical_cdf(df, ["suite", "run_day"], "server_ms").drop("server_ms")


_GRID = [0.5, 0.55, 0.6, 0.7, 0.8, 0.9]


@CORE.add(" UNION ALL ".join(f"SELECT {t}::DOUBLE AS tau, count_if(confidence >= {t})::BIGINT AS accepted, round(count_if(confidence >= {t}) / count(*), 6) AS coverage, round(avg(CASE WHEN confidence >= {t} THEN label END), 6) AS accuracy FROM candidates_to_label WHERE label IS NOT NULL AND confidence IS NOT NULL" for t in _GRID))
def threshold_sweep(spark, sf):
    """Coverage and accuracy of labels over thresholds of confidence, in one pass."""
    df = table(spark, sf, "candidates_to_label").where("label IS NOT NULL AND confidence IS NOT NULL")
    return M.threshold_sweep(df, F.col("confidence"), F.col("label"), _GRID)


@CORE.add(
    "WITH p AS (SELECT e.label AS label, count(DISTINCT lower(e.text)) AS kinds, count(*) AS n, count(DISTINCT regexp_extract(lower(e.text), '([^ ]+)$', 1)) AS last_words FROM (SELECT unnest(entities) AS e FROM benchmark) GROUP BY 1) SELECT * FROM p"
)
def lexical_diversity(spark, sf):
    """Distinct spans and distinct last words of each label."""
    e = table(spark, sf, "benchmark").select(F.explode("entities").alias("e")).select("e.label", F.lower("e.text").alias("t"))
    return e.groupBy("label").agg(F.count_distinct("t").alias("kinds"), F.count(F.lit(1)).alias("n"), F.count_distinct(F.regexp_extract("t", "([^ ]+)$", 1)).alias("last_words"))


@CORE.add(
    f"WITH {FACTS_SQL}, gg AS (SELECT item_id AS id, e.label AS label, lower(e.text) AS text FROM (SELECT item_id, unnest(entities) AS e FROM benchmark)), pp AS (SELECT DISTINCT id, 'BRAND' AS label, brand_text AS text FROM facts UNION SELECT DISTINCT id, 'CATEGORY', category FROM facts) SELECT gg.label AS gold, coalesce(pp.label, 'MISS') AS pred, count(*) AS n FROM gg LEFT JOIN pp ON pp.id = gg.id AND pp.text = gg.text GROUP BY 1, 2"
)
def span_confusion(spark, sf):
    """Gold label against the label predicted for the same text, or MISS."""
    gold = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.explode("entities").alias("e")).select("id", F.col("e.label").alias("gold"), F.lower("e.text").alias("text"))
    f = X.extract(queries(spark, sf), dictionary(spark, sf))
    pred = f.select("id", F.inline(F.array(F.struct(F.lit("BRAND").alias("pred"), F.col("brand_text").alias("text")), F.struct(F.lit("CATEGORY").alias("pred"), F.col("category").alias("text"))))).distinct()
    return gold.join(pred, ["id", "text"], "left").groupBy("gold", F.coalesce("pred", F.lit("MISS")).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


@CORE.add("SELECT 'candidates' AS dataset, count(*) AS n FROM candidates_to_label UNION ALL SELECT 'benchmark', count(*) FROM benchmark UNION ALL SELECT 'latency', count(*) FROM latency_sla_rows UNION ALL SELECT 'catalog', count(*) FROM flat_catalog")
def dataset_sizes(spark, sf):
    """Rows of each dataset."""
    parts = [table(spark, sf, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("dataset"), "n") for k, t in (("candidates", "candidates_to_label"), ("benchmark", "benchmark"), ("latency", "latency_sla_rows"), ("catalog", "flat_catalog"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@CORE.add("SELECT round(avg((n > 0)::INT), 6) AS any_entity, round(avg((b > 0)::INT), 6) AS brand, round(avg((c > 0)::INT), 6) AS category, round(avg((k >= 2)::INT), 6) AS two_types, round(avg(n), 6) AS mean_entities, sum(n)::BIGINT AS entities FROM (SELECT len(entities) AS n, len(list_filter(entities, lambda e: e.label = 'BRAND')) AS b, len(list_filter(entities, lambda e: e.label = 'CATEGORY')) AS c, len(list_distinct(list_transform(entities, lambda e: e.label))) AS k FROM benchmark)")
def label_coverage(spark, sf):
    """Shares of queries with entities of each kind."""
    of = lambda x: F.size(F.filter("entities", lambda e: e["label"] == x))
    k = F.size(F.array_distinct(F.transform("entities", lambda e: e["label"])))
    rate = lambda c: F.round(F.avg(c.cast("int")), 6)
    n = F.size("entities")
    return table(spark, sf, "benchmark").where("entities IS NOT NULL").agg(rate(n > 0).alias("any_entity"), rate(of("BRAND") > 0).alias("brand"), rate(of("CATEGORY") > 0).alias("category"), rate(k >= 2).alias("two_types"), F.round(F.avg(n), 6).alias("mean_entities"), F.sum(n).alias("entities"))


@CORE.add("SELECT count(*) AS n, count_if(g)::BIGINT AS grounded FROM (SELECT list_bool_and(list_transform(entities, lambda e: contains(query, e.text))) AS g FROM benchmark WHERE len(entities) > 0 AND query IS NOT NULL)")
def grounding(spark, sf):
    """Queries all of whose entity texts stand in them."""
    g = F.forall("entities", lambda e: F.col("query").contains(e["text"]))
    return table(spark, sf, "benchmark").where("size(entities) > 0 AND query IS NOT NULL").agg(F.count(F.lit(1)).alias("n"), F.count_if(g).alias("grounded"))
