"""Queries of the pipelines: spelling, labels, training set, audit, frequency tables, mined dictionaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from querymill.functions import attributes as A
from querymill.functions import text as T
from querymill.functions.udf import indel_ratio, similarity, weighted_edit
from querymill.operators import clicks as C
from querymill.operators import labeler as L
from querymill.operators import markov as K
from querymill.operators import mining as D
from querymill.operators import quality as QA
from querymill.operators import silver as V
from querymill.operators import spell as P
from querymill.operators import stats as S
from querymill.operators.metrics import reject
from querymill.plans.clicks import _VOTE, Q, _md5, log
from querymill.plans.registry import CORE
from querymill.sources.tables import stage, table


# ---- spelling

def vocabulary(spark, sf):
    """Words of the brands and of the benchmark's categories."""
    b = table(spark, sf, "brands").select(F.explode(F.split(P.key(F.col("brand")), " ")).alias("w"))
    c = table(spark, sf, "benchmark").where("category <> ''").select(F.explode(F.split(P.key(F.col("category")), " ")).alias("w"))
    return b.union(c).where("w <> ''").distinct()


@CORE.add()
def spell_fixed_queries(spark, sf):
    """Every benchmark query with its spelling repaired."""
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "query")
    return P.fix_queries(q, vocabulary(spark, sf), table(spark, sf, "spell_aliases"))


def _bench_words(spark, sf):
    return table(spark, sf, "benchmark").select(F.explode(T.parts(F.col("query"))).alias("word")).where(F.col("word").rlike(r"^\p{L}")).distinct()


@CORE.add()
def spell_fixed_words(spark, sf):
    """Distinct words that the cascade changes, with score and kind."""
    return P.fix_words(_bench_words(spark, sf), vocabulary(spark, sf), table(spark, sf, "spell_aliases"))


@CORE.add()
def spell_units(spark, sf):
    """Words that are or hold a unit."""
    w = table(spark, sf, "benchmark").select(F.explode(T.parts(F.col("query"))).alias("word")).where(F.col("word").rlike(r"(?U)^\w")).distinct()
    return P.fix_units(w)


_ASCII = "(SELECT DISTINCT lower(unnest(regexp_extract_all({c}, '[a-zA-Z]+'))) AS w FROM {t})"


@CORE.add(
    f"SELECT t AS word, w AS fixed FROM (SELECT t, w, d, row_number() OVER (PARTITION BY t ORDER BY d, w) AS rn FROM (SELECT a.w AS t, b.w AS w, levenshtein(a.w, b.w) AS d FROM {_ASCII.format(c='brand', t='benchmark')} a JOIN {_ASCII.format(c='brand', t='brands')} b ON abs(length(a.w) - length(b.w)) <= 2 WHERE length(a.w) >= 4 AND a.w NOT IN (SELECT w FROM {_ASCII.format(c='brand', t='brands')})) WHERE d <= greatest(1, length(t) // 3) AND d <= 2) WHERE rn = 1 AND (d <= 1 OR length(t) >= 6)"
)
def spell_lite(spark, sf):
    """Typed brand words repaired under the lighter rule."""
    ascii_words = lambda df, c, out: df.select(F.explode(F.regexp_extract_all(c, F.lit("[a-zA-Z]+"), F.lit(0))).alias("x")).select(F.lower("x").alias(out)).distinct()
    return P.fix_lite(ascii_words(table(spark, sf, "benchmark"), "brand", "word"), ascii_words(table(spark, sf, "brands"), "brand", "w"))


@CORE.add("SELECT alias, lower(canon) AS fixed FROM spell_aliases")
def alias_fix(spark, sf):
    """Aliases looked up as words."""
    a = table(spark, sf, "spell_aliases")
    named = a.select(P.key(F.col("alias")).alias("k"), F.lower("canon").alias("fixed")).groupBy("k").agg(F.min("fixed").alias("fixed"))
    return a.select("alias", P.key(F.col("alias")).alias("k")).join(named, "k").select("alias", "fixed")


@CORE.add()
def weighted_edits(spark, sf):
    """Weighted distance, similarity and indel ratio of each alias and the next brand's name."""
    a = table(spark, sf, "spell_aliases").select("alias", F.lower("canon").alias("canon"))
    return a.select("alias", "canon", weighted_edit("alias", "canon").alias("d"), F.round(similarity("alias", "canon"), 6).alias("s"), F.round(indel_ratio("alias", "canon"), 6).alias("r"))


# ---- labels

def lists(spark, sf):
    b = table(spark, sf, "benchmark")
    models = D.model_phrases(table(spark, sf, "flat_catalog"), "name", _brand_words(spark, sf), least=3)
    return {"brand": table(spark, sf, "brands").select(F.col("brand").alias("name")), "category": b.where("category <> ''").select(F.col("category").alias("name")), "model": models.select(F.col("phrase").alias("name"))}


def labelled(spark, sf):
    phrases = L.dictionary(lists(spark, sf))
    return L.label(table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "query"), phrases), phrases


@CORE.add()
def weak_labels(spark, sf):
    """Token tags of every benchmark query."""
    return labelled(spark, sf)[0].select("id", "text", F.array_join("tags", " ").alias("tags"))


@CORE.add()
def weak_entities(spark, sf):
    """Entities of every benchmark query with offsets and attribute types."""
    return L.entities(labelled(spark, sf)[0])


@CORE.add()
def structured_facts(spark, sf):
    """Brand, category, model and attributes of every benchmark query."""
    rows, phrases = labelled(spark, sf)
    return L.structured(L.entities(rows), phrases)


@CORE.add()
def attribute_types(spark, sf):
    """Type of every attribute span, counted."""
    e = table(spark, sf, "benchmark").select(F.explode("entities").alias("e")).where("e.label = 'ATTR'")
    return e.groupBy(A.attribute_type(F.col("e.text")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


_CANON = "CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in A.CANON.items()) + " WHEN '' THEN 'other' ELSE {c} END"


@CORE.add(f"SELECT attr AS subtype, {_CANON.format(c='attr')} AS type FROM (SELECT DISTINCT unnest(map_keys(attributes)) AS attr FROM benchmark) UNION ALL SELECT s, {_CANON.format(c='s')} FROM (SELECT unnest([{', '.join(repr(k) for k in A.CANON)}, 'plug', '']) AS s)")
def canonical_subtypes(spark, sf):
    """Subtypes and the types they fall under."""
    a = table(spark, sf, "benchmark").select(F.explode(F.map_keys("attributes")).alias("subtype")).distinct()
    fixed = spark.createDataFrame([(k,) for k in [*A.CANON, "plug", ""]], "subtype string")
    return a.union(fixed).select("subtype", A.canonical_subtype(F.col("subtype")).alias("type"))


@CORE.add("SELECT item_id, k AS key, v AS value FROM (SELECT item_id, unnest(map_entries(attributes)) AS e FROM benchmark) x, LATERAL (SELECT x.e.key AS k, x.e.value AS v)")
def attribute_map(spark, sf):
    """Attributes of each query as rows."""
    return table(spark, sf, "benchmark").select("item_id", F.explode("attributes").alias("key", "value"))


@CORE.add()
def model_likeness(spark, sf):
    """Spans that look like a model, by label."""
    e = table(spark, sf, "benchmark").select(F.explode("entities").alias("e"))
    return e.groupBy(F.col("e.label").alias("label")).agg(F.count_if(A.looks_like_model(F.col("e.text"))).alias("modelish"), F.count(F.lit(1)).alias("n"))


@CORE.add("SELECT item_id, to_json(list_transform(entities, lambda e: {'label': e.label, 'text': e.text}))::VARCHAR AS entities FROM benchmark WHERE entities IS NOT NULL")
def entities_json(spark, sf):
    """Entities as JSON text."""
    return table(spark, sf, "benchmark").where("entities IS NOT NULL").select("item_id", F.to_json(F.transform("entities", lambda e: F.struct(e["label"].alias("label"), e["text"].alias("text")))).alias("entities"))


# ---- training set

def _evidence(spark, sf):
    votes = stage(C.brand_vote(C.votes(log(spark, sf))), "votes")
    top = S.top_values(log(spark, sf), "sku_brand_name", 60).select(F.col("value").alias("brand"))
    e = V.evidence(votes, table(spark, sf, "spell_aliases"), table(spark, sf, "benchmark").where("category <> ''").select("category"), top)
    inside = top.select(F.col("brand").alias("alias_canon")).withColumn("alias_in_top", F.lit(True))
    return e.join(inside, "alias_canon", "left").withColumn("alias_in_top", F.coalesce("alias_in_top", F.lit(False)))


_TOKS = "list_distinct(regexp_extract_all(lower(query_norm), '[a-zа-яё0-9]+'))"
_PADDED = "' ' || trim(regexp_replace({c}, '[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Nl}}\\p{{Pc}}\\x{{200C}}\\x{{200D}}]+', ' ', 'g')) || ' '"
_NOTRIM = "' ' || regexp_replace({c}, '[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Nl}}\\p{{Pc}}\\x{{200C}}\\x{{200D}}]+', ' ', 'g') || ' '"
_EVIDENCE = f"""v AS ({_VOTE}),
top AS (SELECT sku_brand_name AS brand FROM {Q} WHERE trim(sku_brand_name) <> '' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 60),
al AS (SELECT lower(alias) AS w, min(canon) AS canon FROM spell_aliases WHERE alias NOT LIKE '% %' GROUP BY 1),
cv AS (SELECT DISTINCT w FROM (SELECT unnest(regexp_extract_all(lower(category), '[a-zа-яё0-9]+')) AS w FROM benchmark WHERE category <> '') WHERE length(w) >= 3),
vw AS (SELECT query_norm, unnest({_TOKS}) AS w FROM v),
ah AS (SELECT query_norm, arg_min(canon, (-length(w), w)) AS alias_canon FROM vw JOIN al USING (w) GROUP BY 1),
ch AS (SELECT query_norm, count(*) AS n FROM vw JOIN cv USING (w) GROUP BY 1),
e AS (SELECT v.*, ah.alias_canon, ah.alias_canon IN (SELECT brand FROM top) AS alias_in_top, v.click_brand IN (SELECT brand FROM top) AS in_top,
 contains({_NOTRIM.format(c='v.query_norm')}, {_NOTRIM.format(c='lower(v.click_brand)')}) AS brand_in_query,
 ah.alias_canon IS NULL AND NOT regexp_matches(array_to_string({_TOKS.replace('query_norm', 'v.query_norm')}, ' '), '[0-9]') AND len({_TOKS.replace('query_norm', 'v.query_norm')}) BETWEEN 1 AND 4 AND coalesce(ch.n, 0) / greatest(1, len({_TOKS.replace('query_norm', 'v.query_norm')})) >= 0.6 AS category_only
 FROM v LEFT JOIN ah USING (query_norm) LEFT JOIN ch USING (query_norm)),
z AS (SELECT *, confidence >= 0.6 AND n_clicks >= 1 AND (n_brands <= 1 OR confidence >= 0.8) AS sure FROM e),
r AS (SELECT *, CASE WHEN category_only THEN 'category_only' WHEN alias_canon IS NOT NULL AND alias_in_top THEN 'alias_hint' WHEN brand_in_query AND in_top AND sure THEN 'brand_in_query' WHEN brand_in_query AND NOT in_top AND sure THEN 'ood_brand_surface'
 WHEN NOT brand_in_query AND alias_canon IS NULL AND n_brands >= 3 AND confidence < 0.5 THEN 'ambiguous_clicks' WHEN NOT brand_in_query AND alias_canon IS NULL THEN 'no_evidence_drop' WHEN NOT sure THEN 'low_conf_with_evidence' ELSE 'other_drop' END AS reason FROM z),
lab AS (SELECT *, CASE reason WHEN 'category_only' THEN 'NO_BRAND' WHEN 'alias_hint' THEN alias_canon WHEN 'brand_in_query' THEN click_brand WHEN 'ood_brand_surface' THEN 'UNKNOWN' WHEN 'ambiguous_clicks' THEN 'UNKNOWN' WHEN 'low_conf_with_evidence' THEN 'UNKNOWN' END AS brand FROM r)"""


@CORE.add(f"WITH {_EVIDENCE} SELECT query_norm, click_brand, brand_in_query, alias_canon, category_only, brand, reason FROM lab")
def brand_evidence_labels(spark, sf):
    """Evidence, label and reason of each query."""
    return V.assigned(_evidence(spark, sf)).select("query_norm", "click_brand", "brand_in_query", "alias_canon", "category_only", "brand", "reason")


@CORE.add(
    f"""WITH {_EVIDENCE},
a AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY {_md5('query_norm')}, query_norm) AS rn FROM lab WHERE brand IS NOT NULL AND length(query_norm) BETWEEN 2 AND 120),
b AS (SELECT * FROM a WHERE brand <> 'NO_BRAND' OR rn <= (SELECT greatest(200, floor(0.18 * count(*) / (1 - 0.18))::INT) FROM a WHERE brand <> 'NO_BRAND')),
c AS (SELECT * FROM b WHERE brand <> 'UNKNOWN' OR rn <= (SELECT greatest(150, floor(0.12 * count(*) / (1 - 0.12))::INT) FROM b WHERE brand <> 'UNKNOWN')),
k AS (SELECT brand, count(*) AS n FROM c GROUP BY 1 HAVING count(*) >= 20 OR (brand IN ('NO_BRAND', 'UNKNOWN') AND count(*) >= 15)),
i AS (SELECT brand, n, row_number() OVER (ORDER BY brand IN ('NO_BRAND', 'UNKNOWN'), brand) - 1 AS label_id FROM k),
s AS (SELECT c.query_norm, c.brand, i.label_id::INT AS label_id, CASE WHEN c.brand IN ('NO_BRAND', 'UNKNOWN') THEN 'special' WHEN confidence >= 0.8 AND (n_clicks >= 2 OR brand_in_query OR alias_canon IS NOT NULL) THEN 'high' WHEN confidence >= 0.6 THEN 'medium' ELSE 'low' END AS tier,
 CASE c.brand WHEN 'NO_BRAND' THEN 1.0 WHEN 'UNKNOWN' THEN 0.9 ELSE greatest(0.35, least(1.0, confidence)) END::DOUBLE AS sample_weight,
 CASE WHEN i.n > 1 AND row_number() OVER (PARTITION BY c.brand ORDER BY {_md5('query_norm')}, query_norm) <= greatest(1, round_even(i.n * 0.2, 0)) THEN 'val' ELSE 'train' END AS part FROM c JOIN i USING (brand))
SELECT * FROM s"""
)
def brand_silver(spark, sf):
    """The balanced, tiered, weighted and split training set."""
    return V.training_set(V.assigned(_evidence(spark, sf))).select("query_norm", "brand", "label_id", "tier", "sample_weight", "part")


@CORE.add(
    "SELECT cand_id, CASE WHEN b = 'NO_BRAND' THEN 'NO_BRAND' WHEN b = 'UNKNOWN' AND p < 0.30 THEN 'NO_BRAND' WHEN b <> 'UNKNOWN' AND (p < 0.42 OR m < 0.08) THEN 'NO_BRAND' ELSE b END AS brand"
    f" FROM (SELECT cand_id, CASE WHEN sku_brand_name = '' THEN 'NO_BRAND' WHEN sku_brand_name = 'RAT' THEN 'UNKNOWN' ELSE sku_brand_name END AS b, confidence AS p, confidence / 5 AS m FROM {Q} WHERE confidence IS NOT NULL AND sku_brand_name IS NOT NULL)"
)
def reject_policy(spark, sf):
    """Predictions under the reject thresholds, on recorded confidences."""
    b = F.when(F.col("sku_brand_name") == "", "NO_BRAND").when(F.col("sku_brand_name") == "RAT", "UNKNOWN").otherwise(F.col("sku_brand_name"))
    p = F.col("confidence")
    return log(spark, sf).where("confidence IS NOT NULL AND sku_brand_name IS NOT NULL").select("cand_id", reject(b, p, p / 5).alias("brand"))


# ---- audit

_AUDIT = {
    "empty_query": "query IS NULL OR trim(query) = ''", "empty_brand": "sku_brand_name IS NULL OR trim(sku_brand_name) = ''", "empty_name": "sku_name IS NULL OR trim(sku_name) = ''",
    "price_not_positive": "sku_price <= 0", "price_too_high": "sku_price > 3000000", "position_zero": "sku_position = 0", "position_too_deep": "sku_position > 1000",
    "digits_only_name": "regexp_matches(sku_name, '^\\s*\\d[\\d\\s.,]*$')", "long_query": "length(query) > 120",
    "brand_not_in_name": "trim(sku_brand_name) <> '' AND trim(sku_name) <> '' AND NOT contains(lower(sku_name), lower(sku_brand_name))",
    "mixed_script_query": "regexp_matches(query, '[а-яА-ЯёЁ]') AND regexp_matches(query, '[a-zA-Z]')", "query_is_brand": "lower(trim(query)) = lower(trim(sku_brand_name))",
}


@CORE.add(" UNION ALL ".join(f"SELECT '{k}' AS issue, count_if({c})::BIGINT AS n, round(count_if({c}) / count(*), 6) AS share FROM {Q}" for k, c in _AUDIT.items()))
def dq_audit(spark, sf):
    """All checks of the click log in one pass."""
    return QA.audit(log(spark, sf))


@CORE.add(f"SELECT key, array_to_string(v, '|') AS variants FROM (SELECT lower(trim(sku_brand_name)) AS key, list_sort(list(DISTINCT sku_brand_name)) AS v FROM {Q} WHERE trim(sku_brand_name) <> '' GROUP BY 1) WHERE len(v) > 1")
def dq_case_duplicates(spark, sf):
    """Brands in several spellings by case."""
    return S.collapsing_values(log(spark, sf), "sku_brand_name", F.lower(F.trim("sku_brand_name"))).select("key", F.array_join("variants", "|").alias("variants"))


@CORE.add(f"SELECT key, len(v)::INT AS n FROM (SELECT translate(lower(query), 'асекорхувтмн', 'acekopxybtmh') AS key, list(DISTINCT query) AS v FROM {Q} WHERE trim(query) <> '' GROUP BY 1) WHERE len(v) > 1")
def dq_homoglyph_duplicates(spark, sf):
    """Queries that fall together in the Latin view."""
    return S.collapsing_values(log(spark, sf), "query", T.latin_view(F.col("query"))).select("key", F.size("variants").alias("n"))


_HAVE = "(sku_name IS NOT NULL AND trim(sku_name) <> '')::INT + (sku_brand_name IS NOT NULL AND trim(sku_brand_name) <> '')::INT + (sku_price IS NOT NULL)::INT"


@CORE.add(f"SELECT CASE WHEN h = 3 THEN 'full' WHEN h = 0 THEN 'lost' ELSE 'partial' END AS state, count(*) AS n FROM (SELECT {_HAVE} AS h FROM {Q}) GROUP BY 1")
def dq_completeness(spark, sf):
    """Rows with all, some or none of name, brand and price."""
    return QA.completeness(log(spark, sf), ["sku_name", "sku_brand_name", "sku_price"])


@CORE.add(" UNION ALL ".join(f"SELECT '{c}' AS column_name, round(avg(({c} IS NOT NULL AND trim({c}::VARCHAR) <> '')::INT), 6) AS share FROM flat_catalog" for c in ("name", "brand", "price")))
def field_coverage(spark, sf):
    """Share of catalog items that have each field."""
    return QA.field_coverage(table(spark, sf, "flat_catalog"), ["name", "brand", "price"])


# ---- frequency tables

_SPANS = "(SELECT item_id || '-' || i AS id, e.label AS type, list_transform(regexp_extract_all(lower(e.text), '[\\p{L}\\p{N}]+'), lambda x: CASE WHEN regexp_full_match(x, '[0-9]+') THEN '<num>' ELSE x END) AS t FROM (SELECT item_id, i, entities[i] AS e FROM (SELECT item_id, entities, unnest(generate_series(1, len(entities))) AS i FROM benchmark)))"
_TAB = f"""sp AS {_SPANS}, bg AS (SELECT id, type, i - 1 AS pos, t[i] || '|' || t[i + 1] AS key, t[i] AS a, t[i + 1] AS b FROM (SELECT *, unnest(generate_series(1, len(t) - 1)) AS i FROM sp)),
un AS (SELECT id, type, i - 1 AS pos, t[i] AS key FROM (SELECT *, unnest(generate_series(1, len(t))) AS i FROM sp) WHERE t[i] <> '<num>'),
tb AS (SELECT 'bigram' AS tab, key, type, count(*) AS n FROM bg GROUP BY ALL UNION ALL SELECT 'unit', key, type, count(*) FROM un GROUP BY ALL UNION ALL SELECT 'next', a, b, count(*) FROM bg GROUP BY ALL)"""


def spans(spark, sf):
    e = table(spark, sf, "benchmark").select("item_id", F.posexplode("entities").alias("i", "e"))
    return e.select(F.concat_ws("-", "item_id", F.col("i") + 1).alias("id"), F.regexp_extract_all(F.lower("e.text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("t"), F.col("e.label").alias("type"))


@CORE.add(f"WITH {_TAB} SELECT * FROM tb")
def markov_train(spark, sf):
    """Frequency tables of spans."""
    return K.train(spans(spark, sf))


@CORE.add(f"WITH {_TAB} SELECT 'unit' AS tab, t[-1] AS key, type, count(*) AS n FROM sp WHERE len(t) > 0 AND t[-1] <> '<num>' GROUP BY ALL")
def markov_train_last(spark, sf):
    """Unit table where only the last token of a span is the unit."""
    return K.train(spans(spark, sf), last_unit_only=True).where("tab = 'unit'")


_VOTES = f"""{_TAB}, bv AS (SELECT bg.id, tb.type, sum(tb.n) AS n FROM bg JOIN tb ON tb.tab = 'bigram' AND tb.key = bg.key GROUP BY ALL), bw AS (SELECT id, arg_min(type, (-n, type)) AS type, round(max(n) / sum(n), 6) AS prob FROM bv GROUP BY 1)"""


@CORE.add(f"WITH {_VOTES}, ub AS (SELECT key, arg_min(type, (-n, type)) AS type FROM tb WHERE tab = 'unit' GROUP BY 1), uw AS (SELECT un.id, arg_min(ub.type, (pos, ub.type)) AS type FROM un JOIN ub USING (key) GROUP BY 1) SELECT sp.id, coalesce(bw.type, uw.type, 'unknown') AS type, coalesce(bw.prob, 0)::DOUBLE AS prob FROM sp LEFT JOIN bw USING (id) LEFT JOIN uw USING (id)")
def markov_predict_votes(spark, sf):
    """Types by adding up the votes of all bigrams."""
    s = spans(spark, sf)
    return K.predict_votes(s, K.train(s))


@CORE.add(f"WITH {_VOTES}, uv AS (SELECT un.id, tb.type, sum(tb.n) AS n FROM un JOIN tb ON tb.tab = 'unit' AND tb.key = un.key GROUP BY ALL), uw AS (SELECT id, arg_min(type, (-n, type)) AS type, round(max(n) / sum(n), 6) AS prob FROM uv GROUP BY 1) SELECT sp.id, coalesce(bw.type, uw.type, 'unknown') AS type, coalesce(CASE WHEN bw.type IS NOT NULL THEN bw.prob ELSE uw.prob END, 0)::DOUBLE AS prob FROM sp LEFT JOIN bw USING (id) LEFT JOIN uw USING (id)")
def markov_predict_all_units(spark, sf):
    """Types by votes of bigrams, else of all units."""
    s = spans(spark, sf)
    return K.predict_votes(s, K.train(s), all_units=True)


@CORE.add(f"WITH {_TAB}, kb AS (SELECT tab, key, arg_min(type, (-n, type)) AS type FROM tb GROUP BY 1, 2), b AS (SELECT bg.id, arg_min(kb.type, (pos, kb.type)) AS type FROM bg JOIN kb ON kb.tab = 'bigram' AND kb.key = bg.key GROUP BY 1), u AS (SELECT un.id, arg_min(kb.type, (pos, kb.type)) AS type FROM un JOIN kb ON kb.tab = 'unit' AND kb.key = un.key GROUP BY 1) SELECT sp.id, coalesce(b.type, u.type) AS type FROM sp LEFT JOIN b USING (id) LEFT JOIN u USING (id)")
def markov_predict_first(spark, sf):
    """Types by the first known bigram."""
    s = spans(spark, sf)
    return K.predict_first(s, K.train(s))


@CORE.add(f"WITH {_TAB} SELECT key AS token, type AS next, round(n / sum(n) OVER (PARTITION BY key), 6) AS share FROM tb WHERE tab = 'next'")
def markov_next(spark, sf):
    """Distribution of the next token."""
    return K.next_distribution(K.train(spans(spark, sf)))


@CORE.add(f"WITH {_TAB}, x AS (SELECT key, type, n, row_number() OVER (PARTITION BY key ORDER BY n DESC, type) AS rn FROM tb WHERE tab = 'unit') SELECT key, sum(n)::BIGINT AS total, count(*) AS kinds, string_agg(type || ':' || n, ',' ORDER BY rn) FILTER (WHERE rn <= 4) AS best FROM x GROUP BY 1 HAVING count(*) >= 2 AND sum(n) >= 5")
def markov_ambiguous(spark, sf):
    """Units of several types."""
    return K.ambiguous_keys(K.train(spans(spark, sf)), "unit", least=5)


@CORE.add(f"SELECT part, count(*) AS n FROM (SELECT CASE WHEN rn <= round_even(n * 0.25, 0) THEN 'val' ELSE 'train' END AS part FROM (SELECT row_number() OVER (PARTITION BY type ORDER BY {_md5('id')}, id) AS rn, count(*) OVER (PARTITION BY type) AS n FROM {_SPANS})) GROUP BY 1")
def markov_split(spark, sf):
    """Sizes of the held-out split of spans."""
    return S.value_counts(S.stratified_split(spans(spark, sf).select("id", "type"), "type", ["id"], 0.25), "part")


@CORE.add()
def markov_held_out(spark, sf):
    """Accuracy and unknown rate on held-out spans."""
    s = S.stratified_split(spans(spark, sf), "type", ["id"], 0.25)
    p = K.predict_votes(s.where("part = 'val'"), K.train(s.where("part = 'train'"))).withColumnRenamed("type", "pred")
    return s.where("part = 'val'").join(p, "id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("type") == F.col("pred")).cast("int")), 6).alias("accuracy"), F.round(F.avg((F.col("pred") == "unknown").cast("int")), 6).alias("unknown"))


# ---- mined dictionaries

def _brand_words(spark, sf):
    return table(spark, sf, "brands").select(F.explode(F.split(F.lower("brand"), "[^a-zа-яё0-9]+")).alias("w")).where("length(w) >= 3").distinct()


_BW = "(SELECT DISTINCT w FROM (SELECT unnest(regexp_split_to_array(lower(brand), '[^a-zа-яё0-9]+')) AS w FROM brands) WHERE length(w) >= 3)"


@CORE.add(f"SELECT trim(sku_brand_name) AS brand, count(*) AS n FROM {Q} WHERE NOT regexp_full_match(trim(sku_brand_name), '[0-9]+') AND (length(trim(sku_brand_name)) > 2 OR lower(trim(sku_brand_name)) IN ('lg', 'hp')) GROUP BY 1 HAVING count(*) >= 5 ORDER BY n DESC, 1 LIMIT 5000")
def mined_brands(spark, sf):
    """Brands of the click log."""
    return D.brands(log(spark, sf), "sku_brand_name", 5, ["lg", "hp"])


@CORE.add(f"WITH p AS (SELECT array_to_string(t, ' ') AS phrase, count(*) AS n FROM (SELECT regexp_extract_all(lower(query), '[a-zа-яё0-9]+') AS t FROM {Q}) WHERE len(t) BETWEEN 1 AND 3 GROUP BY 1) SELECT phrase, n FROM p WHERE n >= 20 AND NOT regexp_matches(phrase, '[0-9]|^[a-z]+$') AND NOT list_has_any(string_split(phrase, ' '), (SELECT list(w) FROM {_BW}))")
def mined_categories(spark, sf):
    """Categories from short queries."""
    return D.categories(log(spark, sf), "query", _brand_words(spark, sf))


_OK = "NOT list_bool_and(list_transform(string_split(phrase, ' '), lambda w: regexp_full_match(w, '[0-9]+([.][0-9]+)?'))) AND NOT (NOT contains(phrase, ' ') AND length(phrase) <= 2) AND NOT list_bool_or(list_transform(string_split(phrase, ' '), lambda w: length(regexp_replace(w, '[^0-9]', '', 'g')) >= 3 AND length(regexp_replace(w, '[^a-zа-яё]', '', 'g')) >= 2))"
_MODELS = f"""(SELECT phrase, count(*) AS n FROM (SELECT DISTINCT sku_id, i, array_to_string(t[i + 1:i + k], ' ') AS phrase FROM (SELECT sku_id, t, i, unnest([1, 2, 3, 4]) AS k FROM (SELECT sku_id, t, unnest(generate_series(1, len(t))) AS i FROM (SELECT sku_id, list_filter(regexp_split_to_array(lower(name), '[^a-z0-9а-яё]+'), lambda x: x <> '') AS t FROM flat_catalog)) WHERE t[i] IN (SELECT w FROM {_BW}))
 WHERE i < len(t) AND list_bool_and(list_transform(t[i + 1:i + k], lambda x: regexp_full_match(x, '[a-z0-9]{{1,12}}')))) GROUP BY 1)"""


@CORE.add(f"SELECT phrase, n FROM {_MODELS} WHERE n >= 3 AND {_OK}")
def mined_models(spark, sf):
    """Model phrases behind brands in catalog names."""
    return D.model_phrases(table(spark, sf, "flat_catalog"), "name", _brand_words(spark, sf))


@CORE.add(f"SELECT DISTINCT name AS phrase, regexp_matches(name, '[0-9]{{5,}}') AS long_digits, len(string_split(name, ' ')) >= 5 AS many_tokens, regexp_matches(name, 'чехол|кабель|стекло|case|cable') AS accessory FROM flat_catalog WHERE name IS NOT NULL")
def phrase_flags(spark, sf):
    """Quality flags of catalog names."""
    return table(spark, sf, "flat_catalog").where("name IS NOT NULL").select(F.col("name").alias("phrase"), D.phrase_flags(F.col("name")).alias("f")).select("phrase", "f.*").distinct()


_LEAST = [2, 3, 5, 10, 20]


@CORE.add(" UNION ALL ".join(f"SELECT {g} AS least, count_if(n >= {g})::BIGINT AS n_phrases, round(coalesce(sum(n) FILTER (WHERE n >= {g}), 0) / sum(n), 6) AS covered FROM (SELECT query, count(*) AS n FROM {Q} WHERE query <> '' GROUP BY 1)" for g in _LEAST))
def coverage_sweep(spark, sf):
    """Dictionary size and coverage over least counts."""
    n = log(spark, sf).where("query <> ''").groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    return D.coverage_by_support(n, _LEAST)


# ---- annotations

@CORE.add(f"SELECT candidate_source, pair_id, cand_id, coalesce(label, -1) AS label FROM (SELECT *, row_number() OVER (PARTITION BY candidate_source, pair_id ORDER BY loaded_at DESC, cand_id DESC) AS rn FROM {Q}) WHERE rn = 1")
def annotation_latest(spark, sf):
    """The last delivery of each pair; -1 without a label."""
    return S.latest(log(spark, sf).select("candidate_source", "pair_id", "loaded_at", "cand_id", "label"), ["candidate_source", "pair_id"], ["loaded_at", "cand_id"]).select("candidate_source", "pair_id", "cand_id", F.coalesce("label", F.lit(-1)).alias("label"))


@CORE.add(f"SELECT candidate_source, coalesce(min(cand_id) FILTER (WHERE label IS NULL), 0) AS first_open FROM {Q} GROUP BY 1")
def annotation_first_open(spark, sf):
    """The first unlabelled candidate of each source, 0 when none is left."""
    return log(spark, sf).groupBy("candidate_source").agg(F.coalesce(F.min(F.when(F.col("label").isNull(), F.col("cand_id"))), F.lit(0)).alias("first_open"))


@CORE.add(f"SELECT cand_id, annotator, label FROM {Q} WHERE label IS NOT NULL ORDER BY labeled_at DESC, cand_id DESC LIMIT 50")
def annotation_history(spark, sf):
    """The fifty latest labels."""
    return log(spark, sf).where("label IS NOT NULL").orderBy(F.desc("labeled_at"), F.desc("cand_id")).limit(50).select("cand_id", "annotator", "label")


@CORE.add(f"SELECT cand_id, CASE WHEN sku_name IS NULL OR lower(trim(sku_name)) IN ('', 'nan', 'none') THEN 0 ELSE coalesce(label, -1) END AS label, sku_name IS NULL OR lower(trim(sku_name)) IN ('', 'nan', 'none') AS auto FROM {Q}")
def annotation_auto(spark, sf):
    """Label 0 by itself where there is no name; -1 without a label."""
    auto = F.coalesce(F.lower(F.trim("sku_name")).isin("", "nan", "none"), F.lit(True))
    return log(spark, sf).select("cand_id", F.when(auto, 0).otherwise(F.coalesce("label", F.lit(-1))).alias("label"), auto.alias("auto"))
