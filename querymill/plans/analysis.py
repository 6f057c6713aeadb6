"""Smaller analyses: coverage, alignment, errors, subtypes, tails, lemmas, pairs for annotators."""

from __future__ import annotations

from pyspark.sql import functions as F

from querymill.functions import attributes as A
from querymill.functions import bio as B
from querymill.functions import text as T
from querymill.operators import analysis as Y
from querymill.operators import cascade as X
from querymill.operators import metrics as M
from querymill.operators import ml
from querymill.operators import stats as S
from querymill.plans.clicks import Q, _md5, log
from querymill.plans.pipelines import _SPANS, spans
from querymill.plans.registry import CORE
from querymill.plans.text import _TAGGED, tagged
from querymill.sources.tables import stage, table


@CORE.add("SELECT sku_id, name AS title, brand FROM flat_catalog")
def description_scan(spark, sf):
    """Column-pruned scan of the item table with renames."""
    return table(spark, sf, "flat_catalog").select("sku_id", F.col("name").alias("title"), "brand")


@CORE.add()
def pattern_coverage(spark, sf):
    """Share of queries that match each kind of attribute pattern, and any, in one pass."""
    return Y.pattern_coverage(log(spark, sf).where("query IS NOT NULL"), F.col("query"))


_POW = "regexp_matches(lower(query), '[0-9] ?(квт|kw|ватт|watt)')"


@CORE.add(f"SELECT round(avg(({_POW})::INT), 6) AS share FROM {Q} WHERE query IS NOT NULL")
def power_share(spark, sf):
    """Share of queries that state a power with a spelt-out unit."""
    return log(spark, sf).where("query IS NOT NULL").agg(F.round(F.avg(F.lower("query").rlike("[0-9] ?(квт|kw|ватт|watt)").cast("int")), 6).alias("share"))


@CORE.add("SELECT k AS param, count(*) AS n FROM (SELECT unnest(map_keys(attributes)) AS k FROM benchmark) GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
def top_parameters(spark, sf):
    """The ten most frequent names of attributes."""
    return S.top_values(table(spark, sf, "benchmark").select(F.explode(F.map_keys("attributes")).alias("param")), "param", 10).withColumnRenamed("value", "param")


@CORE.add("SELECT count(*) AS n, count_if(len(list_filter(regexp_split_to_array(query, '[ \\t\\n\\r\\f]+'), lambda w: w <> '')) = len(regexp_extract_all(query, '[A-Za-zА-Яа-яЁё0-9]+(?:[.\\-/][A-Za-zА-Яа-яЁё0-9]+)*|[^\\s\\x{0B}]')))::BIGINT AS aligned FROM benchmark WHERE query IS NOT NULL")
def token_alignment(spark, sf):
    """Queries whose words by white space are as many as their tokens."""
    w = F.filter(F.split("query", "[ \\t\\n\\r\\f]+"), lambda x: x != "")
    return table(spark, sf, "benchmark").where("query IS NOT NULL").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size(w) == F.size(T.tokens(F.col("query")))).alias("aligned"))


@CORE.add(f"SELECT w AS word, count(*) AS n FROM (SELECT a.item_id, a.pos, max(CASE WHEN a.tag <> 'O' THEN a.pos END) OVER (PARTITION BY a.item_id) AS last, b.w FROM {_TAGGED.replace('{seed}', 'a')} a JOIN (SELECT item_id, i - 1 AS pos, t[i] AS w FROM (SELECT item_id, t, unnest(generate_series(1, len(t))) AS i FROM (SELECT item_id, regexp_extract_all(lower(query), '[a-zа-яё0-9]+') AS t FROM benchmark))) b USING (item_id, pos)) WHERE pos > coalesce(last, -1) GROUP BY 1")
def tail_words(spark, sf):
    """Words behind the last entity, counted."""
    return tagged(spark, sf).select(F.explode(B.tail_after_entities(F.col("words"), F.col("gold"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@CORE.add(f"SELECT label = (sku_position <= 2)::INT AS correct, count(*) AS n, round(avg(confidence), 6) AS mean_confidence, count_if(confidence > 0.8)::BIGINT AS sure, count_if(confidence < 0.5)::BIGINT AS unsure FROM {Q} WHERE label IS NOT NULL AND confidence IS NOT NULL AND sku_position IS NOT NULL GROUP BY 1")
def confidence_of_errors(spark, sf):
    """Confidence of right and wrong decisions, the decision being a position among the first three."""
    df = log(spark, sf).where("label IS NOT NULL AND confidence IS NOT NULL AND sku_position IS NOT NULL")
    return Y.confidence_split(df, F.col("label") == (F.col("sku_position") <= 2).cast("int"), F.col("confidence"))


@CORE.add(f"SELECT a.t AS gold, a.p AS pred, count(*) AS n FROM (SELECT a.tag AS t, b.tag AS p FROM {_TAGGED.replace('{seed}', 'a')} a JOIN {_TAGGED.replace('{seed}', 'b')} b USING (item_id, pos)) a WHERE a.t <> a.p GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 15")
def top_errors(spark, sf):
    """The fifteen most frequent pairs of different tags."""
    p = tagged(spark, sf).select(F.inline(F.arrays_zip("gold", "pred"))).where("gold <> pred")
    return p.groupBy("gold", "pred").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "gold", "pred").limit(15)


@CORE.add(f"WITH s AS (SELECT id, type, t[-1] AS last, row_number() OVER (PARTITION BY type ORDER BY {_md5('id')}, id) <= round_even(count(*) OVER (PARTITION BY type) * 0.25, 0) AND count(*) OVER (PARTITION BY type) > 1 AS val FROM {_SPANS} WHERE len(t) > 0) SELECT DISTINCT last FROM s WHERE val AND last NOT IN (SELECT last FROM s WHERE NOT val)")
def unseen_last_words(spark, sf):
    """Last words of held-out spans that no training span has."""
    s = S.stratified_split(spans(spark, sf).where("size(t) > 0"), "type", ["id"], 0.25, least=0)
    last = s.select("part", F.element_at(F.transform("t", lambda x: F.when(x.rlike("^[0-9]+$"), "<num>").otherwise(x)), -1).alias("last"))
    return last.where("part = 'val'").join(last.where("part = 'train'"), "last", "left_anti").select("last").distinct()


@CORE.add(
    "SELECT count(*) AS n, round(avg((raw = gold)::INT), 6) AS raw_agreement, round(avg((mapped = gold)::INT), 6) AS mapped_agreement, count(DISTINCT CASE WHEN raw NOT IN ('type', 'purpose', 'size', 'quantity', 'other') THEN raw END) AS outside FROM (SELECT sub AS raw, CASE sub WHEN 'gas' THEN 'type' WHEN 'width' THEN 'size' WHEN 'counts' THEN 'quantity' ELSE sub END AS mapped, CASE item_id % 4 WHEN 0 THEN 'type' WHEN 1 THEN 'size' WHEN 2 THEN 'quantity' ELSE 'other' END AS gold FROM (SELECT item_id, CASE item_id % 5 WHEN 0 THEN 'gas' WHEN 1 THEN 'width' WHEN 2 THEN 'counts' WHEN 3 THEN 'plug' ELSE 'type' END AS sub FROM benchmark))"
)
def subtype_agreement(spark, sf):
    """Agreement of annotated subtypes before and after mapping, and how many lie outside the canon; subtypes drawn from ids."""
    i = F.col("item_id")
    pick = lambda n, names: F.element_at(F.array(*[F.lit(x) for x in names]), (i % n + 1).cast("int"))
    d = table(spark, sf, "benchmark").select(pick(5, ["gas", "width", "counts", "plug", "type"]).alias("raw"), pick(4, ["type", "size", "quantity", "other"]).alias("gold"))
    return Y.subtype_agreement(d, F.col("raw"), F.col("gold"), sorted(set(A.CANON.values())))


@CORE.add("SELECT item_id, (SELECT min(x) FROM (SELECT unnest(range(e.span[1], e.span[2])) AS x) WHERE x % 3 = 0) AS first_key FROM (SELECT item_id, entities[1] AS e FROM benchmark WHERE len(entities) > 0)")
def subtype_lookup(spark, sf):
    """For the first entity of each query the first key inside its span, of keys that are multiples of three."""
    b = table(spark, sf, "benchmark").where("size(entities) > 0").select("item_id", F.col("entities")[0]["span"].alias("s"))
    keys = F.map_from_arrays(F.transform(F.sequence(F.lit(0), F.lit(999)), lambda i: i * 3), F.sequence(F.lit(0), F.lit(999)))
    return b.select("item_id", Y.first_key(keys, F.col("s")[0], F.col("s")[1]).cast("long").alias("first_key"))


@CORE.add("SELECT item_id, n, round(hits / n, 6) AS recall FROM (SELECT item_id, len(a) AS n, len(list_filter(a, lambda x: regexp_matches(x.text, '[0-9]'))) AS hits FROM (SELECT item_id, list_filter(entities, lambda e: e.label = 'ATTR') AS a FROM benchmark)) WHERE n >= 2")
def multi_attribute_subset(spark, sf):
    """Of queries with two attributes or more the share with digits."""
    a = F.filter("entities", lambda e: e["label"] == "ATTR")
    return table(spark, sf, "benchmark").select("item_id", a.alias("a")).where("size(a) >= 2").select("item_id", F.size("a").cast("long").alias("n"), F.round(F.size(F.filter("a", lambda e: e["text"].rlike("[0-9]"))) / F.size("a"), 6).alias("recall"))


@CORE.add("SELECT a.item_id, round(sum(a.n * b.n) / (sqrt(any_value(a.s)) * sqrt(any_value(b.s))), 5) AS cosine FROM (SELECT *, sum(n * n) OVER (PARTITION BY item_id) AS s FROM (SELECT item_id, w, count(*) AS n FROM (SELECT item_id, unnest(regexp_extract_all(lower(query), '[a-zа-яё0-9]+')) AS w FROM benchmark) GROUP BY 1, 2)) a JOIN (SELECT *, sum(n * n) OVER (PARTITION BY item_id) AS s FROM (SELECT item_id, w, count(*) AS n FROM (SELECT item_id, unnest(regexp_extract_all(lower(category || ' ' || coalesce(brand, '')), '[a-zа-яё0-9]+')) AS w FROM benchmark) GROUP BY 1, 2)) b USING (item_id, w) GROUP BY 1")
def bag_cosine(spark, sf):
    """Cosine of the words of a query with those of its category and brand, where any is shared."""
    b = table(spark, sf, "benchmark").select("item_id", T.plain_tokens(F.col("query")).alias("a"), T.plain_tokens(F.concat("category", F.lit(" "), F.coalesce("brand", F.lit("")))).alias("b"))
    return b.select("item_id", F.round(Y.bag_cosine(F.col("a"), F.col("b")), 5).alias("cosine")).where("cosine > 0")


_FORMS = [("наушники", "наушник"), ("часы", "час"), ("весы", "вес"), ("окон", "окно"), ("памяти", "память"), ("воздуха", "воздух")]


@CORE.add("SELECT cand_id, i - 1 AS pos, coalesce(l, w) AS lemma FROM (SELECT cand_id, i, t[i] AS w FROM (SELECT cand_id, t, unnest(generate_series(1, len(t))) AS i FROM (SELECT cand_id, regexp_extract_all(lower(query), '[a-zа-яё0-9]+') AS t FROM candidates_to_label))) LEFT JOIN (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _FORMS) + ") f(form, l) ON f.form = w")
def lemmas(spark, sf):
    """Words in their base form by a dictionary of forms, else as they are."""
    d = spark.createDataFrame(_FORMS, "form string, lemma string")
    return Y.lemmas(log(spark, sf).select("cand_id", T.plain_tokens(F.col("query")).alias("t")), d)


@CORE.add(
    f"""WITH q AS (SELECT query FROM (SELECT DISTINCT query FROM {Q} WHERE query <> '') ORDER BY {_md5('query')}, query LIMIT 60),
f AS (SELECT query, sku_id, row_number() OVER (PARTITION BY query ORDER BY coalesce(sku_position, 2147483647), cand_id) AS rn FROM {Q} WHERE label = 1),
r AS (SELECT sku_id, row_number() OVER (ORDER BY {_md5('sku_id')}, sku_id) - 1 AS k FROM flat_catalog), n AS (SELECT query, row_number() OVER (ORDER BY query) - 1 AS k FROM q)
SELECT q.query, coalesce(f.sku_id, r.sku_id) AS sku_id, CASE WHEN f.sku_id IS NULL THEN 'random' ELSE 'clicked' END AS kind FROM q JOIN n USING (query) LEFT JOIN f ON f.query = q.query AND f.rn = 1 JOIN r ON r.k = n.k"""
)
def annotator_pairs(spark, sf):
    """Sampled queries with their first clicked item, or with one drawn at random."""
    q = S.hashed_sample(log(spark, sf).where("query <> ''").select("query").distinct(), ["query"], 60)
    return Y.pairs_to_label(q, log(spark, sf).where("label = 1"), table(spark, sf, "flat_catalog"), 60)


@CORE.add("SELECT item_id, array_to_string(list_transform(range(1, len(e) + 1), lambda i: (CASE WHEN i % 3 = 0 THEN 'I' ELSE 'B' END) || '-' || e[i].label), ' ') AS tags FROM (SELECT item_id, entities AS e FROM benchmark WHERE len(entities) > 0)")
def assembled_tags(spark, sf):
    """Tags put together from parallel arrays of positions and types."""
    b = table(spark, sf, "benchmark").where("size(entities) > 0").select("item_id", F.transform("entities", lambda e, i: F.when((i + 1) % 3 == 0, "I").otherwise("B")).alias("bio"), F.col("entities.label").alias("types"))
    return b.select("item_id", F.array_join(Y.assemble_tags(F.col("bio"), F.col("types")), " ").alias("tags"))


@CORE.add()
def attribute_classifier(spark, sf):
    """Type of held-out attribute spans by the classifier, by the rules where it is unsure or the span looks like a model."""
    rows = X.attribute_rows(table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "query", "entities"))
    own = stage(rows.select("id", F.col("span_text").alias("text"), F.col("type").alias("label"), F.lit(1.0).alias("weight"), F.md5(F.concat_ws("|", "id", "start")).alias("h"), "is_aug"), "spans")
    model = ml.BrandClassifier().fit(own.where("h >= '4'").drop("h"))
    p = model.predict(own.where("h < '4' AND NOT is_aug").drop("h"))
    return p.select("id", "text", "label", "top", F.round("p1", 6).alias("p1"), Y.typed(F.col("text"), F.col("top"), F.col("p1")).alias("type"))


@CORE.add()
def attribute_classifier_report(spark, sf):
    """F1 of the attribute classifier by type."""
    return M.class_report(attribute_classifier(spark, sf), "label", "type")
