"""Queries of fact extraction and catalog ranking, on the benchmark's queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from querymill.operators import facts as X
from querymill.plans.registry import CORE
from querymill.sources.tables import table


def dictionary(spark, sf):
    """Brands, one-token aliases and categories."""
    aliases = table(spark, sf, "spell_aliases")
    return (
        X.phrases(table(spark, sf, "brands"), "brand", "brand")
        .unionByName(X.phrases(aliases, "alias", "alias", "canon"))
        .unionByName(X.phrases(table(spark, sf, "benchmark").select("category"), "category", "category"))
    )


def queries(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "query")


_WS = "[\\s\\p{Z}\\x{85}]+"


def tok(c: str) -> str:
    """SQL of the tokens of a text."""
    key = f"regexp_replace(trim(regexp_replace(translate(lower({c}), 'ё', 'е'), '{_WS}', ' ', 'g')), '(\\p{{Nd}})([a-zа-яёA-ZА-Я]{{1,4}})($|[^\\p{{L}}\\p{{M}}\\p{{N}}_])', '\\1 \\2\\3', 'g')"
    return f"list_filter(regexp_split_to_array({key}, '[^a-zа-я0-9ё.+]+'), lambda x: x <> '')"


def _dict_sql(kind: str, name: str, canonical: str, source: str) -> str:
    return f"SELECT '{kind}' AS kind, array_to_string({tok(name)}, ' ') AS phrase, min({canonical}) AS canonical FROM {source} WHERE {name} IS NOT NULL GROUP BY 1, 2 HAVING phrase <> ''"


_PALETTE = "[" + ", ".join(f"'{c}'" for c in X.COLORS) + "]"
FACTS_SQL = f"""
fd AS ({_dict_sql('brand', 'brand', 'brand', 'brands')} UNION ALL {_dict_sql('alias', 'alias', 'canon', '(SELECT a.alias, a.canon FROM spell_aliases a)')} UNION ALL {_dict_sql('category', 'category', 'category', 'benchmark')}),
fq AS (SELECT item_id AS id, query, {tok('query')} AS t FROM benchmark WHERE query <> ''),
fg AS (SELECT id, n, p - 1 AS pos, array_to_string(t[p:p + n - 1], ' ') AS phrase FROM (SELECT id, t, n, unnest(generate_series(1, len(t) - n + 1)) AS p FROM fq, (SELECT unnest([1, 2, 3]) AS n))),
fh AS (SELECT g.id, kind, g.n, pos, g.phrase, canonical, row_number() OVER (PARTITION BY g.id, kind ORDER BY g.n DESC, pos, g.phrase, canonical) AS rn FROM fg g JOIN fd USING (phrase) WHERE kind <> 'alias' OR n = 1),
f1 AS (SELECT q.id, q.t, b.canonical AS bc, b.phrase AS bp, b.pos + b.n AS bend, a.canonical AS ac, a.phrase AS ap, a.pos + a.n AS aend, c.phrase AS category, c.pos AS cpos, c.n AS cn
 FROM fq q LEFT JOIN fh b ON b.id = q.id AND b.kind = 'brand' AND b.rn = 1 LEFT JOIN fh a ON a.id = q.id AND a.kind = 'alias' AND a.rn = 1 LEFT JOIN fh c ON c.id = q.id AND c.kind = 'category' AND c.rn = 1),
f2 AS (SELECT id, t, coalesce(bc, ac) AS brand, coalesce(bp, ap) AS brand_text, coalesce(bend, aend)::INT AS e, category, cpos, cn, list_sort(list_distinct(list_filter(t, lambda x: list_contains({_PALETTE}, x)))) AS colors FROM f1),
tail AS (SELECT id, i, t[e + i] AS w, (NOT regexp_full_match(t[e + i], '[a-z0-9.+-]+') OR list_contains({_PALETTE}, t[e + i]) OR coalesce(e + i - 1 >= cpos AND e + i - 1 < cpos + cn, false)) AS stop FROM (SELECT *, unnest(generate_series(1, least(4, len(t) - e))) AS i FROM f2 WHERE e IS NOT NULL)),
tail2 AS (SELECT id, array_to_string(list(w ORDER BY i) FILTER (WHERE i < coalesce(s, 99)), ' ') AS model FROM (SELECT *, min(CASE WHEN stop THEN i END) OVER (PARTITION BY id) AS s FROM tail) GROUP BY id),
facts AS (SELECT f2.id, brand, brand_text, category, nullif(model, '') AS model, colors FROM f2 LEFT JOIN tail2 ON tail2.id = f2.id)
"""


@CORE.add(f"WITH {FACTS_SQL} SELECT id, brand, category, model, array_to_string(colors, ' ') AS colors FROM facts")
def query_facts(spark, sf):
    """Brand, category, model and colours of each query."""
    f = X.extract(queries(spark, sf), dictionary(spark, sf))
    return f.select("id", "brand", "category", "model", F.array_join("colors", " ").alias("colors"))


def _rank_sql(w: dict, least: float, top: int) -> str:
    pad = lambda x: f"' ' || {x} || ' '"
    cat = "coalesce(list_has_any(t, string_split(category, ' ')), false)" if w["any_token"] else f"coalesce(contains({pad('nm')}, {pad('category')}), false)"
    return f"""WITH {FACTS_SQL},
i AS (SELECT sku_id, t, array_to_string(t, ' ') AS nm, b FROM (SELECT sku_id, {tok("coalesce(name, '')")} AS t, array_to_string({tok("coalesce(brand, '')")}, ' ') AS b FROM flat_catalog)),
k AS (SELECT DISTINCT brand_text, category, model, colors FROM facts),
k2 AS (SELECT *, list_concat(list_concat(coalesce(string_split(category, ' '), []), coalesce(string_split(model, ' '), [])), colors) AS own FROM k),
s AS (SELECT k2.brand_text, k2.category, k2.model, k2.colors, sku_id, brand_text IS NOT NULL AND (b = brand_text OR contains({pad('nm')}, {pad('brand_text')})) AS bh, {cat} AS ch, coalesce(contains({pad('nm')}, {pad('model')}), false) AS mh,
 len(list_filter(colors, lambda x: list_contains(t, x))) AS ah, CASE WHEN len(own) > 0 AND len(t) > 0 THEN len(list_filter(own, lambda x: list_contains(t, x))) / (sqrt(len(own)) * sqrt(len(t))) ELSE 0 END AS cs
 FROM k2 CROSS JOIN i WHERE list_has_any(list_concat(own, coalesce(string_split(brand_text, ' '), [])), list_concat(t, string_split(b, ' ')))),
z AS (SELECT *, round((CASE WHEN bh THEN {w['brand']} WHEN brand_text IS NOT NULL THEN {w['other']} ELSE 0 END + CASE WHEN ch THEN {w['category']} ELSE 0 END + CASE WHEN mh THEN {w['model']} ELSE 0 END + {w['attribute']} * ah + {w['cosine']} * cs)::DOUBLE, 6) AS score,
 concat_ws('+', CASE WHEN bh THEN 'brand' END, CASE WHEN ch THEN 'category' END, CASE WHEN mh THEN 'model' END, CASE WHEN ah > 0 THEN 'attributes' END) AS why FROM s),
o AS (SELECT *, row_number() OVER (PARTITION BY brand_text, category, model, colors ORDER BY score DESC, sku_id) AS rn, max(score) OVER (PARTITION BY brand_text, category, model, colors) AS best FROM z WHERE score > {least})
SELECT facts.id, o.sku_id, o.score, round(o.score / o.best, 6) AS match, o.why, o.rn FROM facts JOIN o ON o.brand_text IS NOT DISTINCT FROM facts.brand_text AND o.category IS NOT DISTINCT FROM facts.category AND o.model IS NOT DISTINCT FROM facts.model AND o.colors = facts.colors WHERE o.rn <= {top}"""


@CORE.add(_rank_sql(X.NATIVE, 0.15, 30))
def facts_rank_catalog(spark, sf):
    """Facts of each query and the thirty best items for them."""
    return X.rank(X.extract(queries(spark, sf), dictionary(spark, sf)), table(spark, sf, "flat_catalog"))


@CORE.add(_rank_sql(X.SIMPLE, 0.05, 12))
def facts_rank_simple(spark, sf):
    """The twelve best items under the other weighting."""
    return X.rank(X.extract(queries(spark, sf), dictionary(spark, sf)), table(spark, sf, "flat_catalog"), top=12, least=0.05, weights=X.SIMPLE)
