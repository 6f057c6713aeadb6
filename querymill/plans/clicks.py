"""Queries over the click log: scans, samples, filters, aggregates, windows, sets.

The click log is ``candidates_to_label``; the catalog is ``flat_catalog``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querymill.functions import text as T
from querymill.operators import clicks as C
from querymill.operators import stats as S
from querymill.operators.skew import order_statistics
from querymill.plans.registry import CORE
from querymill.sources import readers
from querymill.sources.tables import table

Q = "candidates_to_label"


def log(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, Q)


_SP = "[\\s\\p{Z}\\x{85}]+"


def strip_sql(c: str) -> str:
    """SQL of a text without white space at either end."""
    return f"regexp_replace({c}, '^{_SP}|{_SP}$', '', 'g')"


def _md5(*cols: str, seed: str = "42") -> str:
    return "md5(concat_ws('|', " + ", ".join(f"coalesce({c}::VARCHAR, '')" for c in cols) + f", '{seed}'))"


# ---- scans and samples

@CORE.add(f"SELECT sku_id, sku_name, sku_brand_name, sku_price, query AS query_text, sku_position FROM {Q}")
def click_scan(spark, sf):
    """Column-pruned scan with renames."""
    return readers.click_scan(log(spark, sf))


@CORE.add(f"SELECT candidate_source, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY candidate_source ORDER BY {_md5('cand_id')}, cand_id) AS rn FROM {Q}) WHERE rn <= 100 GROUP BY ALL")
def stratified_sample_sizes(spark, sf):
    """Up to 100 rows of each stratum in a fixed random order, counted."""
    return S.value_counts(S.hashed_sample(log(spark, sf), ["cand_id"], 100, ["candidate_source"]), "candidate_source")


@CORE.add(f"SELECT cand_id FROM {Q} ORDER BY {_md5('cand_id')}, cand_id LIMIT 500")
def exact_sample(spark, sf):
    """500 rows in a fixed random order."""
    return S.hashed_sample(log(spark, sf).select("cand_id"), ["cand_id"], 500)


@CORE.add(f"SELECT cand_id FROM (SELECT cand_id, row_number() OVER (ORDER BY {_md5('cand_id')}, cand_id) AS rn, count(*) OVER () AS n FROM {Q}) WHERE rn <= greatest(1, floor(n * 0.01))")
def fraction_sample(spark, sf):
    """One percent of the rows, at least one, in a fixed random order."""
    return readers.fraction(log(spark, sf).select("cand_id"), ["cand_id"], 0.01)


@CORE.add(f"SELECT cand_id, query FROM {Q} ORDER BY cand_id LIMIT 200")
def first_rows(spark, sf):
    """The first 200 rows by id."""
    return log(spark, sf).select("cand_id", "query").orderBy("cand_id").limit(200)


@CORE.add(f"SELECT count(*) AS n_rows FROM {Q}")
def row_count(spark, sf):
    """Rows, without reading a column."""
    return log(spark, sf).agg(F.count(F.lit(1)).alias("n_rows"))


@CORE.add("SELECT name AS column_name FROM (VALUES ('sku_id'), ('name'), ('brand'), ('price')) t(name)")
def schema_names(spark, sf):
    """Column names of the catalog from its schema only."""
    return readers.schema_names(table(spark, sf, "flat_catalog"))


# ---- filters and projections

@CORE.add(f"SELECT * FROM (SELECT cand_id, {strip_sql("coalesce(query, '')")} AS query, length({strip_sql("coalesce(query, '')")}) AS size FROM {Q}) WHERE size BETWEEN 2 AND 120")
def clean_queries(spark, sf):
    """Null as '', trimmed, of 2 to 120 characters."""
    q = T.strip(F.coalesce("query", F.lit("")))
    return log(spark, sf).select("cand_id", q.alias("query")).withColumn("size", F.length("query").cast("long")).where(F.col("size").between(2, 120))


@CORE.add(f"SELECT cand_id, sku_price FROM {Q} WHERE sku_price < (SELECT quantile_cont(sku_price, 0.95) FROM {Q})")
def price_below_p95(spark, sf):
    """Rows below the 95th percentile of the price."""
    return S.below_quantile(log(spark, sf).select("cand_id", "sku_price"), "sku_price", 0.95)


@CORE.add(f"WITH top AS (SELECT sku_brand_name FROM {Q} WHERE trim(sku_brand_name) <> '' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 12) SELECT cand_id, sku_brand_name FROM {Q} SEMI JOIN top USING (sku_brand_name)")
def rows_of_top_brands(spark, sf):
    """Rows of the twelve most frequent brands."""
    return S.in_top(log(spark, sf), "sku_brand_name", 12).select("cand_id", "sku_brand_name")


@CORE.add(f"SELECT count_if(regexp_matches(sku_name, '^\\s*\\d[\\d\\s.,]*$'))::BIGINT AS digits_only_names, count_if(regexp_matches(sku_brand_name, '^\\s*\\d[\\d\\s.,]*$'))::BIGINT AS digits_only_brands FROM {Q}")
def digits_only(spark, sf):
    """Names and brands of digits only."""
    p = r"^\s*\d[\d\s.,]*$"
    return log(spark, sf).agg(F.count_if(F.col("sku_name").rlike(p)).alias("digits_only_names"), F.count_if(F.col("sku_brand_name").rlike(p)).alias("digits_only_brands"))


@CORE.add(
    "SELECT CASE WHEN regexp_matches(query, '[а-яА-ЯёЁ]') AND regexp_matches(query, '[a-zA-Z]') THEN 'mixed' WHEN regexp_matches(query, '[а-яА-ЯёЁ]') THEN 'cyrillic' WHEN regexp_matches(query, '[a-zA-Z]') THEN 'latin' ELSE 'none' END AS script,"
    f" count(*) AS n FROM {Q} WHERE query IS NOT NULL GROUP BY 1"
)
def query_scripts(spark, sf):
    """Queries by script."""
    q = F.col("query")
    s = F.when(T.mixed_script(q), "mixed").when(T.has_cyrillic(q), "cyrillic").when(T.has_latin(q), "latin").otherwise("none")
    return log(spark, sf).where(q.isNotNull()).groupBy(s.alias("script")).agg(F.count(F.lit(1)).alias("n"))


@CORE.add(f"SELECT count_if(contains(lower(query), lower(sku_brand_name)))::BIGINT AS brand_in_query, count_if(contains(lower(sku_name), lower(sku_brand_name)))::BIGINT AS brand_in_name, count(*) AS n FROM {Q} WHERE sku_brand_name <> ''")
def containment(spark, sf):
    """How often the brand stands in the query and in the name."""
    b = F.lower("sku_brand_name")
    return log(spark, sf).where("sku_brand_name <> ''").agg(F.count_if(F.lower("query").contains(b)).alias("brand_in_query"), F.count_if(F.lower("sku_name").contains(b)).alias("brand_in_name"), F.count(F.lit(1)).alias("n"))


_WORDS = "regexp_extract_all(lower(query), '[\\p{L}\\p{N}_]+')"


@CORE.add(
    f"SELECT cand_id FROM {Q} WHERE sku_brand_name <> '' AND contains(' ' || trim(regexp_replace(lower(query), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) || ' ', ' ' || trim(regexp_replace(lower(sku_brand_name), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) || ' ')"
)
def whole_word_brand(spark, sf):
    """Rows whose query holds the brand as whole words."""
    t = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", " "))
    pad = lambda c: F.concat(F.lit(" "), t(c), F.lit(" "))
    return log(spark, sf).where("sku_brand_name <> ''").where(pad("query").contains(pad("sku_brand_name"))).select("cand_id")


@CORE.add(
    f"SELECT brand_key, n, CASE WHEN n < 60 THEN 'UNKNOWN' ELSE brand_key END AS class FROM (SELECT lower(sku_brand_name) AS brand_key, count(*) AS n FROM {Q} WHERE trim(sku_brand_name) <> '' GROUP BY 1)"
)
def rare_class_remap(spark, sf):
    """Brands of few rows as UNKNOWN."""
    n = log(spark, sf).where(~T.missing(F.col("sku_brand_name"))).groupBy(F.lower("sku_brand_name").alias("brand_key")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("class", F.when(F.col("n") < 60, "UNKNOWN").otherwise(F.col("brand_key")))


@CORE.add(
    f"WITH c AS (SELECT lower(sku_brand_name) AS class, count(*) AS n FROM {Q} WHERE trim(sku_brand_name) <> '' GROUP BY 1) SELECT class, n FROM c WHERE n >= 20 OR (class IN ('kava', 'teta') AND n >= 15)"
)
def supported_classes(spark, sf):
    """Classes of at least 20 rows, special ones from 15."""
    return C.supported_classes(log(spark, sf).where(~T.missing(F.col("sku_brand_name"))), F.lower("sku_brand_name"), 20, ["kava", "teta"], 15)


@CORE.add(f"SELECT cand_id, greatest(0.35, least(1.0, confidence)) AS weight, CASE WHEN label = 1 THEN 1.0 WHEN label = 0 THEN 0.9 ELSE greatest(0.35, least(1.0, confidence)) END AS sample_weight FROM {Q} WHERE confidence IS NOT NULL")
def clipped_weights(spark, sf):
    """Confidence clipped to 0.35 to 1, and fixed weights of labelled rows."""
    w = F.greatest(F.lit(0.35), F.least(F.lit(1.0), F.col("confidence")))
    return log(spark, sf).where("confidence IS NOT NULL").select("cand_id", w.alias("weight"), F.when(F.col("label") == 1, 1.0).when(F.col("label") == 0, 0.9).otherwise(w).alias("sample_weight"))


# ---- aggregates

for _col, _name in (("query", "top_queries"), ("sku_brand_name", "top_brands"), ("candidate_source", "top_sources")):

    def _top(spark, sf, _col=_col):
        return S.top_values(log(spark, sf), _col, 20)

    _top.__doc__ = f"The 20 most frequent values of {_col}."
    CORE.add(f"SELECT {_col} AS value, count(*) AS n FROM {Q} WHERE trim({_col}) <> '' GROUP BY 1 ORDER BY n DESC, 1 LIMIT 20", name=_name)(_top)


@CORE.add(
    f"SELECT count(*) AS n_rows, count(DISTINCT query) AS n_queries, count(DISTINCT sku_id) AS n_skus, count(DISTINCT sku_brand_name) AS n_brands, round(avg(sku_position), 6) AS mean_position, quantile_cont(sku_position::DOUBLE, 0.5) AS median_position, round(avg(sku_price), 4) AS mean_price FROM {Q}"
)
def click_profile(spark, sf):
    """Row and distinct counts, mean and median."""
    one = log(spark, sf).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("query").alias("n_queries"), F.count_distinct("sku_id").alias("n_skus"), F.count_distinct("sku_brand_name").alias("n_brands"),
        F.round(F.avg("sku_position"), 6).alias("mean_position"), F.round(F.avg("sku_price"), 4).alias("mean_price"),
    )
    return one.crossJoin(order_statistics(log(spark, sf), [], "sku_position", [0.5]).select(F.col("q0").alias("median_position")))


_PROFILED = ["query", "sku_name", "sku_brand_name", "sku_price", "notes", "annotator", "label"]


@CORE.add(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count_if({c} IS NULL)::BIGINT AS n_null, count_if(trim({c}::VARCHAR) = '')::BIGINT AS n_blank, round((count_if({c} IS NULL)::BIGINT + count_if(trim({c}::VARCHAR) = '')::BIGINT) / count(*), 6) AS share_missing FROM {Q}" for c in _PROFILED))
def missing_values(spark, sf):
    """Null and blank counts of several columns in one pass."""
    return S.missing_profile(log(spark, sf), _PROFILED)


_DESC = "count(x) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd, min(x) AS low, round(quantile_cont(x, 0.25), 6) AS q25, round(quantile_cont(x, 0.5), 6) AS q50, round(quantile_cont(x, 0.75), 6) AS q75, max(x) AS high"


@CORE.add(f"SELECT candidate_source, {_DESC} FROM (SELECT candidate_source, sku_price AS x FROM {Q} WHERE sku_price > 0) GROUP BY 1")
def price_summary(spark, sf):
    """Summary of positive prices per source."""
    return S.describe(log(spark, sf).where("sku_price > 0"), "sku_price", ["candidate_source"])


_SHARES = [0.5, 0.9, 0.95, 0.98, 0.99]


@CORE.add(" UNION ALL ".join(f"SELECT {q}::DOUBLE AS share, round(quantile_cont(length(query)::DOUBLE, {q}), 6) AS value FROM {Q}" for q in _SHARES))
def query_length_quantiles(spark, sf):
    """Exact quantiles of the length of queries."""
    return S.quantiles(log(spark, sf).select(F.length("query").alias("size")), "size", _SHARES)


@CORE.add(f"SELECT count(*) AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT query, sku_id, sku_name, sku_brand_name, sku_position, sku_price FROM {Q})) AS n_distinct, count(*) - (SELECT count(*) FROM (SELECT DISTINCT query, sku_id, sku_name, sku_brand_name, sku_position, sku_price FROM {Q})) AS n_duplicate FROM {Q}")
def duplicate_rows(spark, sf):
    """Rows that repeat another one in all content columns."""
    return S.duplicate_rows(log(spark, sf), ["query", "sku_id", "sku_name", "sku_brand_name", "sku_position", "sku_price"])


@CORE.add(f"SELECT count(*) AS n_groups, round(avg((k >= 2)::INT), 6) AS share_several FROM (SELECT query, count(DISTINCT sku_brand_name) AS k FROM {Q} GROUP BY query)")
def ambiguous_queries(spark, sf):
    """Share of queries with two or more brands."""
    return S.distinct_per_group(log(spark, sf), "query", "sku_brand_name")


@CORE.add(f"SELECT sku_position, median(sku_price) AS median_price, count(*) AS n FROM {Q} WHERE sku_price > 0 GROUP BY 1")
def price_by_position(spark, sf):
    """Median price by position."""
    return order_statistics(log(spark, sf).where("sku_price > 0"), ["sku_position"], "sku_price", [0.5]).select("sku_position", F.col("q0").alias("median_price"), "n")


@CORE.add(f"SELECT sku_brand_name, round(avg((sku_position <= 2)::INT), 6) AS top3_share, count(*) AS n FROM {Q} WHERE sku_brand_name <> '' GROUP BY 1 HAVING count(*) >= 20")
def brand_top3_share(spark, sf):
    """Share of clicks on the first three positions per brand."""
    return log(spark, sf).where("sku_brand_name <> ''").groupBy("sku_brand_name").agg(F.round(F.avg((F.col("sku_position") <= 2).cast("int")), 6).alias("top3_share"), F.count(F.lit(1)).alias("n")).where("n >= 20")


def _topn(col: str, k: int) -> str:
    return f"(SELECT {col} FROM {Q} WHERE trim({col}) <> '' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT {k})"


@CORE.add(
    f"SELECT r.query, c.sku_brand_name, coalesce(n, 0) AS n, round(ln(1 + coalesce(n, 0)), 6) AS log_n FROM {_topn('query', 12)} r CROSS JOIN {_topn('sku_brand_name', 10)} c LEFT JOIN (SELECT query, sku_brand_name, count(*) AS n FROM {Q} GROUP BY ALL) x ON x.query = r.query AND x.sku_brand_name = c.sku_brand_name"
)
def query_brand_crosstab(spark, sf):
    """Contingency of frequent queries and brands."""
    return S.crosstab(log(spark, sf), "query", "sku_brand_name", 12, 10)


@CORE.add(f"SELECT sku_brand_name, count_if(label = 0)::BIGINT AS label_0, count_if(label = 1)::BIGINT AS label_1 FROM {Q} WHERE label IS NOT NULL AND sku_brand_name <> '' GROUP BY 1")
def label_pivot(spark, sf):
    """Labels per brand as columns."""
    return C.label_pivot(log(spark, sf).where("label IS NOT NULL AND sku_brand_name <> ''"), "sku_brand_name", "label", [0, 1])


@CORE.add(f"SELECT least(19, floor((greatest(0, least(100000, sku_price)) - 0) / 5000))::INT AS bin, count(*) AS n FROM {Q} WHERE sku_price IS NOT NULL GROUP BY 1")
def price_histogram(spark, sf):
    """Prices in 20 bins, the tail in the last."""
    return S.histogram(log(spark, sf), "sku_price", 0, 100_000, 20)


@CORE.add(f"SELECT floor(sku_position / 2)::BIGINT AS x_bin, floor(sku_price / 2000)::BIGINT AS y_bin, count(*) AS n FROM {Q} WHERE sku_position IS NOT NULL AND sku_price IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3")
def position_price_density(spark, sf):
    """Rows in rectangles of position and price."""
    return S.density(log(spark, sf), "sku_position", "sku_price", 2, 2000, 3)


_STOP = ["для", "или", "под", "the", "and", "with"]
_WORD_SQL = f"SELECT unnest(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}]+')) AS word FROM {Q}"


def _query_words():
    return F.regexp_extract_all(F.lower("query"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


@CORE.add(f"SELECT word, count(*) AS n FROM ({_WORD_SQL}) WHERE length(word) >= 3 AND NOT regexp_full_match(word, '[0-9]+') AND word NOT IN ({', '.join(repr(w) for w in _STOP)}) GROUP BY 1")
def word_frequency(spark, sf):
    """Words of queries without stop words, digits and short words."""
    return S.word_counts(log(spark, sf), _query_words(), 3, _STOP)


@CORE.add(f"SELECT a AS first, b AS second, count(*) AS n FROM (SELECT unnest(w[1:-2]) AS a, unnest(w[2:]) AS b FROM (SELECT regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}]+') AS w FROM {Q}) WHERE len(w) > 1) GROUP BY 1, 2")
def bigram_frequency(spark, sf):
    """Neighbouring words of queries."""
    return S.bigram_counts(log(spark, sf), _query_words())


_VOTE = f"""
WITH raw AS (SELECT lower(query) AS query_norm, query AS query_raw, brand, pos FROM (SELECT {strip_sql('query')} AS query, {strip_sql('sku_brand_name')} AS brand, coalesce(sku_position, 99) AS pos FROM {Q}) WHERE length(query) >= 2 AND length(brand) >= 2),
w AS (SELECT query_norm, brand, sum(1.0::DOUBLE / (1 + greatest(pos, 0))) AS w, count(*) AS n FROM raw GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_norm ORDER BY round(w, 9) DESC, n DESC, brand) AS rn FROM w),
m AS (SELECT query_norm, query_raw, row_number() OVER (PARTITION BY query_norm ORDER BY count(*) DESC, query_raw) AS rn FROM raw GROUP BY 1, 2),
a AS (SELECT query_norm, max(CASE WHEN rn = 1 THEN brand END) AS click_brand, round(max(CASE WHEN rn = 1 THEN w END) / sum(w), 6) AS confidence, sum(n)::BIGINT AS n_clicks, count(*) AS n_brands,
 max(CASE WHEN rn = 2 THEN brand END) AS runner_up, round((max(CASE WHEN rn = 1 THEN w END) - coalesce(max(CASE WHEN rn = 2 THEN w END), 0)) / sum(w), 6) AS weight_margin FROM r GROUP BY 1)
SELECT a.*, m.query_raw FROM a JOIN m ON a.query_norm = m.query_norm AND m.rn = 1
"""


@CORE.add(_VOTE)
def brand_majority(spark, sf):
    """Position-weighted majority brand per query, with confidence, runner-up and margin."""
    return C.brand_vote(C.votes(log(spark, sf)))


@CORE.add(f"SELECT query, sku_brand_name AS brand FROM (SELECT query, sku_brand_name, row_number() OVER (PARTITION BY query ORDER BY count(*) DESC, sku_brand_name) AS rn FROM {Q} WHERE query <> '' AND sku_brand_name <> '' GROUP BY 1, 2) WHERE rn = 1")
def simple_majority(spark, sf):
    """Most frequent brand per query, ties by name."""
    return C.most_frequent(log(spark, sf).where("query <> '' AND sku_brand_name <> ''"), "query", "sku_brand_name").withColumnRenamed("sku_brand_name", "brand")


@CORE.add(f"SELECT sku_brand_name AS brand, sum(1)::BIGINT AS clicks FROM {Q} WHERE sku_brand_name <> '' GROUP BY 1 ORDER BY clicks DESC, 1 LIMIT 60")
def closed_brand_set(spark, sf):
    """The 60 brands of most clicks."""
    return log(spark, sf).where("sku_brand_name <> ''").groupBy(F.col("sku_brand_name").alias("brand")).agg(F.count(F.lit(1)).alias("clicks")).orderBy(F.desc("clicks"), "brand").limit(60)


# ---- windows, sorts, sets

@CORE.add(f"WITH c AS (SELECT sku_position AS value, count(*) AS n FROM {Q} WHERE sku_position IS NOT NULL GROUP BY 1) SELECT value, n, round(n / sum(n) OVER (), 6) AS share, round(sum(n) OVER (ORDER BY value) / sum(n) OVER (), 6) AS running FROM c")
def position_cumulative(spark, sf):
    """Cumulative share of clicks by position."""
    return S.cumulative_share(log(spark, sf), "sku_position")


@CORE.add(f"SELECT query, cand_id, sku_id FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sku_position, cand_id) AS rn FROM {Q} WHERE query <> '') WHERE rn = 1")
def first_click(spark, sf):
    """The first click of each query by position."""
    return C.first_click(log(spark, sf).where("query <> ''"))


@CORE.add(f"SELECT candidate_source, query, n, rn FROM (SELECT candidate_source, query, count(*) AS n, row_number() OVER (PARTITION BY candidate_source ORDER BY count(*) DESC, query) AS rn FROM {Q} WHERE query <> '' GROUP BY 1, 2) WHERE rn <= 5")
def top_queries_per_source(spark, sf):
    """The five most frequent queries of each source."""
    return C.top_per_group(log(spark, sf).where("query <> ''"), "candidate_source", "query", 5)


@CORE.add(
    f"SELECT candidate_source, part, count(*) AS n FROM (SELECT candidate_source, CASE WHEN n > 1 AND rn <= greatest(1, round_even(n * 0.2, 0)) THEN 'val' ELSE 'train' END AS part FROM (SELECT candidate_source, count(*) OVER (PARTITION BY candidate_source) AS n, row_number() OVER (PARTITION BY candidate_source ORDER BY {_md5('cand_id')}, cand_id) AS rn FROM {Q})) GROUP BY 1, 2"
)
def split_sizes(spark, sf):
    """Sizes of a stratified split of a fifth."""
    return S.value_counts(S.stratified_split(log(spark, sf).select("cand_id", "candidate_source"), "candidate_source", ["cand_id"], 0.2), "candidate_source", "part")


@CORE.add(
    f"SELECT brand, part, count(*) AS n FROM (SELECT brand, CASE WHEN n >= 2 AND rn <= round_even(n * 0.2, 0) THEN 'val' ELSE 'train' END AS part FROM (SELECT lower(brand) AS brand, count(*) OVER (PARTITION BY lower(brand)) AS n, row_number() OVER (PARTITION BY lower(brand) ORDER BY {_md5('item_id')}, item_id) AS rn FROM benchmark WHERE brand <> '')) GROUP BY 1, 2"
)
def split_sizes_small_classes(spark, sf):
    """A split in which a small class may have no validation row."""
    b = table(spark, sf, "benchmark").where("brand <> ''").select("item_id", F.lower("brand").alias("brand"))
    return S.value_counts(S.stratified_split(b, "brand", ["item_id"], 0.2, least=0), "brand", "part")


@CORE.add(f"SELECT part, count(*) AS n FROM (SELECT CASE WHEN rn <= greatest(1, floor(n * 0.15)) THEN 'val' ELSE 'train' END AS part FROM (SELECT row_number() OVER (ORDER BY {_md5('item_id')}, item_id) AS rn, count(*) OVER () AS n FROM benchmark)) GROUP BY 1")
def simple_split(spark, sf):
    """A shuffled split of 15 percent."""
    b = table(spark, sf, "benchmark").select("item_id")
    val = readers.fraction(b, ["item_id"], 0.15).withColumn("part", F.lit("val"))
    return S.value_counts(b.join(val, "item_id", "left").select(F.coalesce("part", F.lit("train")).alias("part")), "part")


@CORE.add(f"SELECT DISTINCT query, sku_brand_name FROM {Q} WHERE query <> ''")
def distinct_pairs(spark, sf):
    """Distinct pairs of query and brand."""
    return log(spark, sf).where("query <> ''").select("query", "sku_brand_name").distinct()


@CORE.add(f"SELECT lower(brand) AS phrase FROM brands UNION SELECT lower(sku_brand_name) FROM {Q} WHERE sku_brand_name <> ''")
def seeds_and_mined(spark, sf):
    """Union of the reference list and the mined brands."""
    mined = log(spark, sf).where("sku_brand_name <> ''").select(F.lower("sku_brand_name").alias("phrase"))
    return table(spark, sf, "brands").select(F.lower("brand").alias("phrase")).union(mined).distinct()


@CORE.add(
    f"SELECT cand_id, round(len(list_intersect(a, b)) / greatest(1, len(list_distinct(a || b))), 6) AS jaccard FROM (SELECT cand_id, regexp_extract_all(lower(query), '[a-zа-яё0-9]+') AS a, regexp_extract_all(lower(sku_name), '[a-zа-яё0-9]+') AS b FROM {Q} WHERE query IS NOT NULL AND sku_name IS NOT NULL)"
)
def token_jaccard(spark, sf):
    """Shared words of query and name."""
    return log(spark, sf).where("query IS NOT NULL AND sku_name IS NOT NULL").select("cand_id", F.round(T.jaccard(T.plain_tokens(F.col("query")), T.plain_tokens(F.col("sku_name"))), 6).alias("jaccard"))


_CAPS = [("random_negative", 0.18, 200), ("deep_position", 0.12, 150)]


@CORE.add(
    f"""WITH a AS (SELECT cand_id, candidate_source AS s, row_number() OVER (PARTITION BY candidate_source ORDER BY {_md5('cand_id')}, cand_id) AS rn FROM {Q}),
b AS (SELECT * FROM a WHERE s <> 'random_negative' OR rn <= (SELECT greatest(200, floor(0.18 * count(*) / (1 - 0.18))::INT) FROM a WHERE s <> 'random_negative')),
c AS (SELECT * FROM b WHERE s <> 'deep_position' OR rn <= (SELECT greatest(150, floor(0.12 * count(*) / (1 - 0.12))::INT) FROM b WHERE s <> 'deep_position'))
SELECT s AS candidate_source, count(*) AS n FROM c GROUP BY 1"""
)
def balanced_classes(spark, sf):
    """Class sizes after balancing caps."""
    df = log(spark, sf).select("cand_id", "candidate_source").where("candidate_source IS NOT NULL")
    return S.value_counts(S.capped_classes(df, "candidate_source", ["cand_id"], _CAPS), "candidate_source")


@CORE.add(
    f"""WITH q AS (SELECT query FROM (SELECT DISTINCT query FROM {Q} WHERE query <> '') ORDER BY {_md5('query')}, query LIMIT 30),
s AS (SELECT sku_id FROM flat_catalog ORDER BY {_md5('sku_id')}, sku_id LIMIT 40),
x AS (SELECT q.query, s.sku_id, row_number() OVER (PARTITION BY q.query ORDER BY {_md5('q.query', 's.sku_id')}, s.sku_id) AS rn FROM q CROSS JOIN s WHERE NOT EXISTS (SELECT 1 FROM {Q} c WHERE c.query = q.query AND c.sku_id = s.sku_id))
SELECT query, sku_id FROM x WHERE rn = 1"""
)
def hard_negatives(spark, sf):
    """For sampled queries one sampled item that was never clicked for them."""
    queries = S.hashed_sample(log(spark, sf).where("query <> ''").select("query").distinct(), ["query"], 30)
    items = S.hashed_sample(table(spark, sf, "flat_catalog").select("sku_id"), ["sku_id"], 40)
    return C.negatives(queries, items, log(spark, sf))


@CORE.add(
    f"""WITH t AS (SELECT cand_id, query, sku_id, 'top' AS kind, row_number() OVER (ORDER BY {_md5('cand_id')}, cand_id) AS rn FROM {Q} WHERE sku_position <= 2 AND query <> ''),
d AS (SELECT cand_id, query, sku_id, 'deep' AS kind, row_number() OVER (ORDER BY {_md5('cand_id')}, cand_id) AS rn FROM {Q} WHERE sku_position >= 8 AND query <> '')
SELECT query, sku_id, min(kind) AS kind FROM (SELECT * FROM t WHERE rn <= 100 UNION ALL SELECT * FROM d WHERE rn <= 100) GROUP BY 1, 2"""
)
def relevance_candidates(spark, sf):
    """Sampled pairs of top and deep positions, each pair once."""
    return C.relevance_candidates(log(spark, sf).where("query <> ''"), 2, 8, 100)


@CORE.add(
    f"""WITH u AS (SELECT DISTINCT query FROM {Q} WHERE query <> ''), o AS (SELECT query, row_number() OVER (ORDER BY {_md5('query')}, query) - 1 AS rn FROM u)
SELECT query, 'annotator_' || (rn // 50)::VARCHAR AS annotator FROM o WHERE rn < 150"""
)
def assignment(spark, sf):
    """Three annotators with fifty queries each, none twice."""
    return C.assignment(log(spark, sf).where("query <> ''"), "query", 3, 50)
