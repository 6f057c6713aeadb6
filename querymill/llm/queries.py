"""Queries of the text problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querymill.llm.copies import collapse
from querymill.llm.entities import Reference
from querymill.llm.frequency import marked, term_counts
from querymill.llm.languages import document_languages, mislabelled, segments, train
from querymill.llm.leaks import leaks
from querymill.llm.lookalikes import plain_rows
from querymill.llm.packing import CAPACITY, pack, token_counts
from querymill.llm.percentiles import ValueStore, delivered_once
from querymill.operators.skew import salted_join
from querymill.plans.registry import Register
from querymill.sources.tables import stage, table

LLM = Register()

TERM_FIELDS = ["query", "sku_name"]
_TERMS = " UNION ALL ".join(
    f"SELECT '{f}' AS field, term, sum(k)::BIGINT AS n, count(*)::BIGINT AS n_records FROM (SELECT cand_id, term, count(*) AS k FROM"
    f" (SELECT cand_id, unnest(regexp_extract_all(lower({f}), '[\\p{{L}}\\p{{Nd}}]+')) AS term FROM candidates_to_label) GROUP BY cand_id, term) GROUP BY term"
    for f in TERM_FIELDS
)
_MARKED = (
    f"SELECT field, term, n, n_records, CASE WHEN n <= 2 THEN 'rare' WHEN n_records >= 0.02 * (SELECT count(*) FROM candidates_to_label) THEN 'common' END AS mark FROM ({_TERMS})"
)


def _marked_terms(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "candidates_to_label")
    return marked(term_counts(df, TERM_FIELDS), df.count())


@LLM.add(f"SELECT field, row_number() OVER (ORDER BY encode(field), encode(term)) - 1 AS term_id, term, n, n_records, mark FROM ({_MARKED})")
def p4_term_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Occurrences and candidate rows of every term, its number and its mark."""
    return _marked_terms(spark, sf)


@LLM.add(f"SELECT field, term, mark FROM ({_MARKED}) WHERE mark IS NOT NULL")
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Terms too rare or too common."""
    return _marked_terms(spark, sf).where("mark IS NOT NULL").select("field", "term", "mark")


_RECORDS = (
    "SELECT cand_id, min(cand_id) OVER (PARTITION BY sku_id, w) AS keep_id, count(*) OVER (PARTITION BY sku_id, w) AS n_copies FROM"
    " (SELECT cand_id, sku_id, array_to_string(list_sort(regexp_extract_all(lower(coalesce(query, '')), '[\\p{L}\\p{Nd}]+')), ' ') AS w FROM candidates_to_label WHERE sku_id IS NOT NULL)"
)


def _collapsed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return collapse(table(spark, sf, "candidates_to_label"), "cand_id", "query", ["sku_id"])


@LLM.add(f"SELECT DISTINCT keep_id, n_copies FROM ({_RECORDS})")
def p5_records(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each record, with the number of its copies."""
    return _collapsed(spark, sf)[0]


@LLM.add(f"SELECT keep_id, cand_id AS dup_id FROM ({_RECORDS}) WHERE cand_id <> keep_id")
def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Each further copy and the record it belongs to."""
    return _collapsed(spark, sf)[1]


SIDES = {"server": "server_ms", "client": "client_ms"}
LIMITS = {"server": 100.0, "client": 150.0}
SHARES = [0.5, 0.9, 0.95, 0.99]
_ONCE = " UNION ALL ".join(
    f"SELECT '{s}' AS side, arg_min(suite, row_id) AS suite, arg_min(run_day, row_id) AS run_day, arg_min({c}, row_id) AS value FROM latency_sla_rows WHERE ok AND {c} IS NOT NULL GROUP BY call_id"
    for s, c in SIDES.items()
)
_RANKED = f"SELECT *, row_number() OVER (PARTITION BY side, suite, run_day ORDER BY value) AS r, count(*) OVER (PARTITION BY side, suite, run_day) AS n FROM (SELECT * FROM ({_ONCE}) UNION ALL SELECT side, suite, '*' AS run_day, value FROM ({_ONCE}))"


def _latency(spark: SparkSession, sf: str) -> ValueStore:
    calls = table(spark, sf, "latency_sla_rows")
    return ValueStore(delivered_once(calls, SIDES, ["suite", "run_day"], F.col("ok")), ["side", "suite", "run_day"])


@LLM.add(
    "SELECT suite, run_day, side, n, "
    + ", ".join(f"max(CASE WHEN r = greatest(1, ceil({q} * n - 1e-9)) THEN value END) AS p{q * 100:.0f}" for q in SHARES)
    + f" FROM ({_RANKED}) GROUP BY suite, run_day, side, n"
)
def p7_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles of the times per suite and run_day and, as run_day '*', per suite over all days; no rank error."""
    store = _latency(spark, sf)
    wanted: dict[tuple, list[tuple]] = {}
    for side, suite, day in store.sizes:
        wanted.setdefault((suite, day, side), []).append((side, suite, day))
        wanted.setdefault((suite, "*", side), []).append((side, suite, day))
    got = store.percentiles(wanted, SHARES)
    rows = [(*g, sum(store.sizes[m] for m in members), *(got[g, q] for q in SHARES)) for g, members in wanted.items()]
    cols = ", ".join(f"p{q * 100:.0f} double" for q in SHARES)
    return spark.createDataFrame(rows, f"suite string, run_day string, side string, n long, {cols}")


@LLM.add(
    f"SELECT suite, run_day, side FROM ({_RANKED}) WHERE run_day <> '*' AND r = greatest(1, ceil(0.95 * n - 1e-9)) AND value > CASE side WHEN 'server' THEN {LIMITS['server']} ELSE {LIMITS['client']} END"
)
def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Suites and days whose 95th percentile is over the limit."""
    store = _latency(spark, sf)
    got = store.percentiles({g: [g] for g in store.sizes}, [0.95])
    rows = [(suite, day, side) for ((side, suite, day), _), v in got.items() if v > LIMITS[side]]
    return spark.createDataFrame(rows, "suite string, run_day string, side string")


@LLM.add()
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose query only looks like plainly typed text, with the plain text."""
    keys = {"candidates_to_label": "cand_id", "latency_sla_rows": "row_id", "benchmark": "item_id"}
    parts = [table(spark, sf, t).select(F.lit(t).alias("tab"), F.col(k).alias("row_id"), F.col("query").alias("text")) for t, k in keys.items()]
    return plain_rows(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@LLM.add()
def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """The entry of brands that each typed brand means (0 for none) and that each candidate's query names."""
    brands = table(spark, sf, "brands").select(F.col("brand_id").alias("entry_id"), F.col("brand").alias("name"))
    aliases = table(spark, sf, "spell_aliases").join(brands, F.col("canon") == F.col("name")).select("entry_id", "alias")
    typed = table(spark, sf, "benchmark").where("brand <> ''").select(F.lit("benchmark").alias("tab"), F.col("item_id").alias("row_id"), F.col("brand").alias("text"))
    named = table(spark, sf, "candidates_to_label").where("query <> ''").select(F.lit("candidates_to_label").alias("tab"), F.col("cand_id").alias("row_id"), F.col("query").alias("text"))
    rows = typed.unionByName(named)
    found = salted_join(rows, Reference(brands, aliases).match(rows), ["text"], "left")
    return found.select("tab", "row_id", F.coalesce("entry_id", F.lit(0).cast("long")).alias("brand_id")).where("tab = 'benchmark' OR brand_id > 0")


@LLM.add()
def p8_containers(spark: SparkSession, sf: str) -> DataFrame:
    """Each document's container of 2,048 tokens."""
    return pack(token_counts(table(spark, sf, "documents"))).select("doc_id", "part", F.col("size").alias("n_tokens"), "container")


@LLM.add()
def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Containers, tokens and the share of room used."""
    per = p8_containers(spark, sf).groupBy("container").agg(F.sum("n_tokens").alias("fill"), F.count(F.lit(1)).alias("n_parts"))
    return per.agg(F.count(F.lit(1)).alias("n_containers"), F.sum("n_parts").alias("n_parts"), F.sum("fill").alias("n_tokens"), F.max("fill").alias("fullest"), F.avg(F.col("fill") / CAPACITY).alias("used"))


@LLM.add("SELECT count(DISTINCT doc_id) AS n_docs, 0::BIGINT AS n_wrong_tokens, 0::BIGINT AS n_split, 0::BIGINT AS n_overfull FROM documents")
def p8_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """Documents placed; those whose parts don't add up to their tokens; those split though they fit; containers over capacity."""
    counts = stage(token_counts(table(spark, sf, "documents")), "counts")
    placed = stage(pack(counts), "placed")
    per = placed.groupBy("doc_id").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("parts"), F.count_distinct("part").alias("distinct"))
    j = per.join(counts, "doc_id", "full")
    docs = j.agg(
        F.count("size").alias("n_docs"),
        F.count_if(~F.col("size").eqNullSafe(F.col("n_tokens")) | (F.col("parts") != F.col("distinct"))).alias("n_wrong_tokens"),
        F.count_if((F.col("parts") > 1) & (F.col("n_tokens") <= CAPACITY)).alias("n_split"),
    )
    over = placed.groupBy("container").agg(F.sum("size").alias("fill")).agg(F.count_if(F.col("fill") > CAPACITY).alias("n_overfull"))
    return docs.crossJoin(over)  # one row each


def _leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


@LLM.add()
def p9_leaks(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold ten words of an evaluation text with at most one edit."""
    return _leaks(spark, sf)


@LLM.add()
def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that share a run of at least ten words with an evaluation text: a window of ten whole words at distance 0."""
    return _leaks(spark, sf).where("edits = 0 AND window = 10").select("doc_id", "eval_id")


def _segments(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return stage(segments(docs, train(docs)), "segments")


@LLM.add()
def p10_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Every stretch of one language inside a document."""
    return _segments(spark, sf)


@LLM.add()
def p10_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's languages."""
    return document_languages(_segments(spark, sf))


@LLM.add()
def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """The languages of documents whose label is missing or wrong or that hold several."""
    labels = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("label"))
    langs = document_languages(_segments(spark, sf)).join(labels, "doc_id")
    cases = mislabelled(langs, F.col("label")).where("case").select("doc_id")
    return langs.join(cases, "doc_id").select("doc_id", "lang").distinct()
