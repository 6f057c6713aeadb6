"""Queries of the two general data problems: hot keys and units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querymill.operators.skew import heavy_keys, key_summaries
from querymill.operators.units import stated_quantities
from querymill.plans.registry import CORE
from querymill.sources.tables import table

MEASURES = ["sku_position", "sku_price"]
KEYS = ["query", "sku_brand_name"]


def _summary_sql(key: str) -> str:
    cols = ", ".join(
        f"count({m}) AS {m}_n, round(sum({m}::DOUBLE), 2) AS {m}_sum, min({m}::DOUBLE) AS {m}_min, round(quantile_cont({m}::DOUBLE, 0.5), 4) AS {m}_median, max({m}::DOUBLE) AS {m}_max"
        for m in MEASURES
    )
    return f"SELECT '{key}' AS field, {key} AS key_value, count(*) AS n_rows, {cols} FROM candidates_to_label WHERE {key} <> '' GROUP BY {key}"


@CORE.add(" UNION ALL ".join(_summary_sql(k) for k in KEYS))
def p1_key_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """Candidate counts, click positions and prices per query and per brand."""
    out = key_summaries(table(spark, sf, "candidates_to_label"), KEYS, MEASURES)
    for m in MEASURES:
        out = out.withColumn(f"{m}_sum", F.round(f"{m}_sum", 2)).withColumn(f"{m}_median", F.round(f"{m}_median", 4))
    return out


@CORE.add(
    " UNION ALL ".join(
        f"SELECT '{k}' AS field, {k} AS key_value FROM candidates_to_label WHERE {k} <> '' GROUP BY {k} HAVING count(*) >= 0.02 * (SELECT count(*) FROM candidates_to_label)" for k in KEYS
    )
)
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Values of query and sku_brand_name that at least 2 % of all rows hold."""
    df = table(spark, sf, "candidates_to_label")
    return heavy_keys(key_summaries(df, KEYS, MEASURES), df.count())


@CORE.add()
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every quantity that a candidate's query or a benchmark entity states, in base units."""
    queries = table(spark, sf, "candidates_to_label").select(F.lit("candidates_to_label").alias("tab"), F.col("cand_id").alias("row_id"), F.col("query").alias("text"))
    entities = table(spark, sf, "benchmark").select(F.lit("benchmark").alias("tab"), F.col("item_id").alias("row_id"), F.explode("entities.text").alias("text"))
    return stated_quantities(queries.unionByName(entities))
