"""Audit of the click log's quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querymill.functions.text import mixed_script


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def audit(df: DataFrame, dear: float = 3_000_000, deep: int = 1000, long: int = 120) -> DataFrame:
    """``issue, n, share``: every check in one pass over the rows."""
    q, b, name, price, pos = (F.col(c) for c in ("query", "sku_brand_name", "sku_name", "sku_price", "sku_position"))
    checks = {
        "empty_query": blank(q), "empty_brand": blank(b), "empty_name": blank(name),
        "price_not_positive": price <= 0, "price_too_high": price > dear, "position_zero": pos == 0, "position_too_deep": pos > deep,
        "digits_only_name": name.rlike(r"^\s*\d[\d\s.,]*$"), "long_query": F.length(q) > long,
        "brand_not_in_name": ~blank(b) & ~blank(name) & ~F.lower(name).contains(F.lower(b)), "mixed_script_query": mixed_script(q), "query_is_brand": F.lower(F.trim(q)) == F.lower(F.trim(b)),
    }
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(k) for k, c in checks.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("issue"), F.col(k).alias("n")) for k in checks])).alias("r")
    return one.select(F.col("n").alias("total"), rows).select("r.issue", "r.n", F.round(F.try_divide(F.col("r.n"), F.col("total")), 6).alias("share"))


def completeness(df: DataFrame, cols: list[str]) -> DataFrame:
    """``state, n``: rows with all, some or none of the fields."""
    have = sum(((~blank(F.col(c).cast("string"))).cast("int") for c in cols), F.lit(0))
    state = F.when(have == len(cols), "full").when(have == 0, "lost").otherwise("partial")
    return df.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def field_coverage(df: DataFrame, cols: list[str]) -> DataFrame:
    """``column_name, share``: rows that have each field, in one pass."""
    one = df.agg(*[F.round(F.avg((~blank(F.col(c).cast("string"))).cast("int")), 6).alias(c) for c in cols])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("share")) for c in cols])))
