"""Click analytics: position-weighted votes, candidate sets, per-group picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querymill.functions.text import strip
from querymill.operators.stats import hash_order, hashed_sample


def position_weight(pos: Column) -> Column:
    """1 / (1 + position), negative positions as 0."""
    return F.lit(1.0) / (1 + F.greatest(pos, F.lit(0)))


def votes(clicks: DataFrame, least: int = 2, no_position: int = 99) -> DataFrame:
    """``query_norm, query_raw, brand, pos`` of clicks whose query and brand have at least ``least`` characters.

    Null positions, and those that are no number, count as ``no_position``.
    """
    q, b = strip(F.col("query")), strip(F.col("sku_brand_name"))
    pos = F.coalesce(F.col("sku_position").cast("string").try_cast("int"), F.lit(no_position))
    return clicks.where((F.length(q) >= least) & (F.length(b) >= least)).select(F.lower(q).alias("query_norm"), q.alias("query_raw"), b.alias("brand"), pos.alias("pos"))


def brand_vote(cast: DataFrame) -> DataFrame:
    """Position-weighted majority per query_norm.

    The winner has the greatest weight, then most clicks, then the first name; the runner-up is the best other brand;
    the raw query is the most frequent one. Two levels of aggregation: a hot query is reduced to its brands first.
    """
    per = cast.groupBy("query_norm", "brand").agg(F.sum(position_weight(F.col("pos"))).alias("w"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("query_norm").orderBy(F.round("w", 9).desc(), F.desc("n"), "brand")
    ranked = per.withColumn("rn", F.row_number().over(w))

    def at(rank: int, c: str) -> Column:
        return F.max(F.when(F.col("rn") == rank, F.col(c)))

    voted = ranked.groupBy("query_norm").agg(
        at(1, "brand").alias("click_brand"),
        F.round(at(1, "w") / F.sum("w"), 6).alias("confidence"),
        F.sum("n").alias("n_clicks"),
        F.count(F.lit(1)).alias("n_brands"),
        at(2, "brand").alias("runner_up"),
        F.round((at(1, "w") - F.coalesce(at(2, "w"), F.lit(0.0))) / F.sum("w"), 6).alias("weight_margin"),
    )
    return voted.join(most_frequent(cast, "query_norm", "query_raw"), "query_norm")


def most_frequent(df: DataFrame, key: str, col: str) -> DataFrame:
    """The most frequent value of ``col`` per key, ties by value: counts first, so a hot key is small before it is compared."""
    n = df.groupBy(key, col).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(key).orderBy(F.desc("n"), col)
    return n.withColumn("rn", F.row_number().over(w)).where("rn = 1").select(key, col)


def top_per_group(df: DataFrame, group: str, col: str, k: int) -> DataFrame:
    """``group, col, n, rn``: the k most frequent values of each group."""
    n = df.groupBy(group, col).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), col))).where(F.col("rn") <= k).withColumn("rn", F.col("rn").cast("long"))


def first_click(clicks: DataFrame) -> DataFrame:
    """The click of the smallest position, then id, of each query; an aggregate, so a hot query isn't sorted. A null position comes last."""
    pos = F.coalesce(F.col("sku_position"), F.lit(2**31 - 1))
    return clicks.groupBy("query").agg(F.min(F.struct(pos.alias("pos"), "cand_id", "sku_id")).alias("m")).select("query", "m.cand_id", "m.sku_id")


def supported_classes(df: DataFrame, label: Column, least: int, special: list[str], special_least: int) -> DataFrame:
    """``class, n`` of classes with enough rows; special ones need fewer."""
    n = df.groupBy(label.alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return n.where((F.col("n") >= least) | (F.col("class").isin(special) & (F.col("n") >= special_least)))


def label_pivot(df: DataFrame, group: str, label: str, values: list[int]) -> DataFrame:
    """Counts of each label value as columns ``label_<value>``, 0 where there are none."""
    return df.groupBy(group).agg(*[F.count_if(F.col(label) == v).alias(f"{label}_{v}") for v in values])


def negatives(queries: DataFrame, items: DataFrame, clicks: DataFrame) -> DataFrame:
    """One item never clicked for each query, in the fixed random order of the pair.

    ``queries`` and ``items`` are samples of stated size, which bounds the grid.
    """
    grid = queries.crossJoin(F.broadcast(items)).join(clicks.select("query", "sku_id"), ["query", "sku_id"], "left_anti")
    return hashed_sample(grid, ["query", "sku_id"], 1, ["query"])


def relevance_candidates(clicks: DataFrame, top: int, deep: int, k: int) -> DataFrame:
    """``query, sku_id, kind``: k clicks of positions up to ``top``, k from ``deep`` on, each pair once."""
    cols = ["cand_id", "query", "sku_id"]
    a = hashed_sample(clicks.where(F.col("sku_position") <= top).select(*cols), ["cand_id"], k).withColumn("kind", F.lit("top"))
    b = hashed_sample(clicks.where(F.col("sku_position") >= deep).select(*cols), ["cand_id"], k).withColumn("kind", F.lit("deep"))
    return a.unionByName(b).groupBy("query", "sku_id").agg(F.min("kind").alias("kind"))


def assignment(df: DataFrame, col: str, annotators: int, each: int) -> DataFrame:
    """Disjoint sets of ``each`` distinct values for every annotator, in the fixed random order."""
    picked = hashed_sample(df.select(col).distinct(), [col], annotators * each)
    rn = F.row_number().over(Window.orderBy(hash_order(col), col)) - 1
    return picked.withColumn("rn", rn).select(col, F.concat(F.lit("annotator_"), F.floor(F.col("rn") / each).cast("string")).alias("annotator"))
