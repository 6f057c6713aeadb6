"""Evaluation: spans under three identities, classes, latency, thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querymill.operators.skew import order_statistics, ranked_within
from querymill.operators.stats import joined_groups


def span_counts(gold: DataFrame, pred: DataFrame, key: list[str]) -> DataFrame:
    """``label, tp, fp, fn`` of two span tables; a span is its row, label and ``key`` (token, character or text identity)."""
    on = ["row_id", "label", *key]
    a = gold.select(*on).distinct().withColumn("g", F.lit(1))
    b = pred.select(*on).distinct().withColumn("p", F.lit(1))
    j = a.join(b, on, "full_outer")
    return j.groupBy("label").agg(
        F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn")
    )


def prf(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 per label, ``MICRO`` over all and ``MACRO`` as the mean of the labels; 0 where nothing is to divide."""

    def add(df: DataFrame) -> DataFrame:
        p = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0))
        r = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
        f = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
        return df.select("label", F.round(p, 6).alias("p"), F.round(r, 6).alias("r"), F.round(f, 6).alias("f1"))

    per = add(counts)
    micro = add(counts.groupBy(F.lit("MICRO").alias("label")).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]))
    macro = per.groupBy(F.lit("MACRO").alias("label")).agg(*[F.round(F.avg(c), 5).alias(c) for c in ("p", "r", "f1")])
    return per.unionByName(micro).unionByName(macro)


def class_report(df: DataFrame, true: str, pred: str) -> DataFrame:
    """``label, support, tp, predicted`` and F1 of each class; one pass."""
    both = df.select(F.explode(F.array(F.struct(F.col(true).alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col(pred).alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p")))).alias("x"), (F.col(true) == F.col(pred)).cast("int").alias("hit"))
    per = both.groupBy("x.label").agg(F.sum("x.t").alias("support"), F.sum("x.p").alias("predicted"), F.sum(F.col("hit") * F.col("x.t")).alias("tp")).where("label IS NOT NULL")
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), F.col("support") + F.col("predicted")), F.lit(0.0))
    return per.withColumn("f1", F.round(f1, 6))


def overall(report: DataFrame) -> DataFrame:
    """Accuracy, macro and weighted F1 of a class report."""
    return report.agg(
        F.round(F.sum("tp") / F.sum("support"), 6).alias("accuracy"), F.round(F.avg(F.when(F.col("support") > 0, F.col("f1"))), 5).alias("macro_f1"), F.round(F.sum(F.col("f1") * F.col("support")) / F.sum("support"), 5).alias("weighted_f1")
    )


def latency_summary(df: DataFrame, by: list[str], value: str, limit: float) -> DataFrame:
    """Count, mean, population deviation, extremes, percentiles and whether the 95th stays within the limit."""
    x = F.col(value)
    q = order_statistics(df, by, value, [0.5, 0.9, 0.95, 0.99]).drop("n")
    out = df.where(x.isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(x), 4).alias("mean"), F.round(F.stddev_pop(x), 4).alias("sd"), F.min(x).alias("low"), F.max(x).alias("high"))
    return joined_groups(out, q, by).select(*by, "n", "mean", "sd", "low", "high", *[F.round(f"q{i}", 4).alias(c) for i, c in enumerate(("p50", "p90", "p95", "p99"))], (F.col("q2") <= limit).alias("within"))


def empirical_cdf(df: DataFrame, by: list[str], value: str, name: str = "cdf") -> DataFrame:
    """Adds the share of a group's other rows with a smaller value; 0 for a single row. A hot group is ranked over many tasks."""
    r = ranked_within(df, by, [F.col(value)], "r__", "n__")
    low = r.groupBy(*by, value).agg(F.min("r__").alias("low__"))
    same = F.col("value__").eqNullSafe(F.col(value))
    for k in by:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}__"))
    low = low.select(*[F.col(k).alias(f"{k}__") for k in by], F.col(value).alias("value__"), "low__")
    return r.join(low, same).withColumn(name, F.round(F.when(F.col("n__") > 1, (F.col("low__") - 1) / (F.col("n__") - 1)).otherwise(0.0), 6)).select(*df.columns, name)


def threshold_sweep(df: DataFrame, score: Column, correct: Column, grid: list[float]) -> DataFrame:
    """``tau, accepted, coverage, accuracy`` of accepting scores from each threshold on; all thresholds in one pass."""
    rows = df.select(score.alias("s"), correct.cast("int").alias("c"))
    aggs = [F.struct(F.lit(t).alias("tau"), F.count_if(F.col("s") >= t).alias("accepted"), F.round(F.try_divide(F.count_if(F.col("s") >= t), F.count(F.lit(1))), 6).alias("coverage"), F.round(F.avg(F.when(F.col("s") >= t, F.col("c"))), 6).alias("accuracy")) for t in grid]
    return rows.agg(F.array(*aggs).alias("a")).select(F.inline("a"))


def rollup_agreement(df: DataFrame, group: str, agree: Column) -> DataFrame:
    """``group, n, agreement`` of each group and ``ALL``."""
    out = df.withColumn("a", agree.cast("int")).rollup(group).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("a"), 6).alias("agreement"), F.grouping(group).alias("g"))
    return out.select(F.when(F.col("g") == 1, "ALL").otherwise(F.coalesce(F.col(group), F.lit(""))).alias("grp"), "n", "agreement")


def reject(top: Column, p1: Column, margin: Column, tau: float = 0.42, least_margin: float = 0.08, tau_unknown: float = 0.30) -> Column:
    """The prediction, or NO_BRAND: an own NO_BRAND stays, UNKNOWN needs ``tau_unknown``, any other ``tau`` and the margin."""
    return (
        F.when(top == "NO_BRAND", "NO_BRAND")
        .when((top == "UNKNOWN") & (p1 < tau_unknown), "NO_BRAND")
        .when((top != "UNKNOWN") & ((p1 < tau) | (margin < least_margin)), "NO_BRAND")
        .otherwise(top)
    )
