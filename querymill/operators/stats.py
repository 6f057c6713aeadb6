"""Exploratory aggregates. Every order has a total tie-break, so results are the same on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querymill.functions.text import missing
from querymill.operators.skew import order_statistics, ranked_within


def top_values(df: DataFrame, col: str, k: int) -> DataFrame:
    """``value, n``: the k most frequent values that aren't missing; ties by value."""
    return df.where(~missing(F.col(col))).groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(k)


def value_counts(df: DataFrame, *cols: str) -> DataFrame:
    """Rows of each combination of values, null being one."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def missing_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """``column_name, n_null, n_blank, share_missing`` in one pass."""
    aggs = []
    for c in cols:
        aggs += [F.count_if(F.col(c).isNull()).alias(f"{c}__0"), F.count_if(F.trim(F.col(c).cast("string")) == "").alias(f"{c}__1")]
    one = df.agg(F.count(F.lit(1)).alias("n"), *aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"{c}__0").alias("n_null"), F.col(f"{c}__1").alias("n_blank")) for c in cols])).alias("r")
    return one.select("n", rows).select("r.*", F.round(F.try_divide(F.col("r.n_null") + F.col("r.n_blank"), F.col("n")), 6).alias("share_missing"))


def describe(df: DataFrame, col: str, by: list[str]) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum of a column, by groups; groups without values have no row."""
    x = F.col(col).cast("double")
    q = order_statistics(df, by, col, [0.25, 0.5, 0.75]).drop("n")
    out = df.where(x.isNotNull()).groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.min(x).alias("low"), F.max(x).alias("high"))
    return joined_groups(out, q, by).select(
        *by, "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), "low", F.round("q0", 6).alias("q25"), F.round("q1", 6).alias("q50"), F.round("q2", 6).alias("q75"), "high"
    )


def joined_groups(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Two tables of one row a group put together; a null group is a group."""
    if not by:
        return a.crossJoin(b)  # one row each
    same = F.lit(True)
    for k in by:
        same = same & a[k].eqNullSafe(F.col(f"{k}__"))
    return a.join(b.withColumnsRenamed({k: f"{k}__" for k in by}), same).drop(*[f"{k}__" for k in by])


def quantiles(df: DataFrame, col: str, shares: list[float]) -> DataFrame:
    """``share, value``: exact quantiles with linear interpolation."""
    one = order_statistics(df, [], col, shares)
    return one.select(F.inline(F.array(*[F.struct(F.lit(q).alias("share"), F.round(f"q{i}", 6).alias("value")) for i, q in enumerate(shares)])))


def below_quantile(df: DataFrame, col: str, share: float) -> DataFrame:
    """Rows with a value under the quantile of all values; one broadcast row."""
    bound = order_statistics(df, [], col, [share]).select(F.col("q0").alias("bound__"))
    return df.crossJoin(F.broadcast(bound)).where(F.col(col) < F.col("bound__")).drop("bound__")


def in_top(df: DataFrame, col: str, k: int) -> DataFrame:
    """Rows whose value is one of the k most frequent."""
    top = top_values(df, col, k).select(F.col("value").alias(col))
    return df.join(F.broadcast(top), col, "left_semi")


def distinct_per_group(df: DataFrame, group: str, col: str) -> DataFrame:
    """``n_groups, share_several``: groups and the share of them with two or more distinct values."""
    per = df.groupBy(group).agg(F.count_distinct(col).alias("k"))
    return per.agg(F.count(F.lit(1)).alias("n_groups"), F.round(F.avg((F.col("k") >= 2).cast("double")), 6).alias("share_several"))


def crosstab(df: DataFrame, rows: str, cols: str, top_rows: int, top_cols: int) -> DataFrame:
    """Long contingency table of the most frequent values of both columns, with zeros and log1p."""
    r = top_values(df, rows, top_rows).select(F.col("value").alias(rows))
    c = top_values(df, cols, top_cols).select(F.col("value").alias(cols))
    grid = r.crossJoin(F.broadcast(c))  # top_rows * top_cols cells
    n = df.groupBy(rows, cols).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(n, [rows, cols], "left").select(rows, cols, F.coalesce("n", F.lit(0)).alias("n"), F.round(F.log1p(F.coalesce("n", F.lit(0))), 6).alias("log_n"))


def histogram(df: DataFrame, col: str, low: float, high: float, bins: int) -> DataFrame:
    """``bin, n``: equal bins from low to high, values outside in the first and last bin."""
    x = F.greatest(F.lit(low), F.least(F.lit(high), F.col(col).cast("double")))
    at = F.least(F.lit(bins - 1), F.floor((x - low) / ((high - low) / bins))).cast("int")
    return df.where(F.col(col).isNotNull()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def density(df: DataFrame, x: str, y: str, width_x: float, width_y: float, least: int) -> DataFrame:
    """``x_bin, y_bin, n`` of rectangles that hold at least ``least`` rows."""
    return (
        df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(F.floor(F.col(x) / width_x).alias("x_bin"), F.floor(F.col(y) / width_y).alias("y_bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= least)
    )


def cumulative_share(df: DataFrame, col: str) -> DataFrame:
    """``value, n, share, running``: share of each value and the running share in order of the value.

    The window runs over one row a distinct value.
    """
    n = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("t"))
    w = Window.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    return n.crossJoin(F.broadcast(total)).select("value", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"), F.round(F.sum("n").over(w) / F.col("t"), 6).alias("running"))


def hash_order(*cols: str, seed: str = "42") -> Column:
    """A fixed random order of rows: the digest of their key, which any engine gives alike."""
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols], F.lit(seed)))


def hashed_sample(df: DataFrame, key: list[str], k: int, by: list[str] | None = None, seed: str = "42") -> DataFrame:
    """k rows, of each group if given, in the fixed random order of the key."""
    if not by:
        return df.orderBy(hash_order(*key, seed=seed), *key).limit(k)
    w = Window.partitionBy(*by).orderBy(hash_order(*key, seed=seed), *key)
    return df.withColumn("rn__", F.row_number().over(w)).where(F.col("rn__") <= k).drop("rn__")


def stratified_split(df: DataFrame, label: str, key: list[str], share: float, least: int = 1, seed: str = "42") -> DataFrame:
    """Adds ``part``: of each class ``greatest(least, bround(n * share))`` rows are ``val``, the rest ``train``; a single row is train.

    Classes are ordered by a digest; a hot class is ranked over many tasks.
    """
    r = ranked_within(df, [label], [hash_order(*key, seed=seed), *map(F.col, key)], "rn__", "n__")
    want = F.greatest(F.lit(least), F.bround(F.col("n__") * share, 0).cast("long"))
    return r.withColumn("part", F.when((F.col("n__") > 1) & (F.col("rn__") <= want), "val").otherwise("train")).drop("n__", "rn__")


def word_counts(df: DataFrame, words: Column, least_size: int = 3, stop: list[str] | None = None) -> DataFrame:
    """``word, n`` of all words of the array column, without stop words, digits and short words."""
    w = F.col("word")
    keep = (F.length(w) >= least_size) & ~w.rlike(r"^\d+$")
    if stop:
        keep = keep & ~w.isin(stop)
    return df.select(F.explode(words).alias("word")).where(keep).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def bigram_counts(df: DataFrame, words: Column) -> DataFrame:
    """``first, second, n`` of neighbouring words."""
    w = df.select(words.alias("w")).where("size(w) > 1")
    pairs = F.explode(F.zip_with(F.expr("slice(w, 1, size(w) - 1)"), F.expr("slice(w, 2, size(w) - 1)"), lambda a, b: F.struct(a.alias("first"), b.alias("second")))).alias("p")
    return w.select(pairs).groupBy("p.first", "p.second").agg(F.count(F.lit(1)).alias("n"))


def duplicate_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    """``n_rows, n_distinct, n_duplicate`` over whole rows of ``cols``."""
    per = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_distinct")).withColumn("n_duplicate", F.col("n_rows") - F.col("n_distinct"))


def collapsing_values(df: DataFrame, col: str, key: Column) -> DataFrame:
    """``key, variants``: keys under which several spellings fall, with the spellings in order."""
    spelled = df.where(~missing(F.col(col))).select(key.alias("key"), F.col(col).alias("v")).distinct()
    return spelled.groupBy("key").agg(F.array_sort(F.collect_list("v")).alias("variants")).where("size(variants) > 1")


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Last write wins: of each key the row with the greatest ``order`` values, aggregated before the shuffle."""
    value = F.struct(*order, *[c for c in df.columns if c not in (*key, *order)])
    return df.groupBy(*key).agg(F.max(value).alias("v")).select(*key, "v.*")


def capped_classes(df: DataFrame, label: str, key: list[str], caps: list[tuple[str, float, int]], seed: str = "42") -> DataFrame:
    """Class balance: each (class, share, least) in turn is cut to ``greatest(least, floor(share * rows of other classes / (1 - share)))`` rows.

    Rows are chosen in the fixed random order of the key; only the capped classes are ordered. Counts are taken once.
    """
    names = [c for c, _, _ in caps]
    label_is = lambda c: F.col(label) == c
    n = df.agg(F.count(F.lit(1)).alias("total__"), *[F.count_if(label_is(c)).alias(f"n{i}__") for i, c in enumerate(names)])
    total, limits = F.col("total__"), []
    for i, (_, share, least) in enumerate(caps):
        own = F.col(f"n{i}__")
        cap = F.greatest(F.lit(least), F.floor(F.lit(share) * (total - own) / F.lit(1 - share)).cast("long"))
        limits.append(cap.alias(f"cap{i}__"))
        total = total - own + F.least(own, cap)
    own = ranked_within(df.where(F.col(label).isin(names)), [label], [hash_order(*key, seed=seed), *map(F.col, key)], "rn__")
    capped = own.crossJoin(F.broadcast(n.select(*limits)))  # one row of caps
    limit = F.coalesce(*[F.when(label_is(c), F.col(f"cap{i}__")) for i, c in enumerate(names)])
    return df.where(F.col(label).isNull() | ~F.col(label).isin(names)).unionByName(capped.where(F.col("rn__") <= limit).select(*df.columns))
