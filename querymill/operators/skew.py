"""Per-key summaries that stay balanced when a few keys own most rows (exact offset chunking).

Rows are pre-aggregated to (key, measure, value, n), spread by *range* over (key, measure, value) -- so a hot key
covers several tasks of equal size -- and staged. Each partition then numbers its own rows; a prefix sum over the
partition counts gives every key its offset in every partition; offset + local number is the exact rank of a row
inside its key. Ranks are cut into chunks of equal size, each chunk is reduced to a state, and the ordered states of
a key are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querymill.sources.tables import shuffle_partitions, stage

ID = ["field", "key_value", "measure"]
#: Pre-aggregated rows of a range partition, and range partitions at most; beyond, partitions grow, of which a task holds one key's numbers.
ROWS, MOST_PARTS = 2_000_000, 20_000


def _number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Running and total counts of values of each key's part in this sorted partition; nulls come last and don't count.

    Rows stream by key: of the key that may go on in the next batch the numbers are held, 16 bytes a row. ``edge`` is 1
    for the partition's first key, 2 for its last, else 0: only these may have rows in another partition.
    """
    begin: tuple | None = None
    name: tuple = ()
    values: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    pid = 0

    def told(finish: bool = False) -> Iterator[pd.DataFrame]:
        edge = 1 if name == begin else 2 if finish else 0
        v, n = np.concatenate(values), np.concatenate(counts)
        own = np.where(np.isnan(v), 0, n)
        end = np.cumsum(own)
        for at in range(0, len(v), 100_000):
            cut = slice(at, at + 100_000)
            yield pd.DataFrame({"field": name[0], "key_value": name[1], "measure": name[2], "value": v[cut], "n": n[cut], "pid": pid, "n_values": own[cut], "local_end": end[cut], "local_total": end[-1], "edge": edge})

    for pdf in batches:
        if not len(pdf):
            continue
        pid = int(pdf["pid"].iloc[0])
        code = pd.MultiIndex.from_frame(pdf[ID]).factorize()[0]
        starts = np.flatnonzero(np.diff(code, prepend=-1))
        first = tuple(pdf[ID].iloc[0])
        fresh = begin is None
        begin = first if fresh else begin
        if values and first != name:
            yield from told()
            values, counts = [], []
        last = int(starts[-1])
        if last:
            # the keys that end in this batch, at once
            head = pdf.iloc[:last]
            if values:
                stop = int(starts[1])
                values.append(head["value"].to_numpy(float)[:stop])
                counts.append(head["n"].to_numpy()[:stop])
                yield from told()
                values, counts = [], []
                head, code = head.iloc[stop:], code[stop:]
            if len(head):
                own = head["n"].where(head["value"].notna(), 0)
                by = own.groupby(code[: len(head)], sort=False)
                yield head.assign(n_values=own, local_end=by.cumsum(), local_total=by.transform("sum"), edge=np.where(fresh & (code[: len(head)] == 0), 1, 0))
        name = tuple(pdf[ID].iloc[-1])
        values.append(pdf["value"].to_numpy(float)[last:])
        counts.append(pdf["n"].to_numpy()[last:])
    if values:
        yield from told(finish=True)


def key_summaries(df: DataFrame, keys: list[str], measures: list[str], chunk_rows: int = 100_000) -> DataFrame:
    """Exact count and summary of each measure per value of each key column.

    Result: ``field, key_value, n_rows`` and for each measure m ``m_n, m_sum, m_min, m_median, m_max``
    (``m_n`` counts non-null values; the median of an even count is the mean of the middle two).

    Defined cases: rows whose key is null or '' are no group of that key; null measures count in ``n_rows`` only and
    the group's other figures are null when it has no value; ties and repeated rows each count; an empty table gives
    an empty result; columns not named are ignored, so their names can't clash; NaN counts as a missing value.
    """
    spark = df.sparkSession
    fields = F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.col(k).cast("string").alias("key_value")) for k in keys])).alias("f")
    values = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.nanvl(F.col(m).cast("double"), F.lit(None).cast("double")).alias("value")) for m in measures])).alias("v")
    counted = (
        df.select(fields, *[F.col(m) for m in measures])
        .where("f.key_value != ''")
        .select("f.*", values)
        .groupBy("field", "key_value", "v.measure", "v.value").agg(F.count(F.lit(1)).alias("n"))
    )
    counted = stage(counted, "counted")
    order = [*ID, F.col("value").asc_nulls_last()]
    n_parts = max(shuffle_partitions(spark), min(MOST_PARTS, -(-counted.count() // ROWS)))
    ranged = counted.repartitionByRange(n_parts, *order).sortWithinPartitions(*order).withColumn("pid", F.spark_partition_id())
    schema = "field string, key_value string, measure string, value double, n long, pid int, n_values long, local_end long, local_total long, edge int"
    numbered = stage(ranged.mapInPandas(_number, schema), "numbered")

    # prefix sums over the first and last keys of the partitions, at most two rows of four numbers a partition
    parts = numbered.where("edge > 0").groupBy(*ID, "pid", "edge").agg(F.sum("n_values").alias("part_n"))
    w = Window.partitionBy(*ID)
    spanning = parts.select(F.col("pid"), "edge", (F.sum("part_n").over(w.orderBy("pid")) - F.col("part_n")).alias("offset"), F.sum("part_n").over(w).alias("total"))
    start = F.coalesce("offset", F.lit(0)) + F.col("local_end") - F.col("n_values")
    ranked = (
        numbered.join(F.broadcast(spanning), ["pid", "edge"], "left")
        .withColumn("rank", start)
        .withColumn("total", F.coalesce("total", "local_total"))
        .withColumn("chunk", F.floor(F.col("rank") / chunk_rows))
    )

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("rank") <= rank) & (rank < F.col("rank") + F.col("n_values")), F.col("value")))

    middle = F.col("total") - 1
    states = ranked.groupBy(*ID, "chunk").agg(
        F.sum("n").alias("n"),
        F.sum("n_values").alias("n_values"),
        F.sum(F.col("value") * F.col("n")).alias("sum"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        at(F.floor(middle / 2)).alias("mid_low"),
        at(F.ceil(middle / 2)).alias("mid_high"),
    )
    # few states a key: the ordered chunks are merged, the first has the minimum and the last with values the maximum
    merged = states.groupBy(*ID).agg(
        F.sum("n").alias("n"),
        F.sum("n_values").alias("n_values"),
        F.sum("sum").alias("sum"),
        F.min_by("low", F.when(F.col("n_values") > 0, F.col("chunk"))).alias("low"),
        F.max_by("high", F.when(F.col("n_values") > 0, F.col("chunk"))).alias("high"),
        ((F.max("mid_low") + F.max("mid_high")) / 2).alias("median"),
    )
    picked = [F.max("n").alias("n_rows")]
    for m in measures:
        for name, c in (("n", "n_values"), ("sum", "sum"), ("min", "low"), ("median", "median"), ("max", "high")):
            picked.append(F.max(F.when(F.col("measure") == m, F.col(c))).alias(f"{m}_{name}"))
    return merged.groupBy("field", "key_value").agg(*picked)


#: Keys of more rows than this may be hot, and only this many of the most frequent are split; any other key has less than a share of 1 / MOST_HOT of the rows.
HOT_ROWS, MOST_HOT, SALTS = 10_000, 1_000, 64
#: Bytes of a table too small for a hot key to matter.
SMALL = 16 << 20


def hot_hashes(rows: DataFrame, key: list[str], least: int = HOT_ROWS) -> list[int]:
    """64-bit hashes of the most frequent keys, at most ``MOST_HOT`` numbers; counts are combined before the shuffle.

    Rows that the optimizer expects to be fewer bytes than one task reads anyway aren't counted.
    """
    if least == HOT_ROWS and int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < SMALL:
        return []
    counts = rows.groupBy(F.xxhash64(*key).alias("h")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least)
    return [r["h"] for r in counts.orderBy(F.desc("n"), "h").limit(MOST_HOT).collect()]


def salted_join(rows: DataFrame, side: DataFrame, key: list[str], how: str = "inner", salts: int = SALTS, hot: list[int] | None = None, least: int = HOT_ROWS) -> DataFrame:
    """``rows`` joined with ``side`` on ``key``, where the rows of a hot key are spread over ``salts`` tasks.

    Hot keys are told by hash; a cold key of the same hash is spread as well, so the result is that of the plain join.
    The side's rows of hot keys are repeated for each salt, so a key should have few of them. ``how`` is any join that
    keeps no unmatched row of the side. Null keys match nothing. Salts are drawn from all columns of a row, so that a task
    run again draws the same; rows equal in all columns stay together.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("unmatched rows of the side would be repeated")
    hot = hot_hashes(rows, key, least) if hot is None else hot
    if not hot:
        return rows.join(side, key, how)
    is_hot = F.xxhash64(*key).isin(hot)
    spread = rows.withColumn("salt__", F.when(is_hot, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c, t in rows.dtypes if "map<" not in t]), F.lit(salts))).otherwise(F.lit(0)).cast("int"))
    every = side.withColumn("salt__", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return spread.join(every, [*key, "salt__"], how).drop("salt__")


def heavy_keys(summaries: DataFrame, n_total: int, share: float = 0.02) -> DataFrame:
    """The keys that hold at least ``share`` of ``n_total`` rows."""
    return summaries.where(F.col("n_rows") >= n_total * share).select("field", "key_value")


def ranked_within(df: DataFrame, key: list[str], order: list[Column], rank: str = "rank", total: str | None = None) -> DataFrame:
    """Adds the exact rank of each row inside its key, from 1, under a total order, and optionally the key's rows.

    A window would sort a hot key in one task. Here rows are spread by range over (key, order), so a hot key covers many
    partitions; rows of a sorted partition have consecutive numbers, and prefix sums over the partitions of a key turn
    them into ranks. Null keys are a key; repeated rows get different ranks.
    """
    spark = df.sparkSession
    by = [*[F.col(k) for k in key], *order]
    ranged = df.repartitionByRange(shuffle_partitions(spark), *by).sortWithinPartitions(*by)
    rows = stage(ranged.withColumn("pid__", F.spark_partition_id()).withColumn("nth__", F.monotonically_increasing_id()), "ranked")
    parts = rows.groupBy(*key, "pid__").agg(F.min("nth__").alias("first__"), F.count(F.lit(1)).alias("n__"))
    # one row a partition that a key covers
    w = Window.partitionBy(*key)
    start = F.sum("n__").over(w.orderBy("pid__")) - F.col("n__") - F.col("first__")
    told = parts.select(*[F.col(k).alias(f"{k}__") for k in key], F.col("pid__").alias("p__"), start.alias("start__"), F.sum("n__").over(w).alias("all__"))
    same = F.col("pid__") == F.col("p__")
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}__"))
    out = rows.join(told, same).withColumn(rank, F.col("nth__") + F.col("start__") + 1)
    return out.select(*df.columns, rank, *([F.col("all__").alias(total)] if total else []))


def order_statistics(df: DataFrame, by: list[str], col: str, shares: list[float]) -> DataFrame:
    """``by, n, q0, q1, ...``: exact quantiles with linear interpolation of each group's values; null and NaN are left out.

    Values are ranked over many tasks and the few ranks that matter are picked with partial aggregation, so neither a
    group nor its distinct values must fit anywhere. Equal values are told apart at random, which changes no quantile.
    """
    x = df.select(*by, F.col(col).cast("double").alias("x__")).where("x__ IS NOT NULL AND NOT isnan(x__)")
    r = ranked_within(x.withColumn("tie__", F.rand(7)), by, [F.col("x__"), F.col("tie__")], "r__", "n__")
    picks = []
    for i, q in enumerate(shares):
        at = (F.col("n__") - 1) * F.lit(float(q))
        picks += [F.max(F.when(F.col("r__") == F.floor(at) + 1, F.col("x__"))).alias(f"low{i}"), F.max(F.when(F.col("r__") == F.ceil(at) + 1, F.col("x__"))).alias(f"high{i}")]
    out = r.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *picks)
    share = lambda q: (F.col("n") - 1) * F.lit(float(q)) - F.floor((F.col("n") - 1) * F.lit(float(q)))
    return out.select(*by, "n", *[(F.col(f"low{i}") + (F.col(f"high{i}") - F.col(f"low{i}")) * share(q)).alias(f"q{i}") for i, q in enumerate(shares)])
