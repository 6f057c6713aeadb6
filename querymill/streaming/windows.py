"""Streaming front of the engine: the same column functions on streams, windows over event time, last writes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querymill.sources.tables import shared_dir


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream of its files; a glob, since a table may be a file or a folder."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet")
    return rows.withColumns({c: F.col(c).cast("timestamp") for c, t in rows.dtypes if t == "timestamp_ntz"})


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now into a table of the shared folder, and reads it. The sink is exactly-once."""
    spark = stream.sparkSession
    out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").outputMode(mode).option("path", f"{out}/rows").option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def tumbling(events: DataFrame, size: str, late: str, by: list[str], slide: str | None = None) -> DataFrame:
    """``start, by, n, total``: counts per event-time window; events later than ``late`` are dropped, a window comes out once the watermark passes its end."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    agg = events.withWatermark("ts", late).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return agg.select(F.col("w.start").cast("timestamp_ntz").alias("start"), *by, "n", F.round("total", 4).alias("total"))


def sessions(events: DataFrame, gap: str, late: str, user: str) -> DataFrame:
    """``user, start, finish, n``: sessions that end after a gap without events."""
    agg = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), user).agg(F.count(F.lit(1)).alias("n"))
    return agg.select(user, F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("finish"), "n")


def percentiles(events: DataFrame, size: str, late: str, by: list[str], shares: list[float], accuracy: int = 10_000) -> DataFrame:
    """``start, by, n, p``: percentiles per window within a rank error of 1 / accuracy."""
    agg = events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("value", shares, accuracy).alias("p"))
    return agg.select(F.col("w.start").cast("timestamp_ntz").alias("start"), *by, "n", "p")


def _last_below(spark: SparkSession, out: str, number: int) -> int | None:
    """The last complete version of a table below ``number``, as the folder tells."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(out)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(jpath)] if fs.exists(jpath) else []
    whole = [int(n[1:]) for n in names if n[0] == "v" and n[1:].isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{out}/{n}/_SUCCESS"))]
    return max((n for n in whole if n < number), default=None)


def latest(stream: DataFrame, key: list[str], order: Column, keep: list[str], out: str | None = None) -> DataFrame:
    """Last write of each key over all that is there now.

    Every micro-batch is reduced and merged into the next version of the table in the folder ``out``, whose number is the
    batch's: a repeated batch rewrites its own version, from the last complete one before it. The folder alone says which that
    is, so a stream that starts again from its checkpoint goes on where it stopped. Without any row there is an empty table.
    """
    spark = stream.sparkSession
    out = out or f"{shared_dir(spark)}/latest-{uuid.uuid4().hex}"
    order = order.alias("order__")
    rows = stream.select(*key, order, *keep)

    def merge(batch: DataFrame, number: int) -> None:
        new = batch.select(*key, order, *keep)
        before = _last_below(batch.sparkSession, out, number)
        if before is not None:
            new = new.unionByName(batch.sparkSession.read.schema(new.schema).parquet(f"{out}/v{before}"))
        new.groupBy(*key).agg(F.max(F.struct("order__", *keep)).alias("m")).select(*key, "m.*").write.mode("overwrite").parquet(f"{out}/v{number}")

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start().awaitTermination()
    last = _last_below(spark, out, 1 << 62)
    done = spark.createDataFrame([], rows.schema) if last is None else spark.read.schema(rows.schema).parquet(f"{out}/v{last}")
    return done.drop("order__")
