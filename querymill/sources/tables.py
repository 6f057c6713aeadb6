"""Reading the input tables and staging intermediate results.

Staged tables go to the folder all executors share (``spark.checkpoint.dir``), so a lost executor never
loses them; a private folder is set only when the session names none, as in tests.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a private one only where all tasks run on this machine and none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="querymill-")
    spark.sparkContext.setCheckpointDir(own)
    return shared_dir(spark)


_STAGED: list[str] = []


def drop_staged(spark: SparkSession) -> int:
    """Deletes all tables staged so far, for long sessions, once results are written; says how many there were."""
    n = len(_STAGED)
    while _STAGED:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(_STAGED.pop())
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
    return n


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, is computed once, survives lost executors.

    The files are deleted when the driver's JVM ends, or by ``drop_staged``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STAGED.append(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    """Partitions of a shuffle as the session has them."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """The rows over as many tasks as a shuffle has, before a step that takes far longer than reading them."""
    return df.repartition(shuffle_partitions(df.sparkSession))
