"""Copies that differ in case, spacing, punctuation or order of words only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querymill.llm.frequency import words
from querymill.sources.tables import stage


def same_words(text: Column) -> Column:
    """Equal for texts that hold the same words equally often; null for null."""
    return F.array_join(F.array_sort(words(text)), " ")


def collapse(df: DataFrame, id_col: str, text_col: str, within: list[str], hot_rows: int = 10_000, salts: int = 64) -> tuple[DataFrame, DataFrame]:
    """(records, copies): ``keep_id, n_copies`` of each record and ``keep_id, dup_id`` of each further copy.

    A record is the rows of equal ``within`` whose text holds the same words; its representative is the smallest id.
    Keys of more than ``hot_rows`` rows, or a millionth of all rows if that is more, are found from exact partial counts, so there
    are at most a million of them however many rows there are; each is reduced in two levels over salted parts. All
    other keys go through one shuffle in groups of at most as many ids. What is broadcast are the 64-bit hashes of hot
    keys, 8 MB at most; a cold key of the same hash is salted as well, which changes no result.

    Defined cases: '' and null texts are missing and hold no word, so they are one record within equal ``within``; a null
    in ``within`` or in the id is never a copy and such rows are left out; repeated rows of one id are one row.
    """
    keys = [*(f"k{i}" for i in range(len(within))), "words"]
    keyed = df.select(
        F.col(id_col).alias("id"), *[F.col(c).alias(k) for c, k in zip(within, keys, strict=False)], same_words(F.coalesce(text_col, F.lit(""))).alias("words")
    ).dropna()
    keyed = stage(keyed.withColumn("h", F.xxhash64(*keys)), "keyed")
    hot_rows = max(hot_rows, keyed.count() // 1_000_000)
    hot = keyed.groupBy("h").count().where(F.col("count") > hot_rows).select("h")

    salted = keyed.join(F.broadcast(hot), "h", "left_semi").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    partial = salted.groupBy(*keys, "salt").agg(F.min("id").alias("keep_id"), F.count_distinct("id").alias("n_copies"))
    hot_records = partial.groupBy(*keys).agg(F.min("keep_id").alias("keep_id"), F.sum("n_copies").alias("n_copies"))
    # a hot key has many more rows than salts, so its record repeated for each salt is little beside them
    every = hot_records.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    hot_copies = salted.join(every, [*keys, "salt"]).where("id <> keep_id").select("keep_id", F.col("id").alias("dup_id")).distinct()

    rest = keyed.join(F.broadcast(hot), "h", "left_anti").groupBy(*keys).agg(F.array_sort(F.collect_set("id")).alias("ids"))
    rest_records = rest.select(F.col("ids")[0].alias("keep_id"), F.size("ids").cast("long").alias("n_copies"))
    rest_copies = rest.where("size(ids) > 1").select(F.col("ids")[0].alias("keep_id"), F.explode(F.slice("ids", 2, hot_rows)).alias("dup_id"))
    return hot_records.select("keep_id", "n_copies").unionByName(rest_records), hot_copies.unionByName(rest_copies)
