"""How often every term occurs, and in how many records: a global dictionary of integers and blockwise count arrays.

Records are reduced to distinct values with a weight. The distinct terms of all values, spread by range, get consecutive
integers: the global dictionary. Every occurrence is encoded by an equi-join with it, in which the occurrences of hot
terms are spread over many tasks. A block of encoded occurrences adds them up in arrays, one pair of arrays for each
range of identifiers it meets; then the arrays of each range are added up and decoded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querymill.operators.skew import HOT_ROWS, MOST_HOT, salted_join
from querymill.sources.tables import shuffle_partitions, stage

#: Identifiers of a range, and encoded occurrences of a block at most.
RANGE, BLOCK = 1 << 16, 1 << 20
_ROW = (1 << 33) - 1


def words(text: Column) -> Column:
    """The longest runs of letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))


def dictionary(terms: DataFrame) -> DataFrame:
    """``field, term, held, term_id`` of rows (field, term): consecutive identifiers from 0 in order of (field, term), and the term's rows.

    Terms are sorted in range partitions and numbered where they lie, so no partition must fit into memory; a prefix sum
    over the partitions, one row each, makes the numbers global. Staged.
    """
    distinct = terms.groupBy("field", "term").agg(F.count(F.lit(1)).alias("held"))
    ranged = distinct.repartitionByRange(shuffle_partitions(terms.sparkSession), "field", "term").sortWithinPartitions("field", "term")
    local = stage(ranged.withColumn("nth", F.monotonically_increasing_id()), "dictionary")
    part = F.shiftright("nth", 33)
    sizes = local.groupBy(part.alias("pid")).count().withColumn("start", F.sum("count").over(Window.orderBy("pid")) - F.col("count")).select("pid", "start")
    return local.withColumn("pid", part).join(F.broadcast(sizes), "pid").select("field", "term", "held", (F.col("start") + F.col("nth").bitwiseAND(F.lit(_ROW))).alias("term_id"))


def occurrences(values: DataFrame) -> DataFrame:
    """``vid, field, term, n, n_records``: the occurrences of the terms of values (vid, field, weight, t), and of each term of a value one that stands for its records."""
    once = F.array_distinct("t")
    one = lambda n, r: lambda x: F.struct(x.alias("term"), n.alias("n"), r.alias("n_records"))
    w, zero = F.col("weight"), F.lit(0).cast("long")
    each = F.when(F.size(once) == F.size("t"), F.transform(once, one(w, w))).otherwise(F.concat(F.transform("t", one(w, zero)), F.transform(once, one(zero, w))))
    return values.select("vid", "field", F.explode(each).alias("o")).select("vid", "field", "o.*")


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The count arrays of each block of encoded occurrences, cut by range of identifiers; identifiers that a block doesn't meet take no room."""

    def arrays(block: list[pd.DataFrame]) -> pd.DataFrame:
        ids, at = np.unique(np.concatenate([b["term_id"].to_numpy() for b in block]), return_inverse=True)
        n, records = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        np.add.at(n, at, np.concatenate([b["n"].to_numpy() for b in block]))
        np.add.at(records, at, np.concatenate([b["n_records"].to_numpy() for b in block]))
        ranges, first = np.unique(ids // RANGE, return_index=True)
        cut = lambda x: np.split(x, first[1:])
        return pd.DataFrame({"range": ranges, "ids": cut((ids % RANGE).astype(np.int32)), "n": cut(n), "n_records": cut(records)})

    block: list[pd.DataFrame] = []
    size = 0
    for pdf in batches:
        if len(pdf):
            block.append(pdf)
            size += len(pdf)
        if size >= BLOCK:
            yield arrays(block)
            block, size = [], 0
    if block:
        yield arrays(block)


def _sum(blocks: pd.DataFrame, terms: pd.DataFrame) -> pd.DataFrame:
    """The arrays of one range of identifiers added up, and its terms."""
    n, records = np.zeros(RANGE, np.int64), np.zeros(RANGE, np.int64)
    for ids, k, r in zip(blocks["ids"], blocks["n"], blocks["n_records"], strict=True):
        n[ids] += k  # the identifiers of an array are distinct
        records[ids] += r
    local = (terms["term_id"] % RANGE).to_numpy()
    return pd.DataFrame({"field": terms["field"], "term_id": terms["term_id"], "term": terms["term"], "n": n[local], "n_records": records[local]})


def term_counts(df: DataFrame, fields: list[str]) -> DataFrame:
    """``field, term_id, term, n, n_records``: occurrences of each term and the records that hold it, exact.

    term_id numbers the terms of all fields from 0 without gaps, in order of (field, term). A term that isn't among the
    ``MOST_HOT`` most frequent is met by one task only, so a range's arrays hold ``RANGE`` numbers and a few more for each hot term.
    Defined cases: null and empty values hold no term; repeats inside a value count in ``n`` and once in ``n_records``;
    repeated rows each count; an empty table has no terms; other columns are ignored.
    """
    value = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])).alias("v")
    distinct = df.select(value).where("v.value <> ''").groupBy("v.field", "v.value").agg(F.count(F.lit(1)).alias("weight"))
    # the value's hash only tells occurrences apart where those of a hot term are spread
    values = stage(distinct.select(F.xxhash64("value").alias("vid"), "field", "weight", words(F.col("value")).alias("t")), "values")
    known = dictionary(values.select("field", F.explode(F.array_distinct("t")).alias("term")))
    most = known.where(F.col("held") > HOT_ROWS).orderBy(F.desc("held"), "term_id").limit(MOST_HOT)
    hot = [r["h"] for r in most.select(F.xxhash64("field", "term").alias("h")).collect()]
    encoded = salted_join(occurrences(values), known.select("field", "term", "term_id"), ["field", "term"], hot=hot).select("term_id", "n", "n_records")
    counted = encoded.mapInPandas(_count, "range long, ids array<int>, n array<long>, n_records array<long>")
    coded = known.select("field", "term", "term_id", F.floor(F.col("term_id") / RANGE).alias("range"))
    return counted.groupBy("range").cogroup(coded.groupBy("range")).applyInPandas(_sum, "field string, term_id long, term string, n long, n_records long")


def marked(counts: DataFrame, n_rows: int, rare: int = 2, common_share: float = 0.02) -> DataFrame:
    """Adds ``mark``: ``rare`` for terms of at most ``rare`` occurrences, else ``common`` from ``common_share`` of all rows, else null."""
    mark = F.when(F.col("n") <= rare, "rare").when(F.col("n_records") >= n_rows * common_share, "common")
    return counts.withColumn("mark", mark)
