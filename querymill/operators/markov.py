"""Types of spans from frequency tables of their tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normal_tokens(c: Column) -> Column:
    """Tokens with numbers as ``<num>``."""
    return F.transform(c, lambda t: F.when(t.rlike(r"^\d+(?:[.,/]\d+)?$"), "<num>").otherwise(t))


def bigrams(t: Column) -> Column:
    """``(key, pos)`` of neighbouring tokens."""
    n = F.size(t) - 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.concat_ws("|", F.get(t, i), F.get(t, i + 1)).alias("key"), i.alias("pos")))).otherwise(F.array().cast("array<struct<key:string,pos:int>>"))


def train(spans: DataFrame, last_unit_only: bool = False) -> DataFrame:
    """``tab, key, type, n`` of spans (t, type): bigrams by type, units by type, tokens by the next token.

    A unit is a token that isn't a number; with ``last_unit_only`` the last one of a span.
    """
    t = spans.select(normal_tokens(F.col("t")).alias("t"), "type")
    pairs = t.select(F.lit("bigram").alias("tab"), F.explode(bigrams(F.col("t"))).alias("b"), "type").select("tab", "b.key", "type")
    units = F.array(F.try_element_at("t", F.lit(-1))) if last_unit_only else F.col("t")
    unit = t.select(F.lit("unit").alias("tab"), F.explode(units).alias("key"), "type").where("key IS NOT NULL AND key <> '<num>'")
    nxt = t.select(F.lit("next").alias("tab"), F.explode(bigrams(F.col("t"))).alias("b")).select("tab", F.substring_index("b.key", "|", 1).alias("key"), F.substring_index("b.key", "|", -1).alias("type"))
    return pairs.unionByName(unit).unionByName(nxt).groupBy("tab", "key", "type").agg(F.count(F.lit(1)).alias("n"))


def best_type(tables: DataFrame, tab: str) -> DataFrame:
    """``key, type``: the most frequent type of each key, ties by name; one row a key."""
    return tables.where(F.col("tab") == tab).groupBy("key").agg(F.min(F.struct((-F.col("n")).alias("neg"), "type")).alias("m")).select("key", "m.type")


def predict_votes(spans: DataFrame, tables: DataFrame, all_units: bool = False) -> DataFrame:
    """``id, type, prob`` of spans (id, t): votes of all known bigrams are added up; without one the first known unit decides, or the votes of all units; else unknown."""
    t = spans.select("id", normal_tokens(F.col("t")).alias("t"))
    voted = t.select("id", F.explode(bigrams(F.col("t"))).alias("b")).select("id", "b.key").join(tables.where("tab = 'bigram'"), "key").groupBy("id", "type").agg(F.sum("n").alias("n"))
    by_bigram = _winner(voted)
    units = t.select("id", F.posexplode("t").alias("pos", "key")).where("key <> '<num>'")
    if all_units:
        by_unit = _winner(units.join(tables.where("tab = 'unit'"), "key").groupBy("id", "type").agg(F.sum("n").alias("n")))
    else:
        by_unit = units.join(best_type(tables, "unit"), "key").groupBy("id").agg(F.min(F.struct("pos", "type")).alias("m")).select("id", "m.type", F.lit(None).cast("double").alias("prob"))
    j = t.select("id").join(by_bigram, "id", "left").join(by_unit.withColumnsRenamed({"type": "u_type", "prob": "u_prob"}), "id", "left")
    return j.select("id", F.coalesce("type", "u_type", F.lit("unknown")).alias("type"), F.when(F.col("type").isNotNull(), F.col("prob")).otherwise(F.coalesce("u_prob", F.lit(0.0))).alias("prob"))


def _winner(votes: DataFrame) -> DataFrame:
    best = votes.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("neg"), "type")).alias("m"), F.sum("n").alias("all"))
    return best.select("id", "m.type", F.round(-F.col("m.neg") / F.col("all"), 6).alias("prob"))


def predict_first(spans: DataFrame, tables: DataFrame) -> DataFrame:
    """``id, type``: the first known bigram decides, else the first known unit, else null."""
    t = spans.select("id", normal_tokens(F.col("t")).alias("t"))
    one = lambda df, tab: df.join(best_type(tables, tab), "key").groupBy("id").agg(F.min(F.struct("pos", "type")).alias("m")).select("id", F.col("m.type").alias(tab))
    b = one(t.select("id", F.explode(bigrams(F.col("t"))).alias("b")).select("id", "b.key", "b.pos"), "bigram")
    u = one(t.select("id", F.posexplode("t").alias("pos", "key")).where("key <> '<num>'"), "unit")
    return t.select("id").join(b, "id", "left").join(u, "id", "left").select("id", F.coalesce("bigram", "unit").alias("type"))


def next_distribution(tables: DataFrame) -> DataFrame:
    """``token, next, share`` of the transitions."""
    w = Window.partitionBy("key")
    return tables.where("tab = 'next'").select(F.col("key").alias("token"), F.col("type").alias("next"), F.round(F.col("n") / F.sum("n").over(w), 6).alias("share"))


def ambiguous_keys(tables: DataFrame, tab: str, least: int = 20, top: int = 4) -> DataFrame:
    """``key, total, kinds, best``: keys of at least two types and ``least`` counts, with their most frequent types."""
    per = tables.where(F.col("tab") == tab).groupBy("key").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("neg"), "type"))).alias("l"))
    return per.where((F.col("kinds") >= 2) & (F.col("total") >= least)).select("key", "total", "kinds", F.array_join(F.transform(F.slice("l", 1, top), lambda x: F.concat_ws(":", x["type"], (-x["neg"]).cast("string"))), ",").alias("best"))
