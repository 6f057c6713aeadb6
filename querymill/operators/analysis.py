"""Smaller analyses over queries, labels and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querymill.functions.attributes import KINDS, attribute_type, canonical_subtype, looks_like_model, pattern
from querymill.operators.clicks import first_click
from querymill.operators.stats import hash_order


def pattern_coverage(df: DataFrame, text: Column) -> DataFrame:
    """``kind, share``: rows that match any pattern of each kind, and ``any``; one pass; no rows give null shares."""
    rules: dict[str, Column] = {}
    for name, rule in KINDS:
        hit = text.rlike(pattern(rule))
        rules[name] = rules[name] | hit if name in rules else hit
    some = F.lit(False)
    for c in rules.values():
        some = some | c
    rules["any"] = some
    one = df.agg(*[F.round(F.avg(c.cast("int")), 6).alias(k) for k, c in rules.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("share")) for k in rules])))


def confidence_split(df: DataFrame, correct: Column, confidence: Column) -> DataFrame:
    """``correct, n, mean_confidence, sure, unsure`` of right and wrong decisions."""
    return df.groupBy(correct.alias("correct")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(confidence), 6).alias("mean_confidence"), F.count_if(confidence > 0.8).alias("sure"), F.count_if(confidence < 0.5).alias("unsure")
    )


def subtype_agreement(df: DataFrame, raw: Column, gold: Column, canon: list[str]) -> DataFrame:
    """Agreement with gold before and after mapping subtypes, and the number of subtypes outside the canon."""
    rate = lambda c: F.round(F.avg(c.cast("int")), 6)
    return df.agg(F.count(F.lit(1)).alias("n"), rate(raw == gold).alias("raw_agreement"), rate(canonical_subtype(raw) == gold).alias("mapped_agreement"), F.count_distinct(F.when(~raw.isin(canon), raw)).alias("outside"))


def first_key(keys: Column, start: Column, end: Column) -> Column:
    """The first position of [start, end) that is a key of the map; null without one."""
    at = F.when(end > start, F.sequence(start, end - 1)).otherwise(F.array().cast("array<int>"))
    return F.array_min(F.filter(at, lambda i: F.map_contains_key(keys, i)))


def bag_cosine(a: Column, b: Column) -> Column:
    """Cosine of two bags of words; 0 with an empty one."""
    count = lambda bag, w: F.size(F.filter(bag, lambda x: x == w))
    square = lambda bag: F.aggregate(F.array_distinct(bag), F.lit(0), lambda s, w: s + count(bag, w) * count(bag, w))
    dot = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, w: s + count(a, w) * count(b, w))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), dot / (F.sqrt(square(a)) * F.sqrt(square(b)))).otherwise(0.0)


def lemmas(df: DataFrame, forms: DataFrame) -> DataFrame:
    """``cand_id, pos, lemma`` of the words (t) of each row, by a dictionary (form, lemma) with the word itself as default."""
    w = df.select("cand_id", F.posexplode("t").alias("pos", "form"))
    one = forms.groupBy("form").agg(F.min("lemma").alias("lemma"))
    return w.join(one, "form", "left").select("cand_id", F.col("pos").cast("long").alias("pos"), F.coalesce("lemma", "form").alias("lemma"))


def pairs_to_label(queries: DataFrame, clicked: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """``query, sku_id, kind``: each of the k sampled queries with its first clicked item, else with one of k items in the fixed random order."""
    number = lambda w: F.row_number().over(w) - 1
    q = queries.withColumn("k", number(Window.orderBy("query")))
    drawn = items.select("sku_id").orderBy(hash_order("sku_id"), "sku_id").limit(k)
    drawn = drawn.withColumn("k", number(Window.orderBy(hash_order("sku_id"), "sku_id"))).withColumnRenamed("sku_id", "drawn")
    j = q.join(first_click(clicked).select("query", "sku_id"), "query", "left").join(drawn, "k")
    return j.select("query", F.coalesce("sku_id", "drawn").alias("sku_id"), F.when(F.col("sku_id").isNull(), "random").otherwise("clicked").alias("kind"))


def assemble_tags(bio: Column, types: Column) -> Column:
    """Tags from parallel arrays; O has no type."""
    return F.zip_with(bio, types, lambda b, t: F.when((b == "O") | b.isNull(), "O").otherwise(F.concat(b, F.lit("-"), t)))


def typed(text: Column, top: Column, p1: Column, tau: float = 0.55) -> Column:
    """The classifier's type from ``tau`` on, else the rules'; spans that look like a model are unknown."""
    return F.when(looks_like_model(text), "UNKNOWN").when(p1 >= tau, top).otherwise(attribute_type(text))


def served(text: Column, top: Column, p1: Column, tau: float = 0.55) -> Column:
    """The classifier's type from ``tau`` on; where it is unsure or says other, or the span looks like a model, the rules' type if they have one, else UNKNOWN or other."""
    label = F.when(looks_like_model(text), "UNKNOWN").when(p1 >= tau, top).otherwise("UNKNOWN")
    rules = attribute_type(text)
    return F.when(label.isin("UNKNOWN", "other") & (rules != "other"), rules).otherwise(label)
