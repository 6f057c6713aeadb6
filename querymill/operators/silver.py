"""From votes to a training set: evidence of a brand in the query, a label with its reason, balance, tiers, split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querymill.functions.text import holds_phrase, plain_tokens
from querymill.operators.stats import capped_classes, stratified_split
from querymill.sources.tables import stage

NO_BRAND, UNKNOWN = "NO_BRAND", "UNKNOWN"
#: Most of a special class: its share of the rows, and the rows it may have at least.
CAPS = [(NO_BRAND, 0.18, 200), (UNKNOWN, 0.12, 150)]


def evidence(voted: DataFrame, aliases: DataFrame, categories: DataFrame, top: DataFrame, most_tokens: int = 4, cover: float = 0.6) -> DataFrame:
    """Adds to votes: whether the brand stands in the query, a known one-word alias and its brand, whether the query is a category only, whether the brand is of the closed set.

    An alias is found by an equi-join on the query's words; of several the longest, then the first by text counts. A query is a category only with at most
    ``most_tokens`` words, a share ``cover`` of category words, no digit and no alias.
    """
    q = F.col("query_norm")
    words = voted.select("query_norm", F.explode(F.array_distinct(plain_tokens(q))).alias("w"))
    named = aliases.select(F.lower("alias").alias("w"), F.col("canon").alias("alias_canon")).where("w NOT LIKE '% %'").groupBy("w").agg(F.min("alias_canon").alias("alias_canon"))
    hit = words.join(named, "w").groupBy("query_norm").agg(F.min(F.struct((-F.length("w")).alias("neg"), "w", "alias_canon")).alias("m")).select("query_norm", "m.alias_canon")
    vocabulary = categories.select(F.explode(plain_tokens(F.col("category"))).alias("w")).where("length(w) >= 3").distinct()
    covered = words.join(vocabulary, "w").groupBy("query_norm").agg(F.count(F.lit(1)).alias("n_cat"))
    closed = top.select(F.col("brand").alias("click_brand")).distinct().withColumn("in_top", F.lit(True))
    j = voted.join(hit, "query_norm", "left").join(covered, "query_norm", "left").join(closed, "click_brand", "left")
    t = F.array_distinct(plain_tokens(q))
    digits = F.exists(t, lambda w: w.rlike(r"\d"))
    only = F.col("alias_canon").isNull() & ~digits & (F.size(t) > 0) & (F.size(t) <= most_tokens) & (F.coalesce("n_cat", F.lit(0)) / F.greatest(F.lit(1), F.size(t)) >= cover)
    return j.withColumn("brand_in_query", F.coalesce(holds_phrase(q, F.lower("click_brand")), F.lit(False))).withColumn("category_only", only).withColumn("in_top", F.coalesce("in_top", F.lit(False))).drop("n_cat")


def assigned(df: DataFrame, least_confidence: float = 0.6, least_clicks: int = 1, high: float = 0.8) -> DataFrame:
    """Adds ``brand`` and ``reason`` by the first rule that holds; ``top`` tells whether an alias's brand is of the closed set."""
    sure = (F.col("confidence") >= least_confidence) & (F.col("n_clicks") >= least_clicks) & ((F.col("n_brands") <= 1) | (F.col("confidence") >= high))
    has_alias, inside = F.col("alias_canon").isNotNull(), F.col("brand_in_query")
    pick = lambda brand, reason: F.struct((brand if isinstance(brand, Column) else F.lit(brand).cast("string")).alias("brand"), F.lit(reason).alias("reason"))
    rule = (
        F.when(F.col("category_only"), pick(NO_BRAND, "category_only"))
        .when(has_alias & F.col("alias_in_top"), pick(F.col("alias_canon"), "alias_hint"))
        .when(inside & F.col("in_top") & sure, pick(F.col("click_brand"), "brand_in_query"))
        .when(inside & ~F.col("in_top") & sure, pick(UNKNOWN, "ood_brand_surface"))
        .when(~inside & ~has_alias & (F.col("n_brands") >= 3) & (F.col("confidence") < 0.5), pick(UNKNOWN, "ambiguous_clicks"))
        .when(~inside & ~has_alias, pick(None, "no_evidence_drop"))
        .when(~sure, pick(UNKNOWN, "low_conf_with_evidence"))
        .otherwise(pick(None, "other_drop"))
    )
    return df.withColumn("l", rule).select("*", "l.*").drop("l")


def tier(brand: Column, confidence: Column, clicks: Column, evidence_: Column, high: float = 0.8, medium: float = 0.6) -> Column:
    """special, high, medium or low."""
    return F.when(brand.isin(NO_BRAND, UNKNOWN), "special").when((confidence >= high) & ((clicks >= 2) | evidence_), "high").when(confidence >= medium, "medium").otherwise("low")


def weight(brand: Column, confidence: Column) -> Column:
    """1 without a brand, 0.9 for unknown ones, else the confidence between 0.35 and 1."""
    return F.when(brand == NO_BRAND, 1.0).when(brand == UNKNOWN, 0.9).otherwise(F.greatest(F.lit(0.35), F.least(F.lit(1.0), confidence)))


def training_set(df: DataFrame, least_class: int = 20, special_least: int = 15, share: float = 0.2) -> DataFrame:
    """Labelled rows of 2 to 120 characters, balanced, with tier, weight, supported classes only, split part and label id (special classes last)."""
    rows = df.where(F.col("brand").isNotNull() & F.length("query_norm").between(2, 120))
    even = capped_classes(stage(rows, "labelled"), "brand", ["query_norm"], CAPS)
    n = even.groupBy("brand").agg(F.count(F.lit(1)).alias("n__"))
    special = F.col("brand").isin(NO_BRAND, UNKNOWN)
    kept = n.where((F.col("n__") >= least_class) | (special & (F.col("n__") >= special_least))).select("brand")
    ids = kept.withColumn("label_id", F.row_number().over(Window.orderBy(special, "brand")) - 1)  # one row a class
    out = even.join(F.broadcast(ids), "brand")
    out = out.withColumn("tier", tier(F.col("brand"), F.col("confidence"), F.col("n_clicks"), F.col("brand_in_query") | F.col("alias_canon").isNotNull())).withColumn("sample_weight", weight(F.col("brand"), F.col("confidence")))
    return stratified_split(out, "brand", ["query_norm"], share)


def serving_set(df: DataFrame, least_class: int = 20, special_least: int = 15) -> DataFrame:
    """``query_norm, brand, sample_weight``: all labelled rows of 2 to 120 characters of the classes that ``training_set`` supports.

    None is cut or held out: a class that ``training_set`` cuts keeps all its rows, each weighing less by as much.
    """
    rows = df.where(F.col("brand").isNotNull() & F.length("query_norm").between(2, 120)).select("query_norm", "brand", weight(F.col("brand"), F.col("confidence")).alias("sample_weight"))
    rows = stage(rows, "labelled")
    n = {r["brand"]: r["count"] for r in rows.groupBy("brand").count().collect()}  # brands of the closed set
    kept, total, even = dict(n), sum(n.values()), F.lit(1.0)
    for c, share, least in CAPS:
        if c in n:
            kept[c] = min(n[c], max(least, int(share * (total - n[c]) / (1 - share))))
            total += kept[c] - n[c]
            even = F.when(F.col("brand") == c, kept[c] / n[c]).otherwise(even)
    special = {c for c, _, _ in CAPS}
    supported = [c for c, k in kept.items() if k >= (min(least_class, special_least) if c in special else least_class)]
    return rows.where(F.col("brand").isin(supported)).withColumn("sample_weight", F.col("sample_weight") * even)


def gate(has_brand: Column, category_only: Column, evidence_: Column) -> Column:
    """Whether the classifier is asked at all: not with a brand found, nor for a category alone."""
    return ~has_brand & ~category_only & evidence_
