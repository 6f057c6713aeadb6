"""Dictionaries mined from the click log and the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querymill.functions.text import plain_tokens


def brands(clicks: DataFrame, col: str, least: int = 5, keep: list[str] | None = None, top: int = 5000) -> DataFrame:
    """``brand, n``: names of more than two characters (or kept ones) that aren't digits only and have ``least`` rows."""
    b = F.trim(col)
    ok = ~b.rlike(r"^\d+$") & ((F.length(b) > 2) | F.lower(b).isin(keep or []))
    return clicks.where(ok).groupBy(b.alias("brand")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "brand").limit(top)


def categories(clicks: DataFrame, col: str, brand_words: DataFrame, least: int = 20, most_words: int = 3) -> DataFrame:
    """``phrase, n`` of short queries without digits of ``least`` rows, none of whose words is a brand's (``w``) and which aren't one Latin word."""
    t = plain_tokens(F.col(col))
    short = clicks.select(t.alias("t")).where(F.size("t").between(1, most_words)).select(F.array_join("t", " ").alias("phrase"))
    n = short.groupBy("phrase").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= least) & ~F.col("phrase").rlike(r"\d|^[a-z]+$"))
    held = n.select("phrase", F.explode(F.split("phrase", " ")).alias("w")).join(brand_words, "w", "left_semi").select("phrase").distinct()
    return n.join(held, "phrase", "left_anti")


def model_phrases(titles: DataFrame, col: str, brand_words: DataFrame, least: int = 3, most: int = 4) -> DataFrame:
    """``phrase, n``: prefixes of the run of one to ``most`` Latin or digit tokens behind a brand word (``w``) of a title.

    Phrases of numbers only, of one short token, or with an article number in them are dropped.
    """
    t = F.filter(F.split(F.lower(col), r"[^a-z0-9а-яё]+"), lambda x: x != "")
    pos = titles.select(t.alias("t")).select("t", F.posexplode("t").alias("i", "w")).join(brand_words.select("w").distinct(), "w")
    run = F.slice("t", F.col("i") + 2, most)
    grown = F.filter(F.transform(F.sequence(F.lit(1), F.lit(most)), lambda n: F.slice(run, F.lit(1), n)), lambda p: (F.size(p) > 0) & F.forall(p, lambda x: x.rlike("^[a-z0-9]{1,12}$")))
    n = pos.select(F.explode(F.array_distinct(F.transform(grown, lambda p: F.array_join(p, " ")))).alias("phrase")).groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))
    return n.where((F.col("n") >= least) & accepted(F.col("phrase")))


def accepted(phrase: Column) -> Column:
    """Whether a phrase may be a model: not numbers only, not one token of two characters, no token of three digits and two letters."""
    words = F.split(phrase, " ")
    article = F.exists(words, lambda w: (F.length(F.regexp_replace(w, r"\D", "")) >= 3) & (F.length(F.regexp_replace(w, r"[^a-zа-яё]", "")) >= 2))
    return ~F.forall(words, lambda w: w.rlike(r"^\d+(\.\d+)?$")) & ~((F.size(words) == 1) & (F.length(phrase) <= 2)) & ~article


def phrase_flags(phrase: Column) -> Column:
    """Long digits, five tokens or more, a word of an accessory."""
    return F.struct(phrase.rlike(r"\d{5,}").alias("long_digits"), (F.size(F.split(phrase, " ")) >= 5).alias("many_tokens"), phrase.rlike("чехол|кабель|стекло|case|cable").alias("accessory"))


def coverage_by_support(counts: DataFrame, grid: list[int]) -> DataFrame:
    """``least, n_phrases, covered`` for each least count: how large the dictionary gets and which share of all rows it covers; one pass."""
    total = F.sum("n")
    cells = [F.struct(F.lit(g).alias("least"), F.count_if(F.col("n") >= g).alias("n_phrases"), F.round(F.coalesce(F.sum(F.when(F.col("n") >= g, F.col("n"))), F.lit(0)) / total, 6).alias("covered")) for g in grid]
    return counts.agg(F.array(*cells).alias("a")).select(F.inline("a"))
