"""One consistent form of visually identical text.

Suspicious distinct texts are exploded into positioned code points. Broadcast joins give each its full compatibility
decomposition, and each letter of a word its look-alike in the alphabet of most of the word's letters; combining marks
are ordered by class behind their starter and recomposed with it, and the strings are rebuilt. All steps after the
explode stay in the partition of the text.

The tables hold one row a code point or pair and come from Python's Unicode database, so their size is fixed.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querymill.functions.chars import GREEK_CYRILLIC, GREEK_LATIN, HYPHENS, INVISIBLE, SPACES, TO_CYRILLIC, TO_LATIN
from querymill.operators.skew import salted_join
from querymill.sources.tables import stage

#: A superset of what can need a change: anything beyond ASCII and the Russian letters, or two alphabets side by side.
SUSPICIOUS = r"[^\x00-\x7Fа-яА-ЯёЁ]|[A-Za-z][а-яА-ЯёЁ]|[а-яА-ЯёЁ][A-Za-z]"


@lru_cache(maxsize=1)
def _unicode() -> tuple[dict[str, str], dict[str, str], set[str]]:
    """Full compatibility decompositions of all characters that have one; primary compositions of pairs; characters that join a starter."""
    special = {**dict.fromkeys(map(chr, INVISIBLE), ""), **dict.fromkeys(map(chr, HYPHENS), "-"), **dict.fromkeys(map(chr, SPACES), " ")}
    parts, pairs, joiners = {}, {}, set()
    for code in range(sys.maxunicode + 1):
        c = chr(code)
        if 0xD800 <= code < 0xE000:
            continue
        if unicodedata.combining(c):
            joiners.add(c)
        if c in special:
            parts[c] = special[c]
            continue
        full = unicodedata.normalize("NFKD", c)
        if full != c:
            parts[c] = "".join(special.get(x, x) for x in full)
        once = unicodedata.decomposition(c)
        if once and once[0] != "<" or 0xAC00 <= code < 0xD7A4:
            if 0xAC00 <= code < 0xD7A4:
                tail = (code - 0xAC00) % 28
                two = [chr(code - tail), chr(0x11A7 + tail)] if tail else list(unicodedata.normalize("NFD", c))
            else:
                two = [chr(int(x, 16)) for x in once.split()]
            if len(two) == 2 and unicodedata.normalize("NFC", c) == c:
                pairs[two[0] + two[1]] = c
                joiners.add(two[1])
    return parts, pairs, joiners


def decompositions(spark: SparkSession) -> DataFrame:
    """``ch, seq``: the characters that ``ch`` stands for, each with its combining class and whether it joins a starter."""
    parts, _, joiners = _unicode()

    def seq(s: str) -> list[tuple[str, int, bool]]:
        return [(x, unicodedata.combining(x), x in joiners) for x in s]

    rows = [(c, seq(s)) for c, s in parts.items()] + [(c, seq(c)) for c in joiners if c not in parts]
    return spark.createDataFrame(rows, "ch string, seq array<struct<c string, ccc int, joins boolean>>")


def compositions(spark: SparkSession) -> DataFrame:
    """``starter, pairs``: all compositions that can be reached from a starter, by the two characters they replace."""
    _, pairs, _ = _unicode()
    grown: dict[str, dict[str, str]] = {}
    for two, c in pairs.items():
        base = unicodedata.normalize("NFD", two[0])[0]
        grown.setdefault(base, {})[two] = c
    return spark.createDataFrame(list(grown.items()), "starter string, pairs map<string,string>")


def look_alikes(spark: SparkSession) -> DataFrame:
    """``alphabet, c, same``: the letter of an alphabet that looks like a letter of another one."""
    rows = [("L", k, v) for k, v in {**GREEK_LATIN, **TO_LATIN}.items()] + [("C", k, v) for k, v in {**GREEK_CYRILLIC, **TO_CYRILLIC}.items()]
    return spark.createDataFrame(rows, "alphabet string, c string, same string")


def _recomposed(marks: Column, starter: Column, pairs: Column) -> Column:
    """The starter with its ordered marks: a mark joins unless an equal or higher class stands between."""
    state = F.struct(F.lit("").alias("done"), starter.alias("cur"), F.lit("").alias("out"), F.lit(-1).alias("last"))

    def step(s: Column, m: Column) -> Column:
        made = F.element_at(pairs, F.concat(s["cur"], m["c"]))
        free = (s["out"] == "") | ((s["last"] < m["ccc"]) & (s["last"] > 0))
        joined = F.struct(s["done"].alias("done"), made.alias("cur"), s["out"].alias("out"), s["last"].alias("last"))
        restart = F.struct(F.concat(s["done"], s["cur"], s["out"]).alias("done"), m["c"].alias("cur"), F.lit("").alias("out"), F.lit(-1).alias("last"))
        kept = F.struct(s["done"].alias("done"), s["cur"].alias("cur"), F.concat(s["out"], m["c"]).alias("out"), m["ccc"].alias("last"))
        return F.when(free & made.isNotNull(), joined).when(m["ccc"] == 0, restart).otherwise(kept)

    return F.aggregate(marks, state, step, lambda s: F.concat(s["done"], s["cur"], s["out"]))


def plain_forms(texts: DataFrame) -> DataFrame:
    """``text, clean`` of every distinct suspicious text of the column ``text`` whose plain form differs from it.

    Letter case, punctuation, tabs, line ends and repeated or outer spaces stay. Defined cases: null and empty texts are
    plain; a text of invisible characters only becomes ''; a tie between alphabets goes to the one with letters that
    have no look-alike, else to Cyrillic; letters without a look-alike stay.
    """
    spark = texts.sparkSession
    distinct = stage(texts.select("text").where(F.col("text").rlike(SUSPICIOUS)).distinct().withColumn("id", F.monotonically_increasing_id()), "suspicious")
    points = distinct.select("id", F.posexplode(F.split("text", "")).alias("pos", "ch")).where("ch <> ''")
    seq = F.coalesce("seq", F.array(F.struct(F.col("ch").alias("c"), F.lit(0).alias("ccc"), F.lit(False).alias("joins"))))
    # an invisible character leaves one row without a character, which carries the original along
    parts = points.join(F.broadcast(decompositions(spark)), "ch", "left").select("id", "pos", "ch", F.posexplode_outer(seq).alias("sub", "x"))
    parts = parts.select("id", "pos", F.coalesce("sub", F.lit(0)).alias("sub"), F.when(F.coalesce("sub", F.lit(0)) == 0, F.col("ch")).otherwise("").alias("was"), "x.*")

    order = Window.partitionBy("id").orderBy("pos", "sub")
    letter = F.coalesce(F.col("c").rlike(r"^\p{L}$"), F.lit(False))
    counted = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).over(order)
    placed = (
        parts.repartition("id")
        .withColumn("letter", letter)
        .withColumn("seg", counted(F.col("c").isNotNull() & ~F.col("joins")))
        .withColumn("inner", counted(F.col("ccc") == 0))
        .withColumn("word", counted(F.col("c").isNotNull() & ~F.col("c").rlike(r"^[\p{L}\p{M}]$")))
    )
    per = Window.partitionBy("id", "word")
    latin, cyrillic, greek = (F.col("letter") & F.col("c").rlike(rf"^\p{{Is{s}}}$") for s in ("Latin", "Cyrillic", "Greek"))
    number = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).over(per)
    own_latin, own_cyrillic = latin & ~F.col("c").isin(list(TO_CYRILLIC)), cyrillic & ~F.col("c").isin(list(TO_LATIN))
    told = placed.select("*", number(latin).alias("l"), number(cyrillic).alias("k"), number(greek).alias("g"), number(own_latin).alias("ol"), number(own_cyrillic).alias("ok"))
    mixed = F.col("letter") & ((F.col("l") > 0).cast("int") + (F.col("k") > 0).cast("int") + (F.col("g") > 0).cast("int") > 1) & (F.col("l") + F.col("k") > 0)
    to_latin = (F.col("l") > F.col("k")) | ((F.col("l") == F.col("k")) & (F.col("ol") > F.col("ok")))
    aimed = told.withColumn("alphabet", F.when(mixed, F.when(to_latin, "L").otherwise("C")))
    # one row a letter and alphabet: the join adds no rows
    mapped = aimed.join(F.broadcast(look_alikes(spark)), ["alphabet", "c"], "left").withColumn("c", F.coalesce("same", "c"))

    grouped = (
        mapped.groupBy("id", "seg")
        .agg(F.array_sort(F.collect_list(F.when(F.col("c").isNotNull(), F.struct("inner", "ccc", "pos", "sub", "c")))).alias("run"), F.array_sort(F.collect_list(F.struct("pos", "sub", "was"))).alias("was"))
        .select("id", "seg", F.array_join(F.col("was.was"), "").alias("was"), F.try_element_at("run", F.lit(1))["c"].alias("starter"), F.when(F.size("run") > 1, F.slice("run", 2, 1 << 30)).alias("marks"))
    )
    piece = F.when(F.col("starter").isNull(), "").when(F.col("marks").isNull(), F.col("starter")).otherwise(
        _recomposed(F.col("marks"), F.col("starter"), F.coalesce("pairs", F.create_map().cast("map<string,string>")))
    )
    pieces = grouped.join(F.broadcast(compositions(spark)), "starter", "left").select("id", "seg", "was", piece.alias("c"))
    rebuilt = pieces.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("seg", "was", "c"))).alias("s")).select(F.array_join("s.was", "").alias("text"), F.array_join("s.c", "").alias("clean"))
    return rebuilt.where("text <> clean")


def plain_rows(texts: DataFrame) -> DataFrame:
    """``tab, row_id, clean`` of the rows (``tab, row_id, text``) whose text isn't plain; the rows of a hot text are spread over many tasks."""
    rows = texts.select("tab", "row_id", "text").where(F.col("text").rlike(SUSPICIOUS))
    return salted_join(rows, plain_forms(texts), ["text"]).select("tab", "row_id", "clean")
