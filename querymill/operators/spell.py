"""Spelling repair of queries: aliases, look-alike letters, fuzzy vocabulary, units behind numbers.

Every distinct word is repaired once; the fuzzy stage joins words and vocabulary on shared deletion variants, so no
word meets the whole vocabulary, and scores only what the built-in distance lets through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querymill.functions.text import one_script, parts, plain_yo
from querymill.functions.udf import similarity, weighted_edit
from querymill.operators.skew import salted_join

# The units to which a mistyped unit is repaired.
UNITS = "гб gb тб tb мб mb мм mm см cm вт w квт kw гц hz кг л".split()


def key(c: Column) -> Column:
    """Lower case, ё as е, trimmed."""
    return plain_yo(F.lower(F.trim(c)))


def _variants(c: Column) -> Column:
    """The word and what is left after one or two deletions."""
    shorter = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
    one = F.when(F.length(c) > 2, shorter(c)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(c), one, F.flatten(F.transform(one, lambda y: F.when(F.length(y) > 1, shorter(y)).otherwise(F.array().cast("array<string>"))))))


#: Edits that a score of 0.8 admits at most, as a share of the longer word: each costs half at least.
EDIT_SHARE = 0.4
Edits = Callable[[Column, Column], Column]


def _edits(n: Column, m: Column) -> Column:
    return F.floor(F.greatest(n, m) * EDIT_SHARE).cast("int")


def pieces(w: Column, edits: Edits, spread: int) -> Column:
    """Of a vocabulary word, for each length n of a typed word that admits three edits or more: its equal pieces, one of which such edits leave whole."""
    m = F.length(w)

    def of(n: Column) -> Column:
        k = edits(n, m)
        size = F.floor(m / (k + 1)).cast("int")
        return F.when(k >= 3, F.transform(F.sequence(F.lit(0), k), lambda i: F.concat_ws("|", m, n, i, F.substring(w, i * size + 1, size)))).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(F.sequence(F.greatest(F.lit(1), m - spread), m + spread), of))


def probes(t: Column, edits: Edits, spread: int) -> Column:
    """Of a typed word, for each length m of a vocabulary word: what may be its pieces, each moved by no more than the edits."""
    n = F.length(t)

    def of(m: Column) -> Column:
        k = edits(n, m)
        size = F.floor(m / (k + 1)).cast("int")
        at = lambda i: F.filter(F.sequence(i * size - k, i * size + k), lambda p: (p >= 0) & (p + size <= n))
        each = F.flatten(F.transform(F.sequence(F.lit(0), k), lambda i: F.transform(at(i), lambda p: F.concat_ws("|", m, n, i, F.substring(t, p + 1, size)))))
        return F.when(k >= 3, each).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.flatten(F.transform(F.sequence(F.greatest(F.lit(1), n - spread), n + spread), of)))


def near_pairs(typed: DataFrame, known: DataFrame, edits: Edits, spread: int) -> DataFrame:
    """``t, w``: pairs of distinct typed (t) and known (w) words that may be within ``edits`` plain edits and differ in length by ``spread`` at most.

    Pairs of up to two edits meet on deletion variants, pairs of more on equal pieces; no pair within the edits is missed.
    """
    both = lambda f, g: typed.select("t", F.explode(f(F.col("t"))).alias("v")).join(known.select("w", F.explode(g(F.col("w"))).alias("v")), "v").select("t", "w")
    far = both(lambda c: probes(c, edits, spread), lambda c: pieces(c, edits, spread))
    return both(_variants, _variants).union(far).distinct().where(F.abs(F.length("t") - F.length("w")) <= spread)


def best_candidates(words: DataFrame, vocabulary: DataFrame, accept: float = 0.8, min_size: int = 4, edit_share: float = 0.34) -> DataFrame:
    """``t, to, score``: for words ``t`` the vocabulary word ``w`` of the best score, ties by word.

    A word in the vocabulary has itself with score 1. A candidate needs the score, which is 0.8 at least, at most
    ``max(1, edit_share * length)`` weighted edits, and a length that differs by two at most. Pairs of up to two plain edits meet on
    deletion variants; pairs of more, possible between long words and neighbouring keys, on equal pieces.
    """
    if accept < 1 - EDIT_SHARE / 2:
        raise ValueError("a lower score admits more edits than are sought")
    known = vocabulary.select("w").distinct()
    own = words.where(F.length("t") >= min_size).select("t").distinct()
    exact = own.join(known, own["t"] == known["w"]).select("t", F.col("w").alias("to"), F.lit(1.0).alias("score"))
    open_ = own.join(known, own["t"] == known["w"], "left_anti")
    pairs = near_pairs(open_, known, _edits, 2).where(F.levenshtein("t", "w") <= F.greatest(F.lit(2), _edits(F.length("t"), F.length("w"))))
    scored = pairs.withColumn("d", weighted_edit("t", "w")).withColumn("score", 1 - F.col("d") / F.greatest(F.length("t"), F.length("w"))).where(F.col("score") >= accept)
    passed = scored.where(F.col("d") <= F.greatest(F.lit(1.0), F.length("t") * edit_share))
    best = passed.groupBy("t").agg(F.min(F.struct((-F.col("score")).alias("neg"), "w")).alias("m"))
    return exact.unionByName(best.select("t", F.col("m.w").alias("to"), (-F.col("m.neg")).alias("score")))


def fix_words(words: DataFrame, vocabulary: DataFrame, aliases: DataFrame) -> DataFrame:
    """``word, fixed, score, kind`` of the distinct words (``word``) that change.

    An alias wins; then look-alike letters are brought into one script, and an alias of that; then the vocabulary; a
    word of look-alikes without a candidate keeps its one-script form.
    """
    table = aliases.select(key(F.col("alias")).alias("a"), key(F.col("canon")).alias("c")).groupBy("a").agg(F.min("c").alias("c"))
    own = words.select("word").distinct().withColumn("t", key(F.col("word"))).withColumn("homo", one_script(F.col("word"))).withColumn("h", key(F.col("homo")))
    a = own.join(table.withColumnRenamed("a", "t").withColumnRenamed("c", "alias_t"), "t", "left").join(table.withColumnRenamed("a", "h").withColumnRenamed("c", "alias_h"), "h", "left")
    fuzzy = best_candidates(a.where("alias_t IS NULL AND (alias_h IS NULL OR h = t)").select(F.col("h").alias("t")), vocabulary)
    j = a.join(fuzzy.select(F.col("t").alias("h"), "to", "score"), "h", "left")
    changed_script = F.col("h") != F.col("t")
    fixed = (
        F.when(F.col("alias_t").isNotNull() & (F.col("alias_t") != F.col("t")), F.struct(F.col("alias_t").alias("fixed"), F.lit(1.0).alias("score"), F.lit("alias").alias("kind")))
        .when(changed_script & F.col("alias_h").isNotNull() & (F.col("alias_h") != F.col("h")), F.struct(F.col("alias_h").alias("fixed"), F.lit(1.0).alias("score"), F.lit("homoglyph+alias").alias("kind")))
        .when(F.col("to").isNotNull() & (F.col("to") != F.col("h")), F.struct(F.col("to").alias("fixed"), F.round("score", 3).alias("score"), F.lit("fuzzy").alias("kind")))
        .when(changed_script, F.struct(F.col("homo").alias("fixed"), F.lit(1.0).alias("score"), F.lit("homoglyph").alias("kind")))
    )
    return j.select("word", fixed.alias("f")).where("f IS NOT NULL").select("word", "f.*")


def fix_units(words: DataFrame, accept: float = 0.7) -> DataFrame:
    """``word, fixed, score`` of words that are a number with a unit behind it (``16гь`` as ``16 гб``), or a unit alone.

    The unit is the one of the best score, ties by spelling; a known unit is parted only.
    """
    own = words.select("word").distinct().withColumn("t", key(F.col("word")))
    num, unit = F.regexp_extract("t", r"^(\d+)([а-яёa-z]{1,5})$", 1), F.regexp_extract("t", r"^(\d*)([а-яёa-z]{1,5})$", 2)
    cut = own.select("word", num.alias("num"), unit.alias("unit")).where("unit <> ''")
    units = cut.sparkSession.createDataFrame([(u,) for u in UNITS], "u string")
    kinds = cut.select("unit").distinct()
    scored = kinds.crossJoin(F.broadcast(units)).withColumn("score", F.when(F.col("unit") == F.col("u"), F.lit(1.0)).otherwise(similarity("unit", "u")))  # 18 units
    best = scored.where(F.col("score") >= accept).groupBy("unit").agg(F.min(F.struct((-F.col("score")).alias("neg"), "u")).alias("m"))
    named = best.select("unit", "m.u", (-F.col("m.neg")).alias("score"))
    return cut.join(named, "unit").select("word", F.trim(F.concat_ws(" ", F.when(F.col("num") != "", F.col("num")), "u")).alias("fixed"), F.round("score", 3).alias("score"), (F.col("num") != "").alias("glued"), (F.col("unit") == F.col("u")).alias("known"))


def fix_queries(queries: DataFrame, vocabulary: DataFrame, aliases: DataFrame) -> DataFrame:
    """``id, fixed, n_fixes`` of queries (id, query): every word repaired, everything between kept.

    Numbers stay; a number with letters behind it is repaired as a glued unit; a word directly behind a number as a unit
    where it isn't a known word; any other by the word cascade. Null queries have no row; '' stays. Each distinct query
    is repaired once.
    """
    own = queries.where("query IS NOT NULL").select("id", "query")
    distinct = own.select("query").distinct().withColumn("id", F.col("query"))
    return salted_join(own, _fix_queries(distinct, vocabulary, aliases).withColumnRenamed("id", "query"), ["query"]).select("id", "fixed", "n_fixes")


def _fix_queries(queries: DataFrame, vocabulary: DataFrame, aliases: DataFrame) -> DataFrame:
    vocabulary = vocabulary.unionByName(vocabulary.sparkSession.createDataFrame([(u,) for u in UNITS], "w string"))
    cut = queries.where("query IS NOT NULL").select("id", F.posexplode_outer(parts(F.col("query"))).alias("pos", "part"))
    word = F.col("part").rlike(r"(?U)^\w")
    # a query's words lie one gap apart, so the word before is two parts back
    w = Window.partitionBy("id").orderBy("pos")
    marked = cut.withColumn("is_word", F.coalesce(word, F.lit(False))).withColumn("before", F.when(F.col("is_word"), F.lag("part", 2).over(w)))
    number = F.col("part").rlike(r"(?U)^\d+$")
    kind = F.when(~F.col("is_word") | number, "keep").when(key(F.col("part")).rlike(r"^\d+[а-яёa-z]"), "glued").when(F.col("before").rlike(r"(?U)^\d+$"), "behind").otherwise("word")
    typed = marked.withColumn("kind", kind).select("id", "pos", "part", "kind")
    distinct = typed.where("kind <> 'keep'").select(F.col("part").alias("word")).distinct()
    fixes = fix_words(distinct, vocabulary, aliases).select(F.col("word").alias("part"), F.col("fixed").alias("by_word"))
    units = fix_units(distinct).select(F.col("word").alias("part"), F.col("fixed").alias("by_unit"), "known", "glued")
    known = vocabulary.select(F.col("w").alias("k")).distinct().withColumn("is_known", F.lit(True))
    j = typed.join(fixes, "part", "left").join(units, "part", "left").withColumn("k", key(F.col("part"))).join(known, "k", "left")
    plain_unit = F.col("by_unit").isNotNull() & ~F.col("known") & ~F.col("glued") & (F.length("k") <= 4) & F.col("is_known").isNull()
    fixed = F.when(F.col("kind") == "glued", F.when(F.col("glued"), F.col("by_unit"))).when((F.col("kind") == "behind") & plain_unit, F.col("by_unit")).when(F.col("kind").isin("word", "behind"), F.col("by_word"))
    out = j.select("id", "pos", "part", fixed.alias("fixed"))
    return out.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("fixed", "part", F.lit("")).alias("p")))).alias("a"), F.count("fixed").alias("n_fixes")).select("id", F.array_join("a.p", "").alias("fixed"), "n_fixes")


def fix_lite(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``word, fixed`` under the lighter rule: at most one plain edit, or two from six letters on, and a third of the length."""
    own = words.select("word").distinct().withColumn("t", key(F.col("word"))).where(F.length("t") >= 4)
    known = vocabulary.select("w").distinct()
    open_ = own.join(known, own["t"] == known["w"], "left_anti")
    pairs = open_.select("word", "t", F.explode(_variants(F.col("t"))).alias("v")).join(known.select("w", F.explode(_variants(F.col("w"))).alias("v")), "v").select("word", "t", "w").distinct()
    d = pairs.withColumn("d", F.levenshtein("t", "w", 2)).where("d >= 0").where(F.col("d") <= F.greatest(F.lit(1), F.floor(F.length("t") / 3)))
    best = d.groupBy("word", "t").agg(F.min(F.struct("d", "w")).alias("m"))
    return best.where("m.d <= 1 OR (m.d = 2 AND length(t) >= 6)").select("word", F.col("m.w").alias("fixed"))
