"""Freely typed values mapped to the entries of a reference list: token repair and soft TF-IDF.

Every distinct token of the texts (and every two neighbouring tokens written as one) is joined with the vocabulary of
the reference list by edit distance: both sides are expanded to their deletion variants, equi-joined on these, and
verified. Forms compared are the token as typed, its sound in Latin letters, and the same after undoing a wrong
keyboard layout. An entry becomes a candidate through any of its key tokens, the rarest ones without which no text can
reach the threshold; it is scored by soft TF-IDF over all its tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querymill.functions.chars import fold
from querymill.functions.text import JCUKEN, QWERTY
from querymill.sources.tables import stage

# Cyrillic letters that one Latin letter stands for, and those that several or none do.
CYRILLIC_ONE = ("абвгдеёзийклмнопрстуфхыэіїєґ", "abvgdeeziiklmnoprstufhieiieg")
CYRILLIC_MANY = {"ж": "zh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sch", "ю": "yu", "я": "ya", "ъ": "", "ь": ""}
# Latin spellings of one sound, applied in this order.
SAME_SOUND = {"x": "ks", "sch": "sh", "ph": "f", "w": "v", "y": "i", "j": "i", "q": "k"}

_TOKEN = re.compile(r"[^\W_]+")
#: Keys that are letters on the other layout only, and that layout.
_PUNCTUATED, _LATIN = re.compile(r"[`\[\];',.]"), re.compile("[A-Za-z]")
_RUSSIAN_KEYS = str.maketrans(QWERTY, JCUKEN)


def sound(token: Column) -> Column:
    """A folded token in Latin letters by sound."""
    out = F.translate(token, *CYRILLIC_ONE)
    for a, b in {**CYRILLIC_MANY, **SAME_SOUND}.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(out, "c(?!h)", "k")


def true_forms(token: Column) -> Column:
    """The distinct forms of a folded token of the reference list."""
    return F.filter(F.array_distinct(F.array(token, sound(token))), lambda f: F.length(f) > 0)


def forms(token: Column) -> Column:
    """The distinct forms in which a typed folded token is compared: as typed, by sound, and with the keyboard layout undone."""
    other = F.when(token.rlike("[а-яё]"), F.translate(token, JCUKEN, QWERTY)).otherwise(F.translate(token, QWERTY, JCUKEN))
    return F.filter(F.array_distinct(F.array(token, sound(token), F.translate(F.regexp_replace(other, "[^a-zа-яё]", ""), "ёй", "еи"), sound(other))), lambda f: F.length(f) > 0)


def allowed(form: Column) -> Column:
    """Edits allowed by the length of the true form: none up to 4 letters and in numbers, one up to 6, else two."""
    n = F.length(form)
    return F.when((n <= 4) | form.rlike("^[0-9]+$"), 0).when(n <= 6, 1).otherwise(2)


def tried_edits(form: Column) -> Column:
    """Edits tried by the length of the typed form, which may have lost letters."""
    n = F.length(form)
    return F.when((n <= 3) | form.rlike("^[0-9]+$"), 0).when(n == 4, 1).otherwise(2)


def _shorter(form: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(form)), lambda i: F.concat(F.substring(form, 1, i - 1), F.substring(form, i + 1, F.length(form))))


def deletions(form: Column, edits: Column) -> Column:
    """The form and everything left of it after at most ``edits`` (0, 1 or 2) deletions."""
    one = F.when(edits >= 1, _shorter(form)).otherwise(F.array().cast("array<string>"))
    two = F.when(edits >= 2, F.flatten(F.transform(_shorter(form), _shorter))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(form), one, two))


def spoken_tokens(text: str) -> list[tuple[int, int, str]]:
    """(position, words, token) of a text: its folded tokens, and two neighbours written as one from five letters on, or if the pair holds a digit.

    A chunk in which a punctuation key may be a letter of the other layout is read once more with the layout undone.
    """
    rows = []
    words = _TOKEN.findall(fold(text))
    for p, w in enumerate(words):
        rows.append((p, 1, w))
        if p + 1 < len(words):
            pair = w + words[p + 1]
            if (len(pair) > 4 and pair.isalpha()) or (len(pair) > 1 and not pair.isalpha() and not pair.isdigit()):
                rows.append((p, 2, pair))
    if _PUNCTUATED.search(text):
        for chunk in text.split():
            if _PUNCTUATED.search(chunk) and _LATIN.search(chunk):
                rows += [(-1, 1, w) for w in _TOKEN.findall(fold(chunk.lower().translate(_RUSSIAN_KEYS)))]
    return rows


def _tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(i, *r) for i, text in zip(pdf["id"], pdf["text"], strict=True) for r in spoken_tokens(text)]
        yield pd.DataFrame(rows, columns=["id", "pos", "n_words", "token"])


def _vocabulary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(i, t) for i, name in zip(pdf["entry_id"], pdf["name"], strict=True) for t in dict.fromkeys(_TOKEN.findall(fold(name)))]
        yield pd.DataFrame(rows, columns=["entry_id", "token"])


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"entry_id": pdf["entry_id"], "form": ["".join(_TOKEN.findall(fold(a))) for a in pdf["alias"]]})


class Reference:
    """A reference list ready for matching: tokens with weights, and forms with their deletion variants."""

    def __init__(self, entries: DataFrame, aliases: DataFrame | None = None, threshold: float = 0.5):
        """``entries``: entry_id, name; ``aliases``: entry_id, alias, other spellings of an entry's key tokens; ``threshold``: the least score of a match.

        The key tokens of an entry are the heaviest, as many as leave less than the threshold to all others: a text that
        holds none of them can't reach it. Entries without a letter or digit match nothing.
        """
        self.threshold = threshold
        tokens = entries.where("name <> ''").select("entry_id", "name").distinct().mapInPandas(_vocabulary, "entry_id long, token string").distinct()
        per = tokens.groupBy("token").agg(F.count_distinct("entry_id").alias("held"))
        total = tokens.agg(F.count_distinct("entry_id").alias("entries"))
        # one row of totals
        weighted = tokens.join(per, "token").crossJoin(F.broadcast(total)).select("entry_id", "token", F.log(1 + F.col("entries") / F.col("held")).alias("weight"))
        # the few tokens of one entry
        own = Window.partitionBy("entry_id")
        order = own.orderBy(F.desc("weight"), F.desc(F.length("token")), "token")
        square = F.col("weight") * F.col("weight")
        heavier = F.sum(square).over(order) - square
        key = (F.row_number().over(order) == 1) | (F.sum(square).over(own) - heavier >= threshold * F.sum(square).over(own) - 1e-9)
        self.tokens = stage(weighted.withColumn("key", key), "reference")
        self.keys = self.tokens.where("key")
        spelled = self.tokens.select("token", F.explode(true_forms(F.col("token"))).alias("form"), F.length("token").alias("size"))
        if aliases is not None:
            own = aliases.where("alias <> ''").select("entry_id", "alias").mapInPandas(_joined, "entry_id long, form string").join(self.keys, "entry_id")
            spelled = spelled.unionByName(own.select("token", F.explode(true_forms(F.col("form"))).alias("form"), F.length("token").alias("size")))
        edits = F.least(allowed(F.col("form")), F.when(F.col("size") <= 4, 0).otherwise(2))
        self.variants = stage(
            spelled.distinct().withColumn("edits", edits).select("token", F.col("form").alias("true_form"), "edits", F.explode(deletions(F.col("form"), F.col("edits"))).alias("variant")), "variants"
        )
        #: A typed form of more letters is out of reach of every true form, so none of its deletions is made.
        self.longest = self.variants.agg(F.coalesce(F.max(F.length("true_form")), F.lit(0)).alias("m")).first()["m"] + 2

    def repairs(self, typed: DataFrame) -> DataFrame:
        """``token, n_words, known, similarity`` of the distinct typed tokens: the vocabulary's tokens nearest to each.

        Two tokens written as one may hold one more error at most.
        """
        # the bound stands in the limit as well, since an optimizer may try deletions before it drops rows
        limit = F.when(F.length("form") > self.longest, 0).when(F.col("n_words") == 2, F.least(tried_edits(F.col("form")), F.lit(1))).otherwise(tried_edits(F.col("form")))
        tried = typed.select("token", "n_words").distinct().select("token", "n_words", F.explode(forms(F.col("token"))).alias("form")).where(F.length("form") <= self.longest)
        tried = tried.withColumn("limit", limit).select("*", F.explode(deletions(F.col("form"), F.col("limit"))).alias("variant"))
        near = (
            tried.join(self.variants.withColumnRenamed("token", "known"), "variant")
            .withColumn("most", F.least("limit", "edits"))
            .withColumn("distance", F.levenshtein("form", "true_form", 2))
            .where("distance >= 0 AND distance <= most")
            .groupBy("token", "n_words", "known")
            .agg(F.max(1 - F.col("distance") / F.greatest(F.length("form"), F.length("true_form"))).alias("similarity"))
        )
        best = F.max("similarity").over(Window.partitionBy("token", "n_words"))
        return near.withColumn("best", best).where("similarity = best").drop("best")

    def match(self, texts: DataFrame) -> DataFrame:
        """``text, entry_id, score`` of every distinct text that names an entry: the best by soft TF-IDF, then the smallest id.

        The score of an entry is the sum of squared token weights, each times the similarity of the best repair in the
        text, over the sum of squared weights. Defined cases: null and empty texts name nothing; words besides the
        entry's don't count against it.
        """
        # the number is given before staging, so it stays the same however the staged files are read
        distinct = stage(texts.where("text <> ''").select("text").distinct().withColumn("id", F.monotonically_increasing_id()), "typed")
        typed = stage(distinct.mapInPandas(_tokens, "id long, pos int, n_words int, token string"), "tokens")
        repaired = typed.join(self.repairs(typed), ["token", "n_words"]).groupBy("id", "known").agg(F.max("similarity").alias("similarity"))
        candidates = repaired.join(self.keys.select("entry_id", F.col("token").alias("known")), "known").select("id", "entry_id").distinct()
        held = candidates.join(self.tokens, "entry_id").join(repaired.withColumnRenamed("known", "token"), ["id", "token"], "left")
        square = F.col("weight") * F.col("weight")
        share = F.sum(square * F.coalesce("similarity", F.lit(0.0))) / F.sum(square)
        scored = held.groupBy("id", "entry_id").agg(share.alias("score")).where(F.col("score") >= self.threshold - 1e-9)
        best = scored.groupBy("id").agg(F.max(F.struct("score", (-F.col("entry_id")).alias("neg"))).alias("b"))
        return best.join(distinct, "id").select("text", (-F.col("b.neg")).alias("entry_id"), F.col("b.score").alias("score"))
