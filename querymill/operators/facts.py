"""Facts of a query from dictionaries, and ranking of a catalog by facts.

Dictionaries are tables ``kind, phrase, canonical`` of token phrases. Phrases are found by an equi-join of the query's
n-grams, so a large dictionary is as good as a small one; Catalyst broadcasts it only below its size limit.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querymill.functions.text import ngrams, parted_numbers, simple_key, split_tokens
from querymill.operators.skew import salted_join
from querymill.sources.tables import shuffle_partitions, stage

# Colour words.
COLORS = (
    "белый белая белое белые черный черная черное серый серая серое серые красный красная красное красные синий синяя синее синие "
    "зеленый зеленая зеленое зеленые золотой золотая золотое золото серебристый серебряный серебристая серебряная серебро розовый розовая розовое "
    "голубой голубая голубое фиолетовый фиолетовая фиолетовое оранжевый оранжевая оранжевое коричневый коричневая коричневое бежевый бежевая бежевое "
    "желтый желтая желтое золотистый золотистая золотистое титановый титан графитовый графит шампань персиковый бронзовый бронза латунь "
    "мятный оливковый бирюзовый бордовый сливовый медный шоколадный midnight starlight silver gold black white pink blue green graphite titanium"
).split()

#: Longest phrase of each kind, in tokens.
LONGEST = {"brand": 3, "alias": 1, "category": 3, "model": 4}
#: The tail of Latin or digit tokens behind a brand is the model, up to this length.
TAIL = 4


def query_tokens(c: Column) -> Column:
    """Tokens in which dictionaries and queries meet."""
    return split_tokens(parted_numbers(simple_key(c)))


def phrases(df: DataFrame, kind: str, name: str, canonical: str | None = None) -> DataFrame:
    """Dictionary rows of a list; the smallest canonical form of each phrase stays."""
    phrase = F.array_join(query_tokens(F.col(name)), " ")
    return df.select(F.lit(kind).alias("kind"), phrase.alias("phrase"), F.col(canonical or name).alias("canonical")).where("phrase <> ''").groupBy("kind", "phrase").agg(F.min("canonical").alias("canonical"))


#: Bits of a filter: 8 MB, of whatever number of strings.
BITS = 26


def _among(strings: DataFrame) -> Callable[[Column], Column]:
    """A test of arrays of strings that says of each whether it may be one of ``strings`` (s): true for all that are, and for the few that share the first ``BITS`` bits of their hash with one.

    So a join with many strings can drop most of what matches nothing before it is shuffled.
    """
    at = F.shiftrightunsigned(F.xxhash64("s"), 64 - BITS)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int"))
    words = strings.where("s IS NOT NULL").groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bits = np.zeros(1 << max(0, BITS - 6), np.uint64)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    shared, shift = strings.sparkSession.sparkContext.broadcast(bits), np.uint64(64 - BITS)

    @F.arrow_udf("array<boolean>")
    def known(hashes: pa.Array) -> pa.Array:
        at = hashes.flatten().to_numpy(zero_copy_only=False).view(np.uint64) >> shift
        held = shared.value[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)
        return pa.ListArray.from_arrays(np.append(0, np.cumsum(pc.list_value_length(hashes).to_numpy(zero_copy_only=False))).astype(np.int32), pa.array(held.astype(bool)))

    return lambda c: known(F.transform(c, lambda x: F.xxhash64(x)))


def extract(queries: DataFrame, dictionary: DataFrame, colors: list[str] | None = None) -> DataFrame:
    """``id, brand, brand_text, category, model, colors`` of queries (id, query).

    Of each kind the longest phrase wins, then the first; a one-token alias counts when no brand phrase is there. Without
    a model phrase the model is the tail of free Latin or digit tokens directly behind the brand. Null and empty queries
    have no facts. Each distinct query is looked up once.
    """
    palette = F.array(*[F.lit(c) for c in (colors or COLORS)])
    own = queries.select("query").where("query <> ''").distinct().select("query", query_tokens(F.col("query")).alias("t"))
    # most n-grams are no phrase, and go no further
    listed = _among(dictionary.select(F.col("phrase").alias("s")))
    grams = own.select("query", ngrams(F.col("t"), max(LONGEST.values())).alias("gs")).select("query", "gs", listed(F.col("gs.phrase")).alias("k"))
    grams = grams.select("query", F.explode(F.filter("gs", lambda _, i: F.get("k", i))).alias("g")).select("query", "g.*")
    hits = grams.join(dictionary, "phrase")
    limit = F.element_at(F.create_map(*[x for k, v in LONGEST.items() for x in (F.lit(k), F.lit(v))]), F.col("kind"))
    hits = hits.where(F.col("n") <= limit)
    first = F.struct((-F.col("n")).alias("neg"), "pos", "phrase", "canonical")
    per = hits.groupBy("query").agg(*[F.min(F.when(F.col("kind") == k, first)).alias(f"m_{k}") for k in LONGEST])
    all_ = own.join(per, "query", "left").withColumn("b", F.coalesce("m_brand", "m_alias"))
    end = F.col("b.pos") - F.col("b.neg")

    def covers(kind: str, i: Column) -> Column:
        return F.coalesce((i >= F.col(f"m_{kind}.pos")) & (i < F.col(f"m_{kind}.pos") - F.col(f"m_{kind}.neg")), F.lit(False))

    hues = F.filter("t", lambda t: F.array_contains(palette, t))
    behind = F.slice(F.transform("t", lambda t, i: F.struct(t.alias("t"), (t.rlike("^[a-z0-9.+-]+$") & ~covers("category", i) & ~F.array_contains(palette, t)).alias("free"))), end + 1, TAIL)
    run = F.aggregate(behind, F.struct(F.array().cast("array<string>").alias("w"), F.lit(True).alias("go")), lambda s, x: F.struct(F.when(s["go"] & x["free"], F.concat(s["w"], F.array(x["t"]))).otherwise(s["w"]).alias("w"), (s["go"] & x["free"]).alias("go")), lambda s: s["w"])
    tail = F.when(F.col("b").isNotNull() & (F.size(run) > 0), F.array_join(run, " "))
    facts = all_.select(
        "query", F.col("b.canonical").alias("brand"), F.col("b.phrase").alias("brand_text"), F.col("m_category.phrase").alias("category"), F.coalesce(F.col("m_model.phrase"), tail).alias("model"), F.array_sort(F.array_distinct(hues)).alias("colors")
    )
    return salted_join(queries.select("id", "query"), facts, ["query"]).select("id", *[c for c in facts.columns if c != "query"])


#: Weights of the two rankers: brand, another brand, category, model, each attribute, cosine; whether any token of the category counts.
NATIVE = {"brand": 3.0, "other": -1.2, "category": 2.4, "model": 2.8, "attribute": 1.2, "cosine": 1.5, "any_token": False}
SIMPLE = {"brand": 3.0, "other": 0.0, "category": 2.0, "model": 1.5, "attribute": 1.0, "cosine": 1.0, "any_token": True}


#: Stands for a run of tokens that no fact asks for.
OTHER = "·"


def _signatures(items: DataFrame, asked: DataFrame, top: int) -> DataFrame:
    """``sid, name, n, b, first, skus``: the items (sku_id, t, bt) that look the same to all facts asked (all, brand_text), and the ``top`` smallest sku_ids of each kind.

    All that a score can see of an item are its asked tokens in their order, the number of its tokens, and its brand where a
    token of that is asked. So there are about as many kinds as the facts can tell apart, however many items there are.
    Asked tokens are told by a filter of bounded size, so tokens are not shuffled; a token it lets through for the hash of
    another stays in its name, which at worst makes two kinds of one.
    """
    known = _among(asked.select(F.explode("all").alias("s")))
    told = items.select("sku_id", "t", "bt", known(F.col("t")).alias("k"), known(F.col("bt")).alias("kb"))
    words = F.transform("t", lambda x, i: F.when(F.get("k", i), x).otherwise(OTHER))
    run = F.filter(words, lambda x, i: (x != OTHER) | (i == 0) | F.get("k", i - 1))
    named = told.select("sku_id", F.array_join(run, " ").alias("name"), F.size("t").alias("n"), F.when(F.exists("kb", lambda x: x), F.array_join("bt", " ")).otherwise("").alias("b"))
    # the limit is applied before the shuffle too, so a kind that most items are of is no burden
    w = Window.partitionBy("name", "n", "b").orderBy("sku_id")
    first = named.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= top)
    kinds = first.groupBy("name", "n", "b").agg(F.array_sort(F.collect_list("sku_id")).alias("skus"))
    return kinds.select(F.monotonically_increasing_id().alias("sid"), "name", "n", "b", F.get("skus", F.lit(0)).alias("first"), "skus")


#: Facts and kinds of items that one task scores at a time at most; what it holds is some hundred bytes of each, and the best of each fact.
FACTS, KINDS = 1 << 15, 1 << 17
#: Pairs of a fact and a kind that are worth a task of their own.
PAIRS = 1 << 24


def _blocks(facts: int, kinds: int, tasks: int) -> tuple[int, int]:
    """Blocks of facts and of kinds: of bounded size, and enough pairs of them for the tasks if there is work for so many."""
    n_facts, n_kinds = max(1, -(-facts // FACTS)), max(1, -(-kinds // KINDS))
    return max(n_facts, -(-min(tasks, facts * kinds // PAIRS) // n_kinds)), n_kinds


def _rounded(x: np.ndarray) -> np.ndarray:
    """To six digits as Spark rounds: half up, by the shortest decimal form."""
    y = x * 1e6
    out = np.floor(y + 0.5) / 1e6
    for i in np.flatnonzero(np.abs(y - np.floor(y) - 0.5) < 1e-5):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    return out


def _best(facts: pd.DataFrame, kinds: pd.DataFrame, top: int, least: float, w: dict) -> pd.DataFrame:
    """The ``top`` best kinds of a block for each fact of a block, exact: all kinds that hold any token of a fact are scored, from lists of the kinds that hold a token or a phrase."""
    kinds = kinds.sort_values("first", kind="stable")
    sid, first, names, norm = kinds["sid"].to_numpy(), kinds["first"].to_numpy(), (" " + kinds["name"] + " ").tolist(), np.sqrt(kinds["n"].to_numpy(float))
    lists: tuple[dict, dict, dict] = ({}, {}, {})  # kinds by token of the name, by brand, by token of the brand
    for i, (name, b) in enumerate(zip(kinds["name"], kinds["b"])):
        for by, keys in zip(lists, (set(name.split(" ")), (b,), set(b.split(" ")))):
            for k in keys:
                by.setdefault(k, []).append(i)
    nobody = np.zeros(0, np.int64)
    tokens, brands, brand_tokens = ({k: np.array(v) for k, v in by.items() if k not in ("", OTHER) or by is lists[1]} for by in lists)

    @cache
    def holding(phrase: str | None) -> np.ndarray:
        if phrase is None or phrase.strip(" ") == "":
            return nobody
        each = phrase.split(" ")
        of = min((tokens.get(x, nobody) for x in each if x), key=len)
        return of if len(each) == 1 else np.array([i for i in of if f" {phrase} " in names[i]], np.int64)

    @cache
    def of_brand(brand: str) -> np.ndarray:
        return np.union1d(brands.get(brand, nobody), holding(brand))

    @cache
    def of_any(category: str) -> np.ndarray:
        return np.unique(np.concatenate([nobody, *[tokens.get(x, nobody) for x in category.split(" ")]]))

    # without a score of its own a pair counts only if any token is shared
    loose = least < max(0.0, w["other"])
    count = np.zeros(len(kinds), np.int64)
    out = []
    asked = facts[["num", "brand_text", "category", "model", "colors", "own"]].astype(object)
    for fid, brand, category, model, hues, own in asked.where(asked.notna(), None).itertuples(index=False, name=None):
        count.fill(0)
        for x in own:
            count[tokens.get(x, nobody)] += 1
        for h in hues if hues is not None else ():
            count[holding(h)] += 1 << 20
        if brand is not None:
            count[of_brand(brand)] += 1 << 40
        count[of_any(category) if w["any_token"] and category is not None else holding(category)] += 1 << 41
        count[holding(model)] += 1 << 42
        if loose:
            for x in {*own, *(brand or "").split(" ")}:
                for by in (tokens, brand_tokens):
                    count[by.get(x, nobody)] += 1 << 43
        at = np.flatnonzero(count)
        c = count[at]
        hit, has_cat, has_model, attrs, common = c >> 40 & 1, c >> 41 & 1, c >> 42 & 1, c >> 20 & 0xFFFFF, c & 0xFFFFF
        # added up in the order of the columns, so that sums are the same to the last bit
        n = norm[at] * np.sqrt(float(len(own)))
        cosine = np.divide(common, n, out=np.zeros(len(at)), where=n > 0)
        score = np.where(hit, w["brand"], 0.0 if brand is None else w["other"]) + has_cat * w["category"] + has_model * w["model"] + w["attribute"] * attrs + w["cosine"] * cosine
        some = np.flatnonzero(score > least - 1e-5)
        if len(some) > top:
            some = some[score[some] >= np.partition(score[some], len(some) - top)[len(some) - top] - 2e-6]
        r = _rounded(score[some])
        best = np.argsort(-r, kind="stable")[:top]
        best = best[r[best] > least]
        if len(best):
            k = some[best]
            out.append((np.full(len(k), fid), at[k], r[best], (hit[k] + 2 * has_cat[k] + 4 * has_model[k] + 8 * (attrs[k] > 0)).astype(np.int8)))
    if not out:
        return pd.DataFrame({"num": [], "sid": [], "first": [], "score": [], "hits": []})
    num, at, score, hits = map(np.concatenate, zip(*out))
    return pd.DataFrame({"num": num, "sid": sid[at], "first": first[at], "score": score, "hits": hits})


def rank(facts: DataFrame, catalog: DataFrame, top: int = 30, least: float = 0.15, weights: dict | None = None) -> DataFrame:
    """``id, sku_id, score, match, why, rn``: the best items of a catalog (sku_id, name, brand) for facts of queries.

    The weights of brand, category, model and attributes found, and of the cosine of the fact tokens with the name's
    are added up; scores of ``least`` and below are dropped; ties by sku_id; ``match`` is the share of the
    best score. A phrase counts where it stands in the name as whole tokens; attributes are the phrases of ``colors``, of any kind.
    Exact without a pair for each item: equal facts are ranked once, against the kinds of items that facts can tell
    apart; a block of facts meets a block of kinds in memory, and no pair but the ``top`` best of each fact leaves it; of a kind
    the first ``top`` items are enough, and so are the first ``top`` kinds of a fact. Null sku_ids and empty names have no rank.
    """
    w = weights or NATIVE
    key = ["brand_text", "category", "model", "colors"]
    fid = F.unhex(F.sha2(F.to_json(F.struct(*key)), 256))
    facts = stage(facts.select("id", *key, fid.alias("fid")), "facts")
    distinct = facts.select("fid", *key).dropDuplicates(["fid"])
    none = F.array().cast("array<string>")
    hues = F.coalesce("colors", none)
    own = F.concat(F.coalesce(F.split("category", " "), none), F.coalesce(F.split("model", " "), none), F.flatten(F.transform(hues, lambda h: F.split(h, " "))))
    asked = stage(distinct.withColumn("own", own).withColumn("all", F.array_distinct(F.concat("own", F.coalesce(F.split("brand_text", " "), none)))).withColumn("num", F.monotonically_increasing_id()), "asked")
    items = catalog.where("sku_id IS NOT NULL").select("sku_id", query_tokens(F.coalesce("name", F.lit(""))).alias("t"), query_tokens(F.coalesce("brand", F.lit(""))).alias("bt"))
    kinds = stage(_signatures(items, asked, top), "kinds")
    n_facts, n_kinds = _blocks(asked.count(), kinds.count(), shuffle_partitions(facts.sparkSession))
    # each block of facts meets each block of kinds once, and only the best of it go on
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    left = asked.select("num", "brand_text", "category", "model", "colors", "own", block("num", n_facts).alias("fb")).withColumn("kb", every(n_kinds))
    right = kinds.select("sid", "first", "name", "n", "b", block("sid", n_kinds).alias("kb")).withColumn("fb", every(n_facts))
    kept = left.groupBy("fb", "kb").cogroup(right.groupBy("fb", "kb")).applyInPandas(lambda a, b: _best(a, b, top, least, w), f"num long, sid long, first {dict(kinds.dtypes)['first']}, score double, hits byte")
    number = lambda c: F.row_number().over(Window.partitionBy("num").orderBy(F.desc("score"), c))
    best = kept.withColumn("rn", number("first")).where(F.col("rn") <= top).drop("rn", "first")
    each = best.join(kinds.select("sid", "skus"), "sid").select("num", "score", "hits", F.explode("skus").alias("sku_id"))
    each = each.withColumn("rn", number("sku_id")).where(F.col("rn") <= top)
    each = each.withColumn("match", F.round(F.col("score") / F.max("score").over(Window.partitionBy("num")), 6))
    why = F.concat_ws("+", *[F.when(F.col("hits").bitwiseAND(1 << i) > 0, name) for i, name in enumerate(("brand", "category", "model", "attributes"))])
    numbered = stage(salted_join(facts.select("id", "fid"), asked.select("fid", "num"), ["fid"]).select("id", "num"), "numbered")
    return salted_join(numbered, each, ["num"]).select("id", "sku_id", "score", "match", why.alias("why"), F.col("rn").cast("long").alias("rn"))
