"""Weak labels of queries from dictionaries and patterns.

Stages in order: brand, model, category, genre, person, colour, patterns, purpose, type. Within a stage longer phrases
come first, then phrases of more characters, then by text, then by position; a token keeps its first label. Phrases are
found by an n-gram join; the choice among overlapping ones is a fold over a query's own candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querymill.functions.attributes import PURPOSES, TYPES, attribute_type, pattern_spans
from querymill.functions.bio import SPAN, merged, spans
from querymill.functions.text import label_key, ngrams, parted_numbers, token_spans
from querymill.operators.facts import COLORS
from querymill.operators.skew import salted_join
from querymill.sources.tables import spread, stage

# Genres known without a list.
GENRES = "боевик драма триллер комедия ужасы фантастика фэнтези детектив мелодрама криминал приключения".split()
#: Stage of each kind of phrase and the label it gives.
STAGES = {"brand": (1, "BRAND"), "model": (2, "MODEL"), "category": (3, "CATEGORY"), "genre": (4, "GENRE"), "person": (5, "PERSON")}
LONGEST = 4


def dictionary(lists: dict[str, DataFrame]) -> DataFrame:
    """``kind, phrase, canonical`` of lists of names (column ``name``).

    Of one phrase's spellings one that isn't all capitals is preferred, then the first; categories that are brands,
    persons of fewer than three letters and models of digits only are dropped; default genres are added.
    """
    out = None
    for kind, df in lists.items():
        n = F.trim("name")
        rows = df.select(F.lit(kind).alias("kind"), label_key(n).alias("phrase"), n.alias("canonical")).where((F.length("phrase") > 0) & (F.length("canonical") >= (3 if kind == "person" else 2)))
        if kind == "model":
            rows = rows.where(~F.col("phrase").rlike(r"^[\d. ]+$"))
        one = rows.groupBy("kind", "phrase").agg(F.min(F.struct((F.upper("canonical") == F.col("canonical")).alias("upper"), "canonical")).alias("m")).select("kind", "phrase", F.col("m.canonical").alias("canonical"))
        out = one if out is None else out.unionByName(one)
    spark = out.sparkSession
    genres = spark.createDataFrame([("genre", g.replace("ё", "е"), g) for g in GENRES], out.schema)
    brands = out.where("kind = 'brand'").select("phrase")
    cats = out.where("kind = 'category'").join(brands, "phrase", "left_anti").select("kind", "phrase", "canonical")
    return out.where("kind <> 'category'").unionByName(cats).unionByName(genres)


def label(queries: DataFrame, phrases: DataFrame) -> DataFrame:
    """``id, text, tokens, tags`` of queries (id, query): text with parted units, its tokens with offsets and their BIO tags.

    Null and empty queries have no row. Each distinct query is labelled once.
    """
    own = queries.where("query <> ''")
    distinct = spread(own.select("query").distinct()).withColumn("id", F.col("query"))
    labelled = _label(distinct, phrases).withColumnRenamed("id", "query")
    return salted_join(own.select("id", "query"), labelled, ["query"]).select("id", "text", "tokens", "tags")


def _label(queries: DataFrame, phrases: DataFrame) -> DataFrame:
    base = queries.select("id", parted_numbers(F.col("query")).alias("text"))
    keyed = base.select("id", "text", token_spans(F.col("text")).alias("tokens")).where("size(tokens) > 0").withColumn("keys", F.transform("tokens", lambda t: label_key(t["token"])))
    # what is costly is worked out once, and told to both sides of the join
    keyed = stage(keyed.withColumn("patterns", pattern_spans(F.col("text"))).withColumn("purposes", purpose_spans(F.col("text"))), "keyed")
    grams = keyed.select("id", F.explode(ngrams(F.col("keys"), LONGEST)).alias("g")).select("id", "g.*")
    nth = F.element_at(F.create_map(*[x for k, (s, _) in STAGES.items() for x in (F.lit(k), F.lit(s))]), F.col("kind"))
    name = F.element_at(F.create_map(*[x for k, (_, t) in STAGES.items() for x in (F.lit(k), F.lit(t))]), F.col("kind"))
    found = grams.join(phrases.where(F.col("kind").isin(list(STAGES))), "phrase")
    per = found.groupBy("id").agg(F.array_sort(F.collect_set(F.struct(nth.alias("stage"), (-F.col("n")).alias("a"), (-F.length("phrase")).alias("b"), "phrase", F.col("pos").alias("start"), (F.col("pos") + F.col("n")).alias("end"), name.alias("label")))).alias("hits"))
    j = keyed.join(per, "id", "left")
    tags = F.aggregate(F.coalesce("hits", F.array().cast(per.schema["hits"].dataType)), F.transform("tokens", lambda _: F.lit("O")), _lay)
    tagged = j.withColumn("tags", tags)
    palette = F.array(*[F.lit(c) for c in COLORS])
    tagged = tagged.withColumn("tags", F.zip_with("tags", "keys", lambda t, k: F.when((t == "O") & F.array_contains(palette, k), "B-ATTR").otherwise(t)))
    tagged = tagged.withColumn("tags", F.aggregate(F.col("patterns"), F.col("tags"), lambda acc, s: _cover(acc, s, F.col("tokens"))))
    tagged = tagged.withColumn("tags", F.aggregate(F.col("purposes"), F.col("tags"), lambda acc, s: _cover(acc, s, F.col("tokens"))))
    seeds = F.array(*[F.lit(x) for x in sorted({*PURPOSES, *TYPES})])
    return tagged.select("id", "text", "tokens", F.zip_with("tags", "keys", lambda t, k: F.when((t == "O") & F.array_contains(seeds, k), "B-ATTR").otherwise(t)).alias("tags"))


def _lay(acc: Column, h: Column) -> Column:
    free = F.forall(F.slice(acc, h["start"] + 1, h["end"] - h["start"]), lambda t: t == "O")
    return F.when(free, F.transform(acc, lambda t, i: F.when(i == h["start"], F.concat(F.lit("B-"), h["label"])).when((i > h["start"]) & (i < h["end"]), F.concat(F.lit("I-"), h["label"])).otherwise(t))).otherwise(acc)


def _cover(acc: Column, span: Column, tokens: Column) -> Column:
    """Free tokens that a character span touches become one attribute."""
    touched = F.transform(tokens, lambda t, i: (t["end"] > span["start"]) & (t["start"] < span["end"]) & (F.get(acc, i) == "O"))
    first = F.array_position(touched, F.lit(True)) - 1
    return F.transform(acc, lambda t, i: F.when(F.get(touched, i), F.when(i == first, "B-ATTR").otherwise("I-ATTR")).otherwise(t))


def purpose_spans(text: Column) -> Column:
    """The up to forty characters behind each ``для``, with offsets."""
    p = r"(?iU)\bдля\s+([а-яa-z0-9][а-яa-z0-9\s\-]{0,40})"
    whole, tail = F.regexp_extract_all(text, F.lit(p), F.lit(0)), F.regexp_extract_all(text, F.lit(p), F.lit(1))
    gaps, sizes = F.transform(F.split(text, p, -1), F.length), F.transform(whole, F.length)
    add = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    end = lambda i: add(F.slice(gaps, 1, i + 1)) + add(F.slice(sizes, 1, i + 1))
    return F.transform(tail, lambda t, i: F.struct((end(i) - F.length(t)).alias("start"), end(i).alias("end")))


def all_spans(labelled: DataFrame) -> Column:
    """The spans of the rules, and with a column ``pred`` those of the tagger where the rules leave room, by start."""
    own = spans(F.col("tags"))
    return merged(own, F.coalesce(spans(F.col("pred")), F.array().cast(SPAN))) if "pred" in labelled.columns else own


def entities(labelled: DataFrame) -> DataFrame:
    """``id, text, label, start, end, attr_type`` of each entity; text cut from the labelled text.

    With a column ``pred`` (tags of a sequence tagger), its entities that overlap none of the rules' are added.
    """
    e = labelled.select("id", "text", "tokens", F.explode(all_spans(labelled)).alias("s"))
    start, end = F.get("tokens", F.col("s.start"))["start"], F.get("tokens", F.col("s.end") - 1)["end"]
    cut = e.select("id", F.col("s.label").alias("label"), start.alias("start"), end.alias("end"), F.substring(F.col("text"), start + 1, end - start).alias("text"))
    return cut.withColumn("attr_type", F.when(F.col("label") == "ATTR", attribute_type(F.col("text"))))


def structured(found: DataFrame, phrases: DataFrame) -> DataFrame:
    """``id, brand, category, model, attributes``: the first of each kind in canonical form, and all attributes by type in order."""
    first = lambda k: F.min(F.when(F.col("label") == k, F.struct("start", "text")))["text"]
    per = found.groupBy("id").agg(first("BRAND").alias("b"), first("CATEGORY").alias("c"), first("MODEL").alias("m"))
    attrs = found.where("label = 'ATTR'").groupBy("id", "attr_type").agg(F.array_sort(F.collect_list(F.struct("start", "text"))).alias("l"))
    maps = attrs.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("attr_type", F.col("l.text").alias("v"))))).alias("attributes"))

    def named(df: DataFrame, c: str, kind: str, out: str) -> DataFrame:
        d = phrases.where(F.col("kind") == kind).select(F.col("phrase").alias("p__"), F.col("canonical").alias("n__"))
        return df.join(d, label_key(F.col(c)) == F.col("p__"), "left").withColumn(out, F.coalesce("n__", c)).drop("p__", "n__", c)

    out = named(named(named(per, "b", "brand", "brand"), "c", "category", "category"), "m", "model", "model")
    return out.join(maps, "id", "left").select("id", "brand", "category", "model", "attributes")
