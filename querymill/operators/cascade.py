"""The cascade from a query to facts, and what belongs to it: fills, preprocessing, span rows, corruption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querymill.functions.attributes import attribute_type
from querymill.functions.bio import spans
from querymill.functions.text import basic_clean, masked, ngrams, norm_key, simple_key, split_tokens, title_phrases, tokens
from querymill.functions.udf import indel_ratio
from querymill.operators import labeler as L
from querymill.operators.analysis import served
from querymill.operators.metrics import reject
from querymill.operators.silver import gate
from querymill.operators.spell import fix_queries, near_pairs
from querymill.sources.tables import stage

# Spellings of one unit that augment a span.
UNIT_SYNONYMS = {"гб": "gb", "тб": "tb", "мм": "mm", "см": "cm", "вт": "w", "кг": "kg", "л": "l", "мл": "ml", "гц": "hz", "в": "v"}


def fuzzy_fill(queries: DataFrame, names: DataFrame, cutoff: float = 92.0, most: int = 3) -> DataFrame:
    """``id, name, text, ratio``: for queries (id, query) the name (name) whose indel ratio with a run of up to ``most`` tokens is greatest and reaches the cutoff; ties by name, then text.

    A ratio r of words of n and m letters means at most (1 - r / 100) * (n + m) insertions and deletions, so pairs are
    found by edit distance, and no run much longer than the longest name can reach the cutoff.
    """
    runs = queries.where("query <> ''").select("id", F.explode(ngrams(split_tokens(simple_key(F.col("query"))), most)).alias("g")).select("id", F.col("g.phrase").alias("t")).where("length(t) >= 4").distinct()
    known = names.select("name", F.array_join(split_tokens(simple_key(F.col("name"))), " ").alias("w")).where("length(w) >= 4")
    share = 1 - cutoff / 100
    edits = lambda n, m: F.floor((n + m) * share + 1e-9).cast("int")
    most_letters = known.agg(F.coalesce(F.max(F.length("w")), F.lit(0)).alias("m")).first()["m"]
    longest = int(most_letters * (1 + share) / (1 - share) + 1e-9)
    pairs = near_pairs(runs.select("t").where(F.length("t") <= longest).distinct(), known.select("w").distinct(), edits, max(2, int((longest + most_letters) * share)))
    good = pairs.where(F.levenshtein("t", "w") <= edits(F.length("t"), F.length("w"))).withColumn("ratio", indel_ratio("t", "w")).where(F.col("ratio") >= cutoff)
    named = good.join(known, "w").join(runs, "t")
    return named.groupBy("id").agg(F.min(F.struct((-F.round("ratio", 6)).alias("neg"), "name", "t")).alias("m")).select("id", "m.name", F.col("m.t").alias("text"), (-F.col("m.neg")).alias("ratio"))


def substring_fill(queries: DataFrame, names: DataFrame, shortest: int = 4) -> DataFrame:
    """``id, name``: the longest name that the query holds anywhere, ties by name; names of ``shortest`` letters or more.

    All substrings of the lengths that names have are joined with the names by equality.
    """
    longest = max(shortest, names.agg(F.coalesce(F.max(F.length(simple_key(F.col("name")))), F.lit(0)).alias("m")).first()["m"])
    q = simple_key(F.col("query"))
    cuts = F.flatten(F.transform(F.sequence(F.lit(shortest), F.lit(longest)), lambda n: F.when(F.length("k") >= n, F.transform(F.sequence(F.lit(1), F.length("k") - n + 1), lambda i: F.substring(F.col("k"), i, n))).otherwise(F.array().cast("array<string>"))))
    own = queries.where("query <> ''").select("id", q.alias("k")).select("id", F.explode(F.array_distinct(cuts)).alias("s"))
    known = names.select("name", simple_key(F.col("name")).alias("s")).where(F.length("s").between(shortest, longest))
    return own.join(known, "s").groupBy("id").agg(F.min(F.struct((-F.length("s")).alias("neg"), "name")).alias("m")).select("id", "m.name")


def preprocess(queries: DataFrame, models: DataFrame, protected: DataFrame) -> DataFrame:
    """``id, text, text_norm, tokens, hints, model_spans, protected_spans`` of queries (id, query).

    ``models`` and ``protected`` hold phrases (phrase) in normal form; a span is (start, end) in tokens, longer phrases
    first, none overlapping another of its kind. Capitalised phrases of the original are hints.
    """
    base = queries.where("query IS NOT NULL").select("id", basic_clean(F.col("query")).alias("text"), title_phrases(F.col("query")).alias("hints")).withColumn("text_norm", norm_key(F.col("text"))).withColumn("tokens", tokens(F.col("text_norm")))
    grams = base.select("id", F.explode(ngrams(F.col("tokens"), 4)).alias("g")).select("id", "g.*")
    out = base
    for name, phrases in (("model_spans", models), ("protected_spans", protected)):
        hit = grams.join(phrases.select("phrase").distinct(), "phrase").groupBy("id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("a"), (-F.length("phrase")).alias("b"), "phrase", F.col("pos").alias("start"), (F.col("pos") + F.col("n")).alias("end")))).alias("h"))
        kept = F.aggregate(F.col("h"), F.array().cast("array<struct<start:int,end:int>>"), lambda acc, x: F.when(F.exists(acc, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])), acc).otherwise(F.concat(acc, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"))))))
        out = out.join(hit.select("id", kept.alias(name)), "id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<struct<start:int,end:int>>")))
    return out.select("id", "text", "text_norm", "tokens", "hints", "model_spans", "protected_spans")


def extract(queries: DataFrame, phrases: DataFrame, vocabulary: DataFrame, aliases: DataFrame, names: DataFrame, classifier=None, tagger=None, typer=None) -> DataFrame:  # noqa: ANN001
    """``id, fixed, n_fixes, brand, brand_source, category, model, attributes`` of queries (id, query): the whole cascade.

    Spelling, then weak labels, with the ``tagger`` its entities where the rules leave room, and with the ``typer`` its
    attribute types, by the rules where it rejects; then their facts; a missing brand is filled by an alias, by the fuzzy ratio, by a
    contained name, and last by the classifier, whose answers pass the reject policy and which is asked only where some
    token is left that isn't part of a category. Every stage sees only the queries that the ones before left open.
    """
    fixed = stage(fix_queries(queries, vocabulary, aliases), "fixed")
    text = fixed.select("id", F.col("fixed").alias("query"))
    labelled = stage(L.label(text, phrases), "labelled")
    if tagger is not None:
        labelled = stage(labelled.join(tagger.predict(labelled.select("id", F.col("tokens.token").alias("tokens"))), "id", "left"), "labelled")
    found = L.entities(labelled)
    if typer is not None:
        found = stage(found, "entities")
        types = typer.predict(found.where("label = 'ATTR'").select("text").distinct()).select(F.col("text").alias("t__"), served(F.col("text"), F.col("top"), F.col("p1")).alias("type__"))
        found = found.join(types, (F.col("label") == "ATTR") & (F.col("text") == F.col("t__")), "left").withColumn("attr_type", F.coalesce("type__", "attr_type")).drop("t__", "type__")
    facts = L.structured(found, phrases)
    first = F.get(F.filter(L.all_spans(labelled), lambda s: s["label"] == "BRAND"), F.lit(0))
    source = labelled.select("id", spans(F.col("tags")).alias("r"), first.alias("b")).select("id", F.when(F.array_contains("r", F.col("b")), "rules").otherwise("tagger").alias("s__"))
    rows = text.join(facts, "id", "left").join(source, "id", "left").withColumn("brand_source", F.when(F.col("brand").isNotNull(), F.col("s__"))).drop("s__")
    rows = stage(rows, "facts")
    for source, fill in (("fuzzy", fuzzy_fill), ("substring", substring_fill)):
        got = fill(rows.where("brand IS NULL").select("id", "query"), names).select("id", F.col("name").alias("n__"))
        rows = stage(rows.join(got, "id", "left").withColumn("brand_source", F.coalesce("brand_source", F.when(F.col("n__").isNotNull(), source))).withColumn("brand", F.coalesce("brand", "n__")).drop("n__"), "facts")
    if classifier is not None:
        only = F.col("category").isNotNull() & (F.length("query") <= F.length("category") + 3)
        asked = rows.where(gate(F.col("brand").isNotNull(), only, F.length("query") > 0)).select("id", F.col("query").alias("text"))
        p = classifier.predict(asked)
        got = p.select("id", reject(F.col("top"), F.col("p1"), F.col("margin")).alias("n__")).where("n__ NOT IN ('NO_BRAND', 'UNKNOWN')")
        rows = rows.join(got, "id", "left").withColumn("brand_source", F.coalesce("brand_source", F.when(F.col("n__").isNotNull(), "classifier"))).withColumn("brand", F.coalesce("brand", "n__")).drop("n__")
    return rows.join(fixed.select("id", "fixed", "n_fixes"), "id").select("id", "fixed", "n_fixes", "brand", "brand_source", "category", "model", "attributes")


def attribute_rows(queries: DataFrame) -> DataFrame:
    """One row for each attribute span of queries (id, query, entities with offsets), with three masked texts, and once more with the unit's other spelling.

    ``id, span_text, start, end, type, masked_all, masked_others, masked_entities, is_aug``.
    """
    e = F.transform(F.filter("entities", lambda x: x["label"] == "ATTR"), lambda x: F.struct(x["span"][0].alias("start"), x["span"][1].alias("end")))
    every = F.transform("entities", lambda x: F.struct(x["span"][0].alias("start"), x["span"][1].alias("end")))
    base = queries.where("query IS NOT NULL").select("id", "query", e.alias("attrs"), every.alias("every")).withColumn("s", F.explode("attrs"))
    others = F.filter("attrs", lambda x: (x["start"] != F.col("s.start")) | (x["end"] != F.col("s.end")))
    span = F.substring(F.col("query"), F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))
    rows = base.select(
        "id", span.alias("span_text"), F.col("s.start").alias("start"), F.col("s.end").alias("end"), masked(F.col("query"), F.col("attrs"), "<attr>").alias("masked_all"), masked(F.col("query"), others, "<attr>").alias("masked_others"), masked(F.col("query"), F.col("every"), "<ent>").alias("masked_entities")
    ).withColumn("type", attribute_type(F.col("span_text")))
    swap = F.col("span_text")
    for a, b in UNIT_SYNONYMS.items():
        swap = F.regexp_replace(swap, rf"(?iU)(?<=\d)(\s*){a}$", f"$1{b}")
    more = rows.withColumn("swapped", swap).where("swapped <> span_text").withColumn("span_text", F.col("swapped")).drop("swapped")
    return rows.withColumn("is_aug", F.lit(False)).unionByName(more.withColumn("is_aug", F.lit(True)))


def corrupted(queries: DataFrame, share: float = 0.5, seed: str = "42") -> DataFrame:
    """``id, query, n_changed``: queries whose words of four letters or more are damaged with probability ``share``, the number of words kept.

    The damage is drawn from a digest of id, position and seed: a doubled letter, a lost one, two swapped, or a letter of
    the other alphabet that looks alike.
    """
    w = F.split("query", " ")

    def hurt(x: Column, i: Column) -> Column:
        h = F.md5(F.concat_ws("|", F.col("id").cast("string"), i.cast("string"), F.lit(seed)))
        drawn = F.conv(F.substring(h, 1, 4), 16, 10).cast("int") / 65536.0
        at = F.conv(F.substring(h, 5, 2), 16, 10).cast("int") % (F.length(x) - 1) + 1
        kind = F.conv(F.substring(h, 7, 1), 16, 10).cast("int") % 4
        left, right = F.substring(x, F.lit(1), at), F.substring(x, at + 1, F.length(x))
        new = (
            F.when(kind == 0, F.concat(left, F.substring(x, at, F.lit(1)), right))
            .when(kind == 1, F.concat(F.substring(x, F.lit(1), at - 1), right))
            .when(kind == 2, F.concat(F.substring(x, F.lit(1), at - 1), F.substring(x, at + 1, F.lit(1)), F.substring(x, at, F.lit(1)), F.substring(x, at + 2, F.length(x))))
            .otherwise(F.translate(x, "aceopxyасеорху", "асеорхуaceopxy"))
        )
        return F.when((F.length(x) >= 4) & (drawn < share), new).otherwise(x)

    out = queries.where("query IS NOT NULL").withColumn("w", w).withColumn("c", F.transform("w", hurt))
    return out.select("id", F.array_join("c", " ").alias("query"), F.size(F.filter(F.zip_with("w", "c", lambda a, b: a != b), lambda x: x)).cast("long").alias("n_changed"))


def highlighted(text: Column, spans: Column) -> Column:
    """``(text, label)`` pieces of a text cut at its [start, end) spans (label, start, end); '' is no label."""
    order = F.array_sort(spans, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0))
    state = F.struct(F.array().cast("array<struct<text:string,label:string>>").alias("out"), F.lit(0).alias("at"))

    def step(s: Column, x: Column) -> Column:
        gap = F.struct(F.substring(text, s["at"] + 1, x["start"] - s["at"]).alias("text"), F.lit("").alias("label"))
        own = F.struct(F.substring(text, x["start"] + 1, x["end"] - x["start"]).alias("text"), x["label"].alias("label"))
        return F.struct(F.concat(s["out"], F.when(x["start"] > s["at"], F.array(gap, own)).otherwise(F.array(own))).alias("out"), x["end"].alias("at"))

    def rest(s: Column) -> Column:
        tail = F.struct(F.substring(text, s["at"] + 1, F.length(text)).alias("text"), F.lit("").alias("label"))
        return F.when(s["at"] < F.length(text), F.concat(s["out"], F.array(tail))).otherwise(s["out"])

    return F.aggregate(order, state, step, rest)
