"""Queries of the string, token and tag functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from querymill.functions import bio as B
from querymill.functions import text as T
from querymill.operators.spell import near_pairs
from querymill.plans.clicks import strip_sql
from querymill.plans.registry import CORE
from querymill.sources.tables import table

_W = "\\p{L}\\p{M}\\p{Nd}\\p{Nl}\\p{Pc}\\x{200C}\\x{200D}"
_S = "[\\s\\p{Z}\\x{85}]+"


def _spaced(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_S}', ' ', 'g'))"


def _dash(x: str) -> str:
    one = f"regexp_replace({x}, '([A-Za-z])[\\s\\x{{0B}}]*[-–—][\\s\\x{{0B}}]*([A-Za-z])', '\\1 \\2', 'g')"
    return one.replace(x, one, 1)


def rows(spark, sf):
    return table(spark, sf, "candidates_to_label").where("query IS NOT NULL").select("cand_id", "query")


@CORE.add(
    f"SELECT cand_id, {_spaced(f'''regexp_replace({_dash(f"regexp_replace(translate(lower({strip_sql('query')}), 'ё', 'е'), '[_\\x{{A0}}]+', ' ', 'g')")}, '[^{_W}\\s\\p{{Z}}\\x{{85}}.\\-]', ' ', 'g')''')} AS key FROM candidates_to_label WHERE query IS NOT NULL"
)
def norm_keys(spark, sf):
    """The normal form of each query."""
    return rows(spark, sf).select("cand_id", T.norm_key(F.col("query")).alias("key"))


@CORE.add(f"SELECT cand_id, {_spaced(f'''regexp_replace(translate(lower({strip_sql('query')}), 'ё', 'е'), '[^{_W}\\s\\p{{Z}}\\x{{85}}.\\-]', ' ', 'g')''')} AS key FROM candidates_to_label WHERE query IS NOT NULL")
def label_keys(spark, sf):
    """The dictionary key of each query."""
    return rows(spark, sf).select("cand_id", T.label_key(F.col("query")).alias("key"))


@CORE.add(f"SELECT cand_id, {_spaced("translate(lower(query), 'ё', 'е')")} AS key FROM candidates_to_label WHERE query IS NOT NULL")
def simple_keys(spark, sf):
    """Lower case, ё as е, single spaces."""
    return rows(spark, sf).select("cand_id", T.simple_key(F.col("query")).alias("key"))


@CORE.add(f"SELECT cand_id, regexp_replace(query, '(\\p{{Nd}})([A-Za-zА-Яа-яЁё]{{1,4}})($|[^{_W}])', '\\1 \\2\\3', 'g') AS query FROM candidates_to_label WHERE query IS NOT NULL")
def parted_numbers(spark, sf):
    """Numbers parted from short letters behind them."""
    return rows(spark, sf).select("cand_id", T.parted_numbers(F.col("query")).alias("query"))


@CORE.add()
def basic_clean(spark, sf):
    """The cleaned query with its case."""
    return rows(spark, sf).select("cand_id", T.basic_clean(F.col("query")).alias("query"))


_TOKEN = "[A-Za-zА-Яа-яЁё0-9]+(?:[.\\-/][A-Za-zА-Яа-яЁё0-9]+)*|[^\\s\\x{0B}]"


@CORE.add(f"SELECT cand_id, i - 1 AS pos, t[i] AS token FROM (SELECT cand_id, t, unnest(generate_series(1, len(t))) AS i FROM (SELECT cand_id, regexp_extract_all(query, '{_TOKEN}') AS t FROM candidates_to_label WHERE query IS NOT NULL))")
def tokenize(spark, sf):
    """Tokens with their position."""
    return rows(spark, sf).select("cand_id", F.posexplode(T.tokens(F.col("query"))).alias("pos", "token")).withColumn("pos", F.col("pos").cast("long"))


@CORE.add()
def tokenize_spans(spark, sf):
    """Tokens with [start, end) offsets."""
    return rows(spark, sf).select("cand_id", F.inline(T.token_spans(F.col("query"))))


@CORE.add("SELECT cand_id, array_to_string(list_filter(regexp_split_to_array(lower(query), '[^a-zа-я0-9ё.+]+'), lambda x: x <> ''), ' ') AS split, array_to_string(regexp_extract_all(lower(query), '[a-zа-яё0-9]+'), ' ') AS plain FROM candidates_to_label WHERE query IS NOT NULL")
def split_tokens(spark, sf):
    """Tokens by splitting, and plain tokens."""
    q = F.col("query")
    return rows(spark, sf).select("cand_id", F.array_join(T.split_tokens(F.lower(q)), " ").alias("split"), F.array_join(T.plain_tokens(q), " ").alias("plain"))


@CORE.add("SELECT cand_id, query AS joined FROM candidates_to_label WHERE query IS NOT NULL")
def word_partition(spark, sf):
    """Words and gaps, joined back to the text."""
    return rows(spark, sf).select("cand_id", F.array_join(T.parts(F.col("query")), "").alias("joined"))


_TL, _TC = T.LATIN_TWINS, T.CYRILLIC_TWINS
_MIXED = "regexp_matches(w, '[а-яА-ЯёЁ]') AND regexp_matches(w, '[a-zA-Z]')"
_WORD_ROWS = "SELECT DISTINCT unnest(regexp_extract_all(query, '[\\p{L}\\p{Nd}]+')) AS w FROM candidates_to_label"


def words(spark, sf):
    return table(spark, sf, "candidates_to_label").select(F.explode(F.regexp_extract_all("query", F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))).alias("w")).distinct()


@CORE.add(
    f"SELECT w, {_MIXED} AS mixed, CASE WHEN NOT ({_MIXED}) OR c + l = 0 THEN w WHEN c >= l THEN translate(w, '{_TL}', '{_TC}') ELSE translate(w, '{_TC}', '{_TL}') END AS fixed"
    f" FROM (SELECT w, length(regexp_replace(w, '[^а-яА-ЯёЁ]|[{_TC}]', '', 'g')) AS c, length(regexp_replace(w, '[^a-zA-Z]|[{_TL}]', '', 'g')) AS l FROM ({_WORD_ROWS}))"
)
def homoglyph_words(spark, sf):
    """Mixed-script words brought into one script."""
    w = F.col("w")
    return words(spark, sf).select("w", T.mixed_script(w).alias("mixed"), T.one_script(w).alias("fixed"))


@CORE.add(f"SELECT w, translate(lower(w), 'асекорхувтмн', 'acekopxybtmh') AS latin, translate(lower(w), '{T.QWERTY.replace(chr(39), chr(39) * 2)}', '{T.JCUKEN}') AS layout FROM ({_WORD_ROWS})")
def word_views(spark, sf):
    """Each word as it looks in Latin letters and as it reads on the other layout."""
    w = F.col("w")
    return words(spark, sf).select("w", T.latin_view(w).alias("latin"), T.other_layout(w).alias("layout"))


@CORE.add(f"SELECT l.w AS typed, translate(lower(l.w), '{T.QWERTY.replace(chr(39), chr(39) * 2)}', '{T.JCUKEN}') AS meant FROM ({_WORD_ROWS}) l SEMI JOIN (SELECT DISTINCT lower(alias) AS a FROM spell_aliases) d ON d.a = translate(lower(l.w), '{T.QWERTY.replace(chr(39), chr(39) * 2)}', '{T.JCUKEN}') WHERE regexp_matches(l.w, '[a-zA-Z]')")
def wrong_layout(spark, sf):
    """Words in Latin letters that read as a known alias on the other layout."""
    known = table(spark, sf, "spell_aliases").select(F.lower("alias").alias("meant")).distinct()
    return words(spark, sf).where(T.has_latin(F.col("w"))).select(F.col("w").alias("typed"), T.other_layout(F.col("w")).alias("meant")).join(known, "meant", "left_semi").select("typed", "meant")


@CORE.add(f"SELECT w, left(regexp_replace(regexp_replace(regexp_replace(w, '\\p{{Lu}}+', 'X', 'g'), '\\p{{Ll}}+', 'x', 'g'), '[0-9]+', 'd', 'g'), 12) AS shape FROM ({_WORD_ROWS}) WHERE regexp_full_match(w, '[\\p{{Lu}}\\p{{Ll}}0-9]+')")
def word_shapes(spark, sf):
    """The shape of each word."""
    return words(spark, sf).where(F.col("w").rlike(r"^[\p{Lu}\p{Ll}0-9]+$")).select("w", T.word_shape(F.col("w")).alias("shape"))


@CORE.add(
    f"SELECT w, lower(left(w, 2)) AS prefix2, lower(left(w, 3)) AS prefix3, lower(right(w, 2)) AS suffix2, lower(right(w, 3)) AS suffix3, upper(w) = w AS is_upper, regexp_full_match(w, '[0-9]+') AS is_digit, regexp_full_match(w, '\\p{{L}}+') AS is_alpha, regexp_matches(w, '[0-9]') AS has_digit, regexp_matches(w, '[a-zA-Z]') AS has_latin, regexp_matches(w, '[а-яА-ЯёЁ]') AS has_cyrillic, least(length(w), 20)::INT AS size FROM ({_WORD_ROWS})"
)
def word_features(spark, sf):
    """Affixes and character classes of each word."""
    return words(spark, sf).select("w", T.word_features(F.col("w")).alias("f")).select("w", "f.*").drop("is_title")


@CORE.add("SELECT a.w AS a, b.w AS b, levenshtein(a.w, b.w)::INT AS d FROM (SELECT DISTINCT lower(unnest(regexp_extract_all(brand, '[a-zA-Z]{5,}'))) AS w FROM brands) a JOIN (SELECT DISTINCT lower(unnest(regexp_extract_all(brand, '[a-zA-Z]{5,}'))) AS w FROM brands) b ON a.w < b.w AND abs(length(a.w) - length(b.w)) <= 2 WHERE levenshtein(a.w, b.w) <= 5")
def near_brands(spark, sf):
    """Pairs of brand words of at most five edits, whatever they start with."""
    w = table(spark, sf, "brands").select(F.explode(F.regexp_extract_all("brand", F.lit("[a-zA-Z]{5,}"), F.lit(0))).alias("w")).select(F.lower("w").alias("w")).distinct()
    pairs = near_pairs(w.withColumnRenamed("w", "t"), w, lambda n, m: F.lit(5), 2)
    return pairs.where("t < w").select(F.col("t").alias("a"), F.col("w").alias("b"), F.levenshtein("t", "w").alias("d")).where("d <= 5")


@CORE.add("SELECT item_id, coalesce(length(query), 0) AS size FROM benchmark")
def text_sizes(spark, sf):
    """Characters of each query, 0 for null."""
    return table(spark, sf, "benchmark").select("item_id", T.text_size(F.col("query")).cast("long").alias("size"))


@CORE.add()
def title_phrases(spark, sf):
    """Capitalised phrases of documents."""
    d = table(spark, sf, "documents").select("doc_id", F.explode(T.title_phrases(F.col("text"))).alias("phrase"))
    return d.groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))


@CORE.add("SELECT count_if(ends_with(trim(name), '-'))::BIGINT AS trailing_hyphen, count_if(regexp_matches(name, 'Ð|Ñ|Ã'))::BIGINT AS mojibake FROM flat_catalog")
def text_defects(spark, sf):
    """Names with a trailing hyphen and with mojibake."""
    n = F.col("name")
    return table(spark, sf, "flat_catalog").agg(F.count_if(F.trim(n).endswith("-")).alias("trailing_hyphen"), F.count_if(n.rlike("Ð|Ñ|Ã")).alias("mojibake"))


# ---- tags; the tags are drawn from digests of the words, so that any engine can draw them

_DRAW = "CASE WHEN h < '6' THEN 'O' WHEN h < '9' THEN 'B-BRAND' WHEN h < 'c' THEN 'I-BRAND' WHEN h < 'e' THEN 'B-ATTR' ELSE 'I-ATTR' END"
_TAGGED = f"(SELECT item_id, pos, {_DRAW} AS tag FROM (SELECT item_id, i - 1 AS pos, left(md5(w[i] || '{{seed}}'), 1) AS h FROM (SELECT item_id, w, unnest(generate_series(1, len(w))) AS i FROM (SELECT item_id, regexp_extract_all(lower(query), '[a-zа-яё0-9]+') AS w FROM benchmark))))"


def _tags(words, seed: str):
    def draw(w):
        h = F.substring(F.md5(F.concat(w, F.lit(seed))), 1, 1)
        return F.when(h < "6", "O").when(h < "9", "B-BRAND").when(h < "c", "I-BRAND").when(h < "e", "B-ATTR").otherwise("I-ATTR")

    return F.transform(words, draw)


def tagged(spark, sf):
    w = T.plain_tokens(F.col("query"))
    return table(spark, sf, "benchmark").where("query IS NOT NULL").select("item_id", w.alias("words"), _tags(w, "a").alias("gold"), _tags(w, "b").alias("pred"))


def _spans_sql(seed: str, orphans: bool) -> str:
    t = _TAGGED.replace("{seed}", seed)
    start = "tag LIKE 'B-%' OR (tag LIKE 'I-%' AND prev <> 'B-' || tag[3:] AND prev <> 'I-' || tag[3:])"
    return f"""SELECT item_id, label, min(pos)::INT AS start, max(pos)::INT + 1 AS "end" FROM (SELECT item_id, pos, tag, tag[3:] AS label, max(CASE WHEN s THEN pos END) OVER (PARTITION BY item_id ORDER BY pos) AS run, max(CASE WHEN tag = 'O' THEN pos END) OVER (PARTITION BY item_id ORDER BY pos) AS gap
 FROM (SELECT *, {start} AS s FROM (SELECT *, coalesce(lag(tag) OVER (PARTITION BY item_id ORDER BY pos), 'O') AS prev FROM {t}))) x WHERE tag <> 'O' GROUP BY item_id, run, label {'' if orphans else "HAVING min_by(tag, pos) LIKE 'B-%'"}"""


@CORE.add(_spans_sql("a", False))
def bio_spans(spark, sf):
    """Entities of tags; an I- that continues nothing is left out."""
    return tagged(spark, sf).select("item_id", F.inline(B.spans(F.col("gold"))))


@CORE.add(_spans_sql("a", True))
def bio_spans_orphans(spark, sf):
    """Entities of tags; an I- that continues nothing begins one."""
    return tagged(spark, sf).select("item_id", F.inline(B.spans(F.col("gold"), orphans=True)))


@CORE.add(
    f"SELECT a.item_id, round(avg((a.tag = b.tag)::INT), 6) AS accuracy FROM {_TAGGED.replace('{seed}', 'a')} a JOIN {_TAGGED.replace('{seed}', 'b')} b USING (item_id, pos) GROUP BY 1"
)
def token_accuracy(spark, sf):
    """Share of equal tags of each query."""
    return tagged(spark, sf).select("item_id", F.round(B.token_accuracy(F.col("gold"), F.col("pred")), 6).alias("accuracy")).where("accuracy IS NOT NULL")


@CORE.add()
def merged_spans(spark, sf):
    """Entities of the first tags and those of the second that overlap none."""
    return tagged(spark, sf).select("item_id", F.inline(B.merged(B.spans(F.col("gold")), B.spans(F.col("pred")))))


@CORE.add()
def masked_queries(spark, sf):
    """Queries with all attribute spans as a placeholder."""
    s = F.transform(F.filter("entities", lambda e: e["label"] == "ATTR"), lambda e: F.struct(e["span"][0].alias("start"), e["span"][1].alias("end")))
    return table(spark, sf, "benchmark").where("query IS NOT NULL").select("item_id", T.masked(F.col("query"), s, "<attr>").alias("masked"))


@CORE.add(
    f"SELECT item_id, count(*) AS n FROM (SELECT item_id, pos, max(CASE WHEN tag <> 'O' THEN pos END) OVER (PARTITION BY item_id) AS last FROM {_TAGGED.replace('{seed}', 'a')}) WHERE pos > coalesce(last, -1) GROUP BY 1"
)
def entity_tails(spark, sf):
    """Words behind the last entity."""
    return tagged(spark, sf).select("item_id", F.size(B.tail_after_entities(F.col("words"), F.col("gold"))).cast("long").alias("n")).where("n > 0")


@CORE.add()
def hinted_tags(spark, sf):
    """Second tags laid over the first where these are free."""
    brand = F.transform(F.filter(B.spans(F.col("pred")), lambda s: s["label"] == "BRAND"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return tagged(spark, sf).select("item_id", F.array_join(B.with_hints(F.col("gold"), brand, "MODEL", over=False), " ").alias("tags"))


@CORE.add(f"SELECT item_id, pos, tag, coalesce(lag(tag) OVER w, 'BOS') AS before, coalesce(lead(tag) OVER w, 'EOS') AS after FROM {_TAGGED.replace('{seed}', 'a')} WINDOW w AS (PARTITION BY item_id ORDER BY pos)")
def neighbour_features(spark, sf):
    """Each tag with its neighbours."""
    g = F.col("gold")
    each = F.transform(g, lambda t, i: F.struct(i.cast("long").alias("pos"), t.alias("tag"), F.coalesce(F.get(g, i - 1), F.lit("BOS")).alias("before"), F.coalesce(F.get(g, i + 1), F.lit("EOS")).alias("after")))
    return tagged(spark, sf).select("item_id", F.inline(each))
