"""SQL twins that are built from rules: patterns, offsets, spans and pieces in DuckDB's terms.

Its patterns know no word border beyond ASCII and no look-ahead, so a border is a neighbour that is no word character, or
an end of the text.
"""

from __future__ import annotations

from querymill.functions import attributes as A
from querymill.functions import text as T
from querymill.operators.cascade import UNIT_SYNONYMS
from querymill.operators.facts import COLORS
from querymill.plans import analysis, cascade, pipelines, streams, text  # noqa: F401  (the queries must be there first)
from querymill.plans.clicks import Q, strip_sql
from querymill.plans.registry import CORE
from querymill.plans.text import _TAGGED, _TOKEN, _W, _dash, _spaced, _spans_sql

_SPACE = "[\\s\\p{Z}\\x{85}\\x{0B}]"
_OPEN, _CLOSE = f"(?:^|[^{_W}])", f"(?:$|[^{_W}])"


def quoted(x: str) -> str:
    """A string literal."""
    return "'" + x.replace("'", "''") + "'"


def listed(xs: list[str]) -> str:
    """A list of string literals."""
    return "[" + ", ".join(map(quoted, xs)) + "]"


def pattern_sql(rule: str) -> str:
    """The pattern of a kind of attribute, for a search."""
    p = rule[1:] if rule.startswith("=") else rf"\b{A.NUMBER}\s*(?:{rule})\b"
    p = _OPEN + p.removeprefix("\\b")
    p = p.removesuffix("\\b") + _CLOSE if p.endswith("\\b") else p
    return "(?i)" + p.replace("\\d", "\\p{Nd}").replace("\\s", _SPACE)


def holds(c: str, rule: str) -> str:
    """Whether a text holds a kind of attribute."""
    return f"regexp_matches({c}, {quoted(pattern_sql(rule))})"


# ---- attributes

_KINDS: dict[str, list[str]] = {}
for _name, _rule in A.KINDS:
    _KINDS.setdefault(_name, []).append(holds("query", _rule))
_HITS = {k: " OR ".join(v) for k, v in _KINDS.items()} | {"any": " OR ".join(x for v in _KINDS.values() for x in v)}
CORE.sql["pattern_coverage"] = " UNION ALL ".join(f"SELECT '{k}' AS kind, round(avg(CASE WHEN {v} THEN 1 ELSE 0 END), 6) AS share FROM {Q} WHERE query IS NOT NULL" for k, v in _HITS.items())


def attribute_type_sql(c: str) -> str:
    """The type of a span ``c`` that is spaced, in lower case and without ё."""
    words = f"string_split({c}, ' ')"
    purpose = f"regexp_matches({c}, '{_OPEN}для{_SPACE}+[{_W}]') OR len(list_filter({words}, lambda w: NOT list_contains({listed(A.PURPOSES)}, w))) = 0"
    purpose += "".join(f" OR contains({c}, {quoted(p)})" for p in A.PURPOSE_PHRASES)
    kinds = " ".join(f"WHEN {holds(c, r)} THEN '{n}'" for n, r in A.KINDS)
    return f"CASE WHEN {c} IS NULL OR {c} = '' THEN 'other' WHEN list_contains({listed(COLORS)}, {c}) THEN 'color' {kinds} WHEN {purpose} THEN 'purpose' WHEN list_contains({listed(A.TYPES)}, {words}[1]) OR {c} = 'smart tv' THEN 'type' ELSE 'other' END"


CORE.sql["attribute_types"] = f"SELECT {attribute_type_sql('t')} AS type, count(*) AS n FROM (SELECT {_spaced("translate(lower(e.text), 'ё', 'е')")} AS t FROM (SELECT unnest(entities) AS e FROM benchmark) WHERE e.label = 'ATTR') GROUP BY 1"
_MODELISH = "regexp_full_match(t, '[a-z0-9][a-z0-9\\-]{3,}') AND regexp_matches(t, '[a-z]') AND regexp_matches(t, '[0-9]') AND NOT regexp_full_match(t, '[0-9]+[a-zа-я]{1,3}')"
CORE.sql["model_likeness"] = f"SELECT label, count_if(coalesce({_MODELISH}, false))::BIGINT AS modelish, count(*) AS n FROM (SELECT e.label AS label, lower(trim(e.text)) AS t FROM (SELECT unnest(entities) AS e FROM benchmark)) GROUP BY 1"

# ---- text

_UNITS = "|".join(sorted(T.UNIT_SUFFIXES, key=lambda u: (-len(u), u)))
_clean = "translate(regexp_replace(translate(trim(translate(query, chr(160), ' ')), 'ёЁ', 'еЕ'), '_+', ' ', 'g'), '×Х', 'xx')"
_clean = rf"regexp_replace({_clean}, '(?i)(\p{{Nd}}+(?:[.,]\p{{Nd}}+)?)((?:{_UNITS}))($|[^{_W}])', '\1 \2\3', 'g')"
_clean = rf"regexp_replace({_clean}, '(\p{{Nd}}+)([A-Za-zА-Яа-яЁё]{{1,4}})($|[^{_W}])', '\1 \2\3', 'g')"
CORE.sql["basic_clean"] = f"SELECT cand_id, {_spaced(_dash(_clean))} AS query FROM candidates_to_label WHERE query IS NOT NULL"

_offsets = "(coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(t[1:i - 1], lambda x: length(x))), 0))::INT"
CORE.sql["tokenize_spans"] = (
    f'SELECT cand_id, token, "start", ("start" + length(token))::INT AS "end" FROM (SELECT cand_id, t[i] AS token, {_offsets} AS "start" FROM (SELECT *, unnest(generate_series(1, len(t))) AS i FROM'
    f" (SELECT cand_id, regexp_extract_all(query, '{_TOKEN}') AS t, regexp_split_to_array(query, '{_TOKEN}') AS g FROM candidates_to_label WHERE query IS NOT NULL)))"
)
# a character of no kind before each sign, so that the sign behind one phrase is still there for the next
_TITLE = f"{_OPEN}([A-ZА-ЯЁ][a-zа-яё]+(?:{_SPACE}+[A-ZА-ЯЁ][a-zа-яё]+)+){_CLOSE}"
CORE.sql["title_phrases"] = rf"SELECT phrase, count(*) AS n FROM (SELECT unnest(regexp_extract_all(regexp_replace(text, '([^{_W}\s\p{{Z}}\x{{85}}\x{{0B}}])', chr(2) || '\1', 'g'), '{_TITLE}', 1)) AS phrase FROM documents) GROUP BY 1"
_key = f"{_spaced(f'''regexp_replace({_dash(f'''regexp_replace(translate(lower({strip_sql('query')}), 'ё', 'е'), '[_\\x{{A0}}]+', ' ', 'g')''')}, '[^{_W}\\s\\p{{Z}}\\x{{85}}.\\-]', ' ', 'g')''')}"
CORE.sql["stream_keys"] = f"SELECT item_id, {_key} AS key, len(regexp_extract_all(query, '{_TOKEN}'))::INT AS n_tokens FROM benchmark WHERE query IS NOT NULL"
CORE.sql["stream_percentiles"] = (
    "SELECT * FROM (SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1, 2)"
    " WHERE start + INTERVAL 1 DAY <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM events)"
)

# ---- spans

_A, _B = _spans_sql("a", False), _spans_sql("b", False)
CORE.sql["merged_spans"] = f'WITH a AS ({_A}), b AS ({_B}) SELECT item_id, label, "start", "end" FROM a UNION ALL SELECT item_id, label, "start", "end" FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.item_id = b.item_id AND a."start" < b."end" AND b."start" < a."end")'
CORE.sql["hinted_tags"] = f"""WITH g AS {_TAGGED.replace('{seed}', 'a')}, h AS (SELECT item_id, "start" AS s, "end" AS e FROM ({_B}) WHERE label = 'BRAND'),
f AS (SELECT h.item_id, h.s, h.e FROM h JOIN g ON g.item_id = h.item_id AND g.pos >= h.s AND g.pos < h.e GROUP BY 1, 2, 3 HAVING count_if(g.tag <> 'O') = 0),
t AS (SELECT g.item_id, g.pos, CASE WHEN f.s IS NULL THEN g.tag WHEN g.pos = f.s THEN 'B-MODEL' ELSE 'I-MODEL' END AS tag FROM g LEFT JOIN f ON f.item_id = g.item_id AND g.pos >= f.s AND g.pos < f.e)
SELECT b.item_id, coalesce(string_agg(t.tag, ' ' ORDER BY t.pos), '') AS tags FROM (SELECT item_id FROM benchmark WHERE query IS NOT NULL) b LEFT JOIN t USING (item_id) GROUP BY 1"""


def masked_sql(spans: str, mark: str, c: str = "query") -> str:
    """``c`` with the spans, a list of entities, replaced from the right; a reduction starts with the text itself."""
    steps = f"list_transform(list_reverse_sort(list_transform({spans}, lambda s: [s.span[1], s.span[2]])), lambda s: {{'t': NULL::VARCHAR, 's': s[1], 'e': s[2]}})"
    one = f"lambda a, x: {{'t': substring(a.t, 1, x.s) || '{mark}' || substring(a.t, x.e + 1), 's': 0, 'e': 0}}"
    return _spaced(f"list_reduce({steps}, {one}, {{'t': {c}, 's': 0, 'e': 0}}).t")


_ATTRS = "list_filter(coalesce(entities, []), lambda e: e.label = 'ATTR')"
CORE.sql["masked_queries"] = f"SELECT item_id, {masked_sql(_ATTRS, '<attr>')} AS masked FROM benchmark WHERE query IS NOT NULL"
_swapped = "span_text"
for _x, _y in UNIT_SYNONYMS.items():
    _swapped = rf"regexp_replace({_swapped}, '(?i)(\p{{Nd}})({_SPACE}*){_x}$', '\1\2{_y}')"
CORE.sql["attribute_rows"] = f"""WITH r AS (SELECT item_id AS id, query, entities, unnest({_ATTRS}) AS ent FROM benchmark WHERE query IS NOT NULL),
s AS (SELECT id, substring(query, ent.span[1] + 1, ent.span[2] - ent.span[1]) AS span_text, ent.span[1] AS "start", ent.span[2] AS "end", {masked_sql(_ATTRS, '<attr>')} AS masked_all,
 {masked_sql(f"list_filter({_ATTRS}, lambda e: e.span[1] <> ent.span[1] OR e.span[2] <> ent.span[2])", '<attr>')} AS masked_others, {masked_sql('coalesce(entities, [])', '<ent>')} AS masked_entities FROM r),
t AS (SELECT *, {_spaced("translate(lower(span_text), 'ёЁ', 'еЕ')")} AS k, {_swapped} AS swapped FROM s), u AS (SELECT *, {attribute_type_sql('k')} AS type FROM t)
SELECT id, span_text, "start", "end", masked_all, masked_others, masked_entities, type, false AS is_aug FROM u UNION ALL SELECT id, swapped, "start", "end", masked_all, masked_others, masked_entities, type, true FROM u WHERE swapped <> span_text"""
_ENDS = "coalesce(lag(e) OVER (PARTITION BY item_id ORDER BY s), 0)"
CORE.sql["highlighted_queries"] = f"""WITH x AS (SELECT item_id, query, unnest(entities) AS n FROM benchmark WHERE query <> ''), y AS (SELECT item_id, query, n.label AS label, n.span[1] AS s, n.span[2] AS e FROM x), z AS (SELECT *, {_ENDS} AS p FROM y),
o AS (SELECT item_id, 2 * s AS o, substring(query, p + 1, s - p) AS text, '' AS label FROM z WHERE s > p UNION ALL SELECT item_id, 2 * s + 1, substring(query, s + 1, e - s), label FROM z
 UNION ALL SELECT b.item_id, 1000000000, substring(b.query, coalesce(m.e, 0) + 1), '' FROM benchmark b LEFT JOIN (SELECT item_id, arg_max(e, s) AS e FROM y GROUP BY 1) m USING (item_id) WHERE b.query <> '' AND length(b.query) > coalesce(m.e, 0))
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY o) - 1)::INT AS nth, text, label FROM o"""

# ---- damage

_h = "md5(concat_ws('|', item_id::VARCHAR, (i - 1)::VARCHAR, '42'))"
_at = "(hurt_at % (length(w) - 1) + 1)"
_hurt = f"""CASE kind % 4 WHEN 0 THEN substring(w, 1, {_at}) || substring(w, {_at}, 1) || substring(w, {_at} + 1) WHEN 1 THEN substring(w, 1, {_at} - 1) || substring(w, {_at} + 1)
 WHEN 2 THEN substring(w, 1, {_at} - 1) || substring(w, {_at} + 1, 1) || substring(w, {_at}, 1) || substring(w, {_at} + 2) ELSE translate(w, 'aceopxyасеорху', 'асеорхуaceopxy') END"""
CORE.sql["corrupted_queries"] = f"""WITH a AS (SELECT item_id, unnest(string_split(query, ' ')) AS w, unnest(generate_series(1, len(string_split(query, ' ')))) AS i FROM benchmark WHERE query IS NOT NULL),
b AS (SELECT *, ('0x' || substring({_h}, 1, 4))::INT / 65536.0 AS drawn, ('0x' || substring({_h}, 5, 2))::INT AS hurt_at, ('0x' || substring({_h}, 7, 1))::INT AS kind FROM a),
c AS (SELECT *, CASE WHEN length(w) >= 4 AND drawn < 0.5 THEN {_hurt} ELSE w END AS x FROM b)
SELECT item_id AS id, string_agg(x, ' ' ORDER BY i) AS query, count_if(w <> x)::BIGINT AS n_changed FROM c GROUP BY 1"""
