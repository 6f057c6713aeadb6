"""Attribute spans of queries: ordered patterns and the type of a span."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from querymill.functions.text import plain_yo, spaced
from querymill.operators.facts import COLORS

# A number, or a range of two.
NUMBER = r"(?:(?:от\s*)?\d+(?:[.,/]\d+)?\s*(?:-|до|—)\s*)?\d+(?:[.,/]\d+)?"

# Types of attributes in order of precedence; what stands behind a number, or a whole pattern after =.
KINDS = [
    ("memory_storage", "gb|гб|гиг(?:ов)?|tb|тб|терабайт|mb|мб|kb|кб"),
    ("memory_storage", r"=\b(?:8|16|32|64|128|256|512|1024|2048)\s*[гg]\b"),
    ("resolution_exact", r"=\b\d{3,5}\s*[xх×*]\s*\d{3,5}\s*(?:пикс|pix|p)?\b"),
    ("dimensions", r"=\b\d+(?:[.,]\d+)?\s*[xх×*]\s*\d+(?:[.,]\d+)?(?:\s*[xх×*]\s*\d+(?:[.,]\d+)?)?\b"),
    ("size", "мм|mm|см|cm|м|m|дюйм(?:а|ов)?|\"|''|inch"),
    ("power", "вт|w|ватт|квт|kw"),
    ("current", "а|a|ампер"),
    ("area", r"м2|m2|кв\.?\s*м|квадрат(?:ов)?"),
    ("weight", "кг|kg|грамм(?:а|ов)?"),
    ("volume", "л|l|литр(?:а|ов)?|мл|ml"),
    ("frequency", "гц|hz|кгц|khz|мгц|mhz"),
    ("noise_level", "дб|db"),
    ("magnification", "xх|крат"),
    ("flow_rate", "г/мин|g/min|л/мин|l/min"),
    ("resolution_standard", r"=\b(?:4k|4к|8k|8к|2k|2к|1080p|720p|1440p|uhd|full\s*hd|fhd|hd)\b"),
    ("ip_rating", r"=\bip\s*[0-6x][0-9x]\b"),
    ("connectivity", r"=\b(?:wi[- ]?fi|bluetooth|bt|nfc|5g|4g|lte|3g|gps|usb[- ]?c|type[- ]?c|hdmi|vga)\b"),
    ("time", "ч|h|час(?:а|ов)?|мин|min|минут(?:ы|у)?"),
    ("temperature", r"°C|\*C|°С|\*С|градус(?:ов)?"),
    ("voltage", "в|v|вольт"),
    ("quantity", r"шт\.?|штук[иа]?"),
    ("age_restriction", r"=\b(?:0|6|12|16|18)\s*\+"),
    ("pages_yield", r"стр\.?|страниц(?:ы)?"),
    ("warranty_period", "год[а]?|лет|мес(?:яц(?:ев|а)?)?|недел[иь]"),
    ("impedance", "ом|ohm"),
    ("rpm", "об/мин|rpm"),
    ("megapixels", "мпикс|mpix|мп|mp"),
    ("airflow_capacity", "м3/ч|m3/h|м³/ч"),
    ("density", "г/м2|g/m2|г/м²"),
]

# Words that tell what an item is for, and of what kind it is.
PURPOSES = "спорт спорта кухня кухни смузи принтер принтера окно окон мойки телефон телефона сушильный сушильных машин плита плиты индукционной часы компьютер компьютера".split()
PURPOSE_PHRASES = ["мойки окон", "сушильных машин", "индукционной плиты", "смарт часы"]
TYPES = (
    "беспроводный беспроводной беспроводные беспроводная беспроводное проводный проводной проводные проводная накладный накладной накладные вкладыш вкладыши "
    "смарт smart android сотовый сотовая газовый газовая газовые газовое электрический электрическая электрические электрическое индукционный индукционная индукционные "
    "встраиваемый встраиваемая встраиваемые встраемый встраемая напольный напольная напольные настенный настенная узкий узкая узкие широкий широкая масляный масляная лазерный лазерная цветной цветная "
    "строительный строительная автомобильный автомобильная планетарный планетарная вертикальный вертикальная ретро ларь разветвитель кухонный кухонная тестомесильный тестомесильная электроподжиг электроподжогом smarttv"
).split()

# Names of annotated subtypes and the types they fall under.
CANON = {
    "type": "type", "gas": "type", "floor": "type", "style": "type", "function": "type", "feature": "type", "purpose": "purpose", "food": "purpose", "depth": "size", "width": "size", "heigh": "size", "length": "size",
    "counts": "quantity", "material": "other", "chip": "other", "sim": "other", "game": "other", "used": "other", "new": "other", "country": "other", "release date": "other", "delivery": "other", "speed": "other",
}


def pattern(rule: str) -> str:
    """The pattern of a kind, Unicode and case-insensitive."""
    return "(?iU)" + (rule[1:] if rule.startswith("=") else rf"\b{NUMBER}\s*(?:{rule})(?!\w)")


def attribute_type(c: Column) -> Column:
    """The type of a span: a colour, the first pattern that matches, purpose, type, else other; null and blank are other."""
    t = spaced(plain_yo(F.lower(c)))
    words = F.split(t, " ")
    of = lambda names: F.array(*[F.lit(x) for x in names])
    out = F.when(t.isNull() | (t == ""), "other").when(t.isin(COLORS), "color")
    for name, rule in KINDS:
        out = out.when(t.rlike(pattern(rule)), name)
    purpose = t.rlike(r"(?U)\bдля\s+\w") | F.forall(words, lambda w: F.array_contains(of(PURPOSES), w))
    for p in PURPOSE_PHRASES:
        purpose = purpose | t.contains(p)
    kind = F.array_contains(of(TYPES), words[0]) | t.isin("smart tv")
    return out.when(purpose, "purpose").when(kind, "type").otherwise("other")


def canonical_subtype(c: Column) -> Column:
    """An annotated subtype as its type; unknown ones stay, missing ones are other."""
    k = F.lower(F.trim(c))
    table = F.create_map(*[F.lit(x) for kv in CANON.items() for x in kv])
    return F.when(k.isNull() | (k == ""), "other").otherwise(F.coalesce(F.try_element_at(table, k), k))


def looks_like_model(c: Column) -> Column:
    """Letters and digits in one word, or a short Latin word with a number: a name of a model, not an attribute."""
    t = F.lower(F.trim(c))
    return F.coalesce(t.rlike(r"^(?=.*[a-z])(?=.*\d)[a-z0-9][a-z0-9\-]{3,}$") & ~t.rlike(r"^\d+[a-zа-я]{1,3}$"), F.lit(False))


#: Kinds whose patterns need no digit.
WORDS_ONLY = ("resolution_standard", "connectivity")


def pattern_spans(c: Column) -> Column:
    """``(start, end, kind)`` of all matches of all patterns in order of precedence; offsets from gaps and matches.

    A text without a digit is tried against the few patterns that need none. Offsets are worked out for patterns that match.
    """
    some = c.rlike(r"\p{Nd}")
    none = F.array().cast("array<string>")

    def matches(name: str, rule: str) -> Column:
        found = F.regexp_extract_all(c, F.lit(pattern(rule)), F.lit(0))
        return F.struct(F.lit(name).alias("kind"), F.lit(pattern(rule)).alias("p"), (found if name in WORDS_ONLY else F.when(some, found).otherwise(none)).alias("found"))

    def spans(r: Column) -> Column:
        gaps, sizes = F.transform(F.split(c, r["p"], -1), F.length), F.transform(r["found"], F.length)
        add = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
        ends = F.transform(sizes, lambda n, i: F.struct(add(F.slice(gaps, 1, i + 1)).alias("g"), add(F.slice(sizes, 1, i + 1)).alias("s"), n.alias("n")))
        return F.transform(ends, lambda e: F.struct((e["g"] + e["s"] - e["n"]).alias("start"), (e["g"] + e["s"]).alias("end"), r["kind"].alias("kind")))

    hits = F.filter(F.array(*[matches(n, r) for n, r in KINDS]), lambda r: F.size(r["found"]) > 0)
    return F.flatten(F.transform(hits, spans))
