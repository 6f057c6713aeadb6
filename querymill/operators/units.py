"""Quantities in any unit: a conversion graph of affine edges, and a parser of quantities in text.

The graph holds exact fractions. For every unit the shortest chain of edges to its dimension's base unit is composed
once; every edge that closes a cycle is checked against the composed chains. The result is a small table that is
equi-joined on the spelling of the unit.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querymill.functions.chars import plain

# Base unit of each dimension.
BASES = {"mass": "g", "volume": "ml", "length": "um", "power": "W", "storage": "MB", "frequency": "Hz", "charge": "mAh", "voltage": "V", "duration": "s"}

# Value in the second unit = value in the first * factor + offset.
EDGES = [
    ("kg", "g", "1000", "0"), ("mg", "g", "1/1000", "0"), ("t", "kg", "1000", "0"), ("lb", "oz", "16", "0"), ("oz", "g", "28.349523125", "0"),
    ("l", "ml", "1000", "0"), ("cl", "ml", "10", "0"), ("dl", "cl", "10", "0"), ("m3", "l", "1000", "0"), ("floz", "ml", "29.5735295625", "0"),
    ("mm", "um", "1000", "0"), ("cm", "mm", "10", "0"), ("dm", "cm", "10", "0"), ("m", "cm", "100", "0"), ("m", "mm", "1000", "0"), ("km", "m", "1000", "0"),
    ("inch", "mm", "25.4", "0"), ("inch", "cm", "2.54", "0"), ("foot", "inch", "12", "0"), ("yard", "foot", "3", "0"),
    ("kW", "W", "1000", "0"), ("MW", "kW", "1000", "0"), ("mW", "W", "1/1000", "0"), ("hp", "W", "735.49875", "0"),
    ("GB", "MB", "1024", "0"), ("TB", "GB", "1024", "0"), ("TB", "MB", "1048576", "0"), ("MB", "KB", "1024", "0"), ("PB", "TB", "1024", "0"),
    ("kHz", "Hz", "1000", "0"), ("MHz", "kHz", "1000", "0"), ("GHz", "MHz", "1000", "0"), ("GHz", "Hz", "1000000000", "0"),
    ("Ah", "mAh", "1000", "0"), ("kV", "V", "1000", "0"), ("V", "mV", "1000", "0"),
    ("min", "s", "60", "0"), ("h", "min", "60", "0"), ("h", "s", "3600", "0"), ("day", "h", "24", "0"), ("s", "ms", "1000", "0"),
]

# Spellings of the units in lower case; Russian words as stems with their endings.
SPELLINGS = {
    "g": "g gr gramm gram grams г гр грам грамм грамма граммов грамми",
    "kg": "kg kilo kilogram kilograms kilogramm кг кило килограмм килограмма килограммов",
    "mg": "mg мг миллиграмм миллиграмма миллиграммов",
    "t": "тонна тонны тонн",
    "lb": "lb lbs pound pounds фунт фунта фунтов",
    "oz": "oz ounce ounces унция унции унций",
    "ml": "ml milliliter millilitre milliliters мл миллилитр миллилитра миллилитров",
    "cl": "cl сл сантилитр",
    "dl": "dl дл",
    "l": "l lt ltr liter litre liters litres л литр литра литров литры",
    "m3": "m³ м³ m3 м3 куб",
    "um": "µm μm um мкм микрон микрона",
    "mm": "mm millimeter millimetre мм миллиметр миллиметра миллиметров",
    "cm": "cm centimeter centimetre centimeters см сантиметр сантиметра сантиметров",
    "dm": "dm дм дециметр",
    "m": "m meter meters metre metres м метр метра метров",
    "km": "km км километр километра километров",
    "inch": "inch inches zoll \" ″ ” '' ′′ дюйм дюйма дюймов дюймы",
    "foot": "ft foot feet фут фута футов",
    "yard": "yd yard yards ярд ярда ярдов",
    "W": "w watt watts вт ватт ватта ваттов",
    "kW": "kw kilowatt квт киловатт киловатта киловаттов",
    "MW": "мегаватт",
    "mW": "милливатт",
    "hp": "hp л.с. лс",
    "KB": "kb кб килобайт",
    "MB": "mb мб мегабайт мегабайта mbyte",
    "GB": "gb гб гиг гига гигов гигабайт гигабайта гигабайтов gbyte",
    "TB": "tb тб терабайт терабайта терабайтов tbyte",
    "PB": "петабайт",
    "Hz": "hz hertz гц герц",
    "kHz": "khz кгц килогерц",
    "MHz": "mhz мгц мегагерц",
    "GHz": "ghz ггц гигагерц",
    "mAh": "mah ma·h мач ма·ч ма*ч мa·ч миллиампер-час",
    "Ah": "ah a·h ач а·ч а*ч ампер-час ампер-часов",
    "V": "v volt volts в вольт вольта",
    "kV": "kv кв киловольт",
    "mV": "mv мв милливольт",
    "ms": "ms мс миллисекунд миллисекунда миллисекунды",
    "s": "sec сек секунда секунды секунд second seconds",
    "min": "min mins minute minutes minuten мин минута минуты минут минуту",
    "h": "h hr hrs hour hours std stunde stunden ч час часа часов",
    "day": "сутки суток",
}

# Number words, to be added up (a hundred word after a digit word in Russian is one word).
NUMBER_WORDS = {
    "ноль": 0, "один": 1, "одна": 1, "одного": 1, "одну": 1, "два": 2, "две": 2, "двух": 2, "три": 3, "трех": 3, "трёх": 3, "четыре": 4, "пять": 5, "шесть": 6, "семь": 7, "восемь": 8, "девять": 9, "десять": 10,
    "одиннадцать": 11, "двенадцать": 12, "тринадцать": 13, "четырнадцать": 14, "пятнадцать": 15, "шестнадцать": 16, "семнадцать": 17, "восемнадцать": 18, "девятнадцать": 19,
    "двадцать": 20, "тридцать": 30, "сорок": 40, "пятьдесят": 50, "шестьдесят": 60, "семьдесят": 70, "восемьдесят": 80, "девяносто": 90,
    "сто": 100, "двести": 200, "триста": 300, "четыреста": 400, "пятьсот": 500, "шестьсот": 600, "семьсот": 700, "восемьсот": 800, "девятьсот": 900,
    "полтора": 1.5, "полторы": 1.5, "пол": 0.5, "half": 0.5,
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "fifteen": 15, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "hundred": 100,
    "eins": 1, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9, "zehn": 10, "zwölf": 12, "zwanzig": 20,
}
THOUSANDS = {"тыс": 1000, "тыс.": 1000, "тысяча": 1000, "тысячи": 1000, "тысяч": 1000, "thousand": 1000, "tausend": 1000, "млн": 1_000_000}


class ConversionGraph:
    """Units as nodes, affine conversions as edges, exact."""

    def __init__(self, edges: list[tuple[str, str, str, str]], bases: dict[str, str]):
        self.bases = bases
        self.near: dict[str, list[tuple[str, Fraction, Fraction]]] = {}
        for a, b, factor, offset in edges:
            f, o = Fraction(factor), Fraction(offset)
            self.near.setdefault(a, []).append((b, f, o))
            self.near.setdefault(b, []).append((a, 1 / f, -o / f))
        self.to_base: dict[str, tuple[str, Fraction, Fraction]] = {}
        for dim, base in bases.items():
            self._compose(dim, base)
        self._check(edges)

    def _compose(self, dim: str, base: str) -> None:
        """Breadth first from the base: the first chain that reaches a unit is a shortest one."""
        self.to_base[base] = (dim, Fraction(1), Fraction(0))
        queue = deque([base])
        while queue:
            u = queue.popleft()
            _, f, o = self.to_base[u]
            for v, g, p in self.near.get(u, []):  # u = v's ... : value_v = value_u * g + p
                if v not in self.to_base:
                    self.to_base[v] = (dim, f / g, o - f * p / g)
                    queue.append(v)

    def _check(self, edges: list[tuple[str, str, str, str]]) -> None:
        """Every edge must agree with the composed chains, so every cycle is consistent."""
        for a, b, factor, offset in edges:
            if a not in self.to_base or b not in self.to_base:
                raise ValueError(f"{a} or {b} reaches no base unit")
            (da, fa, oa), (db, fb, ob) = self.to_base[a], self.to_base[b]
            f, o = Fraction(factor), Fraction(offset)
            if da != db or fb * f != fa or fb * o + ob != oa:
                raise ValueError(f"the edge {a} -> {b} contradicts other edges")

    def table(self, spark: SparkSession, spellings: dict[str, str]) -> DataFrame:
        """``spelling, dim, num, den, offset_num, offset_den``: one row a spelling, so its size is fixed."""
        rows = []
        for unit, words in spellings.items():
            dim, f, o = self.to_base[unit]
            rows += [(w, dim, f.numerator, f.denominator, o.numerator, o.denominator) for w in words.split()]
        if len({r[0] for r in rows}) != len(rows):
            raise ValueError("a spelling belongs to two units")
        return spark.createDataFrame(rows, "spelling string, dim string, num long, den long, offset_num long, offset_den long")


_UNITS = sorted({w for words in SPELLINGS.values() for w in words.split()}, key=len, reverse=True)
_UNIT = re.compile("|".join(map(re.escape, _UNITS)))
_NUMBER = re.compile(r"\d{1,3}(?:[ ]\d{3})+(?![\d])(?:[.,]\d+)?|\d+(?:[.,]\d+)?")
_UNGROUPED = re.compile(r"\d+(?:[.,]\d+)?")
_WORD = re.compile(r"[^\W\d_]+")
_JOIN = re.compile(r"/|\s*(?:[x×х*]|[-–—‐‑]|\bдо\b|\bto\b|\bbis\b|\.\.\.?|…)\s*")
_THOUSAND = re.compile(r"\s*(?:" + "|".join(map(re.escape, sorted(THOUSANDS, key=len, reverse=True))) + r")(?![^\W_])")
_IN_ONE = re.compile(r"\s*(?:в|in)\s*1(?![\d.,])")
_GENERATION = {"2", "3", "4", "5", "6"}
_SPACE = re.compile(r"\s+")
# Words behind which a number is a version or a place, so it begins no grouped thousand.
_VERSIONED = re.compile(r"(?:^|\W)(?:win|windows|android|ios|usb|hdmi|bluetooth|bt|fi|wifi|топ|top|номер|серия|версия|version|класс)\s*$")


def _word_number(text: str, at: int) -> tuple[Fraction, int] | None:
    total, end, last = Fraction(0), at, None
    while m := _WORD.match(text, end):
        v = NUMBER_WORDS.get(m.group())
        if v is None or last is not None and v >= last:
            break
        total, end, last = total + Fraction(v), m.end(), v
        if not (s := re.compile(r"[ ]+").match(text, end)):
            break
        end = s.end()
    if last is None:
        return None
    while text[end - 1] == " ":
        end -= 1
    return total, end


def _unit_at(text: str, at: int) -> tuple[str, int] | None:
    """A unit after optional spaces (and a hyphen), not followed by more letters or by another factor (as in kWh)."""
    spaced = re.compile(r"\s*-?\s*").match(text, at).end()
    m = _UNIT.match(text, spaced)
    if not m:
        return None
    for unit in (u for u in _UNITS if text.startswith(u, spaced)):
        end = spaced + len(unit)
        after = text[end : end + 2]
        if after[:1].isalnum() and unit[-1].isalpha() or re.match(r"[·/][^\W\d]|\*[^\W\d]", after) or unit == "''" and after[:1] == "'":
            continue
        return unit, end
    return None


def _numbers(text: str, at: int) -> tuple[list[Fraction], list[str], int] | None:
    """A number, a range, a size list or a fraction, from ``at``."""
    values, joins, end = [], [], at
    while True:
        if (m := (_NUMBER if not _VERSIONED.search(text, max(0, end - 12), end) else _UNGROUPED).match(text, end)) and not (m.end() < len(text) and text[m.end()] == "."  and text[m.end() + 1 : m.end() + 2].isdigit()):
            raw = m.group().replace(" ", "").replace(",", ".")
            value, stop = Fraction(raw), m.end()
        elif w := _word_number(text, end):
            value, stop = w
        else:
            break
        if t := _THOUSAND.match(text, stop):
            value, stop = value * THOUSANDS[t.group().strip()], t.end()
        values.append(value)
        end = stop
        if not (j := _JOIN.match(text, end)):
            return values, joins, end
        joins.append(j.group().strip())
        end = j.end()
    if not values:
        return None
    joins.pop()
    return values, joins, stop


def quantities(text: str | None) -> list[tuple[str, Fraction]]:
    """(unit spelling, number) of each quantity that ``text`` states; ``text`` is cleaned and lower case.

    A number counts when a unit follows it, for each number of a range or size list alike. ``a/b`` (without spaces) is
    a fraction before inches and a list elsewhere. Any white space counts as one space. Bare numbers, prices, percentages, versions, codes, mobile generations
    (2g to 6g, glued) and "N in 1" don't count.
    """
    out: list[tuple[str, Fraction]] = []
    if not text:
        return out
    text = _SPACE.sub(" ", text)
    i, n = 0, len(text)
    while i < n:
        c = text[i]
        if not c.isalnum():
            i += 1
            continue
        if i and (text[i - 1].isalnum() or text[i - 1] in "._" and i > 1 and text[i - 2].isalnum()):
            i += 1
            continue
        found = _numbers(text, i)
        if found is None:
            m = re.compile(r"[^\W_]+").match(text, i)
            i = m.end() if m else i + 1
            continue
        values, joins, end = found
        unit = _unit_at(text, end)
        if unit is None:
            glued = re.compile(r"[^\W_]+").match(text, end)
            i = glued.end() if glued else max(end, i + 1)
            continue
        name, stop = unit
        if name in ("в", "v") and _IN_ONE.match(text, end) and len(values) == 1 and _unit_at(text, _IN_ONE.match(text, end).end()) is None:
            i = _IN_ONE.match(text, end).end()
            continue
        if name == "g" and stop - end == 1 and len(values) == 1 and text[i:end] in _GENERATION:
            i = stop
            continue
        if name in ("\"", "″", "”", "''", "′′", "inch", "inches", "zoll") or name.startswith("дюйм"):
            merged, k = [], 0
            while k < len(values):
                if k < len(joins) and joins[k] == "/" and values[k + 1]:
                    merged.append(values[k] / values[k + 1])
                    k += 2
                else:
                    merged.append(values[k])
                    k += 1
            values = merged
        out += [(name, v) for v in values]
        i = stop
    return out


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Mentions of each row; each distinct text of a batch is parsed once, a few thousand across batches."""
    seen: dict[str, list[tuple[str, Fraction]]] = {}
    for pdf in batches:
        if len(seen) > 50_000:
            seen.clear()
        rows = []
        for tab, row_id, text in zip(pdf["tab"], pdf["row_id"], pdf["text"], strict=True):
            if (got := seen.get(text)) is None:
                got = seen[text] = quantities(plain(text).lower())
            rows += [(tab, row_id, u, str(v.numerator), str(v.denominator)) for u, v in got]
        yield pd.DataFrame(rows, columns=["tab", "row_id", "spelling", "n", "d"])


#: From here on doubles skip whole numbers.
MOST = 9e15

#: Rows without a digit and without a number word state nothing, but for those that ``plain`` may change: with anything
#: beyond ASCII and the Russian letters, or two alphabets side by side.
MAY_STATE = r"(?iu)\p{N}|(?-i:[^\x00-\x7Fа-яА-ЯёЁ]|[A-Za-z][а-яА-ЯёЁ]|[а-яА-ЯёЁ][A-Za-z])|" + "|".join(sorted({w[:3] for w in NUMBER_WORDS}))


def stated_quantities(texts: DataFrame, graph: ConversionGraph | None = None, spellings: dict[str, str] | None = None) -> DataFrame:
    """``tab, row_id, dim, base_value`` of every distinct quantity that the texts (``tab, row_id, text``) state.

    base_value is rounded to a whole base unit, halves up; values of ``MOST`` base units and more, which no double
    holds exactly, are left out. Defined cases: null and empty texts state nothing; a
    quantity stated twice in a row, in whatever units, is one row; repeated rows count once; other columns are ignored.
    """
    graph = graph or ConversionGraph(EDGES, BASES)
    units = graph.table(texts.sparkSession, spellings or SPELLINGS)
    mentions = texts.select("tab", "row_id", "text").where(F.col("text").rlike(MAY_STATE)).mapInPandas(_parse, "tab string, row_id long, spelling string, n string, d string")
    x = lambda c: F.col(c).cast("double")
    value = x("n") * x("num") / (x("d") * x("den")) + x("offset_num") / x("offset_den")
    return (
        mentions.join(F.broadcast(units), "spelling")
        .select("tab", "row_id", "dim", value.alias("value"))
        .where(F.col("value") < MOST)
        .select("tab", "row_id", "dim", F.floor(F.round("value", 6) + 0.5).cast("long").alias("base_value"))
        .distinct()
    )
