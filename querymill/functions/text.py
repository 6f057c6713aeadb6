"""String functions of the query pipeline: Column in, Column out, all inside the JVM.

Patterns that use word classes carry ``(?U)``, so that they follow Unicode. Null gives null unless a function says
otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The unit suffixes that are parted from a number.
UNIT_SUFFIXES = "gb гб tb тб mb мб mm мм cm см w вт kw квт mah мач маh hz гц mhz мгц kg кг g г l л ml мл v в inch дюйм".split()

# Letters of the other alphabet that look alike, lower and upper case.
LATIN_TWINS = "aceopxyABCEHKMOPTXY"
CYRILLIC_TWINS = "асеорхуАВСЕНКМОРТХУ"

# The keys of the two layouts.
QWERTY = "`qwertyuiop[]asdfghjkl;'zxcvbnm,."
JCUKEN = "ёйцукенгшщзхъфывапролджэячсмитьбю"

TOKEN = r"[A-Za-zА-Яа-яЁё0-9]+(?:[.\-/][A-Za-zА-Яа-яЁё0-9]+)*|[^\s]"


def missing(c: Column) -> Column:
    """True for null, empty and blank."""
    return c.isNull() | (F.trim(c) == "")


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def spaced(c: Column) -> Column:
    """Runs of white space as one space, none outside."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def plain_yo(c: Column) -> Column:
    """ё as е, in both cases."""
    return F.translate(c, "ёЁ", "еЕ")


def parted_units(c: Column) -> Column:
    """``128гб`` as ``128 гб``: first the known units, then any one to four letters."""
    units = "|".join(sorted(UNIT_SUFFIXES, key=lambda u: (-len(u), u)))
    known = F.regexp_replace(c, rf"(?iU)(\d+(?:[.,]\d+)?)((?:{units}))\b", "$1 $2")
    return parted_numbers(known)


def parted_numbers(c: Column) -> Column:
    """A number and the one to four letters behind it, parted."""
    return F.regexp_replace(c, r"(?U)(\d+)([A-Za-zА-Яа-яЁё]{1,4})\b", "$1 $2")


def parted_latin_dash(c: Column) -> Column:
    """A dash between Latin letters as a space."""
    return F.regexp_replace(c, r"(?<=[A-Za-z])\s*[-–—]\s*(?=[A-Za-z])", " ")


def norm_key(c: Column) -> Column:
    """Lower case, ё as е, underscores and dashes between Latin letters as spaces, only letters, digits, ``.`` and ``-``."""
    out = plain_yo(F.lower(strip(c)))
    out = parted_latin_dash(F.regexp_replace(out, r"[_\u00a0]+", " "))
    return spaced(F.regexp_replace(out, r"(?U)[^\w\s.\-]", " "))


def basic_clean(c: Column) -> Column:
    """Spaces, ё, size crosses and parted units cleaned; case stays."""
    out = plain_yo(F.trim(F.translate(c, "\u00a0", " ")))
    out = F.translate(F.regexp_replace(out, "_+", " "), "×Х", "xx")
    return spaced(parted_latin_dash(parted_units(out)))


def label_key(c: Column) -> Column:
    """The key under which dictionaries are kept: lower case, ё as е, only word characters, ``-`` and ``.``."""
    return spaced(F.regexp_replace(plain_yo(F.lower(strip(c))), r"(?U)[^\w\s\-.]", " "))


def simple_key(c: Column) -> Column:
    """Lower case, ё as е, single spaces."""
    return spaced(plain_yo(F.lower(c)))


def tokens(c: Column) -> Column:
    """Words joined by ``.``, ``-`` or ``/``, and single other characters."""
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def token_spans(c: Column) -> Column:
    """Tokens with [start, end) offsets, from the lengths of tokens and of the gaps between them."""
    found = tokens(c)
    gaps = F.transform(F.split(c, TOKEN, -1), F.length)
    sizes = F.transform(found, F.length)

    def at(_: Column, i: Column) -> Column:
        before = F.aggregate(F.slice(gaps, 1, i + 1), F.lit(0), lambda a, x: a + x) + F.aggregate(F.slice(sizes, 1, i), F.lit(0), lambda a, x: a + x)
        return F.struct(F.get(found, i).alias("token"), before.alias("start"), (before + F.get(sizes, i)).alias("end"))

    return F.transform(found, at)


def split_tokens(c: Column) -> Column:
    """Runs of letters, digits, ``.`` and ``+``; ``c`` is in lower case."""
    return F.filter(F.split(c, "[^a-zа-я0-9ё.+]+"), lambda x: x != "")


def plain_tokens(c: Column) -> Column:
    """Runs of Latin or Russian letters and digits of the lower case text."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-zа-яё0-9]+"), F.lit(0))


def parts(c: Column) -> Column:
    """The text cut into words and what stands between, so that joining gives it back."""
    return F.regexp_extract_all(c, F.lit(r"(?U)\w+|\W+"), F.lit(0))


def has_cyrillic(c: Column) -> Column:
    return c.rlike("[а-яА-ЯёЁ]")


def has_latin(c: Column) -> Column:
    return c.rlike("[a-zA-Z]")


def mixed_script(c: Column) -> Column:
    return has_cyrillic(c) & has_latin(c)


def one_script(c: Column) -> Column:
    """A mixed word in the alphabet of most of its letters that have no twin; on a tie Cyrillic; without such letters unchanged."""
    cyrillic = F.length(F.regexp_replace(c, f"[^а-яА-ЯёЁ]|[{CYRILLIC_TWINS}]", ""))
    latin = F.length(F.regexp_replace(c, f"[^a-zA-Z]|[{LATIN_TWINS}]", ""))
    return F.when(~mixed_script(c) | (cyrillic + latin == 0), c).when(cyrillic >= latin, F.translate(c, LATIN_TWINS, CYRILLIC_TWINS)).otherwise(F.translate(c, CYRILLIC_TWINS, LATIN_TWINS))


def latin_view(c: Column) -> Column:
    """Lower case with Cyrillic twins as Latin letters."""
    return F.translate(F.lower(c), "асекорхувтмн", "acekopxybtmh")


def other_layout(c: Column) -> Column:
    """Text typed on a Latin layout as it reads on the Russian one."""
    return F.translate(F.lower(c), QWERTY, JCUKEN)


def word_shape(c: Column) -> Column:
    """X for capitals, x for small letters, d for digits, runs as one, at most twelve characters."""
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\p{Lu}+", "X"), r"\p{Ll}+", "x"), r"\d+", "d")
    return F.substring(F.regexp_replace(out, r"(.)\1+", "$1"), 1, 12)


def word_features(c: Column) -> Column:
    """Affixes and character classes of a token."""
    return F.struct(
        F.lower(F.substring(c, 1, 2)).alias("prefix2"),
        F.lower(F.substring(c, 1, 3)).alias("prefix3"),
        F.lower(F.right(c, F.lit(2))).alias("suffix2"),
        F.lower(F.right(c, F.lit(3))).alias("suffix3"),
        (F.upper(c) == c).alias("is_upper"),
        c.rlike(r"^\p{Lu}[^\p{Lu}]*$").alias("is_title"),
        c.rlike(r"^\d+$").alias("is_digit"),
        c.rlike(r"^\p{L}+$").alias("is_alpha"),
        c.rlike(r"\d").alias("has_digit"),
        has_latin(c).alias("has_latin"),
        has_cyrillic(c).alias("has_cyrillic"),
        F.least(F.length(c), F.lit(20)).alias("size"),
    )


def title_phrases(c: Column) -> Column:
    """Two or more capitalised words in a row."""
    return F.regexp_extract_all(c, F.lit(r"(?U)\b([A-ZА-ЯЁ][a-zа-яё]+(?:\s+[A-ZА-ЯЁ][a-zа-яё]+)+)\b"), F.lit(1))


def holds_phrase(text: Column, phrase: Column) -> Column:
    """Whether the words of ``phrase`` stand in ``text`` between word borders."""
    return F.concat(F.lit(" "), F.regexp_replace(text, r"(?U)[^\w]+", " "), F.lit(" ")).contains(F.concat(F.lit(" "), F.regexp_replace(phrase, r"(?U)[^\w]+", " "), F.lit(" ")))


def ngrams(words: Column, most: int) -> Column:
    """``(phrase, n, pos)`` of all runs of one to ``most`` words."""

    def of(n: int) -> Column:
        last = F.size(words) - n
        return F.transform(
            F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>")),
            lambda i: F.struct(F.array_join(F.slice(words, i + 1, n), " ").alias("phrase"), F.lit(n).alias("n"), i.cast("int").alias("pos")),
        )

    return F.flatten(F.array(*[of(n) for n in range(1, most + 1)]))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; 0 for two empty arrays."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))


def masked(text: Column, spans: Column, placeholder: Column | str) -> Column:
    """``text`` with the [start, end) spans replaced from the right, then single spaces."""
    mark = F.lit(placeholder) if isinstance(placeholder, str) else placeholder
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))), asc=False)
    out = F.aggregate(ordered, text, lambda t, s: F.concat(F.substring(t, F.lit(1), s["start"]), mark, F.substring(t, s["end"] + 1, F.length(t))))
    return spaced(out)


def text_size(c: Column) -> Column:
    """Characters; 0 for null."""
    return F.coalesce(F.length(c), F.lit(0))
