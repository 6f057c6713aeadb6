"""Characters that look alike: tables and the plain form of a text.

The tables that follow a rule are built from Python's Unicode database; those that don't are written out.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import regex

# Characters that show nothing.
INVISIBLE = [0x00AD, 0x034F, 0x061C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0x3164, *range(0xFE00, 0xFE10), 0xFEFF, 0xFFA0]

# Hyphens besides the hyphen-minus.
HYPHENS = [0x2010, 0x2011, 0x2012, 0x2212, 0xFE63, 0xFF0D]

# Cyrillic letters, and the Latin letters that look like them.
CYRILLIC_LATIN = dict(zip("асеорхуіѕјһԁԛԝѵАВСЕНКМОРТХУІЅЈҺԀԚԜѴкмтвнгп", "aceopxyisjhdqwvABCEHKMOPTXYISJHDQWVkmtbhrn", strict=True))
#: The part of it that a writer of the other alphabet could mistake; the rest is a likeness of capitals only.
_CLOSE = "асеорхуіѕјһԁԛԝѵАВСЕНКМОРТХУІЅЈҺԀԚԜѴк"
TO_LATIN = {c: CYRILLIC_LATIN[c] for c in _CLOSE}
TO_CYRILLIC = {v: k for k, v in TO_LATIN.items() if k not in "іѕјһԁԛԝѵІЅЈҺԀԚԜѴ"}

# Greek letters, and the Latin and Cyrillic letters that look like them.
GREEK_LATIN = dict(zip("ορανικυχγτεΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "opavikuxyteABEZHIKMNOPTYX", strict=True))
GREEK_CYRILLIC = dict(zip("οραντεκυχγπΑΒΕΗΚΜΟΡΤΥΧΓΠ", "оравтекихупАВЕНКМОРТУХГП", strict=True))
GREEK_CYRILLIC["ν"], GREEK_CYRILLIC["υ"], GREEK_CYRILLIC["γ"] = "у", "у", "у"

SPACES = [0x00A0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]

_SINGLE = {**dict.fromkeys(INVISIBLE, ""), **dict.fromkeys(HYPHENS, "-"), **dict.fromkeys(SPACES, " ")}
#: A word: letters with their combining marks.
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_ODD = re.compile("[" + "".join(map(re.escape, map(chr, _SINGLE))) + "]")
_L, _G, _C = "A-Za-z\u00c0-\u024f\u1e00-\u1eff", "\u0370-\u03ff\u1f00-\u1fff", "\u0400-\u0482\u048a-\u052f"
#: Letters of two alphabets side by side, or a mark or a letter outside the usual blocks, behind which two may hide.
_MIXED = re.compile(f"[{_L}][{_G}{_C}]|[{_G}{_C}][{_L}]|[{_G}][{_C}]|[{_C}][{_G}]|[\u0300-\u036f\u0483-\u0489]|[^\\x00-\u052f\u1e00-\u1fff\u2000-\u2bff]")


@lru_cache(maxsize=200_000)
def script(letter: str) -> str:
    """``L``atin, ``C``yrillic, ``G``reek or '' of a letter."""
    name = unicodedata.name(letter, "")
    return {"LATIN": "L", "CYRILLIC": "C", "GREEK": "G"}.get(name.split(" ")[0], "")


def one_alphabet(word: str) -> str:
    """A run of decomposed letters in the alphabet of most of them; on a tie, of those without a look-alike, else Cyrillic."""
    latin = sum(script(c) == "L" for c in word)
    cyrillic = sum(script(c) == "C" for c in word)
    greek = sum(script(c) == "G" for c in word)
    if (latin > 0) + (cyrillic > 0) + (greek > 0) < 2 or not latin + cyrillic:
        return word
    if latin == cyrillic:
        own = sum(script(c) == "L" and c not in TO_CYRILLIC for c in word) - sum(script(c) == "C" and c not in TO_LATIN for c in word)
        to_latin = own > 0
    else:
        to_latin = latin > cyrillic
    table = {**GREEK_LATIN, **TO_LATIN} if to_latin else {**GREEK_CYRILLIC, **TO_CYRILLIC}
    return "".join(table.get(c, c) for c in word)


def plain(text: str | None) -> str:
    """``text`` in ordinary characters: nothing invisible, plain spaces and hyphens, composed, each word in one alphabet."""
    if not text:
        return ""
    if text.isascii():
        return text
    out = text
    if _ODD.search(text) or not unicodedata.is_normalized("NFKC", text):
        out = unicodedata.normalize("NFKC", text.translate(_SINGLE)).translate(_SINGLE)
    if not _MIXED.search(out):
        return out
    apart = unicodedata.normalize("NFD", out)
    return unicodedata.normalize("NFC", _LETTERS.sub(lambda m: m.group() if m.group().isascii() else one_alphabet(m.group()), apart))


def fold(text: str | None) -> str:
    """The plain form in lower case without accents; ё is е; й stays."""
    out = unicodedata.normalize("NFD", plain(text).lower().replace("ё", "е").replace("й", "\0"))
    return "".join(c for c in out if not unicodedata.combining(c)).replace("\0", "й")
