"""Text units: extended graphemes, normal forms, simple case folding, word context and UTF-16 offsets.

Everything works in code points; ``utf16_offsets`` converts at the edge where results leave in UTF-16 code units.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from itertools import accumulate

import regex

_CLUSTER = regex.compile(r"\X")
_ASTRAL = re.compile("[\U00010000-\U0010ffff]")
_WORD_CATEGORIES = ("L", "N", "M")
#: What ECMAScript strips at the ends of a string.
_BLANKS = "\t\n\x0b\x0c\r \xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))


#: Characters from U+0300 on may combine with others; all before it are graphemes by themselves and in composed form.
_MAY_COMBINE = re.compile(f"[^{chr(0)}-{chr(0x2FF)}]|\r\n").search


def plain(text: str) -> bool:
    """Whether every code point of ``text`` is one grapheme, in every composed normal form itself."""
    return _MAY_COMBINE(text) is None


def graphemes(text: str) -> list[tuple[int, int]]:
    """Half-open ranges of the extended grapheme clusters, in order."""
    if plain(text):
        return [(i, i + 1) for i in range(len(text))]
    return [m.span() for m in _CLUSTER.finditer(text)]


def edges(text: str) -> set[int] | range:
    """All offsets at which a grapheme begins or ends, 0 and the end included."""
    if plain(text):
        return range(len(text) + 1)
    return {0, len(text), *(e for _, e in graphemes(text))}


def normal(value: str, form: str) -> str:
    return value if form == "none" or value.isascii() else unicodedata.normalize(form, value)


@lru_cache(maxsize=200_000)
def _fold_char(c: str) -> str:
    """One-to-one case folding: no expansions, and dotless or dotted i only match themselves."""
    if c in "İı":
        return c
    low = c.lower()
    if len(low) == 1 and low != c:
        return low
    up = c.upper()
    if len(up) == 1:
        back = up.lower()
        if len(back) == 1 and back != "i" or back == c:
            return back
    return c


def fold(value: str) -> str:
    return value.lower() if value.isascii() else "".join(map(_fold_char, value))


#: Plain characters whose folding is not their lower case.
_ODD = re.compile("[" + "".join(c for c in map(chr, range(0x80, 0x300)) if _fold_char(c) != c.lower()) + "]").search


def fold_plain(text: str) -> str | None:
    """``fold`` of a plain text in one call; None if one of its characters folds otherwise."""
    return text.lower() if _ODD(text) is None else None


@lru_cache(maxsize=1)
def fold_sources() -> dict[str, str]:
    """For each folded, composed character, all single characters that fold and compose to it."""
    out: dict[str, str] = {}
    for cp in range(0x20, 0x10000):
        if not 0xD800 <= cp <= 0xDFFF:
            c = chr(cp)
            out.setdefault(fold(unicodedata.normalize("NFC", c)), []).append(c)
    return {k: "".join(v) for k, v in out.items() if len(k) == 1}


@lru_cache(maxsize=200_000)
def in_word(c: str) -> bool:
    """Letters, numbers, marks, connector punctuation and the two zero-width joiners keep a word going."""
    category = unicodedata.category(c)
    return category[0] in _WORD_CATEGORIES or category == "Pc" or c in "\u200c\u200d"


def trim(value: str) -> str:
    return value.strip(_BLANKS)


def utf16_offsets(text: str):
    """A function from code point offsets to UTF-16 code unit offsets."""
    if _ASTRAL.search(text) is None:
        return lambda i: i
    at = [0, *accumulate(1 + (c > "\uffff") for c in text)]
    return at.__getitem__


def collation_key(value: str) -> tuple[str, str]:
    """An order of identifiers like that of a dictionary: letters first, then lower before upper case."""
    return value.casefold(), value.swapcase()
