"""Splitting text into the pieces that byte-level BPE merges within.

The pattern is that of the rank files. Three routes give the same pieces: the standard library's matcher with spelt
out classes for texts in the Latin blocks, the ``regex`` module for all other assigned characters, and, where a text
holds code points on whose class Unicode versions disagree, the same on a copy in which each of them is replaced by a
character of the class that the caller's tokenizer library gives it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import regex

LATIN_END = 0x24F


def _ranges(category: str) -> str:
    out: list[list[int]] = []
    for cp in range(LATIN_END + 1):
        if unicodedata.category(chr(cp)).startswith(category):
            if out and out[-1][1] == cp - 1:
                out[-1][1] = cp
            else:
                out.append([cp, cp])
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in out)


@lru_cache(maxsize=1)
def _matchers():
    letter, number, space = _ranges("L"), _ranges("N"), r" \t-\r\x85\xa0"
    latin = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")
    wide = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    return latin.findall, re.compile(f"[^\x00-{chr(LATIN_END)}]").search, wide.findall


@lru_cache(maxsize=65536)
def _settled(char: str) -> bool:
    """Whether the class of ``char`` is the same in all Unicode versions since it was assigned."""
    return unicodedata.category(char) != "Cn" and regex.match(r"\p{L}", char) is not None if unicodedata.category(char)[0] == "L" else unicodedata.category(char) != "Cn" and regex.match(r"\p{L}", char) is None


#: Of each class of the pattern, what stands in for its characters: none is in a spelt-out alternative.
STAND_INS = {r"\p{L}": "\u0101", r"\p{N}": "0", r"\s": "\u2003"}
OTHER = "*"


def pieces(text: str, stand_in: Callable[[str], str] | None = None) -> list[str] | None:
    """The pieces in order; None if the classes of its characters are not settled and no ``stand_in`` settles them."""
    latin, beyond, wide = _matchers()
    if beyond(text) is None:
        return latin(text)
    if all(map(_settled, {c for c in text if ord(c) > LATIN_END})):
        return wide(text)
    if stand_in is None:
        return None
    unsettled = {ord(c): stand_in(c) for c in set(text) if ord(c) > LATIN_END and not _settled(c)}
    out, at = [], 0
    for piece in wide(text.translate(unsettled)):
        out.append(text[at : at + len(piece)])
        at += len(piece)
    return out
