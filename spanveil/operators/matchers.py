"""Matchers: from a rule to ranges (start, end, target_start, target_end) in code points of a text.

A text is first turned into units, one for each grapheme that counts: its value as the rule sees it, its source range, the
class of change it took and how many ignored graphemes stand before it. Dictionaries then run as one Aho-Corasick
automaton over units: every distinct unit value of the terms is given a character, so a text becomes a string of one
character a unit, and all overlapping occurrences come out of a single pass, whatever the dictionary's size.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import regex

from spanveil.functions.patterns import STAND_IN, compiled
from spanveil.functions.unicode import fold, fold_plain, fold_sources, graphemes, in_word, normal, plain
from spanveil.operators.rules import Changes, LocaleWord, Rule, folded

Found = tuple[int, int, int, int]
_UNKNOWN = chr(0xFFFF)
_FIRST = 0xF0000  # private use characters stand for unit values


class Unit(NamedTuple):
    value: str
    start: int
    end: int
    change: str | None = None  # class of the change, if any
    skipped: int = 0  # ignored graphemes just before


class Text:
    """A text with what its scans share: graphemes and units by normal form."""

    def __init__(self, source: str):
        self.source = source
        self.plain = plain(source)
        self._ranges: list | None = None
        self._units: dict = {}

    @property
    def ranges(self) -> list[tuple[int, int]]:
        if self._ranges is None:
            self._ranges = graphemes(self.source)
        return self._ranges

    def units(self, form: str, changes: Changes | None = None, key=None) -> list[Unit]:
        if (form, key) not in self._units:
            self._units[form, key] = self._made(form, changes)
        return self._units[form, key]

    def _made(self, form: str, changes: Changes | None) -> list[Unit]:
        source = self.source
        if changes is None:
            if self.plain and form in ("none", "NFC"):
                return [Unit(source[a:b], a, b) for a, b in self.ranges]
            return [Unit(normal(source[a:b], form), a, b) for a, b in self.ranges]
        out, skipped = [], 0
        for a, b in self.ranges:
            value = normal(source[a:b], form)
            if value in changes.ignored:
                skipped += 1
                continue
            canonical = changes.sources.get(value)
            out.append(Unit(value if canonical is None else canonical, a, b, changes.classes.get(value), skipped))
            skipped = 0
        return out


@lru_cache(maxsize=64)
def _word_pattern():
    return regex.compile(r"(?w)\b")


def _word_edges(text: str, boundary: LocaleWord) -> set[int]:
    """Offsets at the ends of word-like segments: default word boundaries, tailored for no locale."""
    cuts = [m.start() for m in _word_pattern().finditer(text)]
    cuts = sorted({0, len(text), *cuts})
    out: set[int] = set()
    for a, b in zip(cuts, cuts[1:], strict=False):
        if any(in_word(c) and not c == "_" for c in text[a:b]):
            out |= {a, b}
    return out


class Boundary:
    """Whether units i..j stand as a word among ``units``, judged on their values, not on the source."""

    def __init__(self, units: list[Unit], kind):
        self.units, self.kind = units, kind
        if isinstance(kind, LocaleWord):
            self.at, n = [0], 0
            for u in units:
                n += len(u.value)
                self.at.append(n)
            self.words = _word_edges("".join(u.value for u in units), kind)

    def accepts(self, i: int, j: int) -> bool:
        if self.kind == "substring":
            return True
        if isinstance(self.kind, LocaleWord):
            return self.at[i] in self.words and self.at[j + 1] in self.words
        units = self.units
        return not (i > 0 and units[i - 1].value and in_word(units[i - 1].value[-1])) and not (j + 1 < len(units) and units[j + 1].value and in_word(units[j + 1].value[0]))


class Dictionary:
    """All occurrences of terms, given as unit values, in a list of units; longest first at each end."""

    def __init__(self, terms: list[tuple[str, ...]], case_sensitive: bool):
        self.key = (lambda v: v) if case_sensitive else fold
        self.chars: dict[str, str] = {}
        self.automaton = ahocorasick.Automaton()
        for term in terms:
            text = "".join(self.chars.setdefault(self.key(v), chr(_FIRST + len(self.chars))) for v in term)
            if text not in self.automaton:
                self.automaton.add_word(text, len(term))
        self.automaton.make_automaton()
        self.memo: dict[str, str] = {}

    def occurrences(self, units: list[Unit]) -> Iterator[tuple[int, int]]:
        """(first, last) unit of each occurrence, by last unit, longest first."""
        memo = self.memo
        if len(memo) > 100_000:
            memo.clear()
        text = []
        for u in units:
            c = memo.get(u.value)
            if c is None:
                c = memo[u.value] = self.chars.get(self.key(u.value), _UNKNOWN)
            text.append(c)
        at, group = -1, []
        for end, n in self.automaton.iter("".join(text)):
            if end != at:
                yield from sorted(group)
                at, group = end, []
            group.append((end - n + 1, end))
        yield from sorted(group)


class RegexMatcher:
    def __init__(self, rule: Rule):
        self.scan, self.rule, self.group = compiled(rule.spec["pattern"], rule.spec["flags"], rule.id), rule, rule.spec["group"]
        mentions = any(c in rule.spec["pattern"] for c in "İı")
        self.mask = "i" in rule.spec["flags"] and not mentions

    def find(self, text: Text) -> Iterator[Found]:
        source = text.source
        if self.mask and not source.isascii():
            source = source.replace("İ", STAND_IN).replace("ı", STAND_IN)
        for m in self.scan.finditer(source):
            start, end = m.span()
            if start == end:
                continue
            target = (start, end)
            if self.group is not None:
                target = m.span(self.group)
                if target[0] < 0:
                    raise ValueError(f'Rule "{self.rule.name}" matched without its target group "{self.group}".')
                if target[0] == target[1]:
                    raise ValueError(f'Rule "{self.rule.name}" matched with an empty target.')
            yield start, end, *target


class CustomMatcher:
    def __init__(self, rule: Rule):
        self.rule, self.call = rule, rule.spec["find"]

    def find(self, text: Text) -> Iterator[Found]:
        n = len(text.source)
        for got in self.call(text.source):
            got = tuple(got)
            start, end = got[:2]
            target = got[2:4]
            if len(target) == 1 or (len(target) == 2 and (target[0] is None) != (target[1] is None)):
                raise ValueError(f'Rule "{self.rule.name}" returned half a target.')
            if len(target) == 0 or target[0] is None:
                target = (start, end)
            if not all(isinstance(x, int) and not isinstance(x, bool) for x in (start, end, *target)):
                raise ValueError(f'Rule "{self.rule.name}" returned offsets that are not integers.')
            if not 0 <= start < end <= n:
                raise ValueError(f'Rule "{self.rule.name}" returned an empty or out-of-bounds match [{start}, {end}).')
            if not start <= target[0] < target[1] <= end:
                raise ValueError(f'Rule "{self.rule.name}" returned a target outside its match.')
            yield start, end, *target


def direct(automaton, source: str, value: str, boundary: str) -> Iterator[Found]:
    """Occurrences in a text of one character a grapheme, given as it is and as the automaton compares it."""
    if not len(automaton):
        return
    whole, n, at, group = boundary == "substring", len(source), -1, []
    for end, size in automaton.iter(value):
        start = end - size + 1
        if not whole and (start and in_word(source[start - 1]) or end + 1 < n and in_word(source[end + 1])):
            continue
        if end != at:
            yield from sorted(group)
            at, group = end, []
        group.append((start, end + 1, start, end + 1))
    yield from sorted(group)


class TermMatcher:
    def __init__(self, rule: Rule):
        s = rule.spec
        self.form, self.boundary = s["normalization"], s["boundary"]
        split = lambda t: tuple(t[a:b] for a, b in graphemes(t))
        self.terms = Dictionary([split(t) for t in s["terms"]], s["case_sensitive"])
        # plain texts can only hold terms that are plain once folded; these run over the text's own characters
        self.fold = (lambda t: t) if s["case_sensitive"] else fold_plain
        self.direct = ahocorasick.Automaton()
        for t in s["terms"]:
            t = folded(t, s["case_sensitive"])
            if plain(t):
                self.direct.add_word(t, len(t))
        self.direct.make_automaton()
        self.direct_use = self.form in ("none", "NFC") and self.boundary in ("word", "unicode-word", "substring")

    def find(self, text: Text) -> Iterator[Found]:
        if self.direct_use and text.plain and (value := self.fold(text.source)) is not None:
            yield from direct(self.direct, text.source, value, self.boundary)
            return
        units = text.units(self.form)
        edge = Boundary(units, self.boundary)
        for i, j in self.terms.occurrences(units):
            if edge.accepts(i, j):
                yield units[i].start, units[j].end, units[i].start, units[j].end


_TURKIC = str.maketrans({"I": "ı", "İ": "i"})


def cased(value: str, casing) -> str:
    if casing in ("sensitive", "unicode-insensitive"):
        return value
    return (value.translate(_TURKIC) if casing[1].split("-")[0].lower() in ("tr", "az") else value).lower()


def shadow(source: str, transform, form: str = "NFC", casing="sensitive") -> list[tuple[str, str, int, int, int, int]]:
    """(source, value, source start and end, value start and end) of each grapheme under a transform."""
    one, out, at = shadow_of(transform, form, casing), [], 0
    for a, b in graphemes(source):
        value = one(source[a:b])
        out.append((source[a:b], value, a, b, at, at + len(value)))
        at += len(value)
    return out


def shadow_of(transform, form: str, casing):
    """A function from a grapheme to its shadow."""

    def one(grapheme: str) -> str:
        value = transform(normal(grapheme, form))
        if not isinstance(value, str):
            raise TypeError("a transform must return a string.")
        return cased(value, casing)

    return one


class _Shadows(dict):
    """The shadows of graphemes, by grapheme and, for ``str.translate``, by code point; a transform sees each once."""

    MOST = 200_000

    def __init__(self, one):
        super().__init__()
        self.one = one
        self.uneven = ""  # characters whose shadow is not one character

    def __missing__(self, key):
        c = chr(key) if isinstance(key, int) else key
        value = self.one(c)
        if len(self) >= self.MOST:
            self.clear()
        self[key] = value
        if isinstance(key, int) and len(value) != 1 and c not in self.uneven:
            self.uneven += c
        return value


class TransformedMatcher:
    """Terms met in the shadow of a text. A transform is a pure function of a grapheme, so its values are kept.

    A text of one character a grapheme whose shadow is such a text too, character for character, is searched as it
    stands; another one is taken apart only if a term stands anywhere in its shadow.
    """

    def __init__(self, rule: Rule):
        s = self.spec = rule.spec
        sensitive = s["casing"] != "unicode-insensitive"
        self.key = (lambda v: v) if sensitive else fold
        self.plain_key = (lambda v: v) if sensitive else fold_plain
        self.shadows = _Shadows(shadow_of(s["transform"], s["normalization"], s["casing"]))
        values = ["".join(self.shadows[t[a:b]] for a, b in graphemes(t)) for t in s["terms"]]
        values = [v for v in values if v]
        if not values:
            raise ValueError("A rule needs at least one term that its transform leaves.")
        self.terms = Dictionary([tuple(v[a:b] for a, b in graphemes(v)) for v in values], sensitive)
        self.direct, self.worth = ahocorasick.Automaton(), ahocorasick.Automaton()
        for v in map(self.key, values):
            self.worth.add_word(v, len(v))
            if plain(v):
                self.direct.add_word(v, len(v))
        self.worth.make_automaton()
        self.direct.make_automaton()
        self.direct_use = not isinstance(s["boundary"], LocaleWord)

    def find(self, text: Text) -> Iterator[Found]:
        source, boundary = text.source, self.spec["boundary"]
        if self.direct_use and text.plain:
            value = source.translate(self.shadows)
            even = len(value) == len(source) and not any(c in source for c in self.shadows.uneven)
            if even and plain(value) and (key := self.plain_key(value)) is not None:
                yield from direct(self.direct, value, key, boundary)
                return
        values = [self.shadows[source[a:b]] for a, b in text.ranges]
        value = "".join(values)
        if next(self.worth.iter(self.key(value)), None) is None:
            return
        starts, ends, at = {}, {}, 0
        for (a, b), v in zip(text.ranges, values, strict=True):
            if v:
                starts[at], ends[at + len(v)] = a, b
                at += len(v)
        units = [Unit(value[a:b], a, b) for a, b in graphemes(value)]
        edge = Boundary(units, boundary)
        for i, j in self.terms.occurrences(units):
            a, b = units[i].start, units[j].end
            if a in starts and b in ends and edge.accepts(i, j):
                yield starts[a], ends[b], starts[a], ends[b]


def _spent(units: list[Unit], i: int, j: int) -> dict[str, int]:
    """Changes by class of units i..j; what was ignored before the first of them is free."""
    out = {"substitution": 0, "width": 0, "confusable": 0, "ignored": 0}
    for k in range(i, j + 1):
        if units[k].change:
            out[units[k].change] += 1
        if k > i:
            out["ignored"] += units[k].skipped
    return out


def _superset(spec: dict, repeats: bool):
    """A search for what any candidate of the entries looks like in the source, or None where that is not one pattern.

    Each unit is one of the characters that fold to it or stand for it, with ignored ones between. It only decides
    whether a text is worth the full scan, so it may find too much, never too little.
    """
    changes: Changes = spec["changes"]
    single = lambda v: len(v) == 1 and unicodedata.normalize("NFD", v) == v
    if spec["normalization"] not in ("none", "NFC") or not all(map(single, [*changes.sources, *changes.sources.values(), *changes.ignored])):
        return None
    key = (lambda v: v) if spec["case_sensitive"] else fold
    stands: dict[str, str] = {}
    for source, canonical in changes.sources.items():
        stands[key(canonical)] = stands.get(key(canonical), "") + source
    escape = lambda cs: "".join("\\" + c if c in "\\]^-[&~|" else c for c in dict.fromkeys(cs))
    skip = f"[{escape(changes.ignored)}]*" if changes.ignored else ""
    options = set()
    for e in spec["entries"]:
        if not all(map(single, e.units)):
            return None
        made = ""
        for value, _, least, letter in e.runs:
            chars = (value + stands.get(value, "")) if spec["case_sensitive"] else fold_sources().get(key(value), value) + stands.get(key(value), "")
            made += f"(?:[{escape(chars)}]{skip}){{{least},{'' if letter and repeats else least}}}"
        options.add(made)
    # an option that begins with another is found with it
    kept = [o for o in options if not any(o != p and o.startswith(p) for p in options)]
    return re.compile("|".join(sorted(kept))).search


class ObfuscatedMatcher:
    """All occurrences on the changed units, within budgets and with one change at least; targets if entries have them."""

    def __init__(self, rule: Rule):
        s = self.spec = rule.spec
        self.targeted = rule.kind == "targeted"
        groups = [[e] for e in s["entries"]] if self.targeted else [s["entries"]]
        self.parts = [(g[0], Dictionary([e.units for e in g], s["case_sensitive"])) for g in groups]
        self.worth = _superset(s, False)

    def find(self, text: Text) -> Iterator[Found]:
        if self.worth is not None and self.worth(text.source) is None:
            return
        s, seen = self.spec, set()
        changes: Changes = s["changes"]
        units = text.units(s["normalization"], changes, id(self))
        edge = Boundary(units, s["boundary"])
        limits = changes.limits
        for entry, terms in self.parts:
            for i, j in terms.occurrences(units):
                spent = _spent(units, i, j)
                total = spent["substitution"] + spent["ignored"]
                if not 0 < total <= limits["all"] or spent["substitution"] > limits["substitution"] or spent["ignored"] > limits["ignored"] or not edge.accepts(i, j):
                    continue
                a, b = entry.target if self.targeted else (0, j - i + 1)
                found = (units[i].start, units[j].end, units[i + a].start, units[i + b - 1].end)
                if found not in seen:
                    seen.add(found)
                    yield found


class RepeatedMatcher:
    """Leftmost occurrences without overlap; a run of a letter takes all that follow, and what exceeds it is repetition."""

    def __init__(self, rule: Rule):
        self.spec = rule.spec
        self.key = (lambda v: v) if rule.spec["case_sensitive"] else fold
        self.first: dict[str, list] = {}
        for e in rule.spec["entries"]:
            runs = [(self.key(v), first, n, letter) for v, first, n, letter in e.runs]
            self.first.setdefault(runs[0][0], []).append((e, runs))
        self.worth = _superset(rule.spec, True)

    def find(self, text: Text) -> Iterator[Found]:
        if self.worth is not None and self.worth(text.source) is None:
            return
        s = self.spec
        changes: Changes = s["changes"]
        limits, classes = changes.limits, ("substitution", "width", "confusable")
        mapped = sum(limits[c] for c in classes)
        units = text.units(s["normalization"], changes, id(self))
        keys = [self.key(u.value) for u in units]
        edge, n, i = Boundary(units, s["boundary"]), len(units), 0
        lengths = _run_lengths(keys)
        while i < n:
            taken = None
            for entry, runs in self.first.get(keys[i], ()):
                got = self._attempt(keys, lengths, i, entry, runs)
                if got is None:
                    continue
                last, repeats, a, b = got
                spent = _spent(units, i, last)
                changed = sum(spent[c] for c in classes)
                total = changed + spent["ignored"] + repeats
                if 0 < total <= limits["all"] and changed <= mapped and spent["ignored"] <= limits["ignored"] and repeats <= limits["repetition"] and edge.accepts(i, last):
                    taken = (last, a, b, spent)
                    break
            if taken is None:
                i += 1
                continue
            last, a, b, spent = taken
            # a candidate over a class's own budget is dropped, but the scan has moved past it
            if all(spent[c] <= limits[c] for c in classes):
                yield units[i].start, units[last].end, units[a].start, units[b].end
            i = last + 1

    @staticmethod
    def _attempt(keys, lengths, i, entry, runs) -> tuple[int, int, int, int] | None:
        """(last unit, repetitions, first and last target unit) if the runs stand at unit i."""
        at, repeats, a, b = i, 0, -1, -1
        for key, first, least, letter in runs:
            if at >= len(keys) or keys[at] != key or lengths[at] < least:
                return None
            used = lengths[at] if letter else least
            repeats += used - least
            if first <= entry.target[0] < first + least:
                a = at + entry.target[0] - first
            final = entry.target[1] - 1
            if first <= final < first + least:
                b = at + used - 1 if letter and final == first + least - 1 else at + final - first
            at += used
        return at - 1, repeats, a, b


def _run_lengths(keys: list[str]) -> list[int]:
    """For each place, how many equal keys stand from there on."""
    out = [1] * len(keys)
    for i in range(len(keys) - 2, -1, -1):
        if keys[i] == keys[i + 1]:
            out[i] = out[i + 1] + 1
    return out


KINDS = {"regex": RegexMatcher, "matcher": CustomMatcher, "terms": TermMatcher, "transformed": TransformedMatcher, "obfuscated": ObfuscatedMatcher, "targeted": ObfuscatedMatcher, "repeated": RepeatedMatcher, "width": RepeatedMatcher, "confusable": RepeatedMatcher}
