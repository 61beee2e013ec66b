"""The engine: ordered rules over text columns.

Match, target, cover, output. Matching needs graphemes and dictionaries, so it is one Arrow UDF for all rules together; it
returns an array of matches. Covering by presets, merging, partitioning, masking and splicing are built-in expressions over
that array (``expr``), or part of the UDF where a coverage is a callable. Null texts give nulls.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from spanveil.functions.unicode import edges, graphemes, utf16_offsets
from spanveil.operators.matchers import KINDS, Text
from spanveil.operators.rules import PRESETS, Rule, rank_of

#: Terms up to which a built-in condition is cheaper than sending a text to Python.
MOST_TESTS = 32
MATCH = "struct<rule_id:string,pack_id:string,profile:string,text:string,start:int,end:int,target_text:string,target_start:int,target_end:int>"
SEGMENT = "struct<text:string,covered:boolean,rule_ids:array<string>,start:int,end:int>"
_match_type = pa.struct([("rule_id", pa.string()), ("pack_id", pa.string()), ("profile", pa.string()), ("text", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("target_text", pa.string()), ("target_start", pa.int32()), ("target_end", pa.int32())])
_segment_type = pa.struct([("text", pa.string()), ("covered", pa.bool_()), ("rule_ids", pa.list_(pa.string())), ("start", pa.int32()), ("end", pa.int32())])


def preset_ranges(name: str, value: str) -> list[tuple[int, int]]:
    """The part of a target that a preset covers; targets too short for it are covered whole."""
    n = len(value)
    if name == "full" or not n:
        return [(0, n)] if n else []
    g = graphemes(value)
    k = len(g)
    first, last = {"tail": (1, k - 1), "inner": (1, k - 2), "middle": ((k - -(-k // 2)) // 2, (k - -(-k // 2)) // 2 + -(-k // 2) - 1)}[name]
    return [(g[first][0], g[last][1])] if k > 1 and last >= first else [(0, n)]


def vowels(context: dict) -> list[tuple[int, int]]:
    """Graphemes of a target whose base letter is a, e, i, o or u."""
    import unicodedata

    value = context["target_text"]
    base = lambda g: "".join(c for c in unicodedata.normalize("NFD", g) if unicodedata.category(c)[0] != "M")
    return [(a, b) for a, b in graphemes(value) if any(c in "aeiouAEIOU" for c in base(value[a:b]))]


def aligned(ranges: Iterable[tuple], value: str) -> list[tuple[int, int]]:
    """A callable's ranges, cut to the target, without empty and non-finite ones, widened to whole graphemes, in order."""
    g, out = graphemes(value), []
    for a, b in ranges:
        if not all(isinstance(x, (int, float)) and x == x and abs(x) != float("inf") for x in (a, b)):
            continue
        a, b = (max(0, min(len(value), int(x))) for x in (a, b))
        inside = [r for r in g if r[1] > a and r[0] < b]
        if a < b and inside:
            out.append((inside[0][0], inside[-1][1]))
    return sorted(out)


class Engine:
    """Compiled rules. It pickles as its rules, and prepares matchers once in each process."""

    def __init__(self, rules: Iterable[Rule] = (), coverage="full"):
        self.rules, self.coverage = list(rules), coverage
        if isinstance(coverage, str) and coverage not in PRESETS:
            raise ValueError(f"unknown coverage {coverage!r}")
        for rule in self.rules:
            KINDS[rule.kind](rule)  # fail where the engine is made, not on an executor
        self._rank, self._ready = rank_of(self.rules), None

    def __getstate__(self):
        return self.__dict__ | {"_ready": None}

    def _matchers(self):
        if self._ready is None:
            self._ready = [KINDS[r.kind](r) for r in self.rules]
        return self._ready

    # one text

    def scan(self, text: str) -> list[tuple[int, int, int, int, int]]:
        """(rule, start, end, target start, target end) in code points: by start, longer first, then pack and rule."""
        if not text or not self.rules:
            return []
        shared, found, cuts = Text(text), [], None
        for k, matcher in enumerate(self._matchers()):
            for got in matcher.find(shared):
                if self.rules[k].kind in ("regex", "matcher"):
                    cuts = edges(text) if cuts is None else cuts
                    for what, a, b in (("match", got[0], got[1]), ("target", got[2], got[3])):
                        if a not in cuts or b not in cuts:
                            raise ValueError(f'Rule "{self.rules[k].name}" produced a {what} range [{a}, {b}) that splits an extended grapheme cluster.')
                found.append((k, *got))
        return sorted(found, key=lambda m: (m[1], -m[2], self._rank[m[0]]))

    def covers(self, text: str, matches: list[tuple]) -> list[tuple[int, int, str]]:
        """(start, end, rule id) that each match's coverage selects of its target, in order."""
        out = []
        for k, start, end, a, b in matches:
            rule, target = self.rules[k], text[a:b]
            chosen = rule.coverage or self.coverage
            if isinstance(chosen, str):
                ranges = preset_ranges(chosen, target)
            else:
                context = {"rule_id": rule.id, "pack_id": rule.pack_id, "profile": rule.profile, "match_text": text[start:end], "target_text": target, "match_start": start, "match_end": end, "target_start": a, "target_end": b}
                ranges = aligned(chosen(context), target)
            out += [(a + s, a + e, rule.id) for s, e in ranges]
        return sorted(out, key=lambda r: (r[0], -r[1]))

    def find(self, text: str) -> list[dict]:
        at = utf16_offsets(text)
        return [self._match(text, at, m) for m in self.scan(text)]

    def _match(self, text, at, m) -> dict:
        k, start, end, a, b = m
        r = self.rules[k]
        return {"rule_id": r.id, "pack_id": r.pack_id or None, "profile": r.profile or None, "text": text[start:end], "start": at(start), "end": at(end), "target_text": text[a:b], "target_start": at(a), "target_end": at(b)}

    def segment(self, text: str) -> list[dict]:
        """An exact partition of the text into covered and plain parts; one empty plain part for an empty text."""
        return partition(text, merged(self.covers(text, self.scan(text))))

    # columns

    def may_match(self, text: Column) -> Column | None:
        """A built-in condition that every text with a match meets; None where the rules give none.

        For dictionaries of ASCII terms: that one of them is in the lower-cased text, or the one letter outside ASCII
        that folds into it without a lower case there. Case-sensitive terms must be in the text itself.
        """
        tests = []
        for rule in self.rules:
            s = rule.spec
            if rule.kind != "terms" or s["normalization"] not in ("none", "NFC") or len(s["terms"]) > MOST_TESTS or not all(t.isascii() and not set(t) & set(";`") for t in s["terms"]):
                return None
            if s["case_sensitive"]:
                tests += [F.contains(text, F.lit(t)) | F.contains(text, F.lit(chr(0x212A))) for t in s["terms"]]
            else:
                tests += [F.contains(F.lower(text), F.lit(t.lower())) for t in s["terms"]] + [F.contains(text, F.lit(chr(0x17F)))]
        out = F.lit(False)
        for t in tests:
            out = out | t
        return out

    def _column(self, fn: Callable, kind: str, arrow: pa.DataType, text: Column) -> Column:
        """``fn`` of each text. Marked as not deterministic, though it is: else the optimizer copies it into the filters
        that it infers from explodes and pushes down, and every text is matched twice. Filter rows before matching."""
        engine = self

        @F.arrow_udf(kind)
        def run(texts: pa.Array) -> pa.Array:
            return pa.array([None if t is None else fn(engine, t) for t in texts.to_pylist()], arrow)

        return run.asNondeterministic()(text)

    def find_column(self, text: Column) -> Column:
        """array<MATCH> of each text."""
        worth = self.may_match(text)
        some = text if worth is None else F.when(text.isNull() | worth, text).otherwise("")  # others don't leave the JVM
        return self._column(lambda e, t: e.find(t), f"array<{MATCH}>", pa.list_(_match_type), some)

    def segment_column(self, text: Column) -> Column:
        """array<SEGMENT> of each text; needed for callable coverages, else ``expr.segments`` gives the same from matches."""
        return self._column(lambda e, t: e.segment(t), f"array<{SEGMENT}>", pa.list_(_segment_type), text)

    def find_and_segment(self, text: Column) -> Column:
        """struct<matches, segments> in one pass."""
        both = pa.struct([("matches", pa.list_(_match_type)), ("segments", pa.list_(_segment_type))])

        def run(e: Engine, t: str) -> dict:
            found, at = e.scan(t), utf16_offsets(t)
            return {"matches": [e._match(t, at, m) for m in found], "segments": partition(t, merged(e.covers(t, found)))}

        return self._column(run, f"struct<matches:array<{MATCH}>,segments:array<{SEGMENT}>>", both, text)

    def sanitize_column(self, text: Column, replacement: str | None = None, scope: str = "target", verify: bool = False) -> Column:
        from spanveil.operators.sanitize import REPORT, report_type, sanitize

        return self._column(lambda e, t: sanitize(e, t, replacement, scope, verify), REPORT, report_type, text)


def merged(ranges: list[tuple[int, int, str]]) -> list[tuple[int, int, list[str]]]:
    """Union of overlapping ranges; ranges that only touch stay apart. Ids keep the order they came in."""
    out: list[list] = []
    for a, b, rule in ranges:
        if out and a < out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
            if rule not in out[-1][2]:
                out[-1][2].append(rule)
        else:
            out.append([a, b, [rule]])
    return [tuple(x) for x in out]


def partition(text: str, covered: list[tuple[int, int, list[str]]]) -> list[dict]:
    at = utf16_offsets(text)
    cuts = list(itertools.chain([(0, 0, [])], covered, [(len(text), len(text), [])]))
    out = []
    for (_, end, _), (start, stop, rules) in zip(cuts, cuts[1:], strict=False):
        if start > end:
            out.append({"text": text[end:start], "covered": False, "rule_ids": [], "start": at(end), "end": at(start)})
        if stop > start:
            out.append({"text": text[start:stop], "covered": True, "rule_ids": rules, "start": at(start), "end": at(stop)})
    return out or [{"text": text, "covered": False, "rule_ids": [], "start": 0, "end": at(len(text))}]
