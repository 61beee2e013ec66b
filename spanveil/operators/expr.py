"""What follows matching, as built-in expressions over arrays of matches, ranges and segments.

Offsets are UTF-16 code units, as the engine gives them. Spark's string functions count code points, which is the same in
texts without characters beyond U+FFFF; other texts are cut as UTF-16 bytes. Whether a text needs that is asked once a
row. Ranges are structs (start, end, rule_ids).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_RANGE = "array<struct<start:int,end:int,rule_ids:array<string>>>"
MASKS = ("asterisk", "grawlix", "scrawl", "bar", "blur", "whiteout", "mosaic")
GRAWLIX = "@#$%&!"  # fixed values: the signs of a grawlix, in their order


#: Characters beyond U+FFFF, and whatever may not be one grapheme a code point.
_WIDE, _COMPLEX = r"[\x{10000}-\x{10FFFF}]", r"[^\x{00}-\x{2FF}]|\r\n"


def units(text: Column) -> Column:
    """The length of ``text`` in UTF-16 code units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def _bytes_cut(raw: Column, a: Column, b: Column) -> Column:
    return F.decode(F.substring(raw, a * 2 + 1, (b - a) * 2), "UTF-16BE")


def cut(text: Column, a: Column, b: Column) -> Column:
    """The text between two UTF-16 offsets."""
    return F.when(text.rlike(_WIDE), _bytes_cut(F.encode(text, "UTF-16BE"), a, b)).otherwise(F.substring(text, a + 1, b - a))


def graphemes(text: Column) -> Column:
    """The extended grapheme clusters of ``text``."""
    return F.regexp_extract_all(text, F.lit(r"\X"), F.lit(0))


def n_graphemes(text: Column) -> Column:
    return F.when(text.rlike(_COMPLEX), F.size(graphemes(text))).otherwise(F.length(text))


def full_covers(matches: Column) -> Column:
    """One range per match: its whole target."""
    return F.transform(matches, lambda m: F.struct(m["target_start"].alias("start"), m["target_end"].alias("end"), F.array(m["rule_id"]).alias("rule_ids")))


def preset_covers(matches: Column, preset: str) -> Column:
    """Ranges of a preset, from grapheme to grapheme; targets too short for it are covered whole."""

    def place(n: Column) -> tuple[Column, Column]:
        """First and after the last grapheme covered of ``n``."""
        half = F.ceil(n / 2).cast("int")
        skip, size = {"full": (F.lit(0), n), "tail": (F.lit(1), n - 1), "inner": (F.lit(1), n - 2), "middle": (F.floor((n - half) / 2).cast("int"), half)}[preset]
        short = n <= {"full": 0, "tail": 1, "inner": 2, "middle": 1}[preset]
        first = F.when(short, 0).otherwise(skip)
        return first, first + F.when(short, n).otherwise(size)

    def complex_(m: Column) -> Column:
        def sized(sizes: Column) -> Column:
            upto = lambda k: F.aggregate(F.slice(sizes, 1, k), m["target_start"], lambda a, x: a + x)
            first, after = place(F.size(sizes))
            return F.struct(upto(first).alias("start"), upto(after).alias("end"))

        return F.get(F.transform(F.array(F.transform(graphemes(m["target_text"]), units)), sized), F.lit(0))

    def plain(m: Column) -> Column:
        first, after = place(m["target_end"] - m["target_start"])
        return F.struct((m["target_start"] + first).alias("start"), (m["target_start"] + after).alias("end"))

    def cover(m: Column) -> Column:
        at = plain(m) if preset == "full" else F.when(m["target_text"].rlike(_COMPLEX), complex_(m)).otherwise(plain(m))
        return F.struct(at["start"].alias("start"), at["end"].alias("end"), F.array(m["rule_id"]).alias("rule_ids"))

    return F.transform(matches, cover)


def _ordered(ranges: Column) -> Column:
    return F.array_sort(ranges, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))


def merge(ranges: Column, touching: bool = False) -> Column:
    """Overlapping ranges joined, with their rule ids in order; ranges that touch join only if ``touching``."""

    def step(out: Column, r: Column) -> Column:
        last = F.element_at(out, -1)
        near = r["start"] <= last["end"] if touching else r["start"] < last["end"]
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end"), F.array_union(last["rule_ids"], r["rule_ids"]).alias("rule_ids"))
        grown = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(joined))
        return F.when((F.size(out) > 0) & near, grown).otherwise(F.concat(out, F.array(r)))

    return F.aggregate(_ordered(ranges), F.array().cast(_RANGE), step)


def segments(text: Column, merged: Column, inverse: bool = False) -> Column:
    """The exact partition of ``text`` by merged ranges; ``inverse`` covers what lies between them instead. Null texts give null."""
    wide, none = text.rlike(_WIDE), F.array().cast("array<string>")
    n = F.when(wide, units(text)).otherwise(F.length(text))
    point = lambda at: F.struct(at.cast("int").alias("start"), at.cast("int").alias("end"), none.alias("rule_ids"))
    stops = F.concat(merged, F.array(point(n)))
    before = F.concat(F.array(F.lit(0)), F.transform(merged, lambda r: r["end"]))
    part = lambda a, b, on, ids: F.struct(F.lit(on != inverse).alias("covered"), ids.alias("rule_ids"), a.alias("start"), b.alias("end"))
    pairs = F.flatten(F.zip_with(before, stops, lambda e, r: F.array(part(e, r["start"], False, none), part(r["start"], r["end"], True, r["rule_ids"]))))
    kept = F.filter(pairs, lambda s: s["end"] > s["start"])
    kept = F.when(F.size(kept) > 0, kept).otherwise(F.array(part(F.lit(0), n, False, none)))
    said = lambda value, s: F.struct(value.alias("text"), s["covered"].alias("covered"), s["rule_ids"].alias("rule_ids"), s["start"].alias("start"), s["end"].alias("end"))
    # the bytes come in beside each range, so that they are made once a row
    raw = F.array_repeat(F.encode(text, "UTF-16BE"), F.size(kept))
    cuts = F.zip_with(kept, raw, lambda s, x: said(_bytes_cut(x, s["start"], s["end"]), s))
    return F.when(wide, cuts).when(text.isNotNull(), F.transform(kept, lambda s: said(F.substring(text, s["start"] + 1, s["end"] - s["start"]), s)))


def covered(segments_: Column) -> Column:
    return F.filter(segments_, lambda s: s["covered"])


def _joined(segments_: Column, said) -> Column:
    return F.array_join(F.transform(segments_, said), "")


def restored(segments_: Column) -> Column:
    """The source text again; null segments give null."""
    return _joined(segments_, lambda s: s["text"])


def masked(segments_: Column, appearance: str) -> Column:
    """Segments' texts with covered ones masked; appearances without a mask text leave the text to the renderer."""
    if appearance not in MASKS:
        raise ValueError(f"unknown appearance {appearance!r}")

    def mask(s: Column) -> Column:
        n = n_graphemes(s["text"])
        if appearance == "asterisk":
            hidden = F.rpad(F.lit(""), n, "*")
        elif appearance == "grawlix":
            hidden = F.rpad(F.lit(""), n, GRAWLIX)
        else:
            hidden = s["text"]
        return F.when(s["covered"], hidden).otherwise(s["text"])

    return _joined(segments_, mask)


def spliced(text: Column, merged: Column, replacement: str = "") -> Column:
    """``text`` with every merged range replaced once."""
    parts = segments(text, merged)
    return _joined(parts, lambda s: F.when(s["covered"], F.lit(replacement)).otherwise(s["text"]))


def target_ranges(matches: Column, scope: str = "target") -> Column:
    a, b = ("target_start", "target_end") if scope == "target" else ("start", "end")
    return F.transform(matches, lambda m: F.struct(m[a].alias("start"), m[b].alias("end"), F.array(m["rule_id"]).alias("rule_ids")))


def identified(matches: Column) -> Column:
    """Matches with ids m0, m1, and so on, within their text."""
    fields = ("rule_id", "pack_id", "profile", "text", "start", "end", "target_text", "target_start", "target_end")
    return F.transform(matches, lambda m, i: F.struct(F.concat(F.lit("m"), i.cast("string")).alias("match_id"), *(m[f].alias(f) for f in fields)))


def selection_term(text: Column) -> Column:
    """A selection as a term: trimmed, white space collapsed, null if empty or over 200 characters."""
    term = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when((F.length(term) > 0) & (F.length(term) <= 200), term)
