"""Destructive output: matched text replaced, with a report of what went and a check that it is gone."""

from __future__ import annotations

import unicodedata

import pyarrow as pa

from spanveil.functions.unicode import utf16_offsets

_RANGE = "struct<start:int,end:int,text:string,matches:array<int>>"
REPORT = f"struct<text:string,scope:string,replacement:string,match_count:int,range_count:int,ranges:array<{_RANGE}>,source_absence:struct<checked:boolean,absent:boolean,present:array<string>,rematches:int>>"
_absence = pa.struct([("checked", pa.bool_()), ("absent", pa.bool_()), ("present", pa.list_(pa.string())), ("rematches", pa.int32())])
_range = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("matches", pa.list_(pa.int32()))])
report_type = pa.struct([("text", pa.string()), ("scope", pa.string()), ("replacement", pa.string()), ("match_count", pa.int32()), ("range_count", pa.int32()), ("ranges", pa.list_(_range)), ("source_absence", _absence)])


def sanitize(engine, text: str, replacement: str | None = None, scope: str = "target", verify: bool = False) -> dict:
    """The text with each merged range of targets (or whole matches) replaced once; coverage plays no part.

    With ``verify`` the result is absent only if none of the selected texts, literally or up to canonical equivalence,
    is in the output and the rules match nothing in it; without, absence is unknown.
    """
    if scope not in ("target", "match"):
        raise ValueError(f"unknown scope {scope!r}")
    found = engine.scan(text)
    picked = sorted(((m[3], m[4], i) if scope == "target" else (m[1], m[2], i) for i, m in enumerate(found)), key=lambda r: (r[0], -r[1], r[2]))
    spans: list[list] = []
    for a, b, i in picked:
        if spans and a < spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
            spans[-1][2].append(i)
        else:
            spans.append([a, b, [i]])
    out, at = [], 0
    for a, b, _ in spans:
        out += [text[at:a], replacement or ""]
        at = b
    clean = "".join([*out, text[at:]])
    absence = {"checked": False, "absent": None, "present": [], "rematches": 0}
    if verify:
        nfc = unicodedata.normalize("NFC", clean)
        gone = dict.fromkeys(text[a:b] for a, b, _ in picked)
        present = [t for t in gone if t in clean or unicodedata.normalize("NFC", t) in nfc]
        again = len(engine.scan(clean))
        absence = {"checked": True, "absent": not present and not again, "present": present, "rematches": again}
    u = utf16_offsets(text)
    ranges = [{"start": u(a), "end": u(b), "text": text[a:b], "matches": m} for a, b, m in spans]
    return {"text": clean, "scope": scope, "replacement": replacement, "match_count": len(found), "range_count": len(spans), "ranges": ranges, "source_absence": absence}
