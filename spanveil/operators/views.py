"""Views of matches and segments for renderers: visual trees, highlights, stages, reveals and export."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanveil.functions.unicode import graphemes
from spanveil.operators.engine import Engine
from spanveil.operators.expr import GRAWLIX, MASKS
from spanveil.operators.relational import _groups
from spanveil.sources import state

_PART = "struct<text:string,covered:boolean,start:int,end:int,mask:string,rule_ids:array<string>,reveal_id:string,match_ids:array<string>,edge:string>"
VISUAL = f"struct<a11y_text:string,visual:array<{_PART}>,controls:array<struct<reveal_id:string,match_ids:array<string>,label:string>>>"
_strings = pa.list_(pa.string())
_part = pa.struct([("text", pa.string()), ("covered", pa.bool_()), ("start", pa.int32()), ("end", pa.int32()), ("mask", pa.string()), ("rule_ids", _strings), ("reveal_id", pa.string()), ("match_ids", _strings), ("edge", pa.string())])
_visual = pa.struct([("a11y_text", pa.string()), ("visual", pa.list_(_part)), ("controls", pa.list_(pa.struct([("reveal_id", pa.string()), ("match_ids", _strings), ("label", pa.string())])))])


def mask(text: str, appearance: str) -> str | None:
    """What stands for a covered text, one sign a grapheme; None for appearances that only style it."""
    if appearance not in MASKS:
        raise ValueError(f"unknown appearance {appearance!r}")
    n = len(graphemes(text))
    return {"asterisk": "*" * n, "grawlix": (GRAWLIX * (n // len(GRAWLIX) + 1))[:n]}.get(appearance)


def visual(engine: Engine, text: str, appearance: str = "scrawl", controls: bool = True) -> dict:
    """One text for assistive readers, the parts to draw, and a control for each group of matches that share covers.

    A text without covers is its own only part and has no controls.
    """
    parts, found = engine.segment(text), engine.find(text)
    groups = _groups(found, parts)
    place = {s["index"]: (g, s["edge"]) for g in groups for s in g["segments"]}
    drawn = []
    for k, s in enumerate(parts):
        g, edge = place.get(k, (None, None))
        drawn.append({k2: s[k2] for k2 in ("text", "covered", "start", "end", "rule_ids")} | {"mask": mask(s["text"], appearance) if s["covered"] else None, "reveal_id": g and g["reveal_id"], "match_ids": g["match_ids"] if g else [], "edge": edge})
    shown = [g for g in groups if g["segments"]]
    buttons = [{"reveal_id": g["reveal_id"], "match_ids": g["match_ids"], "label": f"Reveal covered text {i} of {len(shown)}"} for i, g in enumerate(shown, 1)]
    return {"a11y_text": text, "visual": drawn, "controls": buttons if controls else []}


def visual_column(engine: Engine, text: Column, appearance: str = "scrawl", controls: bool = True) -> Column:
    @F.arrow_udf(VISUAL)
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else visual(engine, t, appearance, controls) for t in texts.to_pylist()], _visual)

    return run.asNondeterministic()(text)


# The declarations of each highlight.
HIGHLIGHTS = {
    "scrawl": {"background-color": "GrayText", "text-decoration-color": "CanvasText", "text-decoration-line": "line-through", "text-decoration-style": "wavy"},
    "blur": {"background-color": "GrayText", "text-shadow": "0 0 0.35em CanvasText"},
    "bar": {"background-color": "CanvasText"},
}


def highlight_css(name: str, appearance: str) -> str:
    """The rule of one named highlight; names that could leave the selector are refused."""
    if re.fullmatch(r"[A-Za-z][A-Za-z0-9-]*", name) is None:
        raise ValueError(f"{name!r} is no safe highlight name.")
    lines = {"color": "transparent", **HIGHLIGHTS[appearance]}
    return f"::highlight({name}) {{\n" + "".join(f"  {k}: {v};\n" for k, v in lines.items()) + "}\n"


def stages(engine: Engine, text: Column) -> Column:
    """The first match taken apart: match, target within it, covers and output; null without a match."""
    both = engine.find_and_segment(text)
    first = lambda b: F.get(b["matches"], F.lit(0))
    made = lambda b: F.when(
        F.size(b["matches"]) > 0,
        F.struct(
            first(b)["text"].alias("match"),
            (first(b)["target_start"] - first(b)["start"]).alias("target_start"),
            (first(b)["target_end"] - first(b)["start"]).alias("target_end"),
            F.transform(F.filter(b["segments"], lambda s: s["covered"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("covers"),
            F.transform(b["segments"], lambda s: s["text"]).alias("output"),
        ),
    )
    return F.get(F.transform(F.array(both), made), F.lit(0))


def exportable(reports: DataFrame, report: str = "report") -> DataFrame:
    """Only rows whose sanitized text was checked and holds nothing of its source."""
    return reports.where(F.col(f"{report}.source_absence.checked") & F.coalesce(F.col(f"{report}.source_absence.absent"), F.lit(False)))


def reusable(active: dict, following: dict, host: str) -> bool:
    """Whether two states match alike on a host, so that a change between them needs no new scan."""
    key = lambda s: (state.active(s)["coverage"], state.BUILT_IN in state.active(s)["lens_ids"], sorted(t.lower() for t in state.profile_terms(s)))

    def on(s: dict) -> bool:
        mode = s["site_modes"].get(host.strip().lower())
        return not s["paused"] and (mode == "on" or (mode is None and s["enabled"]))

    return key(active) == key(following) and on(active) and on(following)


def revealed(events: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, reveal_id) of groups that clicks have left open, from (key, reveal_id, kind, seq).

    A ``click`` turns a group over; ``reset``, for a text whose inputs changed, closes all of its groups.
    """
    last = events.where("kind = 'reset'").groupBy(F.col(key).alias("_k")).agg(F.max("seq").alias("_reset"))
    clicks = events.where("kind = 'click'").join(last, F.col(key) == F.col("_k"), "left").where(F.col("_reset").isNull() | (F.col("seq") > F.col("_reset")))
    return clicks.groupBy(key, "reveal_id").agg((F.count(F.lit(1)) % 2).alias("_odd")).where("_odd = 1").select(key, "reveal_id")


def edges(parts: DataFrame, key: str = "doc_id") -> DataFrame:
    """``parts`` (key, reveal_id, pos) with each part's edge in its group: solo, start, middle or end."""
    group = Window.partitionBy(key, "reveal_id")
    at, n = F.row_number().over(group.orderBy("pos")), F.count(F.lit(1)).over(group)
    return parts.withColumn("edge", F.when(n == 1, "solo").when(at == 1, "start").when(at == n, "end").otherwise("middle"))


def work(engine: Engine, texts: list[str]) -> dict[str, int]:
    """How much a scan of ``texts`` does: texts read, graphemes taken apart, units made and matches found."""
    from spanveil.operators import matchers

    counts = {"texts": 0, "grapheme_passes": 0, "unit_passes": 0, "matches": 0}

    class Counted(matchers.Text):
        @property
        def ranges(self):
            counts["grapheme_passes"] += self._ranges is None
            return super().ranges

        def _made(self, form, changes):
            counts["unit_passes"] += 1
            return super()._made(form, changes)

    for text in texts:
        counts["texts"] += 1
        shared = Counted(text)
        for m in engine._matchers():
            counts["matches"] += len(list(m.find(shared)))
    return counts
