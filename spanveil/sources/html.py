"""HTML pages as text nodes, and pages written back with covers.

A tolerant, event-driven parse: void elements don't nest, an element left open ends with its parent. Two profiles decide
which text nodes may be covered: ``tree`` for documents at rest and ``page`` for live pages, with editable regions.
"""

from __future__ import annotations

import html as entities
from collections.abc import Callable
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanveil.operators.engine import Engine

# Tags whose text each profile leaves alone, and tags without content.
TREE_TAGS = ("code", "pre", "script", "style", "textarea")
PAGE_TAGS = ("button", "code", "input", "kbd", "noscript", "option", "pre", "samp", "script", "select", "style", "template", "textarea")
VOID_TAGS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
FOREIGN_TAGS = ("svg", "math")
IGNORE = "data-veil-ignore"
COVER = "data-veil-cover"
RULES = "data-veil-rules"

NODE = "struct<node_id:int,path:array<int>,tags:array<string>,text:string,eligible:boolean>"
_node = pa.struct([("node_id", pa.int32()), ("path", pa.list_(pa.int32())), ("tags", pa.list_(pa.string())), ("text", pa.string()), ("eligible", pa.bool_())])


class _Parser(HTMLParser):
    """Collects (kind, value, node index) pieces in source order; text nodes carry their elements."""

    def __init__(self, eligible: Callable):
        super().__init__(convert_charrefs=True)
        self.eligible, self.stack, self.children = eligible, [], [0]
        self.nodes: list[dict] = []
        self.pieces: list[tuple[str, object]] = []

    def _place(self) -> list[int]:
        path = [*(p for _, _, p in self.stack), self.children[-1]]
        self.children[-1] += 1
        return path

    def handle_starttag(self, tag, attrs):
        self.pieces.append(("raw", self.get_starttag_text()))
        place = self._place()[-1]
        if tag not in VOID_TAGS:
            self.stack.append((tag, dict(attrs), place))
            self.children.append(0)

    def handle_startendtag(self, tag, attrs):
        self.pieces.append(("raw", self.get_starttag_text()))
        self._place()

    def handle_endtag(self, tag):
        self.pieces.append(("raw", f"</{tag}>"))
        if any(t == tag for t, _, _ in self.stack):
            while self.stack:
                name = self.stack.pop()[0]
                self.children.pop()
                if name == tag:
                    break

    def handle_data(self, data):
        raw = bool(self.stack) and self.stack[-1][0] in ("script", "style")
        elements = [(t, a) for t, a, _ in self.stack]
        self.pieces.append(("raw text" if raw else "text", len(self.nodes)))
        self.nodes.append({"node_id": len(self.nodes), "path": self._place(), "tags": [t for t, _ in elements], "text": data, "eligible": bool(data) and self.eligible(elements)})

    def handle_comment(self, data):
        self.pieces.append(("raw", f"<!--{data}-->"))

    def handle_decl(self, decl):
        self.pieces.append(("raw", f"<!{decl}>"))

    def handle_pi(self, data):
        self.pieces.append(("raw", f"<?{data}>"))

    def unknown_decl(self, data):
        self.pieces.append(("raw", f"<![{data}]>"))


def _editable(elements: list) -> bool:
    for _, attrs in reversed(elements):
        if "contenteditable" in attrs:
            value = (attrs["contenteditable"] or "").strip().lower()
            if value == "false":
                return False
            if value in ("", "true", "plaintext-only"):
                return True
    return False


def profile(name: str = "tree", exclude: tuple[str, ...] = (), ignore: str | None = IGNORE, skip: Callable | None = None) -> Callable:
    """Whether a text node under ``elements``, a list of (tag, attributes) from the root, may be covered."""
    tags = {*(TREE_TAGS if name == "tree" else PAGE_TAGS), *(t.lower() for t in exclude)}

    def eligible(elements: list) -> bool:
        if name == "page" and (not elements or elements[-1][0] in FOREIGN_TAGS or any(t in FOREIGN_TAGS for t, _ in elements) or _editable(elements)):
            return False
        for tag, attrs in elements:
            if tag in tags or (ignore and ignore in attrs) or (name == "tree" and COVER in attrs) or (skip and skip(tag, attrs)):
                return False
        return True

    return eligible


def parse(text: str, eligible: Callable) -> _Parser:
    parser = _Parser(eligible)
    parser.feed(text)
    parser.close()
    return parser


def text_nodes(html: Column, eligible: Callable | None = None) -> Column:
    """array<NODE> of a page's text nodes in document order; null pages give null."""
    eligible = eligible or profile()

    @F.arrow_udf(f"array<{NODE}>")
    def run(pages: pa.Array) -> pa.Array:
        return pa.array([None if p is None else parse(p, eligible).nodes for p in pages.to_pylist()], pa.list_(_node))

    return run.asNondeterministic()(html)


def page_text(pages: DataFrame, eligible: Callable | None = None, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, node_id, path, tags, text, eligible), a row for each text node."""
    nodes = pages.select(F.col(key), F.explode(text_nodes(F.col(html), eligible)).alias("n"))
    return nodes.select(key, "n.*")


def rendered(text: str, engine: Engine, eligible: Callable) -> str:
    """The page with covered parts of eligible text in spans; matches never cross text nodes, and covers are not covered again."""
    parser = parse(text, eligible)
    out = []
    for kind, value in parser.pieces:
        if kind == "raw":
            out.append(value)
            continue
        node = parser.nodes[value]
        safe = (lambda t: t) if kind == "raw text" else lambda t: entities.escape(t, quote=False)
        parts = engine.segment(node["text"]) if node["eligible"] else []
        if not any(p["covered"] for p in parts):
            out.append(safe(node["text"]))
            continue
        for p in parts:
            rules = entities.escape(",".join(p["rule_ids"]))
            out.append(f'<span {COVER}="" {RULES}="{rules}">{safe(p["text"])}</span>' if p["covered"] else safe(p["text"]))
    return "".join(out)


def render(html: Column, engine: Engine, eligible: Callable | None = None) -> Column:
    eligible = eligible or profile()

    @F.arrow_udf("string")
    def run(pages: pa.Array) -> pa.Array:
        return pa.array([None if p is None else rendered(p, engine, eligible) for p in pages.to_pylist()], pa.string())

    return run.asNondeterministic()(html)


def covered_nodes(pages: DataFrame, engine: Engine, eligible: Callable | None = None, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, node_id, start, end, rule_ids) of every covered range of eligible text nodes."""
    nodes = page_text(pages, eligible, key, html).where("eligible")
    parts = nodes.select(key, "node_id", F.explode(engine.segment_column(F.col("text"))).alias("s")).where("s.covered")
    return parts.select(key, "node_id", "s.start", "s.end", "s.rule_ids")


def apply_counts(pages: DataFrame, engine: Engine, eligible: Callable | None = None, key: str = "page_id") -> DataFrame:
    """(key, transformed_text_nodes, covered_segments) of pages with covers."""
    return covered_nodes(pages, engine, eligible, key).groupBy(key).agg(F.countDistinct("node_id").alias("transformed_text_nodes"), F.count(F.lit(1)).alias("covered_segments"))
