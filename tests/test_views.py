import pytest
from pyspark.sql import functions as F

from spanveil.operators import views
from spanveil.operators.engine import Engine
from spanveil.operators.rules import obfuscated_rule, regex_rule, term_rule
from spanveil.sources import state

E = Engine([term_rule("a", ["one two"]), term_rule("b", ["two three"]), term_rule("c", ["five"])])


def test_visual_tree(spark):
    v = views.visual(E, "one two three, five", "grawlix")
    assert [(p["text"], p["mask"], p["reveal_id"], p["edge"]) for p in v["visual"]] == [("one two three", "@#$%&!@#$%&!@", "m0", "solo"), (", ", None, None, None), ("five", "@#$%", "m2", "solo")]
    assert v["a11y_text"] == "one two three, five" and [c["match_ids"] for c in v["controls"]] == [["m0", "m1"], ["m2"]]
    assert views.visual(E, "none")["controls"] == [] and views.mask("ab", "blur") is None
    df = spark.createDataFrame([("five",), (None,)], "text string")
    rows = df.select(views.visual_column(E, F.col("text"), "asterisk").alias("v")).collect()
    assert rows[0].v.visual[0].mask == "****" and rows[1].v is None


def test_highlights():
    assert views.highlight_css("veil-1", "bar") == "::highlight(veil-1) {\n  color: transparent;\n  background-color: CanvasText;\n}\n"
    with pytest.raises(ValueError):
        views.highlight_css("a) {} b", "bar")


def test_stages_and_export(spark):
    e = Engine([regex_rule("r", "x(?<y>one)x", "g", group="y")], coverage="middle")
    df = spark.createDataFrame([("a xonex",), ("b",)], "text string")
    r = df.select(views.stages(e, F.col("text")).alias("s")).collect()
    assert (r[0].s.match, r[0].s.target_start, r[0].s.target_end, [tuple(c) for c in r[0].s.covers], r[0].s.output) == ("xonex", 1, 4, [(3, 5)], ["a x", "on", "ex"])
    assert r[1].s is None
    rep = df.select(e.sanitize_column(F.col("text"), "#", verify=True).alias("report")).unionByName(df.select(e.sanitize_column(F.col("text"), "#").alias("report"))).unionByName(df.select(e.sanitize_column(F.col("text"), "one", verify=True).alias("report")))
    assert sorted(r.report.text for r in views.exportable(rep).collect()) == ["a x#x", "b", "b"]


def test_reuse_of_a_session():
    s = state.normal({"lenses": [{"id": "a", "terms": ["x"]}], "profiles": [{"id": "p", "lens_ids": ["a"]}]})
    paint = state.change(s, {"type": "patch_profile", "patch": {"appearance": "blur"}})
    cover = state.change(s, {"type": "patch_profile", "patch": {"coverage": "tail"}})
    off = state.change(s, {"type": "set_site_mode", "host": "h", "mode": "off"})
    assert views.reusable(s, paint, "h") and not views.reusable(s, cover, "h") and not views.reusable(s, off, "h")


def test_reveals_and_edges(spark):
    log = spark.createDataFrame([(1, "m0", "click", 1), (1, "m1", "click", 2), (1, None, "reset", 3), (1, "m1", "click", 4), (2, "m0", "click", 1), (2, "m0", "click", 2)], "doc_id long, reveal_id string, kind string, seq long")
    assert [tuple(r) for r in views.revealed(log).collect()] == [(1, "m1")]
    parts = spark.createDataFrame([(1, "m0", 0), (1, "m0", 2), (1, "m0", 4), (1, "m5", 6)], "doc_id long, reveal_id string, pos int")
    assert [r.edge for r in views.edges(parts).orderBy("pos").collect()] == ["start", "middle", "end", "solo"]


def test_work_is_counted():
    clean = "z" * 1000
    assert views.work(Engine([obfuscated_rule("o", ["shop"], substitutions={"o": ["0"]}, max_substitutions=1)]), [clean]) == {"texts": 1, "grapheme_passes": 0, "unit_passes": 0, "matches": 0}
    counts = views.work(Engine([term_rule(str(k), ["e" + chr(0x301)]) for k in range(5)]), ["e" + chr(0x301) + " x"])
    assert counts == {"texts": 1, "grapheme_passes": 1, "unit_passes": 1, "matches": 5}


def test_texts_that_cannot_match_stay_in_the_jvm(spark):
    texts = ["the cat", "The", chr(0x212A) + "ey", "a" + chr(0x17F) + "o", "nothing", "", None, "so", "key"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for sensitive in (False, True):
        e = Engine([term_rule("t", ["the", "key", "so", "aso"], case_sensitive=sensitive)])
        assert e.may_match(F.col("text")) is not None
        for r in df.select("text", e.find_column(F.col("text")).alias("m")).collect():
            assert (r.m is None) if r.text is None else [m.asDict() for m in r.m] == e.find(r.text)
    assert Engine([term_rule("t", ["é"])]).may_match(F.col("text")) is None
