"""Pages, corpora, state and change feeds."""

import json
import random

import pytest
from pyspark.sql import functions as F

from spanveil import packs
from spanveil.operators import relational as rel
from spanveil.operators.engine import Engine
from spanveil.operators.rules import rules_from_packs, term_rule
from spanveil.sources import corpus, html, state
from spanveil.streaming import range_index

CAT = Engine([term_rule("cat", ["cat"])])


def nodes(page, eligible=None):
    return [(n["text"], n["eligible"]) for n in html.parse(page, eligible or html.profile()).nodes]


@pytest.mark.parametrize("tag", html.TREE_TAGS)
def test_tree_profile_leaves_some_tags_alone(tag):
    assert nodes(f"<p>a<{tag}>b</{tag}>c</p>") == [("a", True), ("b", False), ("c", True)]


def test_page_profile():
    page = html.profile("page")
    assert nodes('<div contenteditable>a<i contenteditable="false">b</i><i contenteditable="x">c</i></div>', page) == [("a", False), ("b", True), ("c", False)]
    assert nodes("<svg><text>a</text></svg><kbd>b</kbd><p>c</p>", page) == [("a", False), ("b", False), ("c", True)]
    assert nodes(f"<p {html.IGNORE}>a<b>b</b></p><p>c</p>", page) == [("a", False), ("b", False), ("c", True)]
    assert nodes(f"<p><span {html.COVER}>a</span></p>", page) == [("a", True)]  # a page's own markers mean nothing there
    assert nodes("<aside>a</aside>", html.profile("page", exclude=("ASIDE",))) == [("a", False)]
    assert nodes("<p class=x>a</p>", html.profile(skip=lambda tag, attrs: attrs.get("class") == "x")) == [("a", False)]


def test_rendering():
    page = "<!DOCTYPE html><p>a cat &amp; <b>c</b>at<br>cat</p><!-- cat --><pre>cat</pre><script>if (cat < 1) {}</script>"
    out = html.rendered(page, CAT, html.profile())
    span = f'<span {html.COVER}="" {html.RULES}="cat">cat</span>'
    assert out == f"<!DOCTYPE html><p>a {span} &amp; <b>c</b>at<br>{span}</p><!-- cat --><pre>cat</pre><script>if (cat < 1) {{}}</script>"
    assert html.rendered(out, CAT, html.profile()) == out
    deep = "<i>" * 3000 + "cat" + "</i>" * 3000
    assert html.rendered(deep, CAT, html.profile()).count(html.COVER) == 1


def test_pages(spark):
    df = spark.createDataFrame([(1, "<p>cat and cat</p><p>cat</p>"), (2, "<p>dog</p>"), (3, None), (4, "")], "page_id long, html string")
    assert sorted(map(tuple, html.apply_counts(df, CAT).collect())) == [(1, 2, 3)]
    assert [(r.page_id, r.node_id, r.start, r.end) for r in html.covered_nodes(df, CAT).orderBy("page_id", "node_id", "start").collect()] == [(1, 0, 0, 3), (1, 0, 8, 11), (1, 1, 0, 3)]
    assert {r.page_id: r.h for r in df.select("page_id", html.render(F.col("html"), CAT).alias("h")).collect()}[2] == "<p>dog</p>"


def case(id, text, matches=(), profile="canonical", **more):
    full = [{"ruleId": r, "packId": "en-strong-profanity", "text": text[a:b], "start": a, "end": b, "targetText": text[c:d], "targetStart": c, "targetEnd": d} for r, a, b, c, d in matches]
    return {"id": id, "text": text, "profile": profile, "tags": ["x"], "matches": full} | more


def test_corpora(spark, tmp_path):
    cases = [case("plain", "a clean text"), case("inflected", "so fucking late", [("fuck", 3, 10, 3, 7)]), case("wrong", "shit", []), case("unknown", "x", profile="none")]
    (tmp_path / "a.json").write_text(json.dumps(cases[:2]))
    (tmp_path / "b.json").write_text(json.dumps(cases[2:]))
    df = corpus.read(spark, str(tmp_path), "en")
    engines = {"canonical": Engine(rules_from_packs(packs.CANONICAL))}
    assert corpus.summary(df).first() == (4, 1) and corpus.violations(df).count() == 0
    failed = {r.id: r.failures for r in corpus.evaluate(df, engines).collect()}
    assert failed == {"wrong": ["matches differ"], "unknown": ["no engine for profile none"]}
    corpus.check(df.where("id IN ('plain', 'inflected')"), engines)
    with pytest.raises(AssertionError, match="2 cases failed"):
        corpus.check(df, engines)


def test_corpus_violations(spark, tmp_path):
    bad = [case("Bad Id", "x"), case("twice", "x"), case("twice", "x"), case("tags", "x", tags=["a", "a"]), case("out", "abc", [("r", 0, 3, 0, 3)])]
    bad[-1]["matches"][0]["end"] = 9
    bad.append(case("said", "abc", [("r", 0, 3, 0, 3)]))
    bad[-1]["matches"][0]["text"] = "xyz"
    (tmp_path / "a.json").write_text(json.dumps(bad))
    got = {(r.id, r.problem) for r in corpus.violations(corpus.read(spark, str(tmp_path), "en")).collect()}
    assert got == {("Bad Id", "malformed id"), ("twice", "repeated id"), ("tags", "repeated tag"), ("out", "range out of bounds"), ("said", "text is not as declared")}


def test_differences(spark):
    m = lambda a, b, c, d: [("r", a, b, c, d)]
    kind = "id string, text string, note string, matches array<struct<rule_id:string,start:int,end:int,target_start:int,target_end:int>>"
    base = spark.createDataFrame([("same", "t", None, []), ("gone", "t", None, []), ("text", "t", None, []), ("match", "t", None, []), ("target", "t", None, m(0, 1, 0, 1)), ("meta", "t", "a", [])], kind)
    head = spark.createDataFrame([("same", "t", None, []), ("new", "t", None, []), ("text", "u", None, []), ("match", "t", None, m(0, 1, 0, 1)), ("target", "t", None, m(0, 1, 0, 2)), ("meta", "t", "b", [])], kind)
    changes = rel.diff(base, head, ["id"], meta=["note"])
    assert {r.id: r.bucket for r in changes.collect()} == {"same": "unchanged", "gone": "removed", "new": "added", "text": "text", "match": "matches", "target": "target", "meta": "metadata"}
    assert corpus.report(changes).startswith("6 changed\nadded: new")


def test_budgets(spark):
    words = ["Cat", "cat", "x" * 300, "dog", " ", "bird", "ant"]
    df = spark.createDataFrame([(words,)], "t array<string>")
    r = df.select(rel.budgeted_terms(F.col("t"), total=9).alias("b")).first().b
    assert (r.kept, r.added, r.duplicates, r.too_long, r.over_budget) == (["Cat", "dog", "ant"], 3, 1, 1, 1)
    kept, counts = state.terms(words)
    assert kept == ["Cat", "dog", "bird", "ant"] and counts == {"added": 4, "duplicates": 1, "too_long": 1, "over_budget": 0}
    assert df.select(rel.term_list(F.lit("a, B\nb,,c ")).alias("x")).first().x == ["a", "B", "c"]


def test_roots_lenses_and_policy(spark):
    roots = spark.createDataFrame([(1, [0]), (1, [0, 2]), (1, [0, 2]), (1, [1, 1]), (2, [0, 2]), (2, [])], "page_id long, path array<int>")
    assert sorted((r.page_id, r.path) for r in rel.compacted_roots(roots).collect()) == [(1, [0]), (1, [1, 1]), (2, [])]
    pages = spark.createDataFrame([(1, "https://A.com/x"), (2, "http://b.com"), (3, "http://c.com")], "page_id long, url string")
    modes = spark.createDataFrame([(" a.COM ", "off", 1), ("b.com", "off", 1), ("b.com", "on", 2), ("c.com", "maybe", 1)], "host string, mode string, position int")
    assert {r.page_id: r.active for r in rel.site_policy(pages, modes, default=True).collect()} == {1: False, 2: True, 3: True}
    assert not any(r.active for r in rel.site_policy(pages, modes, paused=True).collect())
    profiles = spark.createDataFrame([("p", ["a", "zz"])], "profile_id string, lens_ids array<string>")
    lenses = spark.createDataFrame([("a", ["x"]), ("b", ["y"])], "lens_id string, terms array<string>")
    assert [r.lens_id for r in rel.profile_lenses(profiles, lenses).collect()] == ["a"]


def test_state_is_normalized_and_folded(spark):
    s = state.normal({"lenses": [{"id": "a", "terms": ["x", "X", "y"]}, {"id": "a"}], "profiles": [{"id": "p", "lens_ids": ["zz", "a"], "appearance": "asterisk", "reveal": "focus"}], "active_profile": "nope", "site_modes": {" A.com ": "on", "b": "x"}})
    assert [x["id"] for x in s["lenses"]] == ["english", "a"] and s["lenses"][1]["terms"] == ["x", "y"]
    assert s["profiles"][0] | {"name": ""} == {"id": "p", "name": "", "lens_ids": ["a"], "appearance": "bar", "coverage": "full", "reveal": "click"}
    assert s["active_profile"] == "p" and s["site_modes"] == {"a.com": "on"} and state.normal(None)["active_profile"] == "default"
    s = state.change(s, {"type": "set_site_mode", "host": "A.com", "mode": "inherit"})
    s = state.change(s, {"type": "add_selected_term", "term": " two  words "})
    assert s["site_modes"] == {} and state.profile_terms(s) == ["x", "y", "two words"]
    assert state.change(s, {"type": "patch_profile", "profile_id": "zz", "patch": {"coverage": "tail"}}) == s
    assert state.change(s, {"type": "remove_lens", "lens_id": "english"}) == s
    intents = [{"type": "set_paused", "value": True}, {"type": "add_selected_term", "term": "q"}, {"type": "patch_profile", "patch": {"coverage": "vowel"}}]
    log = spark.createDataFrame([(u, i, json.dumps(x)) for u in (1, 2) for i, x in enumerate(intents)], "user_id long, seq long, intent string").repartition(3)
    got = {r.user_id: json.loads(r.state) for r in state.fold_log(log).collect()}
    assert got[1] == got[2] and got[1]["paused"] and state.active(got[1])["coverage"] == "vowel" and [r.id for r in state.rules_of(got[1])][-1] == "custom"


def test_any_batching_of_a_feed_ends_in_the_same_index(spark, tmp_path):
    rnd = random.Random(7)
    feed = [(rnd.randrange(3), rnd.randrange(6), rnd.choice(["upsert", "upsert", "delete"]), rnd.choice(["a cat", "cat cat", "dog", None]), i) for i in range(80)]
    rnd.shuffle(feed)
    feed += feed[:10]  # delivered twice
    df = spark.createDataFrame(feed, range_index.CHANGE)
    want = sorted(map(tuple, range_index.index(df, CAT).collect()))
    assert want
    for k in range(4):
        spark.createDataFrame(feed[k * 25 : (k + 1) * 25] or feed[:1], range_index.CHANGE).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    source = spark.readStream.schema(range_index.CHANGE).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    q = range_index.stream(source, CAT).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = sorted(map(tuple, range_index.current(spark.read.schema(range_index.ENTRY).parquet(f"{tmp_path}/out")).collect()))
    assert got == want


def test_entry_lists_every_query():
    import __spark_entry__ as e

    names = e.queries()
    assert set(e.oracle_sql()) <= set(names) and len(names) >= 44
