"""Semantics of the engine on single texts: the edge cases each operator must keep."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanveil import packs
from spanveil.functions.patterns import compiled
from spanveil.functions.unicode import edges, fold, graphemes, trim
from spanveil.operators import expr, relational
from spanveil.operators.engine import Engine, preset_ranges, vowels
from spanveil.operators.matchers import shadow
from spanveil.operators.rules import Entry, LocaleWord, Pack, confusable_rule, define_pack, matcher_rule, obfuscated_rule, regex_rule, repeated_rule, rules_from_packs, targeted_rule, term_rule, transformed_rule, width_rule
from spanveil.operators.sanitize import sanitize


def spans(engine, text):
    return [(m["start"], m["end"]) for m in engine.find(text)]


def found(engine, text):
    return [(m["text"], m["target_text"]) for m in engine.find(text)]


def terms(*words, **options):
    return Engine([term_rule("t", words, **options)])


def test_nested_and_crossing_terms_all_match():
    assert spans(terms("one two", "two three", "one two three"), "one two three") == [(0, 13), (0, 7), (4, 13)]
    assert spans(terms("aba", "bab", boundary="substring"), "ababa") == [(0, 3), (1, 4), (2, 5)]


def test_normal_forms_match_with_source_ranges():
    e = terms("caf" + chr(0xE9))
    assert spans(e, "a cafe" + chr(0x301) + " x") == [(2, 7)]
    assert terms("caf" + chr(0xE9), normalization="none").find("cafe" + chr(0x301)) == []


@pytest.mark.parametrize("term,text,hit", [("s", chr(0x17F), 1), ("k", chr(0x212A), 1), (chr(0x3C3), chr(0x3C2), 1), (chr(0xDF), chr(0x1E9E), 1), ("i", chr(0x131), 0), ("i", chr(0x130), 0)])
def test_simple_case_folding(term, text, hit):
    assert len(terms(term).find(text)) == hit
    rule = regex_rule("r", term, "giu")
    if term == "i":
        assert Engine([rule]).find(text) == []


def test_word_context():
    e = terms("cat")
    for tail in (chr(0x301), chr(0x200D), chr(0x203F), "s", "1", "_"):
        assert e.find("cat" + tail) == []
    assert spans(e, "(cat) cat-cat") == [(1, 4), (6, 9), (10, 13)]


def test_offsets_are_utf16():
    fire = chr(0x1F525)
    assert spans(Engine([regex_rule("r", f"(?={fire})|a", "gu")]), fire + "a") == [(2, 3)]
    assert spans(terms("b"), f"{fire} b {fire}") == [(3, 4)]


def test_graphemes_are_units():
    for unit in ("e" + chr(0x301), chr(0x2764) + chr(0xFE0F), chr(0x1F44D) + chr(0x1F3FD), chr(0x1F1EB) + chr(0x1F1F7), "a" + chr(0x200C)):
        assert graphemes(unit) == [(0, len(unit))]
    assert graphemes("a\r\nb") == [(0, 1), (1, 3), (3, 4)]
    with pytest.raises(ValueError, match="splits an extended grapheme"):
        Engine([regex_rule("r", "e", "gu")]).find("e" + chr(0x301))


@pytest.mark.parametrize("got,why", [((-1, 2), "out-of-bounds"), ((0, 0), "empty"), ((0, 9), "out-of-bounds"), ((0, 2, 1), "half a target"), ((0, 2, 1, 3), "outside its match"), ((0, 1.5), "integers")])
def test_matcher_output_is_checked(got, why):
    with pytest.raises(ValueError, match=why):
        Engine([matcher_rule("m", lambda t: [got])]).find("abcd")


def test_regex_rules():
    with pytest.raises(ValueError, match="sticky"):
        regex_rule("r", "a", "gy")
    with pytest.raises(ValueError, match="target group"):
        Engine([regex_rule("r", "(?<x>a)|b", "g", group="x")]).find("b")
    assert found(Engine([regex_rule("r", "(?<x>a)b", "g", group="x")]), "ab ab") == [("ab", "a"), ("ab", "a")]
    assert compiled(r"^\d$", "", "r").match("1\n") is None and compiled(r"\bé", "", "r").search("aé") is not None
    assert compiled(r".", "", "r").match(chr(0x2028)) is None and compiled(r"\s", "", "r").match(chr(0xFEFF))


def test_ordering_and_identity():
    e = Engine([*rules_from_packs(Pack("b", (term_rule("x", ["one"]),)), Pack("a", (term_rule("y", ["one"]),)))])
    assert [(m["pack_id"], m["rule_id"]) for m in e.find("one")] == [("a", "y"), ("b", "x")]
    assert e.segment("one")[0]["rule_ids"] == ["y", "x"]


@pytest.mark.parametrize("preset,word,want", [("full", "abcd", (0, 4)), ("tail", "abcd", (1, 4)), ("tail", "a", (0, 1)), ("inner", "abcd", (1, 3)), ("inner", "ab", (0, 2)), ("middle", "abcde", (1, 4)), ("middle", "abcd", (1, 3)), ("middle", "a", (0, 1)), ("middle", "ab", (0, 1))])
def test_presets(preset, word, want):
    assert preset_ranges(preset, word) == [want]


def test_callable_coverage_is_clamped_and_aligned():
    word = "ae" + chr(0x301) + "i"
    e = Engine([term_rule("t", [word], coverage=lambda c: [(2, 3), (float("nan"), 1), (5, 2), (-4, 1)])])
    assert [(s["text"], s["covered"]) for s in e.segment(word)] == [("a", True), ("e" + chr(0x301), True), ("i", False)]
    assert [s["text"] for s in Engine([term_rule("t", [word])], vowels).segment(word)] == ["a", "e" + chr(0x301), "i"]


def test_touching_covers_stay_apart_and_overlaps_join():
    e = Engine([term_rule("a", ["ab"], boundary="substring"), term_rule("b", ["cd"], boundary="substring"), term_rule("c", ["de"], boundary="substring")])
    assert [(s["text"], s["rule_ids"]) for s in e.segment("abcde")] == [("ab", ["a"]), ("cde", ["b", "c"])]


def test_empty_inputs():
    assert Engine().segment("") == [{"text": "", "covered": False, "rule_ids": [], "start": 0, "end": 0}]
    assert Engine().find("x") == [] and [s["text"] for s in terms("q").segment("plain")] == ["plain"]


def test_obfuscated_terms():
    e = Engine([obfuscated_rule("o", ["shop"], substitutions={"s": ["$"], "o": ["0"]}, ignored=["."], max_substitutions=1, max_ignored=1, max_changes=1)])
    assert found(e, "$hop sh0p shop s.hop $h0p s.h.op") == [("$hop", "$hop"), ("sh0p", "sh0p"), ("s.hop", "s.hop")]
    assert e.find("x.$hop") == []  # the boundary is judged without the ignored sign
    with pytest.raises(ValueError, match="explicit"):
        obfuscated_rule("o", ["a"], substitutions={"a": ["4"]})
    with pytest.raises(ValueError, match="maps to both"):
        obfuscated_rule("o", ["a"], substitutions={"a": ["4"], "b": ["4"]}, max_substitutions=1)
    with pytest.raises(ValueError, match="both ignored"):
        obfuscated_rule("o", ["a"], substitutions={"a": ["4"]}, ignored=["4"], max_substitutions=1, max_ignored=1, max_changes=1)
    with pytest.raises(ValueError, match="one extended grapheme"):
        obfuscated_rule("o", ["a"], substitutions={"a": ["44"]}, max_substitutions=1)
    with pytest.raises(ValueError, match="itself"):
        obfuscated_rule("o", ["a"], substitutions={"a": ["a"]}, max_substitutions=1)


def test_targets():
    options = dict(substitutions={"o": ["0"]}, max_substitutions=1)
    e = Engine([targeted_rule("o", [Entry("workshop", target="shop"), Entry("shop", target_range=(0, 2))], **options)])
    assert found(e, "worksh0p sh0p") == [("worksh0p", "sh0p"), ("sh0p", "sh")]
    for bad in (Entry("papa", target="pa"), Entry("shop", target="zip"), Entry("shop", target_range=(2, 9)), Entry("e" + chr(0x301) + "a", target=chr(0x301))):
        with pytest.raises(ValueError):
            targeted_rule("o", [bad], normalization="none", **options)
    with pytest.raises(ValueError, match="conflicting"):
        targeted_rule("o", [Entry("shop", target="sh"), Entry("shop", target="op")], **options)


def test_repeated_letters():
    e = Engine([repeated_rule("r", [Entry("fall", target="fa"), "ball"], 2)])
    assert found(e, "fal falll ffall faallll ball balll") == [("falll", "fa"), ("ffall", "ffa"), ("balll", "balll")]
    e = Engine([repeated_rule("r", [Entry("bitting", target="bit")], 1)])
    assert found(e, "bittting") == [("bittting", "bit")]  # what exceeds a run belongs to its last letter


def test_width_and_confusables():
    w = chr(ord("o") + 0xFEE0)
    e = Engine([width_rule("w", ["shop"], {"o": [w]}, 1, 0, max_changes=1)])
    assert found(e, f"sh{w}p shop") == [(f"sh{w}p", f"sh{w}p")]
    cyr = chr(0x43E)
    e = Engine([confusable_rule("c", ["shop"], {"o": [cyr]}, 1, 1, max_changes=1)])
    assert found(e, f"sh{cyr}p shhop shh{cyr}p") == [(f"sh{cyr}p", f"sh{cyr}p"), ("shhop", "shhop")]
    with pytest.raises(ValueError, match="fullwidth"):
        confusable_rule("c", ["shop"], {"o": [w]}, 1, 1, max_changes=1)
    with pytest.raises(ValueError, match="compatibility"):
        confusable_rule("c", ["shop"], {"2": [chr(0xB2)]}, 1, 1, max_changes=1)
    with pytest.raises(ValueError, match="fullwidth form"):
        width_rule("w", ["shop"], {"o": ["0"]}, 1, 0, max_changes=1)


def test_a_rejected_candidate_still_takes_its_place():
    """A class over its own budget drops the match after the scan has passed it."""
    w = chr(ord("o") + 0xFEE0)
    e = Engine([confusable_rule("c", ["foo", "oo"], {"f": [chr(0x444)]}, 0, 1, width_variants={"o": [w]}, max_width_variants=1, max_changes=2)])
    assert e.find(f"f{w}{w}") == []


def test_transforms():
    e = Engine([transformed_rule("t", ["ab"], lambda g: "" if g == "-" else g)])
    assert found(e, "x a-b ab") == [("a-b", "a-b"), ("ab", "ab")]
    wide = Engine([transformed_rule("t", ["ab", "a"], lambda g: "ab" if g == "x" else g, boundary="substring")])
    assert found(wide, "x a") == [("x", "x"), ("a", "a")]  # an edge inside an expanded grapheme has no source
    assert [r[1:] for r in shadow("a-", lambda g: g if g != "-" else "")] == [("a", 0, 1, 0, 1), ("", 1, 2, 1, 1)]
    turkish = Engine([transformed_rule("t", ["ılık"], lambda g: g, casing=("locale-insensitive", "tr"))])
    assert found(turkish, "ILIK ilik") == [("ILIK", "ILIK")]
    with pytest.raises(TypeError):
        Engine([transformed_rule("t", ["ab"], lambda g: None)])


def test_locale_words():
    e = Engine([term_rule("t", ["don", "foo", "don't"], boundary=LocaleWord(("en",)))])
    assert [t for t, _ in found(e, "don't foo-bar foo_bar")] == ["don't", "foo"]


def test_packs():
    e = Engine(rules_from_packs(packs.CANONICAL))
    assert found(e, "Fucking motherfucker, bullshit! fuckery") == [("Fucking", "Fuck"), ("motherfucker", "fuck"), ("bullshit", "shit")]
    o = Engine(rules_from_packs(packs.OBFUSCATED))
    for text, want in {"f*ck": ("f*ck", "f*ck"), "shittting": ("shittting", "shit"), "sh1tty": ("sh1tty", "sh1t"), "f" + chr(0x200B) + "uck": ("f" + chr(0x200B) + "uck",) * 2, "@ssholes": ("@ssholes", "@sshole"), "assshole": ("assshole",) * 2}.items():
        assert found(o, text) == [want]
    for clean in ("fuck", "x.f*ck", "(f*ck", "f.u.ck", "fuuuck", "fk", "f**k"):
        assert o.find(clean) == []
    manifest = {"schemaVersion": 1, "id": "x", "version": "1", "name": " X ", "locales": ["EN-us", "en-US"], "review": {"status": "draft"}}
    assert define_pack(manifest, []).manifest["locales"] == ["en-US"] and define_pack(manifest, []).manifest["name"] == "X"
    for bad in ({"schemaVersion": 2}, {"id": ""}, {"locales": []}, {"locales": ["!"]}, {"review": {}}, {"provenance": [{"id": "a"}, {"id": "a"}]}):
        with pytest.raises(ValueError):
            define_pack(manifest | bad, [])


def test_sanitize():
    e = Engine(rules_from_packs(packs.CANONICAL))
    r = sanitize(e, "fucking bullshit", "#", verify=True)
    assert (r["text"], r["match_count"], r["range_count"], r["source_absence"]["absent"]) == ("#ing bull#", 2, 2, True)
    assert sanitize(e, "fucking", None, "match")["text"] == "" and sanitize(e, "fucking")["source_absence"]["absent"] is None
    again = sanitize(terms("ab"), "ab", "ab", verify=True)["source_absence"]
    assert again == {"checked": True, "absent": False, "present": ["ab"], "rematches": 1}
    two = Engine([term_rule("a", ["one two"]), term_rule("b", ["two"])])
    r = sanitize(two, "one two, one two", "x")
    assert (r["text"], r["match_count"], r["range_count"], r["ranges"][0]["matches"]) == ("x, x", 4, 2, [0, 1])


def test_terms_are_prepared():
    with pytest.raises(ValueError, match="non-empty"):
        term_rule("t", [" ", chr(0xFEFF)])
    assert trim(chr(0xFEFF) + " a" + chr(0x1C)) == "a" + chr(0x1C)
    assert term_rule("t", ["a", " abc ", "a"]).spec["terms"] == ["abc", "a"] and fold("AB" + chr(0xC9)) == "ab" + chr(0xE9)


ATOMS = st.sampled_from(["the", "of the", "e" + chr(0x301), " ", ".", chr(0x1F44D) + chr(0x1F3FD), "fuck", "f*ck", "ing", "\r\n", chr(0x200D), "A", "ß"])
ENGINE = Engine([*rules_from_packs(packs.CANONICAL, packs.OBFUSCATED), term_rule("t", ["the", "of the"]), term_rule("m", ["e" + chr(0x301)], coverage="middle", boundary="substring")])


@settings(max_examples=200, deadline=None)
@given(st.lists(ATOMS, max_size=14).map("".join))
def test_invariants(text):
    parts = ENGINE.segment(text)
    assert "".join(s["text"] for s in parts) == text
    assert all(s["text"] for s in parts) or text == ""
    assert all(bool(s["rule_ids"]) == s["covered"] for s in parts)
    cuts = edges(text)
    for _, a, b, c, d in ENGINE.scan(text):
        assert {a, b, c, d} <= set(cuts) and a <= c < d <= b
    assert ENGINE.segment(text) == parts


def test_columns_agree_with_single_texts(spark):
    rnd = random.Random(1)
    texts = [None, "", *("".join(rnd.choice(["the ", "of the ", "fuck ", "f*ck ", "x", " "]) for _ in range(12)) for _ in range(40))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    both = df.select("*", ENGINE.find_and_segment(F.col("text")).alias("b"), ENGINE.find_column(F.col("text")).alias("m"), ENGINE.segment_column(F.col("text")).alias("s"))
    simple = Engine([term_rule("t", ["the", "of the"])])
    both = both.withColumn("native", expr.segments(F.col("text"), expr.merge(expr.full_covers(simple.find_column(F.col("text"))))))
    for r in both.collect():
        if r.text is None:
            assert r.m is None and r.s is None and r.b is None
            continue
        assert [m.asDict() for m in r.m] == ENGINE.find(r.text) == [m.asDict() for m in r.b.matches]
        assert [s.asDict() for s in r.s] == ENGINE.segment(r.text) == [s.asDict() for s in r.b.segments]
        assert [s.asDict() for s in r.native] == simple.segment(r.text)


def test_groups_and_edges(spark):
    e = Engine([term_rule("a", ["one two"]), term_rule("b", ["two three"]), term_rule("c", ["five"])], coverage=lambda c: [(0, 1), (len(c["target_text"]) - 1, len(c["target_text"]))])
    df = spark.createDataFrame([("one two three five",)], "text string").select(relational.disclosure_groups(e.find_and_segment(F.col("text"))).alias("g"))
    groups = df.first().g
    assert [(g.reveal_id, g.match_ids) for g in groups][-1] == ("m2", ["m2"])
    assert [s.edge for s in groups[-1].segments] == ["start", "end"]


def test_plain_characters_fold_alike():
    from spanveil.functions.unicode import fold_plain, plain

    for cp in range(0x300):
        c = chr(cp)
        assert plain(c) and graphemes("a" + c + "b") == [(0, 1), (1, 2), (2, 3)]
        assert fold_plain(c) in (fold(c), None)
    assert fold_plain("É") == "é" and fold_plain("µ") is None


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["the", "THE ", "éa", "ſo", " ", "so", "K", "ask", "\r\n", "İ", "ı", ".", "e" + chr(0x301), "ß"]), max_size=12).map("".join), st.booleans(), st.sampled_from(["word", "substring"]))
def test_plain_texts_scan_as_any_other(text, sensitive, boundary):
    rule = term_rule("t", ["the", "so", "ask", "k", "s", "é", "ß", "éa"], case_sensitive=sensitive, boundary=boundary)
    fast, slow = Engine([rule]), Engine([rule])
    slow._matchers()[0].direct_use = False
    assert fast.find(text) == slow.find(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"fucksht", "f", "u", "*", "(", "1", ".", "-", " ", chr(0x200B), chr(0xFF55), chr(0x441), "K", "ſ", "mother", "shit", "bull", chr(0x301), "tt"]), max_size=14).map("".join))
def test_texts_that_are_passed_over_hold_nothing(text):
    fast, slow = Engine(rules_from_packs(packs.OBFUSCATED)), Engine(rules_from_packs(packs.OBFUSCATED))
    for m in slow._matchers():
        assert m.worth is not None
        m.worth = None
    assert fast.find(text) == slow.find(text)
