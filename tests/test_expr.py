"""The column expressions against the engine's own results, on texts beyond U+FFFF and with combining marks."""

import random

import pytest
from pyspark.sql import functions as F

from spanveil.operators import expr, relational
from spanveil.operators.engine import Engine, merged, partition
from spanveil.operators.rules import term_rule
from spanveil.functions.unicode import graphemes, utf16_offsets
from spanveil.sources import corpus

PIECES = ["the", "The", "tété", "tété", "\U0001f600", "\U0001f468‍\U0001f469‍\U0001f467", "\U0001f1eb\U0001f1f7", "한글", "한", "a", "of", " ", " ", " ", "\r\n", "ẍ́", "\U00010437ab", "é"]
TERMS = ["the", "tété", "of", "\U0001f600", "\U00010437ab", "of the", "ẍ́", "\U0001f468‍\U0001f469‍\U0001f467"]


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(4)
    return ["", None, "\U0001f600 the cat", "the \U0001f600"] + ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(1, 25))) for _ in range(300)]


@pytest.fixture(scope="module")
def rows(spark, texts):
    engine = Engine([term_rule("words", TERMS, boundary="substring")])
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    return df.select("id", "text", engine.find_column(F.col("text")).alias("m")).cache()


def engine_of(coverage):
    return Engine([term_rule("words", TERMS, boundary="substring")], coverage=coverage)


@pytest.mark.parametrize("preset", ["full", "tail", "inner", "middle"])
def test_covers_and_segments(rows, texts, preset):
    engine = engine_of(preset)
    parts = expr.segments(F.col("text"), expr.merge(expr.preset_covers(F.col("m"), preset)))
    for r in rows.select("id", parts.alias("s"), expr.masked(parts, "asterisk").alias("mask"), expr.restored(parts).alias("back")).collect():
        text = texts[r.id]
        if text is None:
            continue
        want = engine.segment(text)
        assert [s.asDict() for s in r.s] == want, text
        assert r.back == text
        assert r.mask == "".join("*" * len(graphemes(s["text"])) if s["covered"] else s["text"] for s in want)


def test_splice_and_inverse(rows, texts):
    engine = engine_of("full")
    ranges = expr.merge(expr.target_ranges(F.col("m"), "match"))
    for r in rows.select("id", expr.spliced(F.col("text"), ranges, "#").alias("c"), relational.inverse_segments(F.col("text"), F.col("m")).alias("inv")).collect():
        text = texts[r.id]
        if text is None:
            continue
        assert r.c == "".join("#" if s["covered"] else s["text"] for s in partition(text, merged(engine.covers(text, engine.scan(text)))))
        assert "".join(s.text for s in r.inv) == text
        at = utf16_offsets(text)
        kept = {(at(m[1]), at(m[2])) for m in engine.scan(text)}
        assert all(any(s.start <= a and b <= s.end for s in r.inv if not s.covered) for a, b in kept)


def test_corpus_offsets_are_utf16(spark):
    m = [("words", "p", "the", 3, 6, "the", 3, 6)]
    match = "array<struct<ruleId:string,packId:string,text:string,start:int,end:int,targetText:string,targetStart:int,targetEnd:int>>"
    df = spark.createDataFrame([("p", "a", "\U0001f600 the cat", "x", m, ["t"]), ("p", "b", "\U0001f600 the cat", "x", [("words", "p", "the", 2, 5, "the", 2, 5)], ["t"])], f"package string, id string, text string, profile string, matches {match}, tags array<string>")
    assert [(r.id, r.problem) for r in corpus.violations(df).collect()] == [("b", "text is not as declared")]
