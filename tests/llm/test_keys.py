"""Text keys, the least long, and one key on many rows."""

import pytest
from pyspark.sql import functions as F

from spanveil.llm import exact_dedup, mixing, ngram_join, toxicity
from tests.llm.helpers import clashing
from tests.llm.test_ngram_join import brute

ROWS = [("b", "one two three four five six"), ("a", "one two three  four five six"), ("c", "another text"), ("d", ""), (None, "another text"), ("e", None)]


def test_text_keys(spark):
    docs = clashing(spark.createDataFrame(ROWS, "doc_id string, text string"))
    kept = {r.doc_id: r.keep_id for r in exact_dedup.mark(docs).collect()}
    assert kept == {"a": "a", "b": "a", "c": "c", None: "c", "d": "d", "e": "d"}
    assert sorted(r.doc_id for r in exact_dedup.dedup(docs).collect()) == ["a", "c", "d"]
    got = sorted(((r[0], r[1], r[2]) for r in ngram_join.join(docs).collect()), key=str)
    assert got == brute(ROWS)
    assert sorted(r.doc_id for r in ngram_join.dedup(docs).collect()) == ["a", "c", "d", "e"]


def test_least_long(spark):
    docs = spark.createDataFrame([(-(2**63), "same"), (5, "same")], "doc_id long, text string")
    assert {r.keep_id for r in exact_dedup.mark(docs).collect()} == {-(2**63)}


@pytest.mark.parametrize("key", ["7", "NULL"])
def test_one_key_on_many_rows(spark, key):
    docs = spark.range(30_000, numPartitions=4).selectExpr(f"CAST({key} AS long) AS doc_id", "concat('t', id % 50, ' word w', id % 50) AS text", "'s' AS source", "0 AS n_chars")
    labels = spark.createDataFrame([(7, 1), (8, 0)], "doc_id long, toxic int")
    assert exact_dedup.dedup(docs).count() == 50
    assert ngram_join.dedup(docs).count() == 50
    assert toxicity.classify(docs, labels).count() == 30_000
    taken = mixing.assign(docs).agg(F.sum("taken"), F.max("target")).first()
    assert abs(taken[0] - taken[1]) <= 2
    assert mixing.ordered(docs).count() == mixing.assign(docs).agg(F.sum("epochs")).first()[0]


def test_a_passage_in_unlike_texts(spark):
    """One passage in a third of the texts, some of them mostly that passage; each text is in a batch of its own task."""
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"{passage} " + " ".join(f"x{i}y{j}" for j in range(3 + i % 40)) if i % 3 == 0 else " ".join(f"z{i}y{j}" for j in range(30))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    assert sorted(((r[0], r[1], r[2]) for r in ngram_join.join(docs).collect()), key=str) == brute(rows)
