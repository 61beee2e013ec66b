"""What Python workers, which outlive stages, keep in memory."""

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from spanveil.llm import byte_bpe, common, exact_dedup, ngram_join, toxicity
from tests.llm.test_ngram_join import brute
from tests.llm.test_tokens import RANKS


def test_a_worker_drops_the_tables_of_other_operators():
    byte_bpe.coder(RANKS)
    common.occupy(byte_bpe.__name__)
    assert byte_bpe.coder.cache_info().currsize == 1
    common.occupy(toxicity.__name__)
    assert byte_bpe.coder.cache_info().currsize == 0


def test_operators_in_turn_give_the_same_results(spark):
    docs = spark.createDataFrame([(1, "some words to encode"), (2, None), (3, "some  words to encode")], "doc_id long, text string").coalesce(1)
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    run = lambda: [sorted(x.collect()) for x in (byte_bpe.digests(docs, RANKS), toxicity.classify(docs, labels).select("doc_id", F.round("score", 9)), exact_dedup.mark(docs), ngram_join.join(docs))]
    assert run() == run()


def test_near_copies_need_no_second_kind_of_workers(spark, monkeypatch):
    """Local rows are made by Python workers under another environment, which stay beside the others."""
    rows = [(i, " ".join(f"w{j}" for j in range(30 + i % 2))) for i in range(80)] + [(100, "alone"), (101, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def refused(*_, **__):
        raise AssertionError("local rows")

    monkeypatch.setattr(SparkSession, "createDataFrame", refused)
    assert sorted(((r[0], r[1], r[2]) for r in ngram_join.join(docs).collect()), key=str) == brute(rows)
