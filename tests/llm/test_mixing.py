import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from spanveil.llm import exact_dedup, mixing, queries
from tests.llm.compare import same
from tests.llm.helpers import AWKWARD, DOCS, awkward, clashing

SF = "/root/testdata/sf0.001"


def shared(sizes):
    """The repeated sharing as the contract words it, in exact fractions."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        rest = total - sum(capped.values())
        free = {s: w for s, w in weight.items() if s not in capped}
        got = {s: Fraction(rest * w, sum(free.values())) for s, w in free.items()}
        over = {s: 3 * sizes[s] for s in got if got[s] > 3 * sizes[s]}
        if not over:
            return {**capped, **got}
        capped |= over


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1, "c": 1000, "d": 7, None: 3}, {"a": 5}, {"b": 100, "a": 1, "C": 0}, {chr(97 + i): (i * 37) % 11 * 100 for i in range(11)}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    want = shared(sizes)
    assert got.keys() == want.keys()
    for s in want:
        assert got[s] == pytest.approx(float(want[s]), rel=1e-12)
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_query_matches_sql(spark):
    same(queries.op4_mixing(spark, SF), SF, mixing.ORACLE)


@pytest.mark.parametrize("extra", [False, True])
def test_awkward(spark, extra):
    df = clashing(awkward(spark)) if extra else awkward(spark)
    rows = mixing.assign(df).collect()
    assert len(rows) == len(AWKWARD)
    sizes = {}
    for _, text, _, source, _ in AWKWARD:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = shared(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(float(want[r.source]))
        assert 0 <= r.epochs <= 3 and r.taken == r.epochs * r.size and len(r.positions) == r.epochs
        assert all(0 <= p <= 1 for p in r.positions) and sorted(r.positions) == r.positions
    assert mixing.assign(df.limit(0)).count() == 0


def test_training_order(spark):
    docs = clashing(spark.read.parquet(f"{SF}/documents.parquet"))
    docs = docs.unionByName(docs.where("doc_id < 5"))
    places = mixing.assign(docs)
    out = mixing.ordered(docs)
    assert out.columns == docs.columns
    assert out.count() == places.agg(F.sum("epochs")).first()[0]
    want = {(r.doc_id): r.n for r in places.groupBy("doc_id").agg(F.sum("epochs").alias("n")).where("n > 0").collect()}
    assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == want
    # light sources come early, heavy ones late
    order = [r.source for r in out.select("source").collect()]
    weight = {r.source: r.weight for r in mixing.targets(docs.groupBy("source").agg(F.sum(mixing.words(F.col("text"))).alias("source_size"))).collect()}
    half = len(order) // 2
    share = lambda part, w: sum(weight[s] == w for s in part) / len(part)
    assert share(order[:half], 1) > share(order[half:], 1) and share(order[:half], 3) < share(order[half:], 3)


def test_each_source_comes_near_its_target(spark):
    got = mixing.assign(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.max("size").alias("m")).collect()
    assert all(abs(r.t - r.g) <= r.m / 2 + 1 for r in got)


def test_exact_dedup_matches_sql(spark):
    same(queries.op7_exact_dedup(spark, SF), SF, exact_dedup.ORACLE)
