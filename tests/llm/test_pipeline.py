import hashlib
import re
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from spanveil.llm import mixing, toxicity
from tests.llm.helpers import AWKWARD, DOCS, awkward, clashing
from tests.llm.test_exact_dedup import brute as equal_texts
from tests.llm.test_mixing import shared
from tests.llm.test_ngram_join import brute as near_texts
from tests.llm.test_tokens import TIK


def test_each_stage_against_brute_force(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in docs.collect()]
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = [tuple(r) for r in docs.collect()]
        if k < 4:
            assert docs.columns == columns
        if name == "toxicity":
            labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
            model = toxicity.train(spark.read.parquet(f"{sf}/documents.parquet").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2), spark.read.parquet(f"{sf}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2))
            score = model.scorer()
            assert sorted(after) == sorted(r for r in before if score(r[1]) < toxicity.THRESHOLD)
            gone = {r[0] for r in before} - {r[0] for r in after}
            assert gone and sum(labels.get(i) == 0 for i in gone) <= 0.05 * len(labels)
        elif name == "exact_dedup":
            keep = {r[0] for r in equal_texts(before) if r[3]}
            assert sorted(after) == sorted(r for r in before if r[0] in keep) and len(after) < len(before)
        elif name == "ngram_join":
            keep = {r[0] for r in near_texts([(r[0], r[1]) for r in before]) if r[0] == r[2]}
            assert sorted(after) == sorted(r for r in before if r[0] in keep) and len(after) < len(before)
        elif name == "mixing":
            times = Counter(after)
            assert set(times) <= set(before) and max(times.values()) <= 3
            size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
            sizes, taken, largest = Counter(), Counter(), Counter()
            for r in before:
                sizes[r[3]] += size(r[1])
                largest[r[3]] = max(largest[r[3]], size(r[1]))
            for r in after:
                taken[r[3]] += size(r[1])
            want = shared(dict(sizes))
            assert all(abs(taken[s] - float(want[s])) <= largest[s] / 2 + 1 for s in want)
        else:
            digest = lambda t: hashlib.sha256(",".join(map(str, TIK.encode_ordinary(t or ""))).encode()).hexdigest()
            assert sorted((r[0], r[2], r[3]) for r in after) == sorted((r[0], digest(r[1]), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in before)


def test_awkward_documents_pass_through(spark, tmp_path):
    rows = AWKWARD + [(7, AWKWARD[8][1], "en", "a", 5), (None, "null key", None, None, None), (50, "one of many words here", "en", "a", 1), (50, "one of many words here", "en", "a", 1), (50, "another text of the same key", None, None, None)]
    docs = clashing(spark.createDataFrame(rows, DOCS))
    spark.createDataFrame([(1, 0, 0), (7, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        docs = out
    assert corpus_pipeline.encode(spark, docs, str(tmp_path)).count() == docs.count() > 0
    empty = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_order_is_range_sorted(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    first = {r.doc_id: r.positions[0] for r in mixing.assign(docs).where("epochs > 0").collect()}
    last = {r.doc_id: r.positions[-1] for r in mixing.assign(docs).where("epochs > 0").collect()}
    got = [r.doc_id for r in mixing.ordered(docs).select("doc_id").collect()]
    seen, highest = Counter(), 0.0
    for d in got:
        seen[d] += 1
        if seen[d] == 1:
            assert first[d] >= highest - 1e-12
            highest = max(highest, first[d])
    assert set(seen) == set(last)
