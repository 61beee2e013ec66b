import zlib

import numpy as np
import pytest

from spanveil.llm import queries, toxicity
from tests.llm.helpers import AWKWARD, DOCS, awkward, clashing


def auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg])


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op3_toxicity(spark, sf).collect()
    assert len(rows) == 10_000
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    insults = {b"trash", b"pathetic", b"idiot", b"disgusting", b"worthless", b"stupid", b"clown", b"loser", b"scum", b"moron"}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [(r.score, toxic[r.doc_id]) for r in rows if r.held_out and r.doc_id in toxic]
    marked = [(s, y) for (s, y), r in zip(held, [r for r in rows if r.held_out and r.doc_id in toxic]) if not y or toxicity.words(text[r.doc_id]) & insults]
    print("auc", auc(held), "auc of worded", auc(marked))
    assert auc(held) > 0.6 and auc(marked) > 0.98
    assert np.mean([s >= 0.3 for s, y in marked if y]) > 0.95
    assert np.mean([s >= 0.3 for s, y in held if not y]) < 0.03


def test_risk_is_corrected_by_the_prior():
    rng = np.random.default_rng(5)
    doc = lambda bad: np.array(sorted({*rng.integers(100, 400, 30)} | ({int(rng.integers(0, 5))} if bad else set())), np.int32)
    model = toxicity.fit([doc(True) for _ in range(300)], [doc(k % 10 == 0) for k in range(3000)], 0.1, decay=1e-5)
    weight = dict(zip(model.slots.tolist(), model.weights.tolist(), strict=True))
    sig = lambda z: 1 / (1 + np.exp(-z))
    assert all(sig(model.bias + weight[k]) > 0.8 for k in range(5)) and sig(model.bias) < 0.1


@pytest.mark.parametrize("extra", [False, True])
def test_awkward(spark, extra):
    df = clashing(awkward(spark)) if extra else awkward(spark)
    labels = spark.createDataFrame([(1, 1, 1), (2, None, None), (None, 1, 1), (6, 0, 0), (6, 1, 1), (7, 1, 0)], "doc_id long, quality int, toxic int")
    for lab in (clashing(labels), labels.limit(0)):
        rows = toxicity.classify(df, lab).collect()
        assert len(rows) == len(AWKWARD) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
    assert toxicity.classify(spark.createDataFrame([], DOCS), labels).count() == 0
    kept = toxicity.clean(df, labels.limit(0))
    assert kept.columns == df.columns and kept.count() == len(AWKWARD)
