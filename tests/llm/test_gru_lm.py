import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from spanveil.llm import gru_lm, queries
from spanveil.llm.gru_lm import CLASSES, END, GRU, HIDDEN
from tests.llm.helpers import AWKWARD, DOCS, awkward, clashing


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows):
    held = [k is None or zlib.crc32(str(k).encode()) % 10 == 0 for k, _ in rows]
    c = Counter(w for (_, t), h in zip(rows, held) if not h for w in [*words(t), None])
    n, v = sum(c.values()), len(c)
    out = []
    for (k, t), h in zip(rows, held):
        all_ = [*words(t), None]
        out.append((k, h, len(all_), sum(c[w] > 0 for w in all_), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in all_)))
    return sorted(out, key=str)


def check(got, rows):
    got = sorted((tuple(r)[:6] for r in got), key=str)
    for a, b in zip(got, brute(rows), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)


def tiny():
    rng = np.random.default_rng(1)
    return GRU.fresh(rng.integers(1, 50, CLASSES * CLASSES).astype(float)), rng


def test_outputs_are_a_distribution():
    gru, rng = tiny()
    h = rng.normal(size=(1, HIDDEN)).astype(np.float32)
    every = np.arange(CLASSES * CLASSES)
    assert np.exp(gru.log_probs(np.repeat(h, len(every), 0), every)).sum() == pytest.approx(1, abs=1e-4)


def test_state_is_carried_through_whole_texts():
    gru, rng = tiny()
    texts = [np.append(rng.integers(0, END, n), END) for n in (0, 3, 31, 32, 33, 200, 1, 90)]

    def plain(t):
        h, last, total = np.zeros((1, HIDDEN), np.float32), np.array([END]), 0.0
        for y in t:
            h = gru.step(gru.wx[last], h)[0]
            last = np.array([y])
            total += float(gru.log_probs(h, last)[0])
        return total

    want = [plain(t) for t in texts]
    for lanes in (1, 3, 256):
        assert gru_lm.whole_texts(gru, texts, lanes) == pytest.approx(want, rel=1e-4)


def test_gradients_are_those_of_the_loss():
    gru, rng = tiny()
    for name in ("wx", "u", "wc", "bc", "wo", "bo"):
        setattr(gru, name, getattr(gru, name).astype(np.float64))
    x, y, h = rng.integers(0, 1024, (5, 3)), rng.integers(0, 1024, (5, 3)), rng.normal(size=(3, HIDDEN))
    fresh = x == x[1, 1]
    _, grads, _ = gru.gradients(x, y, fresh, h)
    for p, g in zip(gru.parts(), grads, strict=True):
        k = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old, sides = p[k], []
        for d in (1e-5, -1e-5):
            p[k] = old + d
            sides.append(gru.gradients(x, y, fresh, h)[0])
        p[k] = old
        assert g[k] == pytest.approx((sides[0] - sides[1]) / 2e-5, rel=1e-4)


@pytest.mark.parametrize("extra", [False, True])
def test_awkward(spark, extra, monkeypatch):
    monkeypatch.setattr(gru_lm, "FREQUENT", 5)
    df = clashing(awkward(spark)) if extra else awkward(spark)
    rows = gru_lm.score(df).collect()
    check(rows, [(k, t) for k, t, *_ in AWKWARD])
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)
    assert gru_lm.score(spark.createDataFrame([], DOCS)).count() == 0


def test_query_on_a_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.op6_gru_lm(spark, sf).collect()
    check(got, rows)
    held = [r for r in got if r.held_out]
    gain = sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held)
    print("gain in log10 per held-out token", gain)
    assert gain > 0.1


def test_every_token_is_trained_on_once(monkeypatch):
    monkeypatch.setattr(gru_lm, "BUFFER", 3_000)
    gru, rng = tiny()
    texts = [np.append(rng.integers(0, END, n), END) for n in (0, 3, 31, 5_000, 32, 33, 200, 1, 900, 2_500, 17)]
    seen = Counter()
    gradients = GRU.gradients

    def spied(self, x, y, fresh, h):
        seen.update(zip(x.ravel().tolist(), y.ravel().tolist()))
        return gradients(self, x, y, fresh, h)

    monkeypatch.setattr(GRU, "gradients", spied)
    run = np.concatenate(texts).tolist()
    assert gru_lm.train_on(gru, iter(texts), 0.01) == len(run)
    assert seen == Counter(zip([END, *run], run))


def test_weights_learn_from_all_training_texts(spark, monkeypatch):
    """With a sample of about one text, held-out texts are still scored well, and the rounds take each training token."""
    monkeypatch.setattr(gru_lm, "SAMPLE", 1)
    took, one = [], getattr(gru_lm, "train_round", None)

    def spied(*args):
        gru, n = one(*args)
        took.append(n)
        return gru, n

    monkeypatch.setattr(gru_lm, "train_round", spied, raising=False)
    got = queries.op6_gru_lm(spark, "/root/testdata/sf0.01").collect()
    held = [r for r in got if r.held_out]
    assert sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held) > 0.1
    assert sum(took) == got[0].train_tokens


def test_windows_share_their_arrays():
    """States are those of single steps, whatever windows came before; a window takes the arrays of the last one."""
    import pickle

    gru, rng = tiny()
    seen = []
    for lanes, steps in ((7, 5), (3, 5), (7, 2)):
        x, h = rng.integers(0, END + 1, (steps, lanes)), rng.normal(size=(lanes, HIDDEN)).astype(np.float32)
        x[steps // 2, 1] = END
        states = gru.run(x, x == END, h)[0]
        seen.append(states)
        for t in range(steps):
            h = gru.step(gru.wx[x[t]], np.where((x[t] == END)[:, None], np.float32(0), h))[0]
            assert states[t] == pytest.approx(h, abs=1e-5)
    assert np.shares_memory(seen[0], seen[1]) and np.shares_memory(seen[0], seen[2])
    assert len(pickle.dumps(gru)) < 1.1 * sum(p.nbytes for p in gru.parts())


def test_ranks_of_words_outside_point_to_their_bucket():
    ranks = gru_lm.Ranks({b"a": 0, b"b": 1})
    assert ranks.of([b"b", b"zebra", b"a", b"7", "é".encode()]).tolist() == [1, -1 - 25, 0, -1 - 26, -1 - gru_lm.bucket("é".encode())]
    assert len(ranks) == 2


def test_words_become_ids_once(spark, monkeypatch):
    """Training reads ids, not texts, and all of them."""
    read, one = [], gru_lm.train_round

    def spied(coded, *args):
        assert coded.columns == ["ids"]
        read.extend(len(r.ids) for r in coded.collect())
        return one(coded, *args)

    monkeypatch.setattr(gru_lm, "train_round", spied)
    got = queries.op6_gru_lm(spark, "/root/testdata/sf0.001").collect()
    assert sum(read) == got[0].train_tokens * gru_lm.ID.itemsize


def test_words_of_odd_texts():
    rng = np.random.default_rng(2)
    odd = ["", None, " ", " a", "  A\t\nB  ", "\x1ca\x1d b\x1e", "\x85x\xa0y z", "é É\x0bÀ\x0c\r", "\0 a\0b", "".join(map(chr, range(300))), "\n\n", "x" * 50 + " 日本 "]
    odd += ["".join(rng.choice(list("aB \t\x0bé日z\x1f09"), n)) for n in rng.integers(0, 12, 500)]
    for texts in (pa.array(odd), pa.array(odd).slice(3, 200), pa.array(odd, pa.large_string()), pa.array([], pa.string()), pa.array([None, ""], pa.string())):
        got, sizes = gru_lm.split(texts)
        want = [words(t) for t in texts.to_pylist()]
        assert sizes.tolist() == [len(w) for w in want] and got.to_pylist() == [x for w in want for x in w]
        distinct = got.dictionary_encode().dictionary.slice(1)
        assert gru_lm.buckets(distinct).tolist() == [gru_lm.bucket(w.encode()) for w in distinct.to_pylist()]


def test_states_that_need_no_way_back_take_one_step_of_each_array():
    gru, rng = tiny()
    x, h = rng.integers(0, END + 1, (9, 5)), rng.normal(size=(5, HIDDEN)).astype(np.float32)
    x[4, 2] = END
    want = gru.run(x, x == END, h)[0].copy()
    states, *rest = gru.run(x, x == END, h, back=False)
    assert np.array_equal(states, want) and all(len(r) == 1 for r in rest)
