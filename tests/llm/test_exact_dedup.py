import hashlib
import random
import re

import pytest

from spanveil.llm import exact_dedup
from tests.llm.helpers import AWKWARD, DOCS, LONG, awkward, clashing


def brute(rows):
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    out = []
    for doc_id, text, *_ in rows:
        s = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        keep = min(groups[s], key=lambda x: x[:3])[3]
        out.append((doc_id, keep, len(groups[s]), doc_id == keep, hashlib.sha256(s.encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = AWKWARD + [(20, LONG.replace(" ", "\n"), "en", "a", 1), (21, LONG + " ", "en", "z", 1), (22, "x" * 30_000, "en", "a", 1), (23, "x" * 30_001, "en", "a", 1), (9, "Hello world,it's 3 o'clock.", "en", "q", 1)]


@pytest.mark.parametrize("extra", [False, True])
def test_against_brute_force(spark, extra):
    df = spark.createDataFrame(ROWS, DOCS)
    got = exact_dedup.mark(clashing(df) if extra else df)
    assert sorted(map(tuple, got.collect()), key=str) == brute(ROWS)


def test_rows_that_stay(spark):
    rows = ROWS + [ROWS[0], (30, "dup of none", None, None, None), (30, "dup of  none", "x", None, None)]
    df = clashing(spark.createDataFrame(rows, DOCS))
    got = exact_dedup.dedup(df)
    assert got.columns == df.columns
    kept = sorted({(r[0], r[4]) for r in brute(rows) if r[3]}, key=str)
    have = sorted(((r.doc_id, hashlib.sha256(exact_dedup.squeeze(r.text)).hexdigest()) for r in got.collect()), key=str)
    assert have == kept


def test_empty(spark):
    df = spark.createDataFrame([], DOCS)
    assert exact_dedup.mark(df).count() == 0
    assert exact_dedup.dedup(df).count() == 0


def test_chunks_rejoin_and_follow_content():
    rnd = random.Random(3)
    data = bytes(rnd.choice(b"abcdefgh") for _ in range(60_000))
    chunks = exact_dedup.cut(data)
    assert b"".join(chunks) == data and len(chunks) > 20 and max(map(len, chunks)) <= exact_dedup.MOST
    moved = exact_dedup.cut(b"new start " * 40 + data)
    assert len(set(moved) & set(chunks)) > 0.8 * len(chunks)
    assert exact_dedup.cut(b"") == []


def test_next_seed_after_a_clash(spark, monkeypatch):
    tried = []
    real = exact_dedup._unambiguous
    monkeypatch.setattr(exact_dedup, "_unambiguous", lambda d, t, s: tried.append(s) or (s > 0 and real(d, t, s)))
    assert sorted(map(tuple, exact_dedup.mark(awkward(spark)).collect()), key=str) == brute(AWKWARD)
    assert tried == [0, 1]
