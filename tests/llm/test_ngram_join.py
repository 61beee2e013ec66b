import random
import re

import pytest

from spanveil.llm import ngram_join, queries
from tests.llm.helpers import AWKWARD, DOCS, awkward, clashing


def grams(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}) if w else set()


def brute(rows):
    sets = [grams(t) for _, t in rows]
    post = {}
    for i, s in enumerate(sets):
        for g in s:
            post.setdefault(g, []).append(i)
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in enumerate(sets):
        seen = {}
        for g in s:
            for j in post[g]:
                if j < i:
                    seen[j] = seen.get(j, 0) + 1
        for j, both in seen.items():
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                up[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[root(i)] = min(least.get(root(i), key), key)
    return sorted(((k, len(s), least.get(root(i)) if s else k) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def found(df):
    return sorted(((r[0], r.n_shingles, r.component_id) for r in ngram_join.join(df).collect()), key=str)


def family(rnd, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rnd.randint(0, edits)):
            w[rnd.randrange(len(w))] = f"e{rnd.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def crowd(seed):
    """Families of near copies at all distances, chains, and a common passage."""
    rnd = random.Random(seed)
    word = lambda: f"w{int(rnd.paretovariate(0.5)) % 3000}"
    passage = [word() for _ in range(60)]
    texts = []
    for n, size, edits in ((60, 80, 3), (30, 200, 8), (12, 30, 2), (25, 120, 6)):
        texts += family(rnd, [word() for _ in range(size)], n, edits)
    base = [word() for _ in range(100)]
    for _ in range(3):  # related families, some within reach of each other
        base = family(rnd, base, 1, 5)[0].split()
        texts += family(rnd, base, 15, 2)
    for _ in range(40):
        texts.append(" ".join([word() for _ in range(rnd.randint(0, 25))] + passage + [word() for _ in range(rnd.randint(0, 25))]))
    texts += [" ".join(word() for _ in range(rnd.randint(1, 12))) for _ in range(60)]
    rnd.shuffle(texts)
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("light,least", [(64, 32), (3, 4), (1, 1000)])
def test_against_brute_force(spark, monkeypatch, light, least):
    monkeypatch.setattr(ngram_join, "LIGHT", light)
    monkeypatch.setattr(ngram_join, "LEAST_FREQUENT", least)
    rows = crowd(light)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows)
    assert len({c for _, _, c in want}) < len(rows) - 100
    assert found(df) == want


def test_awkward(spark):
    rows = [(k, t) for k, t, *_ in AWKWARD]
    extra = [(11, "Hello WORLD, it's 3 o'clock."), (12, "a b"), (13, "A B"), (14, "b a"), (None, None)]
    df = clashing(spark.createDataFrame([(*r, None, None, None) for r in rows + extra], DOCS))
    assert found(df) == brute(rows + extra)
    assert found(spark.createDataFrame([], DOCS)) == []


def test_one_of_each_stays(spark):
    rows = [(k, t) for k, t, *_ in AWKWARD] + [(11, "Hello WORLD, it's 3 o'clock."), (30, "p q"), (30, "P q"), (31, "r s"), (31, "t u"), (None, "null KEY"), (None, "alone")]
    df = clashing(spark.createDataFrame([(*r, None, None, None) for r in rows], DOCS))
    got = ngram_join.dedup(df)
    assert got.columns == df.columns
    have = sorted(((r.doc_id, (r.text or "").lower()[:40]) for r in got.collect()), key=str)
    want, seen = [], set()
    for k, t in rows:
        s = frozenset(grams(t))
        if not s:
            want.append((k, (t or "").lower()[:40]))
        elif s not in seen:
            seen.add(s)
            want.append((k, (t or "").lower()[:40]))
    assert have == sorted(want, key=str)
    assert ngram_join.dedup(df.limit(0)).count() == 0


def test_query_equals_brute_force_on_a_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in queries.op1_ngram_join(spark, sf).collect()), key=str)
    assert got == brute(rows)


def test_sql_equals_brute_force():
    import duckdb

    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/sf0.01/documents.parquet')")
    rows = con.sql("SELECT doc_id, text FROM documents").fetchall()
    assert sorted(con.sql(ngram_join.ORACLE).fetchall(), key=str) == brute(rows)
