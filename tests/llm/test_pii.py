import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanveil.llm import pii, queries
from tests.llm.helpers import AWKWARD, DOCS, awkward, clashing

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(map(int, str(int(c) * (1 + i % 2)))) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = {}
    for kind, rule in RULES.items():
        out[kind] = []
        for m in re.finditer(rule, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out[kind].append(m.span())
    return out


PARTS = st.sampled_from(["a.b", "@", "x-y", ".com", ".", "1.2.3.4", "256.1.1.1", "0001.2.3.255", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111112", "+1 (017) 555-7713", "+", "12", "(", ")", " ", "  ", "-", "é", "😀", "\n", "9807915762804490", "jo@x.y.z@w.v", "%+", "7" * 21])


@settings(max_examples=500, deadline=None)
@given(st.lists(PARTS, max_size=14).map("".join))
def test_base_spans(text):
    assert pii.base_spans(text) == brute(text)


def test_base_on_a_table():
    import duckdb

    for (t,) in duckdb.sql("SELECT text FROM read_parquet('/root/testdata/sf0.01/documents.parquet')").fetchall():
        assert pii.base_spans(t) == brute(t)


def test_long_runs_stay_linear():
    pii.base_spans("a" * 200_000 + "1" * 200_000 + "." * 1000 + "@" * 1000 + "+1" * 50_000)


def test_field_finds_what_it_was_taught():
    crf, rnd = pii.model(), random.Random(4)
    right = wrong = missed = 0
    for _ in range(200):
        tokens, gold = pii._sentence(rnd)
        got = set(crf.decode(tokens))
        right, wrong, missed = right + len(got & set(gold)), wrong + len(got - set(gold)), missed + len(set(gold) - got)
    assert right > 0.85 * (right + missed) and right > 0.9 * (right + wrong)


@pytest.mark.parametrize("text,span", [("call (555) 123-4567 now", ("phone", "(555) 123-4567")), ("host 10[.]2[.]33[.]4", ("ip", "10[.]2[.]33[.]4")), ("4111/1111/1111/1111 paid", ("card", "4111/1111/1111/1111")), ("write to jo.smith at example dot com today", ("email", "jo.smith at example dot com"))])
def test_added_spans(text, span):
    _, spans = pii.find(text, pii.model())
    assert [(k, text[s:e]) for k, s, e in spans] == [span]


def test_plain_numbers_are_left_alone():
    assert pii.find("on 2024-01-02 at 10:30:22 the 12345 of 98765432", pii.model())[1] == []


def test_decoding_is_the_best_segmentation():
    """The dynamic programme against all segmentations of short token lists."""
    crf = pii.model()

    def total(tokens, segments):
        at, before, score = 0, pii._O, 0.0
        spans = {i: (j, k) for i, j, k in segments}
        while at < len(tokens):
            j, k = spans.get(at, (at + 1, pii._O))
            score += crf.moves[before, k] + (crf.score(k, pii._features(tokens, at, j)) if k != pii._O else 0)
            at, before = j, k
        return score

    def every(tokens, at=0):
        if at >= len(tokens):
            yield []
            return
        yield from every(tokens, at + 1)
        for j in range(at + 1, len(tokens) + 1):
            if pii._possible(tokens, at, j):
                for k in range(pii._O):
                    for rest in every(tokens, j):
                        yield [(at, j, k), *rest]

    for text in ("a 12 34567", "x at y dot com", "1.2 3456 78"):
        tokens = pii.tokenize(text)
        best = max(total(tokens, s) for s in every(tokens))
        assert total(tokens, crf.decode(tokens)) == pytest.approx(best)


@pytest.mark.parametrize("extra", [False, True])
def test_scan(spark, extra):
    rows = AWKWARD + [(40, "mail a@b.co 1.2.3.4 +1 (132) 555-1352 4111111111111111 or (555) 123-4567", "en", "a", 1)]
    df = spark.createDataFrame(rows, DOCS)
    got = sorted(pii.scan(clashing(df) if extra else df).collect(), key=lambda r: str(r[0]) + r.spans)
    assert len(got) == len(rows)
    for r in got:
        texts = [t or "" for i, t, *_ in rows if i == r[0]]
        base = brute(texts[0])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(base[k]) for k in RULES]
        said = ",".join(f"{k}:{s}:{e}" for k in RULES for s, e in base[k])
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert set(filter(None, said.split(","))) <= set(r.spans.split(","))
        assert all(texts[0][f.start : f.end] == f.value for f in r.found)
    assert any(f.value == "(555) 123-4567" for r in got for f in r.found)
    assert pii.scan(df.limit(0)).count() == 0


def test_query_columns(spark, tmp_path):
    awkward(spark).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op2_pii(spark, str(tmp_path)).columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]


@pytest.mark.parametrize("text,span", [("ask 8[.]8[.]8[.]8 there", ("ip", "8[.]8[.]8[.]8")), ("host 1 . 1 . 1 . 1 now", ("ip", "1 . 1 . 1 . 1")), ("mail jane at example.com today", ("email", "jane at example.com"))])
@pytest.mark.parametrize("far", [0, 40])
def test_spans_without_two_digits_or_signs(text, span, far):
    text = "some words " * far + text + " other words" * far
    _, spans = pii.find(text, pii.model())
    assert [(k, text[s:e]) for k, s, e in spans] == [span]


def test_at_in_prose_is_no_address():
    assert pii.find("They met at noon. Then she looked at home.Then they left at once", pii.model())[1] == []


FIELD = st.sampled_from(["8[.]8[.]8[.]8", "jane at example.com", "at", "At", " dot ", ".", "@", "1", "22", "(555) 123-4567", "²", "x²", "٣", "é", "_", "\n", " ", "   ", " word", " word" * 9, " " * 300, "a" * 70, "- " * 20, "(at)", "4111/1111/1111/1111"])


@settings(max_examples=150, deadline=None)
@given(st.lists(FIELD, max_size=14).map("".join))
def test_stretches_give_what_the_whole_text_gives(text):
    crf, tokens = pii.model(), pii.tokenize(text)
    offsets = [0]
    for t in tokens:
        offsets.append(offsets[-1] + len(t))
    assert pii.added_spans(text, crf) == [(k, offsets[i], offsets[j]) for i, j, k in crf.decode(tokens)]


def test_lone_numbers_and_words_open_no_stretch():
    """Only four digits without letters between, or signs of an address, are worth decoding."""
    assert pii._windows("in 1 of 22 cases, x12y34\n7 8 9\n10 1 was flat and that été 5 😀 " * 50) == []
    assert pii._windows("call 555 1234 now") and pii._windows("x² ½ ٣٣ ²²") and pii._windows("AT home") and pii._windows("𝟘𝟙 𝟚𝟛")


def test_segments_are_scored_without_feature_strings(monkeypatch):
    crf = pii.model()
    tokens = pii.tokenize("They met at noon. Then 12 34 56 78 9 10 11 12 at home.Then +1 (555) 123-4567. " * 5)
    want = crf.decode(tokens)
    monkeypatch.setattr(pii, "_features", None)
    assert want and crf.decode(tokens) == want


def dense(crf, tokens):
    """The score of the best segmentation, by the whole table over every possible segment with its features."""
    ends, n, O = crf.segments(tokens), len(tokens), pii._O
    best = [[float("-inf")] * O + [0.0]]
    for j in range(1, n + 1):
        options = [[] for _ in range(O)] + [[best[j - 1][b] + crf.moves[b, O] for b in range(O + 1)]]
        for i, features in ends[j]:
            for k in range(O):
                score = crf.score(k, features)
                options[k] += [best[i][b] + crf.moves[b, k] + score for b in range(O + 1)]
        best.append([max(found, default=float("-inf")) for found in options])
    return max(best[n])


def worth(crf, tokens, segments):
    at, before, score, spans = 0, pii._O, 0.0, {i: (j, k) for i, j, k in segments}
    while at < len(tokens):
        j, k = spans.get(at, (at + 1, pii._O))
        score += crf.moves[before, k] + (crf.score(k, pii._features(tokens, at, j)) if k != pii._O else 0)
        at, before = j, k
    return score


TOKENS = st.one_of(FIELD, PARTS, st.sampled_from(["½", "Ⅷ", "x½y", "𝟘", "[at]", "[", "]", "+", ")", "call ", "visa: ", "1234", "0.0.0.0", "00", "dot", "DOT", "com", ".org", "at\n", "\x1c", "1 2 3 4 5 6 7 8 9"]))


@settings(max_examples=400, deadline=None)
@given(st.lists(TOKENS, max_size=16).map("".join))
def test_grown_scores_are_those_of_the_features(text):
    crf, tokens = pii.model(), pii.tokenize(text)
    ends = crf.segments(tokens)
    for j, found in crf.scored(tokens).items():
        features = dict(ends[j])
        for i, scores in found:
            assert scores == pytest.approx([crf.score(k, features[i]) for k in range(pii._O)], abs=1e-9)
    got = crf.decode(tokens)
    assert all(pii._possible(tokens, i, j) for i, j, _ in got)
    assert worth(crf, tokens, got) == pytest.approx(dense(crf, tokens), abs=1e-6)
    offsets = [0]
    for t in tokens:
        offsets.append(offsets[-1] + len(t))
    assert pii.added_spans(text, crf) == [(k, offsets[i], offsets[j]) for i, j, k in got]
