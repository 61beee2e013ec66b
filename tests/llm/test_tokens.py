import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spanveil.llm import byte_bpe, queries, token_counts
from spanveil.llm.byte_bpe import coder
from tests.llm.helpers import AWKWARD, DOCS, awkward, clashing

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
JSON = P.path("byte_bpe_50k.json")
BPE = coder(RANKS)
TIK = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=BPE.ranks, special_tokens={})
LIB = Tokenizer.from_file(JSON)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_encoding_equals_merging_by_rank_and_round_trips(text):
    ids = BPE.encode(text)
    assert ids == TIK.encode_ordinary(text)
    assert BPE.decode(ids) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(list(BPE.ranks)), max_size=8))
def test_token_sequences_as_text(tokens):
    text = b"".join(tokens).decode("utf-8", "ignore")
    assert BPE.encode(text) == TIK.encode_ordinary(text)


def test_long_piece_is_linear_and_right():
    text = "ab" * 50_000
    assert BPE.encode(text) == TIK.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_pieces_count_as_the_library(text):
    split = token_counts.pieces(text)
    if split is not None:
        assert "".join(split) == text
        assert sum(token_counts._length(JSON, p) for p in split) == len(LIB.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("extra", [False, True])
def test_counts(spark, extra):
    df = clashing(awkward(spark)) if extra else awkward(spark)
    got = sorted(map(tuple, token_counts.count_tokens(df, JSON).collect()), key=str)
    want = []
    for doc_id, text, *_ in AWKWARD:
        n = len(LIB.encode(text or "", add_special_tokens=False).ids)
        want.append((doc_id, len((text or "").encode()), n, n > 1024))
    assert got == sorted(want, key=str)
    assert token_counts.count_tokens(df.limit(0), JSON).count() == 0


@pytest.mark.parametrize("extra", [False, True])
def test_digests_and_round_trip(spark, extra):
    df = clashing(awkward(spark)) if extra else awkward(spark)
    got = sorted(map(tuple, byte_bpe.digests(df, RANKS).collect()), key=str)
    want = []
    for doc_id, text, *_ in AWKWARD:
        ids = TIK.encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    encoded = byte_bpe.encode(df, RANKS)
    texts = sorted(bytes(r.decoded) for r in byte_bpe.decode(encoded, RANKS).collect())
    assert texts == sorted((t or "").encode() for _, t, *_ in AWKWARD)
    assert byte_bpe.digests(spark.createDataFrame([], DOCS), RANKS).count() == 0


def test_queries_on_a_table(spark, tmp_path):
    awkward(spark).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op8_byte_bpe(spark, str(tmp_path)).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert queries.op9_token_counts(spark, str(tmp_path)).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]


UNSETTLED = "it's \uffff 12\u0378 a\U0001ecff b \u2fe0\u2fe0 \U0003fffd'll \U00031350x y\U00010d40 5"


@pytest.mark.parametrize("text", [UNSETTLED, "\uffff", " \uffff's", UNSETTLED * 50])
def test_unsettled_characters_are_encoded_by_the_operator(text, monkeypatch):
    want, length = TIK.encode_ordinary(text), len(LIB.encode(text, add_special_tokens=False).ids)
    split = byte_bpe.pieces(text, byte_bpe._stand_in)
    assert "".join(split) == text and [i for p in split for i in BPE.ids_of[p]] == want
    encode = tiktoken.Encoding.encode_ordinary
    monkeypatch.setattr(tiktoken.Encoding, "encode_ordinary", lambda self, t: encode(self, t) if len(t) == 1 and self.name == "class" else pytest.fail("whole text"))
    assert BPE.encode(text) == want
    split = token_counts.pieces(text, token_counts._stand_in)
    assert "".join(split) == text and sum(token_counts._length(JSON, p) for p in split) == length


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("a '0s\uffff"), st.characters(categories=["Cn", "Lo", "Nd", "Zs"])), max_size=30))
def test_unassigned_characters_encode_as_the_library(text):
    assert BPE.encode(text) == TIK.encode_ordinary(text)
    assert sum(token_counts._length(JSON, p) for p in token_counts.pieces(text, token_counts._stand_in)) == len(LIB.encode(text, add_special_tokens=False).ids)
