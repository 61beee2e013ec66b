"""Byte-level BPE encoding and decoding in linear time.

Bytes are mapped to Latin-1 characters, so that one Aho-Corasick automaton over all tokens finds, for each position of
a piece, the longest token that starts there. The encoder takes longest matches from left to right and accepts a token
only if it can stand beside the one before: undoing the merges of both across their border must never meet a merge
that would have joined them earlier. If no token fits, it steps back; a position that was left so is never entered
again, which bounds the work by the piece's length. The answer on each pair of tokens is memoised. The result is the
very sequence that merging by rank gives.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from spanveil.llm.common import Cache, arrow_map, droppable
from spanveil.llm.pretokens import OTHER, STAND_INS, pieces

PIECE_CACHE = 200_000
PAIR_CACHE = 300_000


class ByteBPE:
    """One rank file's encoder and decoder."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.ranks = ranks
        self.names = [""] * (max(ranks.values()) + 1)
        self.bytes = [b""] * len(self.names)
        for raw, rank in ranks.items():
            self.bytes[rank], self.names[rank] = raw, str(rank)
        self.by_text = {raw.decode("latin-1"): rank for raw, rank in ranks.items()}
        self._prepare()
        self.fits = Cache(self._fits, PAIR_CACHE)
        self.ids_of = Cache(self._piece, PIECE_CACHE, 64)

    def _prepare(self) -> None:
        """Halves of each token, the token of each pair of halves, and each token's longest proper prefix token."""
        halves: dict[int, tuple[int, int]] = {}
        joined: dict[tuple[int, int], int] = {}
        prefix: dict[int, int] = {}
        self.halves, self.joined, self.prefix = halves, joined, prefix
        reach = {}
        for text, rank in sorted(self.by_text.items(), key=lambda x: x[1]):
            for cut in range(len(text) - 1, 0, -1):
                head = self.by_text.get(text[:cut])
                if head is None or head > rank:
                    continue
                tail = self.by_text.get(text[cut:])
                if tail is not None and tail < rank and head in reach and tail in reach and self._fits((head, tail)):
                    halves[rank], joined[head, tail] = (head, tail), rank
                    break
            if rank in halves or len(text) == 1:
                reach[rank] = text
        found = ahocorasick.Automaton()
        for rank, text in reach.items():
            found.add_word(text, (rank, len(text)))
            prefix[rank] = next((r for c in range(len(text) - 1, 0, -1) if (r := self.by_text.get(text[:c])) in reach), -1)
        found.make_automaton()
        self.length = {rank: len(text) for rank, text in reach.items()}
        self.matches = found.iter

    def _fits(self, pair: tuple[int, int]) -> bool:
        """Whether merging by rank leaves a border between these two tokens.

        Both are taken apart along the border, latest merge first. A merge across it wins if it comes before the
        merge that was undone last.
        """
        left, right = pair
        halves, joined = self.halves, self.joined
        before = len(self.names)
        while True:
            across = joined.get((left, right))
            if across is not None and across < before:
                return False
            open_left, open_right = left in halves, right in halves
            if not open_left and not open_right:
                return True
            # equal ranks: the left one is merged first, so the right one is undone first, and may still lose to it
            if open_left and (left > right or not open_right):
                before, left = left, halves[left][1]
            else:
                before, right = right + 1, halves[right][0]

    def _piece(self, piece: str) -> tuple[int, ...]:
        """The ids of one piece; a piece that is itself a token is that token."""
        text = piece.encode().decode("latin-1")
        whole = self.by_text.get(text)
        if whole is not None:
            return (whole,)
        longest = [-1] * len(text)
        for end, (rank, n) in self.matches(text):
            longest[end - n + 1] = rank
        length, prefix, fits, end = self.length, self.prefix, self.fits, len(text)
        barred = bytearray(end + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < end:
            while token >= 0:
                to = at + length[token]
                if not barred[to] and (not out or fits[out[-1], token]):
                    break
                token = prefix[token]
            if token >= 0:
                out.append(token)
                at = to
                token = longest[at] if at < end else -1
            else:
                barred[at] = 1
                token = out.pop()
                at -= length[token]
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        split = pieces(text, _stand_in)
        return list(chain.from_iterable(map(self.ids_of.__getitem__, split)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


@lru_cache(maxsize=1)
def _classes() -> list:
    """Encodings of the reference library that leave out all but one class of characters."""
    import tiktoken

    return [(tiktoken.Encoding("class", pat_str=p, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={}), x) for p, x in STAND_INS.items()]


@lru_cache(maxsize=65536)
def _stand_in(char: str) -> str:
    """A character of the class that the reference library gives ``char``; the library splits, it encodes nothing."""
    return next((x for own, x in _classes() if own.encode_ordinary(char)), OTHER)


@lru_cache(maxsize=2)
def coder(path: str) -> ByteBPE:
    return ByteBPE(path)


droppable(__name__, coder.cache_clear)


def encode(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids array<int>) of every row; null texts are empty and give an empty list.

    Null keys and repeated rows stay as they are, other columns are not read, an empty table gives no rows.
    """

    def run(keys: pa.Array, texts: pa.Array) -> dict:
        bpe = coder(path)
        return {"key": keys, "ids": [bpe.encode(t or "") for t in texts.to_pylist()]}

    kind = docs.schema[key].dataType.simpleString()
    return arrow_map(docs, run, f"`{key}` {kind}, ids array<int>", key, text)


def decode(encoded: DataFrame, path: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """(key, decoded binary) of every row of ids; null lists give empty bytes."""

    def run(keys: pa.Array, lists: pa.Array) -> dict:
        bpe = coder(path)
        return {"key": keys, "decoded": [bpe.decode(x or []) for x in lists.to_pylist()]}

    kind = encoded.schema[key].dataType.simpleString()
    return arrow_map(encoded, run, f"`{key}` {kind}, decoded binary", key, ids)


def digests(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): every text encoded, and its ids decoded again, in one pass."""

    def run(keys: pa.Array, texts: pa.Array) -> dict:
        bpe = coder(path)
        out: dict = {"key": keys, "n": [], "ids": [], "decoded": []}
        for t in texts.to_pylist():
            ids = bpe.encode(t or "")
            out["n"].append(len(ids))
            out["ids"].append(hashlib.sha256(",".join(map(bpe.names.__getitem__, ids)).encode()).hexdigest())
            out["decoded"].append(hashlib.sha256(bpe.decode(ids)).hexdigest())
        return out

    kind = docs.schema[key].dataType.simpleString()
    return arrow_map(docs, run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", key, text)
