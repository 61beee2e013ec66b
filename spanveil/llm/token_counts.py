"""Token counts by a map-side two-tier lookup.

Tier one is a broadcast table of the lengths, in tokens, of the corpus's most frequent pre-tokens; tier two encodes
what the table lacks through a bounded cache in each Python worker. No pre-token is shuffled: the table is made from
one bounded summary per partition, and counting itself is a narrow map.

Sizes: a summary holds at most ``SUMMARY`` pre-tokens of at most ``LONGEST`` characters, the table ``FREQUENT`` of
them (under 8 MB), whatever the input. The table changes speed only, never a count.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.llm.common import Cache, arrow_map
from spanveil.llm.pretokens import OTHER, STAND_INS, pieces

FREQUENT = 32_768
SUMMARY = 8_192
LONGEST = 64
WORKER_CACHE = 150_000
_COUNTING = 400_000


@lru_cache(maxsize=2)
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _specials(path: str) -> tuple[str, ...]:
    return tuple(x.content for x in _library(path).get_added_tokens_decoder().values())


@lru_cache(maxsize=65536)
def _stand_in(char: str) -> str:
    """A character of the class that the library's patterns give ``char``."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    return next((x for p, x in STAND_INS.items() if not Split(Regex(p), "removed").pre_tokenize_str(char)), OTHER)


def _length(path: str, text: str) -> int:
    return len(_library(path).encode(text, add_special_tokens=False).ids)


def _parts(text: str, specials: tuple[str, ...]) -> tuple[list[str], int]:
    """The ordinary stretches of a text and how many special strings stand between them."""
    parts, found = [text], 0
    for special in specials:
        if special in text:
            cut = [p.split(special) for p in parts]
            found += sum(len(x) - 1 for x in cut)
            parts = [y for x in cut for y in x]
    return parts, found


def frequent_pretokens(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(pretoken, n) of the most frequent pre-tokens of all texts, at most ``FREQUENT`` rows.

    Each partition counts all its pre-tokens in a table that is pruned to its most frequent half when full, and
    returns its ``SUMMARY`` most frequent ones; only these summaries meet.
    """

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        specials = _specials(path)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                for part in _parts(t, specials)[0] if t else ():
                    seen.update(pieces(part, _stand_in))
                if len(seen) > _COUNTING:
                    seen = Counter(dict(seen.most_common(_COUNTING // 2)))
        top = [(w, n) for w, n in seen.most_common(SUMMARY) if len(w) <= LONGEST]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["pretoken", "n"])

    found = docs.select(F.col(text)).mapInArrow(summarise, "pretoken string, n long")
    return found.groupBy("pretoken").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "pretoken").limit(FREQUENT)


class _Lengths(Cache):
    """Tier two in front of tier one's misses."""

    def __init__(self, path: str):
        super().__init__(lambda piece: _length(path, piece), WORKER_CACHE)


@lru_cache(maxsize=2)
def _worker(path: str) -> _Lengths:
    return _Lengths(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row.

    ``path``: a file of the tokenizers library. Null texts count as empty: 0 bytes and tokens. Special strings in a
    text count as one token each, as the library does by default. Rows repeat as they come; null keys are kept;
    other columns, whatever their names, are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    top = [r[0] for r in frequent_pretokens(docs, path, text).collect()]  # at most FREQUENT short strings
    shared = spark.sparkContext.broadcast({w: _length(path, w) for w in top})

    def count(keys: pa.Array, texts: pa.Array) -> dict:
        first, cache, specials = shared.value, _worker(path), _specials(path)
        n_bytes, n_tokens = [], []
        for t in texts.to_pylist():
            t = t or ""
            n_bytes.append(len(t.encode()))
            parts, n = _parts(t, specials)
            for part in parts:
                split = pieces(part, _stand_in)
                found = list(map(first.get, split))
                if None in found:
                    n += sum(f if f is not None else cache[p] for f, p in zip(found, split, strict=True))
                else:
                    n += sum(found)
            n_tokens.append(n)
        return {"key": keys, "n_bytes": n_bytes, "n_tokens": n_tokens, "over": [n > limit for n in n_tokens]}

    kind = docs.schema[key].dataType.simpleString()
    return arrow_map(docs, count, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean", key, text)
