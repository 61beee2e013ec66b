"""Exact duplicates by content-defined chunk recipes.

A text, without its white space, is cut where a hash of the last bytes says so; its recipe is the ordered list of its
chunks' identifiers. An identifier is the chunk's 128-bit hash under a seed for which one job has verified, over all
chunks of the corpus, that no two different chunks share it; if two do, the next seed is tried. So equal recipes are
equal texts. Every distinct chunk moves at most once from each partition, to be verified; from then on only
identifiers move, 16 bytes a chunk, however long the documents are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanveil.llm.common import SPACES, arrow_map, occupy, stored, trim, unused

LEAST, MEAN, MOST = 256, 1024, 8192  # bytes of a chunk
_REACH = 8
_DROP = SPACES.encode()


def squeeze(text: str | None) -> bytes:
    return (text or "").encode().translate(None, _DROP)


def _marks(data: bytes) -> np.ndarray:
    """Positions after which the hash of the last ``_REACH`` bytes allows a cut."""
    h = np.frombuffer(data, np.uint8).astype(np.uint32)
    for reach, factor in ((1, 0x9E3779B1), (2, 0x85EBCA77), (4, 0xC2B2AE3D)):
        h = h[reach:] * np.uint32(factor) + h[:-reach]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x27D4EB2F)
    return np.flatnonzero(h < np.uint32(2**32 // MEAN)) + _REACH


def cut(data: bytes) -> list[bytes]:
    """The chunks of ``data`` in order; none for empty data."""
    end, at, out = len(data), 0, []
    if end > LEAST:
        for to in _marks(data).tolist():
            while to - at > MOST:
                out.append(data[at : at + MOST])
                at += MOST
            if to - at >= LEAST:
                out.append(data[at:to])
                at = to
    while end - at > MOST:
        out.append(data[at : at + MOST])
        at += MOST
    if at < end:
        out.append(data[at:])
    return out


def _unambiguous(docs: DataFrame, text: str, seed: int) -> bool:
    """Whether under ``seed`` no two different chunks of the corpus have one hash."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        occupy(__name__)
        for batch in batches:
            found = {c for t in batch.column(0).to_pylist() if t for c in cut(squeeze(t))}
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(c, seed) for c in found], pa.binary()), pa.array(found, pa.binary())], names=["hash", "chunk"])
        trim()

    distinct = docs.select(F.col(text)).mapInArrow(chunks, "hash binary, chunk binary").distinct()
    return distinct.groupBy("hash").count().where("count > 1").limit(1).count() == 0


def recipes(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_chars, recipe binary, text_sha256) of every row, with verified identifiers."""
    seed = next(s for s in count() if _unambiguous(docs, text, s))

    def run(keys: pa.Array, texts: pa.Array) -> dict:
        out: dict = {"key": keys, "n_chars": [], "recipe": [], "sha": []}
        for t in texts.to_pylist():
            data = squeeze(t)
            out["n_chars"].append(len(t or ""))
            out["recipe"].append(b"".join(xxhash.xxh3_128_digest(c, seed) for c in cut(data)))
            out["sha"].append(hashlib.sha256(data).hexdigest())
        return out

    kind = docs.schema[key].dataType.simpleString()
    return arrow_map(docs, run, f"`{key}` {kind}, n_chars long, recipe binary, text_sha256 string", key, text)


def mark(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256), a row for each row of ``docs``.

    Texts are equal if they are identical without white space; null texts are empty, and empty texts equal each
    other. Of each group the row with the most characters stays, then the smallest key, of whatever type that has an order, nulls last. Rows that repeat
    a key with an equal text are all marked kept if that key stays; ``dedup`` keeps one of them. An empty table gives
    no rows; other columns are not read.

    Groups are aggregated before they meet, and rows join only groups of two or more; a group of any size is a
    skewed join key, which Spark's adaptive execution splits.
    """
    rows = stored(recipes(docs, text, key).withColumnRenamed(key, "key"), "recipes")
    best = F.min(F.struct((-F.col("n_chars")).alias("chars"), F.col("key").isNull().alias("unknown"), "key"))
    groups = rows.groupBy("recipe").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best")).where("group_size > 1")
    groups = stored(groups.select("recipe", "group_size", F.col("best.key").alias("keep"), F.lit(True).alias("shared")), "groups")
    out = rows.join(groups, "recipe", "left")
    keep = F.when(F.col("shared"), F.col("keep")).otherwise(F.col("key"))
    return out.select(F.col("key").alias(key), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.col("key").eqNullSafe(keep).alias("kept"), "text_sha256")


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Columns of any names pass through. Rows leave by an anti join on the keys that go. Keys that are null or repeat can't name a row; their rows, few
    as a rule, are compared by digest and one of each key and text stays.
    """
    k, sha, kept, row = unused(docs, "key", "sha", "kept", "row")
    own, body = F.col(f"`{key}`"), F.col(f"`{text}`")
    marks = stored(mark(docs, text, key), "marks").withColumnRenamed(key, k)
    names = marks.groupBy(k).agg(F.count(F.lit(1)).alias("times"), F.max("kept").alias("stays"))
    odd = names.where(f"times > 1 OR {k} IS NULL").select(k)
    gone = stored(names.where(f"times > 1 OR {k} IS NULL OR NOT stays").select(k, "times"), "gone")
    plain = docs.join(gone.select(k), own.eqNullSafe(F.col(k)), "left_anti")
    if gone.where(f"times > 1 OR {k} IS NULL").limit(1).count() == 0:
        return plain

    again = docs.join(odd, own.eqNullSafe(F.col(k)), "left_semi")
    again = again.withColumn(sha, F.sha2(F.regexp_replace(F.coalesce(body, F.lit("")), r"[\x20\x09-\x0D]", "").cast("binary"), 256))
    stay = marks.where("kept").select(k, F.col("text_sha256").alias(kept)).distinct()
    again = again.join(stay, own.eqNullSafe(F.col(k)) & (F.col(sha) == F.col(kept)), "left_semi")
    order = Window.partitionBy(own, sha).orderBy(F.length(body).desc_nulls_last(), *[F.col(f"`{c}`") for c in docs.columns])
    again = again.withColumn(row, F.row_number().over(order)).where(F.col(row) == 1)
    return plain.unionByName(again.select(*[f"`{c}`" for c in docs.columns]))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(length(text), 0) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS s FROM documents
), g AS (
  SELECT s, count(*) AS group_size, first(doc_id ORDER BY n DESC, doc_id) AS keep_id FROM t GROUP BY s
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(s) AS text_sha256 FROM t JOIN g USING (s)
"""
