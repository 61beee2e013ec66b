"""N-gram Jaccard join by adaptive multi-match prefixes.

Each document is the set of its five-word shingles; two link when their Jaccard similarity is 0.8 or more. Equal sets
are one class, and the join is between classes.

Shingles have one global order: rare before frequent. A set of n shingles needs at least t = ceil(0.8 n) of them in
common with any partner, so partners share at least l of the first n - t + l. Each class takes its own l, from 1 to
``MOST_MATCHES``: the one with the least estimated cost, counting the postings its prefix meets and the candidates that
can gather l of them. A pair is verified only if it shares as many prefix shingles as its sizes then require: the
overlap needed less what the shingles beyond the prefixes can give. Verification intersects whole sets.

Only components are asked for, so a pair already joined through others needs no verification. Of a class's candidates the
least is verified first, then those whose classes are still apart. A shingle that more than ``LIGHT`` classes have in
their prefix is heavy: pairing them all would be quadratic, and in a family of near copies most of it idle. There each
class is first paired with a hub: the class in which that shingle comes earliest has the fewest shingles of its own, so it
is the middle of the family, and one round joins what is near it. Rounds go on, with other hubs, while they halve
the pairs left across components. What is left is paired by shingle, only across components, and only where the places of the
shingle in the two sets leave room for the overlap that their sizes need: the first shingle that two partners share
stands so early in both. No link is lost.

The order knows which shingles are frequent from bounded summaries of all partitions, and then from the prefixes of all
classes: shingles that are heavy there though the summaries hold none of them join the table, before prefixes are taken
for good. The order decides costs only, never results.

Scale: texts are read in narrow maps that hash whole batches of bytes at a time; what moves is the prefixes, about a
fifth of the shingles at 24 bytes, and the sets of classes that have candidates, once for each pair that a round verifies. Tables of ids and labels are
broadcast while they are small, and shuffled beyond ``BROADCAST_ROWS``.
The table of frequent shingles has ``FREQUENT`` rows at most from each of its two sources. Class keys are 64-bit hashes
that one aggregation verifies against a second hash; if two sets share a key, the next seed is tried. Shingles are
compared by 64-bit hash. Tables that no later step reads are deleted.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanveil.llm.common import arrow_map, discard, occupy, small, stored, trim, unused

WIDTH = 5
LIGHT = 32
MOST_MATCHES = 8
FREQUENT = 262_144
SUMMARY = 8_192
LEAST_FREQUENT = 32
SALT = 4_096  # rows of a heavy shingle in one task
SALTS = 16
_TALLY = 300_000
_CELLS = 1 << 21
_BYTES = 500_000  # of texts that are hashed at a time
_LONG_WORD = 64


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


_rng = np.random.default_rng(5)
_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_VALUES[ord("A") : ord("Z") + 1] = _VALUES[ord("a") : ord("z") + 1]
_POWERS = np.cumprod(np.full(_LONG_WORD, 0x9E3779B97F4A7C15, np.uint64))
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each lower-cased word: a polynomial over byte values, long words by xxhash."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + _BYTES)))
        a, b = starts[at:to], ends[at:to]
        size = np.minimum(b - a, _LONG_WORD)
        first = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(first, size)
        values = _VALUES[data[np.repeat(a, size) + place]] * _POWERS[place]
        out[at:to] = np.add.reduceat(values, first)
        at = to
    out = _mixed(out)
    for i in np.flatnonzero(ends - starts > _LONG_WORD):
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes().lower())
    return out


def sets_of(texts: pa.Array) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles; fewer words than five are one, none give none."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    _, offsets, buffer = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffer, np.uint8)[off[0] : off[-1]] if buffer is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    off = off - off[0]
    if not len(data):
        return [np.zeros(0, np.uint64) for _ in range(len(texts))]
    space = _SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1]
    heads = off[:-1][off[1:] > off[:-1]]
    begins[heads] = ~space[heads]
    closes = ~space
    closes[:-1] &= space[1:]
    closes[heads[1:] - 1] = ~space[heads[1:] - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    w = _word_hashes(data, starts, ends)
    edge = np.searchsorted(starts, off)
    h = np.zeros(max(0, len(w) - WIDTH + 1), np.uint64)
    if len(h):
        h += w[: len(h)]
        for k in range(1, WIDTH):
            h *= np.uint64(0x9E3779B97F4A7C15)
            h += w[k : len(h) + k]
        h = _mixed(h)
    out = []
    for a, b in zip(edge.tolist(), edge[1:].tolist(), strict=False):
        if b - a >= WIDTH:
            s = np.sort(h[a : b - WIDTH + 1])
            new = s[1:] != s[:-1]
            out.append(s if new.all() else np.concatenate([s[:1], s[1:][new]]))
        elif b > a:
            words = b" ".join(data[starts[i] : ends[i]].tobytes().lower() for i in range(a, b))
            out.append(np.array([xxhash.xxh3_64_intdigest(words, b - a)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingles(text: str | None) -> np.ndarray:
    return sets_of(pa.array([text], pa.string()))[0]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of batches of ``_BYTES`` of texts, their last column, or a single longer one."""
    occupy(__name__)
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total, at = np.cumsum(size), 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(total, total[at] - size[at] + _BYTES, "right")))
            yield batch.slice(at, to - at)
            at = to
    trim()


def _class(s: np.ndarray, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes(), seed)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


class Tally:
    """Frequent shingles of all that a task reads, in bounded memory.

    Every shingle counts in one of ``_CELLS`` cells. One whose cell has gathered clearly more than the mean is counted by
    itself from then on, starting from its cell, so that a shingle held once in each batch is found as well.
    """

    def __init__(self):
        self.cells, self.seen = np.zeros(_CELLS, np.int32), 0
        self.tokens, self.times = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, flat: np.ndarray) -> None:
        cell = (flat >> np.uint64(64 - 21)).astype(np.int64)
        self.cells += np.bincount(cell, minlength=_CELLS).astype(np.int32)
        self.seen += len(flat)
        often = flat[self.cells[cell] >= 8 + 4 * self.seen // _CELLS]
        if not len(often):
            return
        new, n = np.unique(often, return_counts=True)
        at = np.searchsorted(self.tokens, new)
        known = np.zeros(len(new), bool)
        if len(self.tokens):
            known = self.tokens[np.minimum(at, len(self.tokens) - 1)] == new
        self.times[at[known]] += n[known]
        fresh = new[~known]
        first = self.cells[(fresh >> np.uint64(64 - 21)).astype(np.int64)].astype(np.int64)
        self.tokens, self.times = np.insert(self.tokens, at[~known], fresh), np.insert(self.times, at[~known], first)
        if len(self.tokens) > _TALLY:
            top = np.sort(np.argsort(-self.times, kind="stable")[: _TALLY // 2])
            self.tokens, self.times = self.tokens[top], self.times[top]

    def top(self) -> tuple[np.ndarray, np.ndarray]:
        top = np.argsort(-self.times, kind="stable")[:SUMMARY]
        return self.tokens[top], self.times[top]


def _describe(docs: DataFrame, text: str, key: str, seed: int) -> DataFrame:
    """A row for each document (key, n, cls, proof), and rows (token, times) of each partition's frequent shingles."""
    kind = docs.schema[key].dataType
    out = f"`key` {kind.simpleString()}, n long, cls long, proof long, token long, times long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        none = lambda n: pa.nulls(n, pa.int64())
        names, last = ["key", "n", "cls", "proof", "token", "times"], None
        for batch in _slices(batches):
            keys, sets = batch.column(0), sets_of(batch.column(1))
            last = keys.type
            if sets:
                tally.add(np.concatenate(sets))
            cls = [_class(s, seed) if len(s) else None for s in sets]
            proof = [xxhash.xxh64_intdigest(s.tobytes()) if len(s) else None for s in sets]
            signed = lambda xs: pa.array([x if x is None or x < 2**63 else x - 2**64 for x in xs], pa.int64())
            yield pa.RecordBatch.from_arrays([keys, pa.array([len(s) for s in sets], pa.int64()), signed(cls), signed(proof), none(len(sets)), none(len(sets))], names=names)
        tokens, times = tally.top()
        if last is not None and len(tokens):
            m = len(tokens)
            yield pa.RecordBatch.from_arrays([pa.nulls(m, last), none(m), none(m), none(m), _signed(tokens), pa.array(times)], names=names)

    return docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).mapInArrow(run, out)


def describe(docs: DataFrame, text: str, key: str) -> tuple[int, DataFrame, np.ndarray]:
    """The verified seed, (key, n, cls) of every row, and the frequent shingles (token, times)."""
    for seed in count():
        found = stored(_describe(docs, text, key, seed), "described")
        rows = found.where("n IS NOT NULL").select("key", "n", "cls", "proof")
        mixed = rows.where("n > 0").groupBy("cls").agg(F.min("proof").alias("a"), F.max("proof").alias("b"), F.min("n").alias("c"), F.max("n").alias("d"))
        if mixed.where("a <> b OR c <> d").limit(1).count() == 0:
            break
        discard(found)
    frequent = found.where("token IS NOT NULL").groupBy("token").agg(F.sum("times").alias("times")).where(F.col("times") >= LEAST_FREQUENT)
    return seed, rows.drop("proof"), _table(frequent)


def _table(frequent: DataFrame) -> np.ndarray:
    """The ``FREQUENT`` most frequent rows (token, times), in the order of tokens."""
    rows = frequent.orderBy(F.desc("times"), "token").limit(FREQUENT).toArrow()
    out = np.zeros(rows.num_rows, [("token", np.uint64), ("times", np.int64)])
    out["token"], out["times"] = rows["token"].to_numpy().astype(np.int64).view(np.uint64), rows["times"].to_numpy()
    return np.sort(out, order="token")


def needed(n: int) -> int:
    """The least overlap of a set of ``n`` with any partner."""
    return (4 * n + 4) // 5


def _needed(n: Column) -> Column:
    return F.floor((F.lit(4) * n + 4) / 5).cast("long")


def _overlap(na: str, nb: str) -> Column:
    """The least overlap of linked sets of ``na`` and ``nb`` shingles: 100 x >= 80 (na + nb - x)."""
    return F.ceil((F.col(na) + F.col(nb)) * 4 / 9)


def _prefixes(batches: Iterator[pa.RecordBatch], frequent: np.ndarray, seed: int) -> Iterator[list[tuple[int, int, np.ndarray, int]]]:
    """For the sets of a slice of texts, but those met before: class, size, longest prefix, and how many of it are not frequent."""
    table, times = frequent["token"].copy(), frequent["times"].copy()
    maybe = np.zeros(_CELLS, bool)
    maybe[(table >> np.uint64(64 - 21)).astype(np.int64)] = True
    seen: set[int] = set()
    for batch in _slices(batches):
        out = []
        for s in sets_of(batch.column(0)):
            if not len(s) or (c := _class(s, seed)) in seen:
                continue
            if len(seen) >= 500_000:
                seen.clear()
            seen.add(c)
            size = min(len(s), len(s) - needed(len(s)) + MOST_MATCHES)
            late = np.flatnonzero(maybe[(s >> np.uint64(64 - 21)).astype(np.int64)])
            if len(late):
                at = np.minimum(np.searchsorted(table, s[late]), len(table) - 1)
                hit = table[at] == s[late]
                late, at = late[hit], at[hit]
            if len(late):
                rare = np.ones(len(s), bool)
                rare[late] = False
                # ties are settled by the token, so that the order is one for all sets
                late = late[np.argsort(times[at], kind="stable")]
                out.append((c, len(s), np.concatenate([s[rare][:size], s[late]])[:size], min(size, int(rare.sum()))))
            else:
                out.append((c, len(s), s[:size], size))
        if out:
            yield out


def _counted(docs: DataFrame, text: str, seed: int, frequent: np.ndarray) -> DataFrame:
    """(token, times) of the shingles that are not in the table and heavy in the prefixes it gives."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _prefixes(batches, shared.value, seed):
            yield pa.RecordBatch.from_arrays([_signed(np.concatenate([s[:rare] for _, _, s, rare in rows]))], names=["token"])

    found = docs.select(F.col(f"`{text}`")).mapInArrow(run, "token long")
    return found.groupBy("token").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") > LIGHT)


def _postings(docs: DataFrame, text: str, seed: int, frequent: np.ndarray) -> DataFrame:
    """(token, cls, n, pos, often) of the longest prefix that a class may take, at least once for each class."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    names = ["token", "cls", "n", "pos", "often"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _prefixes(batches, shared.value, seed):
            sizes = [len(s) for _, _, s, _ in rows]
            cls = np.repeat(np.array([c for c, _, _, _ in rows], np.uint64), sizes)
            n = np.repeat(np.array([n for _, n, _, _ in rows], np.int32), sizes)
            pos = np.concatenate([np.arange(k, dtype=np.int32) for k in sizes])
            often = pos >= np.repeat(np.array([rare for _, _, _, rare in rows], np.int32), sizes)
            yield pa.RecordBatch.from_arrays([_signed(np.concatenate([s for _, _, s, _ in rows])), _signed(cls), pa.array(n), pa.array(pos), pa.array(often)], names=names)

    return docs.select(F.col(f"`{text}`")).mapInArrow(run, "token long, cls long, n int, pos int, often boolean")


def _met(postings: DataFrame) -> DataFrame:
    """Postings whose shingle two classes or more have in their prefix, with ``df`` and whether it is ``heavy``.

    All shingles of the table of frequent ones are heavy, so that their rows can be dealt to ``SALTS`` tasks each; their
    ``df`` is an estimate. The others are counted.
    """
    salt = F.when(F.col("often"), F.pmod(F.xxhash64("cls"), F.lit(SALTS))).otherwise(0).cast("int")
    group = Window.partitionBy("token", "salt")
    rows = postings.withColumn("salt", salt).repartition("token", "salt")
    rows = rows.withColumn("before", F.lag("cls").over(group.orderBy("cls"))).where("before IS NULL OR before <> cls")
    rows = rows.withColumn("df", F.count(F.lit(1)).over(group)).where("df > 1 OR often")
    df = F.when(F.col("often"), F.greatest(F.col("df") * SALTS, F.lit(LIGHT + 1))).otherwise(F.col("df"))
    return rows.select("token", "cls", "n", "pos", df.alias("df"), "often").withColumn("heavy", F.col("df") > LIGHT)


def prefixes(docs: DataFrame, text: str, seed: int, frequent: np.ndarray) -> DataFrame:
    """``_met``, under an order that has late what is frequent in a partition or heavy in the prefixes of all."""
    missed = _table(_counted(docs, text, seed, frequent))
    return stored(_met(_postings(docs, text, seed, np.sort(np.concatenate([frequent, missed]), order="token"))), "met")


def _adapted(met: DataFrame) -> DataFrame:
    """``met`` cut to each class's own prefix, with its length ``len``.

    For l matches, S(l) postings are met in the prefix and at most S(l) / l candidates gather l of them; one posting
    costs 1, one verification a tenth of the set's size.
    """
    base = F.col("n") - _needed(F.col("n"))
    sums = [F.sum(F.when(F.col("pos") < base + k, F.least(F.col("df"), F.lit(LIGHT)) - 1).otherwise(0)).alias(f"s{k}") for k in range(1, MOST_MATCHES + 1)]
    costs = met.groupBy("cls", "n").agg(*sums)
    cost = [(F.col(f"s{k}") * (1 + F.col("n") / (10 * k))).alias("c") for k in range(1, MOST_MATCHES + 1)]
    least = F.array_min(F.array(*(F.struct(c, F.lit(k).alias("k")) for k, c in enumerate(cost, 1))))["k"]
    length = costs.select("cls", F.least(F.col("n"), F.col("n") - _needed(F.col("n")) + least).cast("int").alias("len"))
    return met.join(length, "cls").where("pos < len").drop("often")


def _candidates(posts: DataFrame) -> DataFrame:
    """(a, b), a < b: classes that share a light prefix shingle and may share enough prefix shingles in all."""
    heavy = posts.where("heavy").groupBy("cls").agg(F.count(F.lit(1)).alias("h"))
    light = posts.where("NOT heavy").join(heavy, "cls", "left").withColumn("h", F.coalesce("h", F.lit(0)))
    side = lambda o: light.select("token", F.col("cls").alias(o), *(F.col(c).alias(f"{x}{o}") for c, x in (("n", "n"), ("len", "l"), ("h", "h"))))
    pairs = side("a").join(side("b"), "token").where("a < b AND 5 * least(na, nb) >= 4 * greatest(na, nb)")
    pairs = pairs.groupBy("a", "b", "na", "nb", "la", "lb", "ha", "hb").agg(F.count(F.lit(1)).alias("shared"))
    # what is not in both prefixes lies beyond the one that ends first in the global order
    wanted = _overlap("na", "nb") - F.greatest(F.col("na") - F.col("la"), F.col("nb") - F.col("lb"))
    return pairs.where(F.col("shared") + F.least("ha", "hb") >= wanted).select("a", "b")


def _sets(docs: DataFrame, text: str, key: str, seed: int, keys: DataFrame) -> DataFrame:
    """(cls, tokens) of the documents with the given keys, more than once for a class only where keys repeat."""

    def run(texts: pa.Array) -> dict:
        sets = [s for s in sets_of(texts) if len(s)]
        return {"cls": _signed(np.array([_class(s, seed) for s in sets], np.uint64)), "tokens": [s.view(np.int64) for s in sets]}

    some = docs.select(F.col(f"`{key}`").alias("_k"), F.col(f"`{text}`").alias("text")).join(small(keys), F.col("_k").eqNullSafe(F.col("key")), "left_semi")
    return arrow_map(some, run, "cls long, tokens array<long>", "text", pieces=_slices)


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, link) of each pair, by whole sets; only the sets of these pairs move."""
    pairs = stored(pairs, "pairs")
    n = pairs.count()
    left = sets.join(small(pairs.select(F.col("a").alias("cls")).distinct(), n), "cls", "left_semi")
    right = sets.select(F.col("cls").alias("b"), F.col("tokens").alias("tb")).join(small(pairs, n), "b")
    got = right.join(left.select(F.col("cls").alias("a"), F.col("tokens").alias("ta")), "a")
    same = F.size(F.array_intersect("ta", "tb"))
    got = got.select("a", "b", same.alias("same"), (F.size("ta") + F.size("tb")).alias("sum"))
    out = stored(got.select("a", "b", (F.col("same") * 100 >= (F.col("sum") - F.col("same")) * 80).alias("link")), "verified")
    discard(pairs)
    return out


def components(links: DataFrame) -> DataFrame:
    """(node, label): the least node that each node of ``links`` (a, b) reaches, by neighbours' minima and jumps."""
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    n = labels.count()
    while True:
        near = both.join(small(labels.select(F.col("node").alias("b"), "label"), n), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        new = labels.join(small(near, n), "node").select("node", "label", F.least("label", "near").alias("next"))
        jump = small(labels.select(F.col("node").alias("next"), F.col("label").alias("further")), n)
        new = new.join(jump, "next", "left").select("node", F.least("next", F.coalesce("further", "next")).alias("label"), (F.least("next", F.coalesce("further", "next")) < F.col("label")).alias("moved"))
        new = stored(new, "labels")
        if new.where("moved").limit(1).count() == 0:
            return new.drop("moved")
        labels = new


def _merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """``labels`` after more links: only the components that these join are gone through again."""
    if labels is None:
        return components(links)
    joins = _apart(links, labels, named=True)
    if joins.limit(1).count() == 0:
        return labels
    over = components(joins)
    moved = over.select(F.col("node").alias("label"), F.col("label").alias("to"))
    old = labels.join(small(moved), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return stored(old.unionByName(over.join(small(labels), "node", "left_anti")), "labels")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with each class's component, or the class itself where it has none yet."""
    return rows.join(small(labels.withColumnRenamed("node", "cls")), "cls", "left").withColumn("label", F.coalesce("label", "cls"))


def _apart(pairs: DataFrame, labels: DataFrame, named: bool = False) -> DataFrame:
    """The pairs (a, b, ...) whose ends are not in one component yet; ``named`` gives their components as (a, b)."""
    n = labels.count()
    la, lb = small(labels.select(F.col("node").alias("a"), F.col("label").alias("_la")), n), small(labels.select(F.col("node").alias("b"), F.col("label").alias("_lb")), n)
    out = pairs.join(la, "a", "left").join(lb, "b", "left").withColumns({"_la": F.coalesce("_la", "a"), "_lb": F.coalesce("_lb", "b")}).where("_la <> _lb")
    return out.select(F.col("_la").alias("a"), F.col("_lb").alias("b")) if named else out.drop("_la", "_lb")


def _open(posts: DataFrame, labels: DataFrame) -> tuple[DataFrame, int, int]:
    """Heavy rows (token, cls, n, pos, df, label, top) of shingles whose classes are not all in one component.

    ``top`` is the component that most of a shingle's classes are in. Then how many rows, and how many pairs across
    components, there are. A first shared shingle stands before n - t + 1 in both sets; later places can't be one.
    """
    rows = posts.where("heavy").where(F.col("pos") <= F.col("n") - _needed(F.col("n"))).select("token", "cls", "n", "pos", "df")
    rows = _labelled(rows, labels)
    sizes = rows.groupBy("token", "label").agg(F.count(F.lit(1)).alias("c"))
    sums = sizes.groupBy("token").agg(F.max(F.struct("c", "label"))["label"].alias("top"), F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("q")).where("m * m > q")
    sums = stored(sums, "open-shingles")
    out = stored(rows.join(small(sums.select("token", "top")), "token"), "open")
    m, pairs = sums.agg(F.coalesce(F.sum("m"), F.lit(0)), F.coalesce(F.sum((F.col("m") * F.col("m") - F.col("q")) / 2), F.lit(0.0))).first()
    discard(sums)
    return out, int(m), int(pairs)


def _hubs(rows: DataFrame, used: DataFrame) -> DataFrame:
    """(a, b, hub): each class of open heavy shingles with one of their hubs in another component.

    A shingle has a hub for each band of sizes: the class that was no hub yet in which it stands earliest.
    """
    rows = rows.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25))))
    fresh = rows.join(used, "cls", "left_anti")
    hub = fresh.groupBy("token", "band").agg(F.min(F.struct("pos", "cls", "label")).alias("hub"))
    hub = hub.select("token", "band", F.col("hub.cls").alias("hub"), F.col("hub.label").alias("hub_label"))
    met = rows.join(hub, ["token", "band"]).where("label <> hub_label").groupBy("cls", "hub").agg(F.count(F.lit(1)).alias("shared"))
    # of the hubs that a class meets, the one with which it shares most
    met = met.groupBy("cls").agg(F.max(F.struct("shared", "hub")).alias("m")).select("cls", F.col("m.hub").alias("hub"))
    return met.select(F.least("cls", "hub").alias("a"), F.greatest("cls", "hub").alias("b"), "hub").distinct()


def _left(rows: DataFrame) -> DataFrame:
    """(a, b), a < b: open pairs that a heavy shingle's places allow. Pairs within a shingle's top component are skipped.

    The overlap of two sets is at most what stands before a shared shingle in the one that has less there, the shingle,
    and what stands behind it likewise; for the first shared one, nothing before. Rows of a shingle are cut into salted
    parts of about ``SALT``, and those outside the top component meet each part.
    """
    parts = F.ceil(F.col("df") / SALT).cast("int")
    whole = rows.withColumn("part", F.pmod(F.xxhash64("cls"), parts).cast("int"))
    few = rows.where("label <> top").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    side = lambda df, o: df.select("token", "part", "top", F.col("cls").alias(o), *(F.col(c).alias(f"{x}{o}") for c, x in (("n", "n"), ("pos", "p"), ("label", "y"))))
    pairs = side(few, "a").join(side(whole, "b").drop("top"), ["token", "part"])
    room = _overlap("na", "nb") <= F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    pairs = pairs.where("ya <> yb AND (yb = top OR a < b) AND 5 * least(na, nb) >= 4 * greatest(na, nb)").where(room)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _enough(pairs: DataFrame, posts: DataFrame) -> DataFrame:
    """The pairs (a, b) without a candidate's light shingles that share as many heavy prefix shingles as they need."""
    some = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    lists = posts.where("heavy").join(some, "cls", "left_semi").groupBy("cls", "n", "len").agg(F.collect_list("token").alias("often"))  # at most a prefix
    side = lambda o: lists.select(F.col("cls").alias(o), F.col("n").alias(f"n{o}"), F.col("len").alias(f"l{o}"), F.col("often").alias(f"o{o}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    wanted = _overlap("na", "nb") - F.greatest(F.col("na") - F.col("la"), F.col("nb") - F.col("lb"))
    return both.where(F.size(F.array_intersect("oa", "ob")) >= wanted).select("a", "b")


def join(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_shingles, component_id, cls, label), a row for each row of ``docs``.

    ``component_id`` is the smallest key that links reach, equal sets included; rows without shingles (null, empty or
    wordless texts) are linked with nothing and have their own key. ``cls`` names the set and ``label`` the component;
    both are null for rows without shingles. Null keys take part and are never the smallest unless all are null. Rows that
    repeat are equal sets. Keys may be of any type that has an order. Other columns are not read, whatever their names; a
    very long text is hashed in pieces; an empty table gives no rows.
    """
    return _joined(docs, text, key)[1]


def _joined(docs: DataFrame, text: str, key: str) -> tuple[int, DataFrame]:
    spark = docs.sparkSession
    seed, rows, frequent = describe(docs, text, key)
    met = prefixes(docs, text, seed, frequent)
    posts = stored(_adapted(met), "posts")
    discard(met)
    light = stored(_candidates(posts), "candidates")
    classes = rows.where("n > 0").groupBy("cls").agg(F.min("key").alias("key"))
    involved = light.select(F.col("a").alias("cls")).unionByName(light.select(F.col("b").alias("cls"))).unionByName(posts.where("heavy").select("cls")).distinct()
    wanted = stored(classes.join(involved, "cls", "left_semi").select("key").distinct(), "wanted")
    sets = stored(_sets(docs, text, key, seed, wanted), "sets")
    if sets.count() > wanted.count():  # keys repeat
        sets = stored(sets.dropDuplicates(["cls"]), "sets")
    discard(wanted)

    # no local rows: these would go through Python, in workers beside those of the other stages
    nobody = spark.range(1).select(F.col("id").alias("node"), F.col("id").alias("label")).where(F.lit(False))
    hubs, done = nobody.select(F.col("node").alias("cls")), None
    labels, before = nobody, None
    while True:
        rows_open, m, across = _open(posts, labels)
        # rounds end when few pairs are left, or when the last one joined little of what its shingles hold
        if done is not None and (across <= LIGHT * m // 2 or 2 * across > before):
            break
        star = stored(_hubs(rows_open, hubs), "star")
        hubs = stored(hubs.unionByName(star.select(F.col("hub").alias("cls"))).distinct(), "hubs")
        if done is None:
            least = light.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
            done = _verify(star.select("a", "b").unionByName(least).distinct(), sets)
            labels = _merged(None, done.where("link"))
        else:
            found = _verify(star.select("a", "b").distinct().join(done.select("a", "b"), ["a", "b"], "left_anti"), sets)
            labels = _merged(labels, found.where("link"))
            done = done.unionByName(found)
        discard(rows_open, star)
        before = across
    left = stored(_left(rows_open).join(light, ["a", "b"], "left_anti"), "left")
    more = _apart(light.unionByName(_enough(left, posts)).join(done.select("a", "b"), ["a", "b"], "left_anti"), labels)
    second = _verify(more, sets)
    labels = _merged(labels, second.where("link"))
    discard(sets, posts, light, rows_open, left)

    named = _labelled(classes, labels).select("cls", "key", "label")
    named = stored(named, "classes")
    least_key = named.groupBy("label").agg(F.min("key").alias("component"))
    named = stored(named.select("cls", "label").join(least_key, "label"), "named")
    out = rows.join(named, "cls", "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("key"))
    return seed, out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), "cls", "label")


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each component, the one with the smallest key, and all rows without shingles, with all columns.

    Rows leave by an anti join on keys. Keys that are null or repeat can't name a row; of their rows, few as a rule,
    those whose component they stand for are told apart by a row number. Columns of any names pass through.
    """
    seed, found = _joined(docs, text, key)
    k, c, row = unused(docs, "k", "cls", "row")
    own = F.col(f"`{key}`")
    found = stored(found.select(own.alias(k), "component_id", F.col("cls").alias("_c"), F.col("label").alias("_l")), "joined")
    names = found.groupBy(k).agg(F.count(F.lit(1)).alias("times"), F.min(F.col(k).eqNullSafe(F.col("component_id")).cast("int")).alias("stays"))
    odd = names.where(f"times > 1 OR {k} IS NULL").select(k)
    gone = stored(names.where(f"times > 1 OR {k} IS NULL OR stays = 0").select(k, "times"), "gone")
    plain = docs.join(gone.select(k), own.eqNullSafe(F.col(k)), "left_anti")
    if gone.where(f"times > 1 OR {k} IS NULL").limit(1).count() == 0:
        return plain

    again = docs.join(odd, own.eqNullSafe(F.col(k)), "left_semi")
    kept, kc, kl = unused(docs, "kept", "kept_cls", "kept_label")
    sizes = found.where(F.col(k).eqNullSafe(F.col("component_id"))).select(F.col(k).alias(kept), F.col("_c").alias(kc), F.col("_l").alias(kl)).distinct()

    @F.arrow_udf("long")
    def cls_of(texts: pa.Array) -> pa.Array:
        return pa.array([None if not len(s) else int(np.uint64(_class(s, seed)).view(np.int64)) for s in sets_of(texts)], pa.int64())

    again = again.withColumn(c, cls_of(F.col(f"`{text}`")))
    again = again.join(sizes, own.eqNullSafe(F.col(kept)) & F.col(c).eqNullSafe(F.col(kc)))
    order = Window.partitionBy(kl, kept).orderBy(*[F.col(f"`{x}`") for x in docs.columns])
    again = again.withColumn(row, F.when(F.col(kl).isNull(), 1).otherwise(F.row_number().over(order))).where(F.col(row) == 1)
    return plain.unionByName(again.select(*[f"`{x}`" for x in docs.columns]))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0
), grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM starts
), sizes AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM pairs JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * c >= 80 * (s.n + t.n - c)
), both_ways AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT x AS doc_id, x AS node FROM both_ways UNION SELECT r.doc_id, b.y FROM reach r JOIN both_ways b ON b.x = r.node
), least AS (
  SELECT doc_id, min(node) AS component_id FROM reach GROUP BY doc_id
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(l.component_id, d.doc_id) AS component_id FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN least l USING (doc_id)
"""
