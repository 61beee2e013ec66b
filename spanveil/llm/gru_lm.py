"""A gated recurrent language model with a class-factored output.

Tokens are lower-cased words and one end for each text. The model's output vocabulary is the most frequent words, the
end, and buckets that stand for all other words by their letters: ``CLASSES`` classes of ``CLASSES`` outputs, so that a
probability is that of the class by that of the output within it. A word outside the vocabulary then has its bucket's
probability by its share of the bucket's smoothed counts, so that all words, seen or not, have one proper distribution.

Counts are of all training texts: each task counts the words of a few megabytes at once, and words meet in one aggregation. The
recurrent weights are trained in numpy, by backpropagation cut at windows of ``WINDOW`` steps, on all training texts.
They start from ``UPDATES`` steps on a sample of ``SAMPLE`` texts; then each training text belongs to one of ``ROUNDS``
rounds by a hash. In a round every task goes on from the same weights over each token of its texts, and the weights of
all tasks are averaged by their tokens, so updates grow with the input. Words become ids once, in a stored table that
training and scoring read. Texts are scored whole: they are dealt to lanes that run side by
side, a window at a time, and each lane carries its state from window to window to the end of its text.

Scale: weights are summed in ``CHUNKS`` parts where they meet, and the driver takes one model a round. The counts of the ``FREQUENT`` most frequent words are broadcast (under 8 MB); rarer words leave the texts as (row,
word, times), join the counts by word and come back as one sum for each row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.llm.common import discard, fold, stored

CLASSES = 32
BUCKETS = 31
WORDS = CLASSES * CLASSES - BUCKETS - 1  # of the vocabulary; then the end and the buckets
END = WORDS
ID = np.dtype("<u2")  # of stored ids
HIDDEN = 32
WINDOW = 32
SAMPLE = 2_000
UPDATES = 400
ROUNDS = 4
CHUNKS = 32
RATE = 0.02  # of the first round; the last has a quarter
TRAINED = 256  # lanes of training: as many as keep a step's arrays in a core's cache
BUFFER = 262_144  # tokens that a training task gathers before it deals them to lanes
LANES = 256
SCORED = 4_096  # rows scored side by side
SCORED_BYTES = 4 << 20  # of their ids, or of texts that are encoded together
FREQUENT = 131_072
LONGEST = 48  # bytes of a word in the broadcast table
TALLIED = 32 << 20  # bytes of words that a task counts at once


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts on end, A-Z lower-cased, and the number of words of each text; only ASCII letters and white space matter."""
    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    lists = pc.ascii_split_whitespace(trimmed)
    sizes = np.where(pc.binary_length(trimmed).to_numpy() > 0, lists.value_lengths().to_numpy(), 0)
    words = lists.flatten()
    return (words if sizes.sum() == len(words) else words.filter(pc.greater(pc.binary_length(words), 0))), sizes  # an empty text has an empty word


def bucket(word: bytes) -> int:
    """Of the buckets for words outside the vocabulary: by first letter, or by last byte if not all ASCII."""
    if not word.isascii():
        return 27 + word[-1] % 4
    first = word[0] - 97
    return first if 0 <= first < 26 else 26


def buckets(words: pa.Array) -> np.ndarray:
    """``bucket`` of each of an array of words."""
    _, offsets, data = words.cast(pa.binary()).buffers()
    if not len(words):
        return np.zeros(0, np.int64)
    edge = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(data, np.uint8)
    first, last = data[edge[:-1]].astype(np.int64) - 97, data[edge[1:] - 1].astype(np.int64)
    high = np.concatenate([[0], np.cumsum(data[edge[0] : edge[-1]] > 127)])[edge - edge[0]]
    return np.where(np.diff(high) > 0, 27 + last % 4, np.where((first >= 0) & (first < 26), first, 26))


class Ranks:
    """Places of the frequent words, most frequent first; another word's is -1 less its bucket, from the end of a table."""

    def __init__(self, words: Iterable[bytes]):
        self.words = pa.array(words, pa.binary())

    def __len__(self) -> int:
        return len(self.words)

    def of(self, words: pa.Array | list[bytes]) -> np.ndarray:
        words = words.cast(pa.binary()) if isinstance(words, pa.Array) else pa.array(words, pa.binary())
        places = pc.index_in(words, value_set=self.words)
        outside = places.is_null()
        out = places.fill_null(0).to_numpy().astype(np.int64)
        out[outside.to_numpy(zero_copy_only=False)] = -1 - buckets(words.filter(outside))
        return out


@dataclass
class GRU:
    """Weights: input rows by token, recurrent, class and word outputs with biases."""

    wx: np.ndarray
    u: np.ndarray
    wc: np.ndarray
    bc: np.ndarray
    wo: np.ndarray
    bo: np.ndarray
    _space: dict[str, np.ndarray] = field(default_factory=dict, repr=False, compare=False)

    def __reduce__(self):
        return GRU, tuple(self.parts())

    def space(self, name: str, *shape: int) -> np.ndarray:
        """An array that the next window takes again: fresh pages would cost as much as what is computed in them."""
        size = int(np.prod(shape))
        held = self._space.get(name)
        if held is None or held.size < size or held.dtype != self.wx.dtype:
            held = self._space[name] = np.empty(size, self.wx.dtype)
        return held[:size].reshape(shape)

    @staticmethod
    def fresh(counts: np.ndarray, seed: int = 3) -> GRU:
        """Small random weights, with biases that give the counts' distribution."""
        rng, n, h = np.random.default_rng(seed), CLASSES * CLASSES, HIDDEN
        make = lambda *s: (rng.normal(size=s) * 0.1).astype(np.float32)
        mass = (counts + 0.5).reshape(CLASSES, CLASSES).T  # id = index * CLASSES + class
        bc = np.log(mass.sum(1) / mass.sum()).astype(np.float32)
        bo = np.log(mass / mass.sum(1, keepdims=True)).astype(np.float32)
        return GRU(make(n, 3 * h), make(h, 3 * h), make(h, CLASSES), bc, make(CLASSES, h, CLASSES), bo)

    def parts(self) -> list[np.ndarray]:
        return [self.wx, self.u, self.wc, self.bc, self.wo, self.bo]

    def step(self, a: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """The state after ``h``, with gates, candidate and the recurrent part of it; ``a`` are rows of ``wx``."""
        g, n = h @ self.u, HIDDEN
        zr = a[:, : 2 * n] + g[:, : 2 * n]
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        z, gn = zr[:, :n], g[:, 2 * n :]
        new = zr[:, n:] * gn
        new += a[:, 2 * n :]
        np.tanh(new, out=new)
        out = h - new
        out *= z
        out += new
        return out, zr, new, gn

    def run(self, x: np.ndarray, fresh: np.ndarray, h: np.ndarray, back: bool = True) -> tuple[np.ndarray, ...]:
        """All steps of a window: the states after them, (steps, lanes, features), and for each step the state before, gates,
        candidates and the recurrent part of these, which only the way ``back`` needs.

        ``x`` and ``fresh`` are (steps, lanes), ``h`` is (lanes, features). What is returned lasts until the next call.
        Each gate lies in one piece of (lanes, features), so that no step changes layout.
        """
        (steps, lanes), n, kind = x.shape, HIDDEN, self.wx.dtype
        wx, u = _by_gate(self.wx), _by_gate(self.u)
        wx[:2] *= -1  # for the exponentials of the gates
        u[:2] *= -1
        any_fresh, going = fresh.any(1).tolist(), (~fresh).astype(kind)[:, :, None]
        kept = steps if back else 1
        a, states = self.space("a", 3, lanes, n), self.space("states", steps, lanes, n)
        befores, cands, parts = (self.space(name, kept, lanes, n) for name in ("befores", "cands", "parts"))
        gates, out = self.space("gates", kept, 2, lanes, n), h
        for t in range(steps):
            k = t if back else 0
            before, zr, new, part = befores[k], gates[k], cands[k], parts[k]
            if any_fresh[t]:
                np.multiply(out, going[t], out=before)
            else:
                before[:] = out
            np.take(wx, x[t], axis=1, out=a, mode="clip")
            np.matmul(before, u[:2], out=zr)
            np.matmul(before, u[2], out=part)
            zr += a[:2]
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            np.multiply(zr[1], part, out=new)
            new += a[2]
            np.tanh(new, out=new)
            out = states[t]
            np.subtract(before, new, out=out)
            out *= zr[0]
            out += new
        return states, befores, gates, cands, parts

    def _outputs(self, h: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple[int, slice]]]:
        """Rows ordered by class: their order, states, outputs within the class, logits of these, and each class's place."""
        cls = (y % CLASSES).astype(np.int8)
        order = np.argsort(cls, kind="stable")
        edge = np.searchsorted(cls[order], np.arange(CLASSES + 1)).tolist()
        places = [(c, slice(edge[c], edge[c + 1])) for c in range(CLASSES) if edge[c] < edge[c + 1]]
        states, logits = self.space("ordered", *h.shape), self.space("logits", len(y), CLASSES)
        np.take(h, order, axis=0, out=states, mode="clip")
        for c, at in places:
            np.matmul(states[at], self.wo[c], out=logits[at])
            logits[at] += self.bo[c]
        return order, states, (y // CLASSES)[order], logits, places

    def _class_logits(self, h: np.ndarray) -> np.ndarray:
        out = np.matmul(h, self.wc, out=self.space("classes", len(h), CLASSES))
        out += self.bc
        return out

    def log_probs(self, h: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural log probabilities of outputs ``y`` after states ``h``, computed class by class."""
        row, e = np.arange(0, len(y) * CLASSES, CLASSES), self.space("exps", len(y), CLASSES)
        lc = self._class_logits(h)
        out = lc.ravel()[row + y % CLASSES] - _lse(lc, e)
        order, _, idx, logits, _ = self._outputs(h, y)
        out[order] += logits.ravel()[row + idx] - _lse(logits, e)
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray, fresh: np.ndarray, h: np.ndarray) -> tuple[float, list[np.ndarray], np.ndarray]:
        """Mean loss, gradients and last state of a window; ``x``, ``y``, ``fresh`` are (steps, lanes)."""
        steps, lanes = x.shape
        n, kind = HIDDEN, self.wx.dtype
        states, befores, gates, cands, recurrent = self.run(x, fresh, h)
        last = states[-1].copy()
        target = y.ravel()
        size = len(target)
        ones, row = np.ones(size, kind), np.arange(0, size * CLASSES, CLASSES)
        order, flat, idx, logits, places = self._outputs(states.reshape(-1, n), target)
        pc, po = self.space("class_exps", size, CLASSES), self.space("exps", size, CLASSES)
        loss = np.zeros(size, kind)
        for e, x_, at in ((pc, self._class_logits(flat), row + target[order] % CLASSES), (po, logits, row + idx)):
            total, e1 = _exps(x_, e), e.reshape(-1)
            loss += np.log(total) - np.log(e1[at] + kind.type(1e-30))
            e *= (1 / total)[:, None]
            e1[at] -= 1
        # a product over many rows is faster step by step than at once
        dwc, dbc = (flat.reshape(steps, lanes, n).transpose(0, 2, 1) @ pc.reshape(steps, lanes, CLASSES)).sum(0), ones @ pc
        dflat = np.matmul(pc, self.wc.T, out=self.space("dflat", size, n))
        dwo, dbo = np.zeros_like(self.wo), np.zeros_like(self.bo)
        for c, at in places:
            part = po[at]
            np.matmul(flat[at].T, part, out=dwo[c])
            np.matmul(ones[at], part, out=dbo[c])
            dflat[at] += part @ self.wo[c].T
        dstates = self.space("dstates", steps, lanes, n)
        dstates.reshape(-1, n)[order] = dflat
        slabs = self.space("slabs", 4, steps, lanes, n)  # of update, reset and candidate's recurrent and other inputs
        dh, du, u = np.zeros((lanes, n), kind), np.zeros((3, n, n), kind), np.ascontiguousarray(_by_gate(self.u).transpose(0, 2, 1))
        any_fresh, going = fresh.any(1).tolist(), (~fresh).astype(kind)[:, :, None]
        keep, gap, slope, through = np.empty_like(dh), np.empty_like(dh), np.empty((2, lanes, n), kind), np.empty((3, lanes, n), kind)
        for t in range(steps - 1, -1, -1):
            zr, cand, wide, dn, before = gates[t], cands[t], slabs[:2, t], slabs[3, t], befores[t]
            dh += dstates[t]
            np.multiply(dh, zr[0], out=keep)
            np.subtract(dh, keep, out=gap)
            np.multiply(cand, cand, out=dn)
            np.subtract(1, dn, out=dn)
            dn *= gap
            np.multiply(zr, zr, out=slope)
            np.subtract(zr, slope, out=slope)
            np.subtract(before, cand, out=wide[0])
            wide[0] *= dh
            np.multiply(dn, recurrent[t], out=wide[1])
            wide *= slope
            np.multiply(dn, zr[1], out=slabs[2, t])
            du += before.T @ slabs[:3, t]
            np.matmul(slabs[:3, t], u, out=through)
            np.add(through[0], through[1], out=dh)
            dh += through[2]
            dh += keep
            if any_fresh[t]:
                dh *= going[t]
        # tokens of one remainder side by side: their rows are summed by a product with zeros and ones
        own, heaps = x.ravel(), 4 * CLASSES
        rest = (own % heaps).astype(np.int8)
        order = np.argsort(rest, kind="stable")
        edge = np.searchsorted(rest[order], np.arange(heaps + 1)).tolist()
        chosen = np.zeros((size, CLASSES * CLASSES // heaps), kind)
        chosen[np.arange(size), (own // heaps)[order]] = 1
        rows, dwx = self.space("rows", 3, size, n), np.zeros_like(self.wx)
        np.take(slabs[:2].reshape(2, size, n), order, axis=1, out=rows[:2], mode="clip")
        np.take(slabs[3].reshape(size, n), order, axis=0, out=rows[2], mode="clip")
        by_token = dwx.reshape(-1, 3, n)
        for c in range(heaps):
            if edge[c] < edge[c + 1]:
                at = slice(edge[c], edge[c + 1])
                by_token[c::heaps] = (chosen[at].T @ rows[:, at]).transpose(1, 0, 2)
        du = du.transpose(1, 0, 2).reshape(n, 3 * n)
        return float(loss.mean()), [g / kind.type(size) for g in (dwx, du, dwc, dbc, dwo, dbo)], last


def _by_gate(w: np.ndarray) -> np.ndarray:
    """A copy of weights with the columns of update, reset and candidate each in one piece."""
    return np.ascontiguousarray(w.reshape(len(w), 3, HIDDEN).transpose(1, 0, 2))


def _exps(x: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Puts exponentials of a table but for a factor of each row into ``e``, and gives the sums of its rows."""
    np.subtract(x, x.max(), out=e)
    np.exp(e, out=e)
    total = e @ np.ones(x.shape[1], x.dtype)
    if not (total > 1e-25).all():  # rows far below the largest
        np.exp(x - x.max(1)[:, None], out=e)
        total = e.sum(1)
    return total


def _lse(x: np.ndarray, e: np.ndarray) -> np.ndarray:
    m = x.max()
    np.subtract(x, m, out=e)
    np.exp(e, out=e)
    total = e @ np.ones(x.shape[1], x.dtype)
    if (total > 1e-25).all():
        return np.log(total) + m
    m = x.max(1)
    return m + np.log(np.exp(x - m[:, None]).sum(1))


class Adam:
    """Steps down clipped gradients, with running means of them and of their squares."""

    def __init__(self, gru: GRU):
        self.gru, self.t = gru, 0
        self.m, self.v = [np.zeros_like(p) for p in gru.parts()], [np.zeros_like(p) for p in gru.parts()]

    def step(self, grads: list[np.ndarray], rate: float) -> None:
        self.t += 1
        norm = np.sqrt(sum(float(np.vdot(g, g)) for g in grads))
        scale = np.float32(min(1.0, 1.0 / (norm + 1e-9)))
        step, wide = np.float32(rate / (1 - 0.9**self.t)), np.float32(1 / (1 - 0.99**self.t))
        for p, g, a, b in zip(self.gru.parts(), grads, self.m, self.v, strict=True):
            g = g * scale
            a *= np.float32(0.9)
            a += np.float32(0.1) * g
            g *= g
            g *= np.float32(0.01)
            b *= np.float32(0.99)
            b += g
            np.multiply(b, wide, out=g)
            np.sqrt(g, out=g)
            g += np.float32(1e-8)
            np.divide(a, g, out=g)
            g *= step
            p -= g


def train(texts: list[np.ndarray], counts: np.ndarray, updates: int = UPDATES, lanes: int = 64, rate: float = 0.02, seed: int = 3) -> GRU:
    """A model from token id lists that end with ``END``: truncated backpropagation with Adam, lanes side by side."""
    gru = GRU.fresh(counts, seed)
    texts = [t for t in texts if len(t)]
    if not texts:
        return gru
    rng = np.random.default_rng(seed)
    run = np.concatenate([texts[i] for i in rng.permutation(len(texts))])
    width = max(1, len(run) // lanes)
    run = np.resize(run, lanes * width).reshape(lanes, width).T
    before = np.concatenate([np.full((1, lanes), END, run.dtype), run[:-1]])
    adam, h, at = Adam(gru), np.zeros((lanes, HIDDEN), np.float32), 0
    for t in range(1, updates + 1):
        if at >= width:
            at, h = 0, np.zeros_like(h)
        x, y = before[at : at + WINDOW], run[at : at + WINDOW]
        at += WINDOW
        _, grads, h = gru.gradients(x, y, x == END, h)
        adam.step(grads, rate * min(1.0, 2 * (1 - t / (updates + 1))))
    return gru


def train_on(gru: GRU, texts: Iterator[np.ndarray], rate: float, lanes: int = TRAINED) -> int:
    """Trains ``gru`` on every token of a stream of texts, once, and gives their number.

    Texts are gathered to ``BUFFER`` tokens and cut into lanes of one width; what is over goes before the next texts. A
    lane that begins within a text sees the token before it, with a fresh state. Steps of fewer tokens are smaller.
    """
    adam, total, last = Adam(gru), 0, END
    kept: list[np.ndarray] = []
    held = 0

    def go(run: np.ndarray) -> None:
        nonlocal total, last
        wide = min(lanes, max(1, len(run) // WINDOW))
        width = len(run) // wide
        used = wide * width
        y = run[:used].reshape(wide, width).T
        x = np.concatenate([[last], run[: used - 1]]).reshape(wide, width).T
        h = np.zeros((wide, HIDDEN), np.float32)
        for at in range(0, width, WINDOW):
            now = x[at : at + WINDOW]
            _, grads, h = gru.gradients(now, y[at : at + WINDOW], now == END, h)
            adam.step(grads, rate * min(1.0, now.size / (lanes * WINDOW)) * min(1.0, (adam.t + 1) / 20))
        total, last = total + used, int(run[used - 1])
        kept[:] = [run[used:]] if used < len(run) else []

    for ids in texts:
        kept.append(ids)
        held += len(ids)
        if held >= BUFFER:
            go(np.concatenate(kept))
            held = sum(map(len, kept))
    while kept:
        go(np.concatenate(kept))
    return total


def train_round(coded: DataFrame, gru: GRU, rate: float) -> tuple[GRU, int]:
    """One round over the one column of ``coded``, ids as bytes: the mean of the tasks' weights by tokens, and the number of tokens."""
    shared = coded.sparkSession.sparkContext.broadcast(gru)
    schema = "chunk int, part int, n long, weights binary"
    names = ["chunk", "part", "n", "weights"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = GRU(*(p.copy() for p in shared.value.parts()))
        n = train_on(own, (np.frombuffer(t, ID) for b in batches for t in b.column(0).to_pylist()), rate)
        if n:
            cut = np.array_split(np.concatenate([p.ravel() for p in own.parts()]), CHUNKS)
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([part] * CHUNKS, pa.int32()), pa.array([n] * CHUNKS, pa.int64()), pa.array([c.tobytes() for c in cut], pa.binary())], names=names)

    def mean(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("part")  # in one order, so that runs give the same sums
        n = sum(rows["n"].to_pylist())
        whole = sum(np.frombuffer(w.as_py(), np.float32) * (c.as_py() / n) for w, c in zip(rows["weights"], rows["n"], strict=True))
        return pa.table([pa.array([rows["chunk"][0].as_py()], pa.int32()), pa.array([0], pa.int32()), pa.array([n], pa.int64()), pa.array([whole.astype(np.float32).tobytes()], pa.binary())], names=names)

    found = sorted(coded.mapInArrow(run, schema).groupBy("chunk").applyInArrow(mean, schema).collect())
    shared.unpersist()
    if not found:
        return gru, 0
    flat, out, at = np.concatenate([np.frombuffer(r.weights, np.float32) for r in found]), [], 0
    for p in gru.parts():
        out.append(flat[at : at + p.size].reshape(p.shape).copy())
        at += p.size
    return GRU(*out), found[0].n


def whole_texts(gru: GRU, texts: list[np.ndarray], lanes: int = LANES) -> np.ndarray:
    """Natural log likelihood of each whole text (ids that end with ``END``).

    Texts are dealt to the lane that ends first, longest first. All lanes move together by windows; a lane's state goes
    from one window to the next, and starts anew with a text. Memory is a window's states, not a text's.
    """
    out = np.zeros(len(texts))
    if not texts:
        return out
    sizes = np.array([len(t) for t in texts])
    order = np.argsort(-sizes, kind="stable")
    lanes = min(lanes, len(texts))
    import heapq

    ends = [(0, i) for i in range(lanes)]
    dealt: list[list[int]] = [[] for _ in range(lanes)]
    for i in order.tolist():
        n, lane = heapq.heappop(ends)
        dealt[lane].append(i)
        heapq.heappush(ends, (n + int(sizes[i]), lane))
    ahead = np.array([sizes[d].sum() for d in dealt])
    by_size = np.argsort(-ahead, kind="stable")
    dealt, width = [dealt[i] for i in by_size], ahead[by_size]
    run = np.concatenate([texts[i] for d in dealt for i in d])
    owner = np.repeat(np.array([i for d in dealt for i in d], np.int32), sizes[[i for d in dealt for i in d]])
    starts = np.cumsum(width) - width
    h = np.zeros((lanes, HIDDEN), np.float32)
    last = np.full(lanes, END)
    for at in range(0, int(width[0]), WINDOW):
        live = int((width > at).sum())
        size = min(WINDOW, int(width[0]) - at)
        step = np.arange(at, at + size)[:, None]
        ok = step < width[:live]
        places = np.where(ok, starts[:live] + step, 0)
        y = np.where(ok, run[places], END)
        x = np.concatenate([last[None, :live], y[:-1]])
        last = y[-1]
        states = gru.run(x, x == END, h[:live], back=False)[0]
        h = states[-1].copy()
        got = gru.log_probs(states.reshape(-1, HIDDEN), y.ravel())
        ok = ok.ravel()
        out += np.bincount(owner[places.ravel()[ok]], got[ok].astype(np.float64), len(texts))
    return out


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches joined to ``SCORED`` rows or ``SCORED_BYTES``, enough to keep all lanes at work."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= SCORED or sum(b.nbytes for b in held) >= SCORED_BYTES:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, c, bucket) of all words of all texts; each task counts the words of ``TALLIED`` bytes at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []

        def counted():
            found = pa.chunked_array(held, pa.string()).value_counts()
            words = found.field("values")
            return pa.RecordBatch.from_arrays([words.cast(pa.binary()), found.field("counts").cast(pa.int64()), pa.array(buckets(words), pa.int32())], names=["word", "n", "bucket"])

        for batch in batches:
            held.append(split(batch.column(0))[0])
            if sum(w.nbytes for w in held) >= TALLIED:
                yield counted()
                held.clear()
        yield counted()

    parts = docs.select(F.col(f"`{text}`")).mapInArrow(run, "word binary, n long, bucket int")
    return parts.groupBy("word", "bucket").agg(F.sum("n").alias("c"))


def score(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row, whole texts.

    Rows whose key's crc32 is divisible by 10, and rows without a key, are held out; the rest is learnt from. Null texts
    are empty: their only token is the end. Rows that repeat are scored alike, and count as often in training. Without
    training texts all counts are 0 and V is 0. Other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    held = F.coalesce(fold(F.col(f"`{key}`")) % 10 == 0, F.lit(True))
    training = docs.where(~held)
    counts = stored(word_counts(training, text), "counts")
    ends = training.count()
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    n, v = n + ends, v + (ends > 0)
    short = counts.where(F.length("word") <= LONGEST)
    frequent = short.orderBy(F.desc("c"), "word").limit(FREQUENT).select("word", "c").toArrow()
    top = list(zip(frequent["word"].to_pylist(), frequent["c"].to_pylist(), strict=True))
    ids = [w for w, _ in top[:WORDS]]
    outside = counts
    if ids:
        listed = spark.createDataFrame([(bytearray(w),) for w in ids], "word binary")
        outside = counts.join(F.broadcast(listed), "word", "left_anti")
    mass = np.zeros(CLASSES * CLASSES)
    kinds, totals = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in outside.groupBy("bucket").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect():
        totals[r.bucket], kinds[r.bucket] = r.c, r.v
    mass[: len(ids)] = [c for _, c in top[:WORDS]]
    mass[END], mass[END + 1 :] = ends, totals
    in_bucket = np.log10(totals + 0.1 * (kinds + 1))

    # by rank, and by bucket from the end: a word's output, its logarithm if frequent, and its share of its bucket
    outputs = np.array([*range(len(ids)), *(END + 1 + bucket(w) for w, _ in top[WORDS:]), *range(END + BUCKETS, END, -1)], np.int64)
    logs = np.append(np.log10(np.array([c for _, c in top], float) + 0.1), np.zeros(BUCKETS))
    shares = np.where(outputs > END, logs - in_bucket[np.maximum(outputs - END - 1, 0)], 0.0)
    known = spark.sparkContext.broadcast((Ranks([w for w, _ in top]), outputs.astype(ID), logs, shares))
    kind = docs.schema[key].dataType.simpleString()
    tail_type = pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int32())]))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, outputs, logs, shares = known.value
        end_log = float(np.log10(ends + 0.1))
        for batch in _gathered(batches):
            words, sizes = split(batch["text"])
            rows, row = len(sizes), np.repeat(np.arange(len(sizes)), sizes)
            words = words.dictionary_encode()
            distinct, at = words.dictionary, words.indices.to_numpy().astype(np.int64)
            places = ranks.of(distinct)[at]
            coded = np.full(len(at) + rows, END, ID)
            coded[np.arange(len(at)) + row] = outputs[places]
            ends_at = np.append(0, np.cumsum(sizes + 1)).astype(np.int32) * np.int32(ID.itemsize)
            rare = places < 0
            tail, times = np.unique(row[rare] * max(1, len(distinct)) + at[rare], return_counts=True)
            tail_row, tail_word = np.divmod(tail, max(1, len(distinct)))
            tail_ends = np.append(0, np.cumsum(np.bincount(tail_row, minlength=rows))).astype(np.int32)
            tails = pa.StructArray.from_arrays([distinct.take(pa.array(tail_word)).cast(pa.binary()), pa.array(times, pa.int32())], names=["word", "times"])
            uids = [xxhash.xxh3_128_digest(repr(k).encode() + b"\0" + (t or "").encode()) for k, t in zip(batch["key"].to_pylist(), batch["text"].to_pylist(), strict=True)]
            made = {
                "uid": pa.array(uids, pa.binary()),
                "n_tokens": pa.array(sizes + 1, pa.int64()),
                "known": pa.array(sizes - np.bincount(row[rare], minlength=rows) + (ends > 0), pa.int64()),
                "freq_log": pa.array(np.bincount(row, logs[places], rows) + end_log, pa.float64()),
                "share_log": pa.array(np.bincount(row, shares[places], rows), pa.float64()),
                "ids": pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(ends_at), pa.py_buffer(coded)]),
                "tail": pa.ListArray.from_arrays(pa.array(tail_ends), tails).cast(tail_type),
            }
            yield pa.RecordBatch.from_pydict({c: batch[c] for c in ("key", "held_out", "turn")} | made)

    turn = F.pmod(F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`")), F.lit(ROUNDS)).cast("int")
    coded = docs.select(F.col(f"`{key}`").alias("key"), held.alias("held_out"), turn.alias("turn"), F.col(f"`{text}`").alias("text"))
    coded = coded.mapInArrow(encode, f"key {kind}, held_out boolean, turn int, uid binary, n_tokens long, known long, freq_log double, share_log double, ids binary, tail array<struct<word:binary,times:int>>")
    coded = stored(coded, "coded")
    below = int(2**31 * min(1.0, SAMPLE / max(1, ends)))
    some = coded.where(~F.col("held_out") & (F.pmod(F.xxhash64("key"), F.lit(2**31)) < below))
    sample = some.select("ids").limit(2 * SAMPLE).toArrow()["ids"]
    gru = train([np.frombuffer(x.as_py(), ID) for x in sample], mass)
    for k in range(ROUNDS):
        gru, _ = train_round(coded.where(~F.col("held_out") & (F.col("turn") == k)).select("ids"), gru, RATE * (1 - 0.75 * k / (ROUNDS - 1)))
    shared = spark.sparkContext.broadcast(gru)
    names = ["key", "uid", "held_out", "n_tokens", "known", "freq_log", "model_log"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _gathered(batches):
            for start in range(0, whole.num_rows, SCORED):
                batch = whole.slice(start, SCORED)
                got = whole_texts(shared.value, [np.frombuffer(t, ID) for t in batch["ids"].to_pylist()]) / np.log(10)
                model = pa.array(got + batch["share_log"].to_numpy(), pa.float64())
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in names[:-1]), model], names=names)

    scored = coded.select(*names[:-1], "share_log", "ids").mapInArrow(run, f"key {kind}, uid binary, held_out boolean, n_tokens long, known long, freq_log double, model_log double")
    scored = stored(scored, "scored")
    # rows with one uid are equal, and so are their rare words; each is taken once
    rare = coded.where(F.size("tail") > 0).select("uid", "tail").dropDuplicates(["uid"]).select("uid", F.explode("tail").alias("w")).select("uid", "w.word", "w.times")
    rare = rare.join(counts.select("word", "c"), "word", "left")
    c = F.coalesce("c", F.lit(0))
    sums = rare.groupBy("uid").agg(F.sum(F.col("times") * F.log10(c + 0.1)).alias("tail_log"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("tail_known"))
    sums = stored(sums, "sums")
    discard(coded, counts)
    out = scored.join(sums, "uid", "left")
    tail_log = F.coalesce("tail_log", F.lit(0.0))
    base = F.col("freq_log") + tail_log - F.col("n_tokens") * F.lit(float(np.log10(n + 0.1 * (v + 1))))
    return out.select(F.col("key").alias(key), "held_out", "n_tokens", (F.col("known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("model_log") + tail_log).alias("score"))
