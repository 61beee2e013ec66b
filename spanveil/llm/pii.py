"""Personal data by rules and a semi-Markov conditional random field.

Rules find e-mail addresses, IP numbers, card numbers and phone numbers; their spans are kept as they are. The field adds
spans that the rules miss, such as spelt-out addresses, phone numbers without a plus or card numbers with other
separators. It scores whole candidate segments of at most ``MOST_TOKENS`` tokens by features of the segment (its shape,
digit count, separators, length, the words around it) and a table of label transitions; dynamic programming over
segmentations with that bound chooses boundaries and types jointly. A segment holds four digits without letters between, an
at sign or the word "at", so only the tokens around those are decoded, and the result is that of decoding the whole text; all
else costs two regular expressions. Segments are scored while they grow token by token, and those that lose to background
between any labels never enter the programme.

The weights are trained by maximum likelihood, with forward and backward sums over segmentations, on sentences made from
a fixed grammar of spans in neutral words. No row of the input is learnt from.
"""

from __future__ import annotations

import hashlib
import random
import re
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spanveil.llm.common import Cache, arrow_map

KINDS = ("email", "ip", "card", "phone")
MOST_TOKENS = 16
CONTEXT = 6  # tokens before a segment that its features look at

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping; from each at sign outwards, so that long words cost no more than their length."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            last = m.end()
            out.append((start, last))
            at = text.find("@", last)
        else:
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The rules' spans by kind, in code points."""
    out = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = _emails(text)
    if _ANY_DIGIT(text) is None:
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out["ip"].append(m.span())
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out["card"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.sub("", m[0])) <= 15:
                out["phone"].append(m.span())
    return out


_ANY_DIGIT = re.compile("[0-9]").search
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\s+|.", re.S)
#: Digits, and all characters of words, that are neither 0-9 nor letters: superscripts, fractions, digits of other scripts.
#: Those beyond U+FFFF are looked up in a set, as a regular expression would try them one by one.
_MORE_DIGITS = "".join(c for c in map(chr, range(128, 0x10000)) if c.isdigit()) + "\U00010000-\U0010ffff"
_ODD = [c for c in map(chr, range(128, 0x110000)) if c.isalnum() and not c.isalpha()]
_ODD_NEAR = re.compile(f"[{''.join(c for c in _ODD if c <= chr(0xFFFF))}]").search
_ODD_FAR = frozenset(c for c in _ODD if c > chr(0xFFFF))
_FAR = re.compile("[\U00010000-\U0010ffff]").findall
#: What every segment that ``_possible`` admits meets: four digits with no token of letters and no line end between, an at
#: sign, or "at" as a whole token of letters. In a text with odd characters a token with letters may not count as one.
_RUN = re.compile(r"[0-9](?:[^A-Za-z\n0-9]*+[0-9]){3,}+")
_ODD_RUN = re.compile(rf"[0-9{_MORE_DIGITS}](?:[^\n0-9{_MORE_DIGITS}]*+[0-9{_MORE_DIGITS}]){{3,}}+")
_AT = re.compile(r"@|(?<![A-Za-z])[Aa][Tt](?![A-Za-z])")
#: Last words of host names.
_ENDS = frozenset(("com", "org", "net", "example", "edu", "gov", "io", "info", "de", "fr", "es", "it", "uk", "eu"))
#: Words that stand near personal data.
_CUES = {"mail": 1, "email": 1, "e": 1, "contact": 1, "write": 1, "ip": 2, "host": 2, "server": 2, "address": 2, "card": 3, "visa": 3, "payment": 3, "credit": 3, "call": 4, "phone": 4, "tel": 4, "mobile": 4, "dial": 4}
_O = len(KINDS)  # the background label


def _features(tokens: list[str], i: int, j: int) -> list[str]:
    """What a whole segment tokens[i:j] looks like; background segments are single tokens without features."""
    text = "".join(tokens[i:j])
    digits = _DIGITS.sub("", text)
    shape = re.sub(r"a+", "a", re.sub(r"0+", "0", "".join("0" if c.isdigit() else "a" if c.isalpha() else " " if c.isspace() else c for c in text)))
    groups = re.findall("[0-9]+", text)
    words = [t.lower() for t in tokens[i:j] if t.isalpha()]
    seps = "".join(sorted({c for c in text if not c.isalnum()}))
    out = ["bias", f"digits={len(digits)}", f"groups={len(groups)}", f"first={'d' if text[0].isdigit() else 'a' if text[0].isalpha() else text[0]}", f"last={'d' if text[-1].isdigit() else 'a' if text[-1].isalpha() else text[-1]}"]
    out += [f"seps={seps[:6]}", f"lens={','.join(str(len(g)) for g in groups[:6])}", f"alldigits={len(digits) == sum(c.isalnum() for c in text)}", f"shape={shape[:24]}"]
    out.append(f"at={'@' in text or '(at)' in text.lower() or '[at]' in text.lower()}/{'at' in words}/{'dot' in words or '.' in text}")
    if tokens[i].lower() == "at":
        out.append("starts=at")
    if words and words[-1] in _ENDS and tokens[j - 1].isalpha():
        out.append(f"end={tokens[j - 2] == '.'}")
    if len(groups) == 4:
        out.append(f"bytes={all(len(g) <= 3 and int(g) <= 255 for g in groups)}")
    if 13 <= len(digits) <= 19:
        out.append(f"luhn={luhn(digits)}")
    if i and tokens[i - 1].isalnum() or j < len(tokens) and tokens[j].isalnum():
        out.append("glued")
    before = [t.lower() for t in tokens[max(0, i - CONTEXT) : i] if t.isalpha()][-2:]
    out += [f"cue={_CUES[w]}" for w in before if w in _CUES]
    return out


def _possible(tokens: list[str], i: int, j: int) -> bool:
    """Whether tokens[i:j] may be an entity at all: no white space at its ends, and digits or a sign of an address."""
    if tokens[i].isspace() or tokens[j - 1].isspace():
        return False
    if not (tokens[i][0].isalnum() or tokens[i] in "+([") or not (tokens[j - 1][-1].isalnum() or tokens[j - 1] in ")"):
        return False
    part = tokens[i:j]
    if any("\n" in t for t in part):
        return False
    if sum(len(t) for t in part if t.isdigit()) >= 4 and sum(t.isalpha() for t in part) == 0:
        return True
    words = {t.lower() for t in part if t.isalpha()}
    return bool(({"@"} & set(part) or "at" in words) and ("." in part or "dot" in words) and sum(t.isspace() for t in part) <= 8)


class SemiCRF:
    """Weights of (kind, feature) and of transitions between segment labels."""

    def __init__(self):
        self.weights: dict[tuple[int, str], float] = {}
        self.moves = np.zeros((_O + 1, _O + 1))
        #: Entities of a stretch of text, memoised: passages that many documents share come again and again.
        self.decoded = Cache(lambda piece: self.decode(t) if _promising(t := tokenize(piece)) else [], 20_000, 4096)
        self._made = None

    def __reduce__(self):
        return _restored, (self.weights, self.moves)

    def segments(self, tokens: list[str]) -> list[list[tuple[int, list[str]]]]:
        """For each end, the starts of possible entities with their features."""
        out: list[list[tuple[int, list[str]]]] = [[] for _ in range(len(tokens) + 1)]
        for i in range(len(tokens)):
            for j in range(i + 1, min(len(tokens), i + MOST_TOKENS) + 1):
                if _possible(tokens, i, j):
                    out[j].append((i, _features(tokens, i, j)))
        return out

    def score(self, kind: int, features: list[str]) -> float:
        get = self.weights.get
        return sum(get((kind, f), 0.0) for f in features)

    def _tables(self) -> tuple[dict[str, dict[str, tuple[float, ...]]], list[float]]:
        """Weights of all kinds by name and value of a feature, and the most that moves can add to a segment's score."""
        if self._made is None:
            by: dict[str, dict[str, list[float]]] = {}
            for (kind, feature), w in self.weights.items():
                name, _, value = feature.partition("=")
                by.setdefault(name, {}).setdefault(value, [0.0] * _O)[kind] = w
            m = self.moves
            into, out = (m[:, :_O] - m[:, _O:]).max(0), (m[:_O] - m[_O]).max(1)
            self._made = {n: {v: tuple(w) for v, w in t.items()} for n, t in by.items()}, (into + np.maximum(out, 0.0)).tolist()
        return self._made

    def scored(self, tokens: list[str]) -> dict[int, list[tuple[int, list[float]]]]:
        """By end, the starts of possible entities with their scores for each kind, without those that cannot be in the best
        segmentation: with any labels beside them, background in their place scores more."""
        tables, most = self._tables()
        stay, n = float(self.moves[_O, _O]), len(tokens)
        out: dict[int, list[tuple[int, list[float]]]] = {}

        def add(i: int, j: int, scores: list[float]) -> None:
            bound = stay * (j - i - 1) - 1e-6
            if any(s + m >= bound for s, m in zip(scores, most, strict=True)):
                out.setdefault(j, []).append((i, scores))

        if _odd("".join(tokens)):
            for j, found in enumerate(self.segments(tokens)):
                for i, features in found:
                    add(i, j, [self.score(k, features) for k in range(_O)])
            return out

        none = (0.0,) * _O
        get = lambda name, value="": tables.get(name, {}).get(value, none)
        empty: dict[str, tuple[float, ...]] = {}
        digits_w, groups_w, lens_w, last_w, seps_w, shape_w, at_w = (tables.get(k, empty) for k in ("digits", "groups", "lens", "last", "seps", "shape", "at"))
        bias, glued, all_digits, some_letters, starts_at = get("bias"), get("glued"), get("alldigits", "True"), get("alldigits", "False"), get("starts", "at")
        # of each token: d digits, a letters, s white space, or itself
        classes = ["d" if "0" <= t[0] <= "9" else "a" if t[0].isalpha() else "s" if t[0].isspace() else t for t in tokens]
        lower = [t.lower() if c == "a" else "" for t, c in zip(tokens, classes, strict=True)]
        # the next at, dot, letters and line end from each token on; digits up to each token
        far = n + MOST_TOKENS
        next_at, next_dot, next_word, next_line = ([far] * (n + 1) for _ in range(4))
        for i in range(n - 1, -1, -1):
            c = classes[i]
            next_at[i] = i if c == "@" or lower[i] == "at" else next_at[i + 1]
            next_dot[i] = i if c == "." or lower[i] == "dot" else next_dot[i + 1]
            next_word[i] = i if c == "a" else next_word[i + 1]
            next_line[i] = i if c == "s" and "\n" in tokens[i] else next_line[i + 1]
        upto = [0]
        for t, c in zip(tokens, classes, strict=True):
            upto.append(upto[-1] + (len(t) if c == "d" else 0))

        for i in range(n):
            c = classes[i]
            if c not in "da+([":
                continue
            stop = min(n, i + MOST_TOKENS, next_line[i])
            address = max(next_at[i], next_dot[i]) + 1
            if address > stop and upto[min(stop, next_word[i])] - upto[i] < 4:
                continue
            first = get("first", c)
            before_glued = i > 0 and classes[i - 1] in "da"
            said = [t for t in lower[max(0, i - CONTEXT) : i] if t][-2:]
            cues = [get("cue", str(_CUES[w])) for w in said if w in _CUES]
            signs, at_word, bracketed, dot, letters, spaces = False, False, False, False, False, 0
            seps: set[str] = set()
            seps_key = shape = lens = ""
            groups: list[str] = []
            for j in range(i + 1, stop + 1):
                t, c = tokens[j - 1], classes[j - 1]
                if c == "d":
                    groups.append(t)
                    if len(groups) <= 6:
                        lens = f"{lens},{len(t)}" if lens else str(len(t))
                    if shape[-1:] != "0":
                        shape += "0"
                elif c == "a":
                    letters = True
                    if lower[j - 1] == "at":
                        at_word = True
                    elif lower[j - 1] == "dot":
                        dot = True
                    if shape[-1:] != "a":
                        shape += "a"
                else:
                    if c == "s":
                        spaces += 1
                        shape += " " * len(t)
                    else:
                        shape += t
                        if c == "@":
                            signs = True
                        elif c == ".":
                            dot = True
                        elif (c == ")" or c == "]") and j - i >= 3 and lower[j - 2] == "at" and tokens[j - 3] == ("(" if c == ")" else "["):
                            bracketed = True
                    if not seps.issuperset(t):
                        seps.update(t)
                        seps_key = "".join(sorted(seps))[:6]
                if c != "d" and c != "a" and c != ")":
                    continue
                digits = upto[j] - upto[i]
                if not (digits >= 4 and not letters or j >= address and spaces <= 8):
                    if letters and (j >= address or address > stop):
                        break
                    continue
                got = [bias, digits_w.get(str(digits), none), groups_w.get(str(len(groups)), none), first, last_w.get(c, none), seps_w.get(seps_key, none), lens_w.get(lens, none), some_letters if letters else all_digits, shape_w.get(shape[:24], none)]
                got.append(at_w.get(f"{signs or bracketed}/{at_word}/{dot}", none))
                if lower[i] == "at":
                    got.append(starts_at)
                if c == "a" and lower[j - 1] in _ENDS:
                    got.append(get("end", str(tokens[j - 2] == ".")))
                if len(groups) == 4:
                    got.append(get("bytes", str(all(len(g) <= 3 and int(g) <= 255 for g in groups))))
                if 13 <= digits <= 19:
                    got.append(get("luhn", str(luhn("".join(groups)))))
                if before_glued or j < n and classes[j] in "da":
                    got.append(glued)
                add(i, j, [sum(w) for w in zip(*got, *cues, strict=True)])
        return out

    def decode(self, tokens: list[str]) -> list[tuple[int, int, int]]:
        """(start, end, kind) of the best segmentation, by bounded-entity dynamic programming.

        A token that no segment holds is background, so the stretches between such tokens are decoded each for itself.
        """
        ends = self.scored(tokens)
        stretches: list[list[int]] = []
        for a, b in sorted((i, j) for j, found in ends.items() for i, _ in found):
            if stretches and a <= stretches[-1][1]:
                stretches[-1][1] = max(b, stretches[-1][1])
            else:
                stretches.append([a, b])
        moves = self.moves.T.tolist()
        labels = range(_O + 1)

        def into(scores: list[float], kind: int) -> tuple[float, int]:
            step = [s + m for s, m in zip(scores, moves[kind], strict=True)]
            value = max(step)
            return value, step.index(value)

        out = []
        for a, b in stretches:
            best = {a: [-np.inf] * _O + [0.0]}
            entered: dict[int, list[tuple[float, int]]] = {}
            back: dict[tuple[int, int], tuple[int, int]] = {}
            for j in range(a + 1, b + 1):
                value, label = into(best[j - 1], _O)
                now = [-np.inf] * _O + [value]
                back[j, _O] = (j - 1, label)
                for i, scores in ends.get(j, ()):
                    if i not in entered:
                        entered[i] = [into(best[i], k) for k in range(_O)]
                    for kind, (value, label) in enumerate(entered[i]):
                        if value + scores[kind] > now[kind]:
                            now[kind] = value + scores[kind]
                            back[j, kind] = (i, label)
                best[j] = now
            label = into(best[b], _O)[1] if b < len(tokens) else max(labels, key=best[b].__getitem__)
            found, j = [], b
            while j > a:
                i, before = back[j, label]
                if label != _O:
                    found.append((i, j, label))
                j, label = i, before
            out += found[::-1]
        return out

    def _gradient(self, tokens: list[str], gold: list[tuple[int, int, int]], rate: float) -> None:
        """One step up the log-likelihood: observed less expected counts, by forward and backward sums."""
        self._made = None
        ends, n, lse = self.segments(tokens), len(tokens), np.logaddexp.reduce
        scores = [[(i, f, [self.score(k, f) for k in range(_O)]) for i, f in e] for e in ends]
        alpha, beta = np.full((n + 1, _O + 1), -np.inf), np.full((n + 1, _O + 1), -np.inf)
        alpha[0, _O] = 0.0
        for j in range(1, n + 1):
            alpha[j, _O] = lse(alpha[j - 1] + self.moves[:, _O])
            for i, _, s in scores[j]:
                for k in range(_O):
                    alpha[j, k] = np.logaddexp(alpha[j, k], lse(alpha[i] + self.moves[:, k]) + s[k])
        beta[n] = 0.0
        starts: list[list] = [[] for _ in range(n + 1)]
        for j in range(n + 1):
            for i, f, s in scores[j]:
                starts[i].append((j, f, s))
        for i in range(n - 1, -1, -1):
            into = self.moves[:, _O] + beta[i + 1, _O]
            for j, _, s in starts[i]:
                for k in range(_O):
                    into = np.logaddexp(into, self.moves[:, k] + s[k] + beta[j, k])
            beta[i] = into
        z, moves = lse(alpha[n]), np.zeros_like(self.moves)
        change: dict[tuple[int, str], float] = {}
        for i in range(n):
            moves[:, _O] -= np.exp(alpha[i] + self.moves[:, _O] + beta[i + 1, _O] - z)
            for j, f, s in starts[i]:
                for k in range(_O):
                    p = np.exp(alpha[i] + self.moves[:, k] + s[k] + beta[j, k] - z)
                    moves[:, k] -= p
                    if p.sum() > 1e-6:
                        for x in f:
                            change[k, x] = change.get((k, x), 0.0) - p.sum()
        at, before, spans = 0, _O, {i: (j, k) for i, j, k in gold}
        while at < n:
            j, k = spans.get(at, (at + 1, _O))
            moves[before, k] += 1
            if k != _O:
                for x in _features(tokens, at, j):
                    change[k, x] = change.get((k, x), 0.0) + 1
            at, before = j, k
        for key, g in change.items():
            self.weights[key] = self.weights.get(key, 0.0) * (1 - rate * 1e-3) + rate * g
        self.moves += rate * (moves - 1e-3 * self.moves)


def _restored(weights, moves) -> SemiCRF:
    crf = SemiCRF()
    crf.weights, crf.moves = weights, moves
    return crf


def tokenize(text: str) -> list[str]:
    return _TOKEN.findall(text)


def _sentence(rnd: random.Random) -> tuple[list[str], list[tuple[int, int, int]]]:
    """A made-up sentence with labelled spans, and numbers that are none."""
    word = lambda: "".join(rnd.choice("aeioubcdfghlmnprstv") for _ in range(rnd.randint(2, 9)))
    num = lambda n: "".join(rnd.choice("0123456789") for _ in range(n))

    def card() -> str:
        body = num(15)
        body += next(d for d in "0123456789" if luhn(body + d))
        sep = rnd.choice([".", "/", "_", " - ", " ", "  "])
        return sep.join(body[i : i + 4] for i in range(0, 16, 4))

    def email() -> str:
        dot = rnd.choice([" dot ", " DOT ", "."])
        at = rnd.choice([" at ", " AT ", " (at) ", "(at)", " [at] ", "[at]", " @ "])
        local = rnd.choice([word(), f"{word()}{num(2)}", f"{word()}.{word()}", f"{word()}_{word()}", f"{word()[0]}.{word()}"])
        return f"{local}{at}{word()}{dot}{rnd.choice(['com', 'org', 'net', 'example'])}"

    def phone() -> str:
        return rnd.choice([f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"00{num(2)} {num(3)} {num(7)}", f"0{num(3)} {num(3)} {num(4)}"])

    def ip() -> str:
        p = [str(rnd.randint(0, 255)) for _ in range(4)]
        return rnd.choice(["[.]", "(.)", " . "]).join(p)

    def none() -> str:
        return rnd.choice([f"{num(4)}-{num(2)}-{num(2)}", num(5), f"{num(2)}.{num(2)}", f"{num(1)}.{num(3)}.{num(3)}", f"{num(2)}:{num(2)}:{num(2)}", f"{num(4)} {num(4)}", num(8), f"{word()} at {word()}. {word()}", f"{word()} at {word()}.{word()}", f"the dot at {word()}", f"{word()} dot {word()}", f"{word()} at the {word()} dot", "".join(rnd.choice("0123456789abcdef") for _ in range(32)), f"{word()}{num(7)}{word()}", f"{num(4)}/{num(4)}", num(16), f"v{num(1)}.{num(2)}.{num(1)}", f"{num(3)} {num(5)} {num(2)}"])

    tokens: list[str] = []
    gold = []
    cues = {0: ["email", "mail", "contact", "write"], 1: ["ip", "host", "server"], 2: ["card", "visa", "payment"], 3: ["call", "phone", "tel", "mobile"]}
    for _ in range(rnd.randint(1, 3)):
        tokens += tokenize(" ".join(word() for _ in range(rnd.randint(1, 4))) + " ")
        kind = rnd.choice([0, 1, 2, 3, _O, _O])
        if kind != _O and rnd.random() < 0.5:
            tokens += tokenize(rnd.choice(cues[kind]) + rnd.choice([" ", ": "]))
        part = tokenize((email, ip, card, phone, none)[kind]())
        if kind != _O and len(part) <= MOST_TOKENS and _possible(part, 0, len(part)):
            gold.append((len(tokens), len(tokens) + len(part), kind))
        tokens += part
        tokens += tokenize(rnd.choice([" ", " ", ". ", ", "]))
    return tokens, gold


@lru_cache(maxsize=1)
def model(rounds: int = 2500, seed: int = 11) -> SemiCRF:
    """The trained field; the driver trains it once and broadcasts its few thousand weights."""
    crf, rnd = SemiCRF(), random.Random(seed)
    for t in range(rounds):
        tokens, gold = _sentence(rnd)
        crf._gradient(tokens, gold, 0.25 / (1 + t / 200))
    return crf


def _odd(text: str) -> bool:
    """Whether a text holds word characters that are neither 0-9 nor letters."""
    return not text.isascii() and (_ODD_NEAR(text) is not None or not _ODD_FAR.isdisjoint(_FAR(text)))


def _around(text: str, start: int, end: int) -> tuple[int, int]:
    """``start`` and ``end`` moved out to token borders, past every segment that holds what is between and its context."""
    back, forth = MOST_TOKENS + CONTEXT, MOST_TOKENS + 1
    # tokens are runs of one class of characters, so they are the same from right to left
    reach = 256
    while True:
        ends = [m.end() for m in islice(_TOKEN.finditer(text[max(0, start - reach) : start][::-1]), back + 2)]
        if len(ends) == back + 2 or reach >= start:
            break
        reach *= 4
    a = start - ends[back] if len(ends) == back + 2 else 0
    b = end
    for m in islice(_TOKEN.finditer(text, end), forth + 1):
        b = m.end()
    return a, b


def _windows(text: str) -> list[tuple[int, int]]:
    """Stretches, at token borders, that hold every possible segment with its context, merged where they meet."""
    out: list[list[int]] = []
    hints: list[list[int]] = []
    run = _ODD_RUN if _odd(text) else _RUN
    for start, end in sorted(m.span() for rule in (run, _AT) for m in rule.finditer(text)):
        if hints and start - hints[-1][1] <= MOST_TOKENS:  # no more tokens than characters
            hints[-1][1] = max(end, hints[-1][1])
        else:
            hints.append([start, end])
    for start, end in hints:
        a, b = _around(text, start, end)
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _promising(tokens: list[str]) -> bool:
    """Whether any segment can be possible: four digits without letters or line ends between, or signs of an address."""
    digits, at, dot = 0, False, False
    for t in tokens:
        if t.isalpha():
            digits, word = 0, t.lower()
            at, dot = at or word == "at", dot or word == "dot"
        elif t.isdigit():
            digits += len(t)
            if digits >= 4:
                return True
        elif "\n" in t:
            digits = 0
        else:
            at, dot = at or t == "@", dot or t == "."
    return at and dot


def added_spans(text: str, crf: SemiCRF) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the field's entities."""
    found = []
    for a, b in _windows(text):
        tokens = tokenize(text[a:b])
        at, offsets = a, []
        for t in tokens:
            offsets.append(at)
            at += len(t)
        offsets.append(at)
        for i, j, kind in crf.decoded[text[a:b]]:
            found.append((kind, offsets[i], offsets[j]))
    return found


def find(text: str | None, crf: SemiCRF) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int]]]:
    """The rules' spans by kind, and all spans: those and the field's that do not overlap them."""
    text = text or ""
    base = base_spans(text)
    spans = [(KINDS.index(k), s, e) for k in KINDS for s, e in base[k]]
    taken = sorted((s, e) for _, s, e in spans)
    for kind, s, e in added_spans(text, crf):
        if not any(a < e and s < b for a, b in taken):
            spans.append((kind, s, e))
    return base, [(KINDS[k], s, e) for k, s, e in sorted(spans)]


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base_sha256, spans, found) of every row.

    Counts and digest are of the rules' spans; ``spans`` and ``found``, an array of (kind, start, end, value), hold the
    field's too. Null texts are empty and hold none. Rows repeat as they come, null keys stay, other columns are not
    read; an empty table gives no rows.
    """

    shared = docs.sparkSession.sparkContext.broadcast(model())

    def run(keys: pa.Array, texts: pa.Array) -> dict:
        crf = shared.value
        out: dict = {"key": keys} | {k: [] for k in KINDS} | {"sha": [], "spans": [], "found": []}
        for t in texts.to_pylist():
            base, spans = find(t, crf)
            for k in KINDS:
                out[k].append(len(base[k]))
            said = ",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in base[k])
            out["sha"].append(hashlib.sha256(said.encode()).hexdigest())
            out["spans"].append(",".join(f"{k}:{s}:{e}" for k, s, e in spans))
            out["found"].append([{"kind": k, "start": s, "end": e, "value": t[s:e]} for k, s, e in spans])
        return out

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, found array<struct<kind:string,start:int,end:int,value:string>>"
    return arrow_map(docs, run, schema, key, text)
