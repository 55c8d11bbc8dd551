"""Secret scans: fixed patterns, and a linear-chain conditional random field.

The field tags tokens as secret begin (B), inside (I) or outside (O) from their
shape, the words around them and features of the file.  Only tokens of a
secret's shape may be B or I, so a text falls into runs of such tokens that are
decoded by Viterbi on their own.  It is trained here, on a bounded sample of
documents whose labels are the fixed patterns' values.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.llm.common import small_batches

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key", b"credential", b"private_key", b"bearer")
ASSIGN_WORDS = KEYWORDS[:6]
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
#: Documents whose labels train the field, those with the smallest hashes of their ids.
TRAIN_DOCS = 6000
SHAPE_LEAST, LONG_TOKEN = 6, 20
STEPS, RATE, DECAY = 200, 0.1, 1e-3
OUT, BEGIN, INSIDE = 0, 1, 2
#: A run ends before a gap, and no I follows an O.
NEVER = -1e9
_TRIM = b"\"'`.,;:()[]{}<>=|*#"


def base_spans(text: str, raw: bytes) -> list[tuple[int, int, int, int, int]]:
    """(start, kind, end, value start, value end) of the fixed patterns, in order."""
    found = []
    low = raw.lower()
    if any(word in low for word in ASSIGN_WORDS):
        found += [
            (m.start(), 0, m.end(), m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST
        ]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end(), m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    if _has_run(np.frombuffer(raw, np.uint8)):
        found += [(m.start(), 2, m.end(), m.start(), m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= HEX_LEAST]
    return sorted(found)


def _table(characters: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(characters)] = True
    return table


_DIGIT, _UPPER = _table(b"0123456789"), _table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LOWER, _HEX = _table(b"abcdefghijklmnopqrstuvwxyz"), _table(b"0123456789abcdef")
_SPACE, _SIGN, _SET = _table(b" \t\n\v\f\r"), _table(b"+/_=-"), _table(b":=")


def _has_run(data: np.ndarray) -> bool:
    """Whether HEX_LEAST hexadecimal digits stand side by side."""
    if len(data) < HEX_LEAST:
        return False
    other = np.flatnonzero(~_HEX[data])
    return bool((np.diff(np.r_[-1, other, len(data)]) > HEX_LEAST).any())


class Tokens:
    """Tokens of one text with the shape of each, and the runs that may hold secrets."""

    def __init__(self, raw: bytes):
        data = np.frombuffer(raw, np.uint8)
        gap = np.r_[True, _SPACE[data], True]
        self.starts = np.flatnonzero(gap[:-1] & ~gap[1:])
        self.ends = np.flatnonzero(~gap[:-1] & gap[1:])
        self.raw, self.data = raw, data
        size = self.ends - self.starts
        digits = self._count(_DIGIT)
        self.shaped = (size >= SHAPE_LEAST) & ((digits > 0) | (size >= LONG_TOKEN))
        self.size, self.digits = size, digits

    def _count(self, table: np.ndarray) -> np.ndarray:
        sums = np.r_[0, np.cumsum(table[self.data])]
        return sums[self.ends] - sums[self.starts]

    def runs(self) -> list[tuple[int, int]]:
        mask = np.r_[False, self.shaped, False]
        edges = np.flatnonzero(mask[1:] != mask[:-1])
        return list(zip(edges[::2].tolist(), edges[1::2].tolist()))

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """Shaped tokens and one row of 0/1 features for each."""
        at = np.flatnonzero(self.shaped)
        size, digits = self.size[at], self.digits[at]
        upper, lower, hexa, sign = (self._count(t)[at] for t in (_UPPER, _LOWER, _HEX, _SIGN))
        plain = np.maximum(digits + upper + lower, 1)
        low = self.raw.lower()
        words = [low[a:b] for a, b in zip(self.starts.tolist(), self.ends.tolist())] if len(at) < 64 else None

        def around(i: int, back: int) -> bytes:
            if i < back:
                return b""
            return words[i - back] if words else low[self.starts[i - back] : self.ends[i - back]]

        near = [[around(i, k) for k in range(4)] for i in at.tolist()]
        has = lambda word: any(k in word for k in KEYWORDS)
        named = has(low)
        columns = [
            np.ones(len(at)), size < 12, (size >= 12) & (size < 20), (size >= 20) & (size < 32), size >= 32,
            digits == 0, digits == plain, (digits > 0) & (4 * digits < plain), (4 * digits >= plain) & (digits < plain),
            hexa >= 0.9 * size, (upper > 0) & (lower > 0) & (digits > 0), (upper > 1) & (lower == 0), (lower == 0) & (upper == 0),
            sign > 0, plain < 0.8 * size, [w[0][:1] in (b'"', b"'", b"`") for w in near],
            [w[0].startswith((b"http", b"www")) or b"@" in w[0] for w in near], [w[0][:1] in (b"+", b"(") for w in near],
            [has(w[0]) for w in near], [has(w[1]) for w in near], [has(w[2]) or has(w[3]) for w in near],
            [w[1][-1:] in (b"=", b":") for w in near], [b"=" in w[0][:-1] or b":" in w[0][:-1] for w in near],
            np.full(len(at), named), np.full(len(at), 20 * _SIGN[self.data].sum() > len(self.data)),
        ]
        return at, np.stack([np.asarray(c, np.float64) for c in columns], axis=1)


FEATURES = 25
_HEXA, _MIXED = 9, 10


class Field:
    """Weights of the features for each tag, and of tag pairs; the edges count as O."""

    def __init__(self, weights: np.ndarray, pairs: np.ndarray):
        self.weights, self.pairs = weights, pairs

    def viterbi(self, features: np.ndarray) -> list[int]:
        scores = features @ self.weights
        best, back = self.pairs[OUT] + scores[0], []
        for score in scores[1:]:
            step = best[:, None] + self.pairs
            back.append(step.argmax(axis=0))
            best = step.max(axis=0) + score
        tags = [int((best + self.pairs[:, OUT]).argmax())]
        for step in reversed(back):
            tags.append(int(step[tags[-1]]))
        return tags[::-1]


def _sum_exp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def train(runs: list[np.ndarray], tags: list[np.ndarray]) -> Field:
    """Penalised maximum likelihood by gradient steps over all runs at once.

    Without a secret among the tags the field tags nothing.
    """
    pairs = np.zeros((3, 3))
    pairs[OUT, INSIDE] = NEVER
    weights = np.zeros((FEATURES, 3))
    if not any((t != OUT).any() for t in tags):
        weights[0, 1:] = NEVER
        return Field(weights, pairs)
    longest = max(map(len, runs))
    x = np.zeros((len(runs), longest, FEATURES))
    y = np.zeros((len(runs), longest + 2), np.int64)
    inside = np.zeros((len(runs), longest))
    for i, (run, own) in enumerate(zip(runs, tags)):
        x[i, : len(run)], y[i, 1 : len(run) + 1], inside[i, : len(run)] = run, own, 1
    eye = np.eye(3)
    gold = np.einsum("nlf,nlt,nl->ft", x, eye[y[:, 1:-1]], inside)
    gold_pairs = np.einsum("nls,nlt->st", eye[y[:, :-1]], eye[y[:, 1:]])
    memory = [np.zeros_like(weights), np.zeros_like(pairs)]
    for _ in range(STEPS):
        # Places after a run are O for certain.
        score = x @ weights + np.where(inside[:, :, None] > 0, 0, np.array([0, NEVER, NEVER]))
        ahead, behind = np.empty_like(score), np.empty_like(score)
        ahead[:, 0] = pairs[OUT] + score[:, 0]
        for t in range(1, longest):
            ahead[:, t] = _sum_exp(ahead[:, t - 1][:, :, None] + pairs, 1) + score[:, t]
        behind[:, -1] = pairs[:, OUT]
        for t in range(longest - 2, -1, -1):
            behind[:, t] = _sum_exp(pairs + (score[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
        whole = _sum_exp(ahead[:, -1] + pairs[:, OUT], 1)
        chance = np.exp(ahead + behind - whole[:, None, None])
        seen = np.einsum("nlf,nlt,nl->ft", x, chance, inside)
        seen_pairs = np.zeros((3, 3))
        seen_pairs[OUT] += chance[:, 0].sum(axis=0)
        seen_pairs[:, OUT] += chance[:, -1].sum(axis=0)
        for t in range(1, longest):
            both = ahead[:, t - 1][:, :, None] + pairs + (score[:, t] + behind[:, t])[:, None, :] - whole[:, None, None]
            seen_pairs += np.exp(both).sum(axis=0)
        for value, old, step in (
            (weights, memory[0], gold - seen - DECAY * len(runs) * weights),
            (pairs, memory[1], gold_pairs - seen_pairs - DECAY * len(runs) * np.where(pairs > NEVER, pairs, 0)),
        ):
            old += step * step
            value += RATE * step / np.sqrt(old + 1e-8)
        pairs[OUT, INSIDE] = NEVER
    return Field(weights, pairs)


def _gold(tokens: Tokens, spans: list[tuple[int, int]]) -> np.ndarray:
    """Tag of each token: B where a value begins in it, I where one goes on."""
    tags = np.zeros(len(tokens.starts), np.int64)
    for low, high in spans:
        hit = np.flatnonzero((tokens.starts < high) & (tokens.ends > low))
        tags[hit[1:]] = INSIDE
        tags[hit[:1]] = BEGIN
    return tags


def training_runs(text: str) -> tuple[list[np.ndarray], list[np.ndarray]]:
    raw = text.encode()
    tokens = Tokens(raw)
    if not tokens.shaped.any():
        return [], []
    values = [(len(text[:a].encode()), len(text[:b].encode())) for *_, a, b in base_spans(text, raw)]
    tags = _gold(tokens, values)
    at, features = tokens.features()
    place = np.searchsorted(at, [a for a, _ in tokens.runs()])
    ends = [p + b - a for p, (a, b) in zip(place, tokens.runs())]
    own = tags[at]
    own[(own == INSIDE) & np.r_[True, (own[:-1] == OUT) | (np.diff(at) > 1)]] = BEGIN
    return [features[p:e] for p, e in zip(place, ends)], [own[p:e] for p, e in zip(place, ends)]


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", train_docs: int = TRAIN_DOCS) -> Field:
    """Train on at most ``train_docs`` documents, chosen by the hash of their ids."""
    ids = docs.select(key).where(F.col(key).isNotNull()).distinct().orderBy(F.xxhash64(key), key).limit(train_docs)
    sample = docs.join(F.broadcast(ids), key, "left_semi").select(key, text).where(F.col(text).isNotNull())
    runs, tags = [], []
    for row in sample.dropDuplicates([key]).orderBy(key).toLocalIterator():
        more, own = training_runs(row[1])
        for run, tag in zip(more, own):
            for a in range(0, len(run), 32):
                runs.append(run[a : a + 32])
                tags.append(tag[a : a + 32])
    # The fixed patterns know few forms of a value.  A second copy of each run
    # with a secret has the secret's tokens in mixed letters, so that the words
    # around it count on their own.
    for run, tag in list(zip(runs, tags)):
        if (tag != OUT).any():
            other = run.copy()
            other[tag != OUT, _HEXA], other[tag != OUT, _MIXED] = 0, 1
            runs.append(other)
            tags.append(tag)
    return train(runs, tags)


def scan(text: str | None, field: Field) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and those that the field adds, each (start, kind, end) in code points."""
    text = text or ""
    raw = text.encode()
    base = [s[:3] for s in base_spans(text, raw)]
    tokens = Tokens(raw)
    added = []
    if tokens.shaped.any():
        at, features = tokens.features()
        done = 0
        for first, last in tokens.runs():
            tags = field.viterbi(features[done : done + last - first])
            done += last - first
            i = 0
            while i < len(tags):
                j = i + 1
                if tags[i] != OUT:
                    while j < len(tags) and tags[j] == INSIDE:
                        j += 1
                    low, high = int(tokens.starts[first + i]), int(tokens.ends[first + j - 1])
                    while low < high and raw[low] in _TRIM:
                        low += 1
                    while high > low and raw[high - 1] in _TRIM:
                        high -= 1
                    if low < high:
                        added.append((low, high))
                i = j
    if added and len(raw) != len(text):
        lead = np.r_[0, np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)]
        added = [(int(lead[a]), int(lead[b])) for a, b in added]
    more = [(a, len(KINDS), b) for a, b in added if all(b <= s or e <= a for s, _, e in base)]
    return base, more


def _joined(spans: list[tuple[int, int, int]]) -> str:
    names = (*KINDS, "crf")
    return ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(spans))


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", field: Field | None = None) -> DataFrame:
    """Numbers of base spans, their digest, and all spans of every row's text.

    A null text is empty and has no span; repeated rows get equal rows; no rows
    give none.  Spans of the field that touch a base span are left out.  Only
    ``key`` and ``text`` are read.
    """
    small_batches(docs.sparkSession)
    field = field or fit(docs, key, text)

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    def find(texts: pd.Series) -> pd.DataFrame:
        out = []
        for body in texts:
            base, more = scan(body, field)
            numbers = [sum(k == kind for _, k, _ in base) for kind in range(3)]
            out.append((*numbers, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + more)))
        return pd.DataFrame(out, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    found = docs.select(F.col(key).alias("doc_id"), find(F.col(text).cast("string")).alias("s"))
    return found.select("doc_id", "s.*")
