"""Mixing sources to target weights with soft membership.

A classifier trained on the labelled table gives every document a posterior
over domains.  Document rates, zero or more, are then fitted so that the
expected tokens of each domain come to its target: least squares, solved by
projected gradient.  Each step is one distributed sum over the documents; only
one number a domain comes back.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.llm.common import carry, small_batches, text_key
from hirelake.session import materialize

#: Domains are the combinations of the two labels; their names, and the share of tokens each is to have.
DOMAINS = ("poor", "poor_toxic", "good", "good_toxic")
TARGETS = (0.045, 0.001, 0.95, 0.004)
#: Hashed words that the classifier may look at.
FEATURES = 1 << 16
#: Labelled documents the classifier is fitted on: those with the smallest hashes of their ids.
TRAIN_DOCS = 4_000
#: A word is looked at if it tells a label apart by so many standard deviations.
TELLING = 4.0
DESCENTS, DECAY = 400, 1e-3
ROUNDS = 40
#: Steps between writes of the rates reached.
WRITE_EVERY = 8
#: A target is met within this share of it.
MET = 1e-3
#: With an upper limit, steps end when no domain's gap, or no domain's tokens since the last step, differ by this share of all tokens.
NEAR = 1e-4
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def hashed_words(raw: bytes) -> np.ndarray:
    """Feature of each word: a polynomial hash of its letters, other signs left out."""
    data = np.frombuffer(raw.lower(), np.uint8)
    letter = ((data >= 97) & (data <= 122)) | (data >= 128)
    gap = np.r_[True, _SPACE[data]] if len(data) else np.ones(1, bool)
    word = np.cumsum(gap[:-1] & ~gap[1:]) - 1
    spot = np.flatnonzero(letter & (word >= 0))
    if not spot.size:
        return np.zeros(0, np.int64)
    own = word[spot]
    fresh = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    depth = np.arange(len(spot)) - np.repeat(fresh, np.diff(np.r_[fresh, len(spot)]))
    power = (np.uint64(0x9E3779B97F4A7C15) * (2 * depth.astype(np.uint64) + np.uint64(1))) | np.uint64(1)
    value = (data[spot].astype(np.uint64) + np.uint64(257)) * power
    value ^= value >> np.uint64(29)
    total = np.add.reduceat(value * np.uint64(0xBF58476D1CE4E5B9), fresh)
    return ((total ^ (total >> np.uint64(32))) % np.uint64(FEATURES)).astype(np.int64)


def shape(raw: bytes, features: np.ndarray) -> list[float]:
    """Measures of a whole text: length, variety of words, and shares of signs, digits and lines."""
    size, words = max(len(raw), 1), max(len(features), 1)
    signs = sum(raw.count(c) for c in (b"|", b"#", b"*", b"%", b"&", b"$", b"<", b">"))
    digits = sum(raw.count(b"%d" % d) for d in range(10))
    return [
        np.log1p(len(features)) / 5, len(np.unique(features)) / words, min(5.0, 20 * signs / size), min(5.0, 20 * digits / size),
        min(5.0, 20 * raw.count(b"\n") / words), min(5.0, size / words / 5),
    ]


class Classifier:
    """Logistic regressions for quality and toxicity on telling words and the text's shape."""

    def __init__(self, words: np.ndarray, weights: np.ndarray):
        self.column = np.full(FEATURES, -1)
        self.column[words] = np.arange(len(words))
        self.words, self.weights = words, weights.astype(np.float64)

    def inputs(self, raw: bytes, features: np.ndarray) -> np.ndarray:
        row = np.zeros(len(self.words) + 7)
        own = self.column[features]
        row[own[own >= 0]] = 1
        row[len(self.words) :] = [1.0, *shape(raw, features)]
        return row

    def posterior(self, raw: bytes) -> list[float]:
        """Chance of each domain, the two labels being independent given the text."""
        good, toxic = 1 / (1 + np.exp(-np.clip(self.inputs(raw, hashed_words(raw)) @ self.weights, -30, 30)))
        return [(1 - good) * (1 - toxic), (1 - good) * toxic, good * (1 - toxic), good * toxic]


def _telling(present: np.ndarray, label: np.ndarray, features: list[np.ndarray]) -> np.ndarray:
    """Words whose documents have a label more or less often than others do."""
    with_label = np.zeros(FEATURES)
    for own in (features[i] for i in np.flatnonzero(label)):
        with_label[own] += 1
    rate = label.mean()
    spread = np.sqrt(np.maximum(present * rate * (1 - rate) * (1 - present / len(label)), 1e-9))
    return np.flatnonzero((present >= 5) & (np.abs(with_label - present * rate) > TELLING * spread))


def fit_classifier(docs: DataFrame, labels: DataFrame, key: str, text: str, train_docs: int = TRAIN_DOCS) -> Classifier:
    """Fit on at most ``train_docs`` labelled documents, one text of each id.

    Only labels of ids that ``docs`` holds count.  Of several texts under an id
    that with the smallest hash is taken.  Without labelled documents every
    domain is equally likely.
    """
    held = docs.select(F.col(key).alias("_id")).distinct()
    known = materialize(
        labels.where(F.col("quality").isin(0, 1) & F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").alias("_id")).agg(
            F.max(2 * F.col("quality") + F.col("toxic")).cast("int").alias("_domain")
        ).where("_id IS NOT NULL").join(held, "_id", "left_semi").orderBy(F.xxhash64("_id"), "_id").limit(train_docs),
        "labelled",
    )
    texts = docs.select(F.col(key).alias("_id"), F.col(text).cast("binary").alias("_raw")).join(F.broadcast(known), "_id")
    # The hash decides first, so that no more than one text of an id is moved.
    least = texts.groupBy("_id").agg(F.min(F.xxhash64("_raw")).alias("_least"))
    rows = texts.join(F.broadcast(least), "_id").where(F.xxhash64("_raw") == F.col("_least")).dropDuplicates(["_id"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [raw.as_py() or b"" for raw in batch.column(0)]
            words = [hashed_words(raw) for raw in bodies]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array([np.unique(w).astype(np.int32) for w in words], pa.list_(pa.int32())),
                 pa.array([shape(raw, w) for raw, w in zip(bodies, words)], pa.list_(pa.float64()))],
                ["domain", "words", "shape"],
            )

    sample = rows.select("_raw", "_domain").mapInArrow(gather, "domain int, words array<int>, shape array<double>").toPandas()
    if sample.empty:
        return Classifier(np.zeros(0, np.int64), np.zeros((7, 2)))
    features = list(sample["words"])
    present = np.zeros(FEATURES)
    for own in features:
        present[own] += 1
    truth = np.stack([sample["domain"].to_numpy() // 2, sample["domain"].to_numpy() % 2], axis=1).astype(np.float64)
    words = np.union1d(*(_telling(present, truth[:, k], features) for k in (0, 1)))
    model = Classifier(words, np.zeros((len(words) + 7, 2)))
    x = np.zeros((len(features), len(words) + 7), np.float32)
    for row, own, dense in zip(x, features, sample["shape"]):
        at = model.column[own]
        row[at[at >= 0]] = 1
        row[len(words) :] = [1.0, *dense]
    weights, memory = np.zeros((x.shape[1], 2), np.float32), np.full((x.shape[1], 2), 1e-6, np.float32)
    for _ in range(DESCENTS):
        chance = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (chance - truth).astype(np.float32) / len(x) + DECAY * weights / np.sqrt(len(x))
        memory += slope * slope
        weights -= 0.3 * slope / np.sqrt(memory)
    model.weights = weights.astype(np.float64)
    return model


def memberships(docs: DataFrame, labels: DataFrame, key: str, text: str, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, key, tokens, p) of every row: words, and posterior over the domains."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit_classifier(docs, labels, key, text, train_docs))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, chances = [], []
            for raw in batch.column(2):
                body = raw.as_py() or b""
                gap = np.r_[True, _SPACE[np.frombuffer(body, np.uint8)]]
                tokens.append(int((gap[:-1] & ~gap[1:]).sum()))
                chances.append([float(c) for c in model.value.posterior(body)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(tokens, pa.int64()), pa.array(chances, pa.list_(pa.float64()))],
                ["doc_id", "key", "tokens", "p"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), text_key(text), F.col(text).cast("binary")).mapInArrow(
        judge, f"doc_id {kind}, key binary, tokens long, p array<double>"
    )


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def fit_rates(members: DataFrame, targets: list[float], most: float | None = None, rounds: int = ROUNDS) -> DataFrame:
    """``members`` with ``rate``: nonnegative, expected domain tokens near ``targets``.

    Minimises the squared gaps between the domains' expected tokens and their
    targets.  A step moves each rate by its document's share in the gaps and
    projects it to 0 and more, or up to ``most``.  Gaps are weighed by the
    inverse of the domains' moments, so that a small domain counts as much as a
    large one.  Without an upper limit those are the moments of the documents
    whose rate isn't zero: the others can't take up a part of the gap, and with
    them a step would fall short.  Steps end when every domain is within MET of
    its target; targets that are not met after ``rounds`` steps are reported by
    a warning, and can be seen by ``gaps``.  With an upper limit targets are
    often out of reach, and steps end when nothing moves any more.  A step
    needs one sum over all rows; the rates reached are written every few steps.
    """
    n = len(targets)
    p = [F.get("p", F.lit(d)) for d in range(n)]
    first = members.agg(F.sum("tokens").alias("all")).first()
    rows = members.withColumn("rate", F.lit(1.0))
    if not first["all"]:
        return rows
    moves: list[list[float]] = []
    before, gap = None, None

    def stepped() -> DataFrame:
        rate = F.col("rate")
        for move in moves:
            rate = F.greatest(F.lit(0.0), rate - _sum([p[d] * move[d] for d in range(n)]))
            rate = F.least(F.lit(float(most)), rate) if most is not None else rate
        return rows.withColumn("rate", rate)

    aims = np.array(targets)
    for _ in range(rounds):
        moved = F.when(F.col("rate") > 0, F.col("tokens")).otherwise(F.lit(0)) if most is None else F.col("tokens")
        sums = stepped().agg(
            *(F.sum(F.col("tokens") * F.col("rate") * p[d]) for d in range(n)),
            *(F.sum(moved * p[d] * p[e]) for d in range(n) for e in range(n)),
        ).first()
        now, moments = np.array(sums[:n], float), np.array(sums[n:], float).reshape(n, n)
        gap = now - aims
        if most is None and (np.abs(gap) <= MET * aims + NEAR / 100 * first["all"]).all():
            break
        still = before is not None and np.abs(now - before).max() <= NEAR / 10 * first["all"]
        if most is not None and (still or np.abs(gap).max() <= NEAR * first["all"]):
            break
        before = now
        floor = 1e-9 if most is None else 1e-6
        moves.append((np.linalg.inv(moments + floor * np.trace(moments) * np.eye(n)) @ gap).tolist())
        if len(moves) == WRITE_EVERY:
            rows, moves = materialize(stepped(), "rates"), []
    else:
        if most is None:
            warnings.warn(f"targets not met after {rounds} steps, last gaps {gap.tolist()} tokens", stacklevel=2)
    return stepped()


def gaps(rates: DataFrame, targets: Sequence[float]) -> DataFrame:
    """(domain, target, expected): the tokens each domain was to have, and those it can be expected to."""
    sums = F.array(*(F.sum(F.col("tokens") * F.col("rate") * F.get("p", F.lit(d))) for d in range(len(targets))))
    both = F.arrays_zip(F.array(*map(F.lit, DOMAINS)).alias("domain"), F.array(*(F.lit(float(t)) for t in targets)).alias("target"),
                        F.col("sums").alias("expected"))
    return rates.agg(sums.alias("sums")).select(F.inline(both))


def mix(docs: DataFrame, labels: DataFrame, shares: tuple[float, ...] = TARGETS, most: float | None = None, key: str = "doc_id", text: str = "text", train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, key, tokens, p, rate) of every row; targets are ``shares`` of all tokens.

    A null or empty text has no tokens and the labels' own frequencies as its
    posterior.  Repeated rows are documents of their own.  Labels that are null,
    unknown or of no document aren't used; a document labelled twice has the
    higher domain.  No rows give no rows.  Other columns aren't read.
    """
    members = materialize(memberships(docs, labels, key, text, train_docs), "memberships")
    total = members.agg(F.sum("tokens")).first()[0] or 0
    return fit_rates(members, [total * s for s in shares], most)


def apply_mix(docs: DataFrame, labels: DataFrame, shares: tuple[float, ...] = TARGETS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows that a mix with rates up to one keeps, in all their columns.

    A row stays if the hash of its text, as a number under one, lies below its
    rate; so copies of a text share their fate, and rates of one keep all.
    """
    rates = mix(docs, labels, shares, 1.0, key, text).groupBy("key").agg(F.max("rate").alias("_rate"))
    gone = rates.where(F.pmod(F.xxhash64(F.lit("mix"), "key"), F.lit(1 << 20)) + 0.5 >= F.col("_rate") * (1 << 20)).select(
        F.col("key").alias("_key")
    )
    return docs.select(carry(docs), text_key(text).alias("_key")).join(gone, "_key", "left_anti").select("_row.*")
