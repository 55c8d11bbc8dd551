import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hirelake.llm import mixing


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(900):
        toxic, good = i % 5 == 0, i % 4 > 0
        body = [rng.choice(words) for _ in range(rng.randint(30, 90))]
        if toxic:
            body[3] = rng.choice(["nastyword", "awfulword"])
        if not good:
            body = [w + " |" for w in body]
        rows.append((i, " ".join(body), "x", 1.0))
        if i < 600:
            labels.append((i, int(good), int(toxic), "x"))
    rows += [(2000, None, None, None), (2001, "", None, None), (None, "words without an id", None, None), rows[7], rows[7]]
    labels += [(None, 1, 0, None), (5, None, 1, None), (99_999, 1, 1, None), (0, 7, 0, None), labels[3]]
    return (
        spark.createDataFrame(rows, "doc_id long, text string, p string, rate double").repartition(3),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string"),
    )


def test_rates_meet_the_targets(tables):
    docs, labels = tables
    rows = mixing.mix(docs, labels, (0.1, 0.02, 0.86, 0.02)).collect()
    assert len(rows) == docs.count() and all(r.rate >= 0 for r in rows)
    total = sum(r.tokens for r in rows)
    for d, share in enumerate((0.1, 0.02, 0.86, 0.02)):
        assert abs(sum(r.tokens * r.rate * r.p[d] for r in rows) / total - share) < 0.01
    # Posteriors on documents that had no label in training.
    unseen = [r for r in rows if r.doc_id is not None and 600 <= r.doc_id < 900]
    right = sum(max(range(4), key=lambda d: r.p[d]) == 2 * (r.doc_id % 4 > 0) + (r.doc_id % 5 == 0) for r in unseen)
    assert right / len(unseen) > 0.95


def solved(p, tokens, targets):
    """Expected tokens of each domain after plain projected gradient with tiny safe steps."""
    a = (p * tokens[:, None]).T
    step, rate = 1 / np.linalg.norm(a @ a.T, 2), np.ones(len(tokens))
    weigh = np.diag(1 / np.array(targets))
    step /= weigh.max()
    for _ in range(200_000):
        rate = np.maximum(0, rate - step * (a.T @ (weigh @ (a @ rate - targets))))
    return a @ rate


@pytest.mark.parametrize("shares", [(0.1, 0.02, 0.86, 0.02), (0.3, 0.03, 0.65, 0.02)])
def test_rates_against_plain_least_squares(tables, shares):
    """Domain by domain within one percent of the target, and of another solver's result."""
    docs, labels = tables
    found = mixing.mix(docs, labels, shares)
    rows = found.collect()
    p, tokens, rate = (np.array([getattr(r, c) for r in rows], float) for c in ("p", "tokens", "rate"))
    targets = [tokens.sum() * s for s in shares]
    expected = solved(p, tokens, targets)
    assert (rate >= 0).all()
    assert np.allclose((p * (tokens * rate)[:, None]).sum(axis=0), targets, rtol=0.01)
    assert np.allclose(expected, targets, rtol=0.01)
    report = {r.domain: r for r in mixing.gaps(found, targets).collect()}
    assert np.allclose([report[d].expected for d in mixing.DOMAINS], [report[d].target for d in mixing.DOMAINS], rtol=0.01)


def test_targets_out_of_reach_are_reported(tables):
    docs, labels = tables
    members = mixing.memberships(docs, labels, "doc_id", "text").withColumn("p", F.array(*map(F.lit, (0.5, 0.0, 0.5, 0.0))))
    with pytest.warns(UserWarning, match="targets not met"):
        rates = mixing.fit_rates(members, [900.0, 5.0, 90.0, 5.0], rounds=6)
    assert rates.where("rate < 0 OR isnan(rate)").isEmpty()


def test_a_mix_keeps_what_is_short_of_its_target(tables):
    docs, labels = tables
    kept = mixing.apply_mix(docs, labels, (0.2, 0.005, 0.79, 0.005))
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert all(i in ids for i in range(900) if i % 4 and i % 5)
    assert sum(i in ids for i in range(0, 900, 5)) < 40


def test_no_rows_and_no_labels(tables):
    docs, labels = tables
    assert mixing.mix(docs.limit(0), labels).count() == 0
    none = mixing.memberships(docs.where(F.col("doc_id") < 3), labels.limit(0), "doc_id", "text").collect()
    assert all(r.p == [0.25] * 4 for r in none)
