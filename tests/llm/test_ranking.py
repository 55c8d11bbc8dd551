import math
import random
import re

import numpy as np
import pytest

from hirelake.llm import ranking
from llm import made

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def by_hand(rows, items, top=10):
    """Sorted (item_id, rank, doc_id, score) for rows and items (id, text)."""
    docs = [(i, terms(t)) for i, t in rows if terms(t)]
    number, total = len(docs), sum(len(w) for _, w in docs)
    df = {}
    for _, w in docs:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        scores = []
        for i, w in docs:
            m = 10 + 90 * len(w) * number // total
            score = 0
            for t in set(terms(text)) & set(w):
                tf = w.count(t)
                score += math.floor(1000 * math.log((2 * number + 2) / (2 * df[t] + 1))) * (10**9 * tf // (1000 * tf + 8 * m))
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:top])]
    return sorted(out, key=repr)


def found(docs, queries, **options):
    return sorted((tuple(r) for r in ranking.search(docs, queries, **options).collect()), key=repr)


def test_odd_rows_against_all_scores(spark, documents):
    """Nulls, long texts, repeated rows and items, ties, rows without an id, clashing columns."""
    items = [*made.ITEMS, (8, "another text without an id"), (None, "line one two"), (9, "nowhere to befound")]
    queries = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, segment string, score int")
    assert found(documents, queries) == by_hand([(d[0], d[1]) for d in made.documents()], items)


def corpus(rng):
    words = [f"w{i}" for i in range(120)]
    weights = [1 / (i + 1) for i in range(120)]
    rows = [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 60)))) for i in range(400)]
    rows += [(1000 + i, "w100 w101 w102 " * 3) for i in range(30)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 15)))) for i in range(30)] + [(99, "w100 w101 w102")]
    return rows, items


@pytest.mark.parametrize("block", [ranking.BLOCK_TERMS, 40])
def test_many_segments_against_all_scores(spark, monkeypatch, block):
    """Small segments and blocks change nothing; thirty equal scores are cut by id."""
    monkeypatch.setattr(ranking, "BLOCK_TERMS", block)
    rows, items = corpus(random.Random(5))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    queries = spark.createDataFrame(items, "item_id long, text string")
    assert found(docs, queries, top=7) == by_hand(rows, items, 7)


def test_pair_bounds_skip_what_single_bounds_could_not(monkeypatch):
    """Two heavy terms that never meet bound a segment by one of them, so it is skipped; nothing is lost otherwise."""
    gains = {"a": (np.array([0, 2]), np.array([50, 40])), "b": (np.array([1]), np.array([60])), "c": (np.array([0, 1]), np.array([5, 6]))}
    pairs, bounds = [("a", "b"), ("c", "")], {("a", "b"): 60, ("c", ""): 6}
    assert ranking.best_of_segment(pairs, bounds, gains, 67, 3)[0].size == 0
    docs, scores = ranking.best_of_segment(pairs, bounds, gains, 40, 3)
    assert list(docs) == [1, 0, 2] and list(scores) == [66, 55, 40]
    docs, scores = ranking.best_of_segment(pairs, bounds, gains, 56, 3)
    assert list(docs) == [1] and list(scores) == [66]


def test_pair_lists_hold_joint_maxima(spark):
    rows = [(1, "a b"), (2, "a a a"), (3, "b b"), (4, "c")]
    index = ranking.build_index(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    docs, total = ranking.totals(index)
    assert (docs, total) == (4, 8)
    plan = spark.sparkContext.broadcast(({"a": 7, "b": 5}, None, [("a", "b")]))
    got = ranking.pair_lists(index.where("term IN ('a', 'b')").drop("keys"), plan, docs, total, 2).first()

    def gain(w, tf, n):
        return w * (10**9 * tf // (1000 * tf + 8 * (10 + 90 * n * 4 // 8)))

    both, most = gain(7, 1, 2) + gain(5, 1, 2), gain(7, 3, 3)
    assert (got.joint, got.bound) == (both, max(both, most, gain(5, 2, 2))) and list(got.gains)[0] == got.bound


def test_no_rows(spark, nothing):
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranking.search(nothing, some).count() == 0
    assert ranking.search(some.withColumnRenamed("item_id", "doc_id"), some.where("item_id < 0")).count() == 0
