import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from hirelake.llm import minhash
from llm import made


def grams(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3)))


def by_hand(rows, percent=80):
    """Sorted results for rows (id, text), from all pairs."""
    sets = {s for s in (grams(t) for _, t in rows) if s}
    group = {s: {s} for s in sets}
    for a in sets:
        for b in sets:
            if group[a] is not group[b] and 100 * len(a & b) >= percent * len(a | b):
                group[a] |= group[b]
                for s in group[b]:
                    group[s] = group[a]
    smallest = {}
    for i, t in rows:
        s = grams(t)
        if s and i is not None:
            smallest[id(group[s])] = min(i, smallest.get(id(group[s]), i))
    out = []
    for i, t in rows:
        s = grams(t)
        c = smallest.get(id(group[s])) if s else i
        out.append((i, len(s), c, c == i))
    return sorted(out, key=repr)


def found(docs, **options):
    return sorted((tuple(r) for r in minhash.near_duplicates(docs, **options).collect()), key=repr)


def near(rng):
    """Groups of near copies around the limit, chains, and a passage that many texts hold."""
    words = [f"w{i}" for i in range(500)]
    out = ["One two", "one TWO", "a b c d", "a b c d e", "", " \n", "x", "X"] + ["y z " * n for n in (20, 30)]
    passage = [rng.choice(words) for _ in range(40)]
    for n in (30, 60, 200):
        base = [rng.choice(words) for _ in range(n)]
        for _ in range(40):
            other = list(base)
            for at in rng.sample(range(n), rng.randint(0, max(2, n // 40))):
                other[at] = rng.choice(words)
            out.append(" ".join(other[rng.choice([0, 0, 1, n // 5, n // 8]):]))
            out.append(" ".join(passage + [rng.choice(words) for _ in range(rng.randint(2, 20))]))
    return out


def test_groups_against_all_pairs(spark):
    rows = list(enumerate(near(random.Random(4)) + [None, None]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found(docs) == by_hand(rows)


def test_odd_rows_against_all_pairs(documents):
    assert found(documents) == by_hand([(d[0], d[1]) for d in made.documents()])


def test_estimates_and_bit_counts(spark):
    """Low bits agree as similarity and chance say, in SQL as in NumPy."""
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 62, 4000, dtype=np.uint64)
    rows = []
    for shared in (0, 500, 800, 950, 1000):
        a, b = np.unique(pool[:1000]), np.unique(np.r_[pool[:shared], pool[1000 : 2000 - shared]])
        pa, pb = minhash.packed(minhash.minima(a)), minhash.packed(minhash.minima(b))
        rows.append((shared, [int(x) for x in pa.view(np.int64)], [int(x) for x in pb.view(np.int64)]))
    frame = spark.createDataFrame(rows, "shared int, a array<long>, b array<long>")
    for r in frame.select("shared", minhash.agreement(F.col("a"), F.col("b")).alias("n")).collect():
        similar = r.shared / (2000 - r.shared)
        expected = minhash.MINIMA * (1 / 16 + 15 / 16 * similar)
        assert abs(r.n - expected) < 5 * np.sqrt(minhash.MINIMA / 4)
        assert r.n >= minhash.least_agreement() or similar < 0.8


def test_filter_keeps_every_node(spark):
    nodes = [0, 1, -1, 32767, 32768, 32769, (1 << 26) - 1, 1 << 26, -(1 << 63), (1 << 63) - 1]
    bits = minhash._filter_of(spark.createDataFrame([(x,) for x in nodes], "node long"))
    assert sorted(np.flatnonzero(np.unpackbits(bits, bitorder="little"))) == sorted({x % (1 << 26) for x in nodes})


@pytest.mark.parametrize("percent", [100])
def test_only_equal_sets_at_the_highest_limit(spark, percent):
    rows = [(1, "a b c d e"), (2, "A B c d e"), (3, "a b c d f"), (4, "a b c d e a b c d e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(docs, percent=percent) == by_hand(rows, percent)


def test_no_rows(nothing):
    assert minhash.near_duplicates(nothing).count() == 0


def test_fine_signatures_estimate_closer(spark):
    rng = np.random.default_rng(3)
    sets, rows = [], []
    for i, shared in enumerate((0, 500, 780, 840, 900, 1000)):
        pool = rng.integers(0, 1 << 63, 2000 - shared, dtype=np.uint64)
        a, b = pool[:1000], pool[1000 - shared :]
        sets += [(2 * i, [int(x) for x in a.view(np.int64)]), (2 * i + 1, [int(x) for x in b.view(np.int64)])]
        rows.append((2 * i, 2 * i + 1, shared / (2000 - shared)))
    fine = spark.createDataFrame(sets, "node long, shingles array<long>").mapInArrow(minhash._refine, "node long, fine array<long>")
    pairs = spark.createDataFrame(rows, "a long, b long, similar double")
    both = pairs.join(fine.selectExpr("node AS a", "fine AS x"), "a").join(fine.selectExpr("node AS b", "fine AS y"), "b")
    found = both.select("similar", minhash.fine_agreement(F.col("x"), F.col("y")).alias("n")).collect()
    assert len(found) == len(rows)
    least = minhash.least_agreement(count=minhash.FINE)
    for r in found:
        expected = minhash.FINE * (1 / 16 + 15 / 16 * r.similar)
        assert abs(r.n - expected) < 5 * np.sqrt(minhash.FINE / 4)
        assert r.n >= least if r.similar >= 0.8 else r.n < least or r.similar > 0.7
