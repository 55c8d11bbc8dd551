import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from hirelake.llm import links, simhash
from llm import made


def by_hand(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(points):
    """Smallest index linked to each point."""
    parent = list(range(len(points)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    array = np.array(points, np.uint64)
    for i in range(len(points)):
        for j in np.flatnonzero(np.bitwise_count(array ^ array[i]) <= 4):
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(points))]


def test_documents_against_all_pairs(documents):
    rows = [d for d in made.documents() if d[0] is not None]
    prints = [by_hand(d[1]) for d in rows]
    smallest = {}
    for d, g in zip(rows, groups(prints)):
        smallest[g] = min(d[0], smallest.get(g, d[0]))
    expected = sorted((d[0], f"{p:016x}", smallest[g]) for d, p, g in zip(rows, prints, groups(prints)))
    got = simhash.near_duplicates(documents).collect()
    assert sorted(tuple(r) for r in got if r.doc_id is not None) == expected
    assert sum(r.doc_id is None for r in got) == 2
    kept = simhash.drop_near_duplicates(documents)
    assert kept.columns == documents.columns
    # One row of every component, also where an id has texts in two of them; rows without an id form one of their own.
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(smallest.values())
    assert ids.count(None) == 1


@pytest.mark.parametrize("limit", [simhash.ANCHOR_ROWS, 30])
def test_dense_groups_keep_every_link(spark, limit):
    rng = random.Random(2)
    centres = [rng.getrandbits(64) for _ in range(20)]
    points = []
    for i in range(1500):
        x = rng.choice(centres) if i % 3 else centres[0]
        for b in rng.sample(range(64), rng.choice([0, 1, 2, 3, 4, 5, 7])):
            x ^= 1 << b
        points.append(x)
    points = sorted(set(points))
    signed = [x - (1 << 64) if x >> 63 else x for x in points]
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = simhash.fingerprint_links(frame, 4, limit)
    roots = {r.node: r.root for r in links.components(found).collect()}
    mine = groups(points)
    same = {}
    for x, g in zip(signed, mine):
        same.setdefault(g, set()).add(roots.get(x, x))
    assert all(len(r) == 1 for r in same.values()) and len(set.union(*same.values())) == len(same)


def test_anchors_within_reach_are_all_code_words():
    rng = np.random.default_rng(1)
    points = rng.integers(0, 1 << 31, 40, dtype=np.int64).astype(np.uint32)
    row, anchor = simhash.anchors(points, 2)
    assert {int(np.bitwise_count(np.uint32(points[r] ^ np.uint32(a)))) for r, a in zip(row, anchor)} <= {0, 1, 2}
    assert set(np.bincount(row)) <= {1, 16}


def test_components_of_chains_and_odd_links(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(5, 5), (100, 101), (101, 100), (None, 3)]
    got = {r.node: r.root for r in links.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100}


def test_no_rows(nothing):
    assert simhash.near_duplicates(nothing).count() == 0
    assert simhash.drop_near_duplicates(nothing.withColumn("extra", F.lit(1))).count() == 0
