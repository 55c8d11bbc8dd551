import random
import zlib
from collections import defaultdict

import numpy as np

from hirelake.llm.sharding import assign_shards, jump_hash
from llm import made


def by_hand(key, shards):
    key, b, j = key % (1 << 64), -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_equals_its_definition_and_moves_only_into_the_new_shard():
    keys = [random.Random(1).getrandbits(64) - (1 << 63) for _ in range(1)] + list(range(-500, 500))
    array = np.array(keys, np.int64)
    for shards in (1, 2, 40):
        now, grown = jump_hash(array, shards), jump_hash(array, shards + 1)
        assert now.tolist() == [by_hand(k, shards) for k in keys]
        assert all(g in (n, shards) for n, g in zip(now, grown))


def test_every_row_gets_one_slot(documents):
    rows = assign_shards(documents, 5, buckets=4).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted(
        (str(d[0]), len((d[1] or "").encode()) + 16, zlib.crc32((d[1] or "").encode())) for d in made.documents()
    )
    slots, shard = defaultdict(list), {}
    for r in rows:
        slots[r.shard].append(r.slot)
        assert shard.setdefault(r.doc_id, r.shard) == r.shard
        assert r.law == "key" and r.grown_shard in (r.shard, 5)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_a_row_repeated_many_times(spark):
    many = spark.range(150_000).selectExpr("7L doc_id", "'x' text")
    rows = assign_shards(many, 3).agg({"slot": "max", "*": "count"}).first()
    assert tuple(rows) in {(149_999, 150_000), (150_000, 149_999)}


def test_no_rows(nothing):
    assert assign_shards(nothing, 3).count() == 0
