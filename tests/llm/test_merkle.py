import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from hirelake.llm import merkle
from llm import made


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha(*last[i : i + 2]) for i in range(0, len(last), 2)])
    return levels


def steps(levels, at):
    for level in levels[:-1]:
        yield (level[at ^ 1] if at ^ 1 < len(level) else None, at & 1)
        at >>= 1


def by_hand(rows):
    """Sorted results of ``audit`` over rows (doc_id, text, lang, source, n_chars)."""
    groups = {}
    for r in rows:
        fields = [r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]]
        leaf = sha(*map(field, fields))
        changed = leaf
        if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n_chars"] is not None:
            changed = sha(*map(field, [*fields[:3], r["n_chars"] + 1, r["text"]]))
        groups.setdefault(r["lang"], []).append(((r["doc_id"] is not None, r["doc_id"] or 0, leaf), r["doc_id"], leaf, changed))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda x: x[0])
    trees = {g: tree([leaf for _, _, leaf, _ in groups[g]]) for g in order}
    top = tree([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for i, (_, key, leaf, node) in enumerate(groups[g]):
            path = [*steps(trees[g], i), *steps(top, k)]
            for sibling, left in path:
                node = sha(sibling, node) if left else sha(node, sibling or "")
            out.append((key, leaf, trees[g][-1][0], top[-1][0], sha(*(s or "" for s, _ in path)), node, node == top[-1][0]))
    return sorted(out, key=repr)


def audited(docs):
    found = merkle.audit(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0)
    return sorted((tuple(r) for r in found.collect()), key=repr)


def test_odd_rows_against_plain_trees(documents):
    rows = [dict(zip(documents.columns, d)) for d in made.documents()]
    assert audited(documents) == by_hand(rows)


@pytest.mark.parametrize("sizes", [{"a": 1}, {None: 2, "a": 255, "b": 256, "c": 257, "d": 3, "é": 16, "z": 17}])
def test_groups_around_the_block_size(spark, sizes):
    rows = [dict(doc_id=i, text=f"t{i}", lang=g, source="s", n_chars=i if i % 5 else None) for g, n in sizes.items() for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").repartition(3)
    assert audited(docs) == by_hand(rows)


def test_copies_and_many_groups(spark):
    """Copies of one row fill whole blocks; groups need tiers of their own."""
    rows = [dict(doc_id=7, text="same", lang="a", source=None, n_chars=1)] * 700
    rows += [dict(doc_id=i, text="x", lang=f"g{i}", source="", n_chars=0) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    assert audited(docs) == by_hand(rows)


def test_a_proof_is_of_its_row_and_order_only(spark, documents):
    """Proofs don't depend on how rows lie, and a foreign leaf doesn't lead to the root."""
    leaf = merkle.leaf_of([F.col("text")])
    first = merkle.manifest(documents, leaf).withColumn("to", merkle.fold(F.col("leaf"), F.col("path")))
    again = merkle.manifest(documents.repartition(7), leaf).withColumn("to", merkle.fold(F.lit("0" * 64), F.col("path")))
    a, b = first.collect(), again.collect()
    assert sorted(map(repr, ((r.key, r.path, r.root) for r in a))) == sorted(map(repr, ((r.key, r.path, r.root) for r in b)))
    assert all(r.to == r.root for r in a) and not any(r.to == r.root for r in b)


def test_no_rows(nothing):
    assert merkle.audit(nothing, F.lit(True)).count() == 0
