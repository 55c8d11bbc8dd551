"""Ranked lexical search: MaxScore with bounds on pairs of terms.

The index is cut into segments of a bounded number of documents, which tasks
fill as they read.  For a set of queries every query's terms are put into
pairs, heaviest first, and an intersection list is worked out for each pair
and segment: the documents that hold both terms, by their joint impact.  It
keeps the joint maximum and the best ``k`` entries, as no other entry can bound
or raise a query's top k.

A query takes its threshold from the best entries of its lists.  In a segment
no document can gain more from a pair than the greatest of the two terms' own
maxima and their joint maximum, which is less than the sum of the two where
the terms' best documents differ.  Pairs whose bounds together stay below the
threshold raise no candidates, a segment whose bounds all do is skipped, and a
candidate is dropped as soon as the bounds of what is left can't lift it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirelake.llm.common import ascii_lower, small_batches
from hirelake.session import materialize

#: A segment ends after so many documents or terms, repeats included.
SEGMENT_DOCS, SEGMENT_TERMS = 8_192, 1_000_000
#: Terms of the queries that are worked on at once, about.
BLOCK_TERMS = 200_000
TOP = 10
_TERM = rb"[0-9A-Za-z\x80-\xff]+"
_TERM_SQL = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Name of the index row that holds a segment's keys and lengths; no term is empty.
_HEAD = ""
_ALONE = ""


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(_TERM_SQL), F.lit(0))


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """Share of a term's weight that a document of ``n`` terms takes: whole numbers, rounded down."""
    m = 10 + (90 * n.astype(np.int64) * docs) // max(total, 1)
    return (1_000_000_000 * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + 8 * m)


def weight(df: Column, docs: int) -> Column:
    return F.floor(F.lit(1000.0) * F.log((F.lit(2.0 * docs + 2)) / (2 * df + 1))).cast("long")


def _lists(cuts: np.ndarray, *values: np.ndarray) -> list[pa.Array]:
    return [pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(v.astype(np.int32))) for v in values]


def _segment(name: str, known: dict[bytes, int], keys: list, held: list[np.ndarray], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Index rows of one segment: its head, then one row a term."""
    order = sorted(range(len(keys)), key=lambda i: (keys[i] is None, 0 if keys[i] is None else keys[i]))
    lengths = np.array([len(held[i]) for i in order], np.int64)
    doc = np.repeat(np.arange(len(order)), lengths)
    pair, tf = np.unique(np.concatenate([held[i] for i in order]) * len(order) + doc, return_counts=True)
    term, doc = np.divmod(pair, len(order))
    starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
    names = ["segment", "term", "docs", "tfs", "lengths", "keys"]
    words = [w.decode() for w in known]
    yield pa.RecordBatch.from_arrays(
        [pa.array([name]), pa.array([_HEAD]), *_lists(np.zeros(2), doc[:0], tf[:0]), *_lists(np.array([0, len(order)]), lengths),
         pa.array([[keys[i] for i in order]], pa.list_(kind))], names,
    )
    for at in range(0, len(starts), 8_192):
        own = starts[at : at + 8_192]
        end = starts[at + 8_192] if at + 8_192 < len(starts) else len(term)
        cuts, span = np.r_[own, end] - own[0], slice(own[0], end)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * len(own)), pa.array([words[t] for t in term[own]]), *_lists(cuts, doc[span], tf[span], lengths[doc[span]]),
             pa.nulls(len(own), pa.list_(kind))], names,
        )


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Term lists (segment, term, docs, tfs, lengths) of all rows with a term, and a head row with the keys of each segment.

    A task cuts the rows it reads into segments; a segment's documents are
    numbered by key, null keys last, so that equal scores stand in key order.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").cast("binary").alias("body"))
    pattern = re.compile(_TERM)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, known, keys, held, size = TaskContext.get().partitionId(), 0, {}, [], [], 0
        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = pattern.findall((body.as_py() or b"").lower())
                if not words:
                    continue
                keys.append(name)
                held.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)))
                size += len(words)
                if len(keys) >= SEGMENT_DOCS or size >= SEGMENT_TERMS:
                    yield from _segment(f"{part}-{number}", known, keys, held, kind)
                    number, known, keys, held, size = number + 1, {}, [], [], 0
        if keys:
            yield from _segment(f"{part}-{number}", known, keys, held, kind)

    schema = "segment string, term string, docs array<int>, tfs array<int>, lengths array<int>, keys array<%s>"
    return materialize(rows.mapInArrow(fill, schema % docs.schema[key].dataType.simpleString()), "lexical-index")


def totals(index: DataFrame) -> tuple[int, int]:
    """Documents with a term, and terms with their repeats."""
    length = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n)
    row = index.where(F.col("term") == _HEAD).agg(F.sum(F.size("keys")), F.sum(length)).first()
    return int(row[0] or 0), int(row[1] or 0)


def _gains(frame: pd.DataFrame, weights: dict[str, int], docs: int, total: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Documents of each term of a segment and what the term adds to their scores."""
    return {
        term: (own, weights[term] * impacts(tf, n, docs, total))
        for term, own, tf, n in zip(frame["term"], frame["docs"], frame["tfs"], frame["lengths"])
    }


def pair_lists(postings: DataFrame, plan, docs: int, total: int, top: int) -> DataFrame:
    """(segment, a, b, bound, joint, docs, gains) of every pair of a plan and segment that holds one of its terms.

    ``joint`` is the greatest gain of a document with both terms, ``bound`` the
    greatest of any.  ``docs`` are the ``top`` documents by gain.
    """

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        weights, _, pairs = plan.value
        gains, segment, out = _gains(frame, weights, docs, total), frame["segment"].iloc[0], []
        space = np.zeros(SEGMENT_DOCS, np.int64)
        for a, b in pairs:
            held = [gains[t] for t in (a, b) if t in gains]
            if not held:
                continue
            for own, gain in held:
                space[own] += gain
            seen = np.unique(np.concatenate([own for own, _ in held])) if len(held) > 1 else held[0][0]
            gain = space[seen]
            joint = 0
            if len(held) > 1:
                both = np.intersect1d(held[0][0], held[1][0], assume_unique=True)
                joint = int(space[both].max()) if both.size else 0
            best = np.lexsort((seen, -gain))[:top]
            out.append((segment, a, b, int(gain.max()), joint, seen[best].tolist(), gain[best].tolist()))
            space[seen] = 0
        return pd.DataFrame(out, columns=["segment", "a", "b", "bound", "joint", "docs", "gains"])

    schema = "segment string, a string, b string, bound long, joint long, docs array<int>, gains array<long>"
    return materialize(postings.groupBy("segment").applyInPandas(work, schema), "lexical-pairs")


def best_of_segment(pairs: list[tuple[str, str]], bounds: dict, gains: dict, least: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``top`` documents of a segment with a score of at least ``least``, and their scores.

    All documents above are found whose score could count; bounds of pairs only
    ever leave out those that can't reach ``least``.
    """
    ranked = sorted(((bounds[p], p) for p in pairs if p in bounds), reverse=True)
    rest = sum(b for b, _ in ranked)
    none = np.zeros(0, np.int64)
    if rest < least:
        return none, none
    scores, at = np.zeros(SEGMENT_DOCS, np.int64), 0
    # The pairs of highest bounds raise candidates, until the others together can't reach the threshold.
    while at < len(ranked) and rest >= least:
        for term in ranked[at][1]:
            if term in gains:
                own, gain = gains[term]
                scores[own] += gain
        rest -= ranked[at][0]
        at += 1
    found = np.flatnonzero((scores > 0) & (scores + rest >= least))
    for bound, pair in ranked[at:]:
        for term in pair:
            if term in gains and found.size:
                own, gain = gains[term]
                place = np.minimum(np.searchsorted(own, found), len(own) - 1)
                scores[found] += np.where(own[place] == found, gain[place], 0)
        rest -= bound
        found = found[scores[found] + rest >= least]
    best = np.lexsort((found, -scores[found]))[:top]
    return found[best], scores[found[best]]


def _thresholds(lists: DataFrame, of_items: DataFrame, top: int) -> dict[int, int]:
    """For each item the ``top``-th best sum of its pairs' listed gains; a document's score is no less."""
    entries = lists.join(F.broadcast(of_items), ["a", "b"]).select("item", "segment", F.explode(F.arrays_zip("docs", "gains")).alias("e"))
    sums = entries.groupBy("item", "segment", F.col("e.docs").alias("doc")).agg(F.sum("e.gains").alias("gain"))
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("gain")))
    last = sums.withColumn("place", place).where(F.col("place") <= top).where(F.col("place") == top)
    return {r["item"]: r["gain"] for r in last.select("item", "gain").collect()}


def _search_block(index: DataFrame, items: DataFrame, docs: int, total: int, top: int) -> DataFrame:
    """(item, segment, doc, score): the best documents of every segment for a block of items."""
    spark = index.sparkSession
    of_items = items.select("item", F.explode("terms").alias("term"))
    postings = index.where(F.col("term") != _HEAD).drop("keys")
    held = postings.join(F.broadcast(of_items.select("term").distinct()), "term").groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
    known = of_items.join(held.select("term", weight(F.col("df"), docs).alias("weight")), "term").collect()
    weights = {r["term"]: r["weight"] for r in known}
    by_item: dict[int, list[str]] = {}
    for r in sorted(known, key=lambda r: (-r["weight"], r["term"])):
        by_item.setdefault(r["item"], []).append(r["term"])
    pairs = {i: [(t[k], t[k + 1] if k + 1 < len(t) else _ALONE) for k in range(0, len(t), 2)] for i, t in by_item.items()}
    plan = spark.sparkContext.broadcast((weights, pairs, sorted({p for own in pairs.values() for p in own})))
    of_pairs = spark.createDataFrame([(i, a, b) for i, own in pairs.items() for a, b in own], "item long, a string, b string")
    wanted = postings.join(F.broadcast(spark.createDataFrame([(t,) for t in weights], "term string")), "term")
    lists = pair_lists(wanted, plan, docs, total, top)
    least = spark.sparkContext.broadcast(_thresholds(lists, of_pairs, top))

    def work(frame: pd.DataFrame, listed: pd.DataFrame) -> pd.DataFrame:
        weights, pairs, _ = plan.value
        gains, segment = _gains(frame, weights, docs, total), frame["segment"].iloc[0]
        bounds = {(a, b): bound for a, b, bound in zip(listed["a"], listed["b"], listed["bound"])}
        out = []
        for item, own in pairs.items():
            found, scores = best_of_segment(own, bounds, gains, max(1, least.value.get(item, 0)), top)
            out += [(item, segment, int(d), int(s)) for d, s in zip(found, scores)]
        return pd.DataFrame(out, columns=["item", "segment", "doc", "score"])

    grouped = wanted.groupBy("segment").cogroup(lists.select("segment", "a", "b", "bound").groupBy("segment"))
    return grouped.applyInPandas(work, "item long, segment string, doc int, score long")


def search(docs: DataFrame, queries: DataFrame, top: int = TOP, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """(item_id, rank, doc_id, score) of the ``top`` best rows of ``docs`` for every row of ``queries``.

    Only scores above zero count, so an item may have fewer rows, and one
    without a term, or whose terms no document holds, has none.  Equal scores
    are in the order of ``doc_id``, rows without one last; rows that share one
    are documents of their own and get ranks of their own.  Repeated rows of
    ``queries`` are items of their own, each with all its ranks.  A null or
    empty text has no term and counts nowhere.  Other columns aren't read.
    """
    spark = docs.sparkSession
    index = build_index(docs, key, text)
    number, total = totals(index)
    items = materialize(
        queries.select(F.monotonically_increasing_id().alias("item"), F.col(item).alias("item_id"), F.array_distinct(terms_of(F.col(text))).alias("terms")),
        "lexical-items",
    )
    sizes = items.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, math.ceil(sizes / BLOCK_TERMS))
    found = spark.createDataFrame([], "item long, segment string, doc int, score long")
    for block in range(blocks if number and sizes else 0):
        part = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        found = found.union(materialize(_search_block(index, part, number, total, top), "lexical-found"))
    heads = index.where(F.col("term") == _HEAD).select("segment", "keys")
    named = found.join(heads, "segment").select("item", "segment", "doc", "score", F.get("keys", "doc").alias("doc_id"))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "segment", "doc")
    ranked = named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(items.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
