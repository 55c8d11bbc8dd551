"""SimHash near-duplicates found through the anchors of a covering code.

Two fingerprints that differ in at most T of their 64 bits differ in at most
T // 2 bits of one half, hence of the first 31 bits of that half.  The anchors
of a half are the words of the perfect Hamming code of length 31: every point
has an anchor within one bit.  A point midway between two fingerprints has an
anchor within one bit as well, so replicating each fingerprint to all anchors
within the covering radius plus half that half's threshold, rounded up, makes
every linked pair meet at an anchor.  Pairs are compared there and nowhere else.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.llm.common import small_batches
from hirelake.llm.links import components
from hirelake.llm.survivors import one_of_each, row_hash
from hirelake.session import materialize

SHINGLE_WORDS = 4
THRESHOLD = 4
SEED = 42
CODE_BITS = 31
COVERING_RADIUS = 1
#: Distinct fingerprints of one anchor compared at once; beyond it the anchor is split by the other half.
ANCHOR_ROWS = 1 << 18
_BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def fingerprint(text: str | None, width: int = SHINGLE_WORDS) -> int:
    """Unsigned fingerprint of a whole text; zero without a word."""
    joined = b" ".join((text or "").encode().lower().split())
    if not joined:
        return 0
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(joined)]
    if len(starts) <= width:
        starts, ends = [0], [len(joined)]
    else:
        starts, ends = starts[: 1 - width], ends[width - 1 :]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), 65_536):
        hashes = [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[at : at + 65_536], ends[at : at + 65_536])]
        octets = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(_BITS[2 * ones > len(starts)].sum(dtype=np.uint64))


def print_of(text: Column) -> Column:
    """Fingerprint of a text as a signed 64-bit number."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))

    return of(text.cast("string"))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) of every row."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(key).alias("doc_id"), print_of(F.col(text)).alias("fp"))


def _syndromes() -> np.ndarray:
    table = np.zeros((4, 256), np.uint8)
    for octet in range(4):
        for value in range(256):
            for bit in range(8):
                if value >> bit & 1 and 8 * octet + bit < CODE_BITS:
                    table[octet, value] ^= 8 * octet + bit + 1
    return table


_SYNDROME = _syndromes()


def anchors(points: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) for all code words within ``reach`` bits of each 31-bit point."""
    flips = [0, *(sum(1 << b for b in bits) for n in range(1, reach) for bits in combinations(range(CODE_BITS), n))]
    near = points.astype(np.uint32)[:, None] ^ np.array(flips, np.uint32)[None, :]
    syndrome = np.zeros(near.shape, np.uint8)
    for octet in range(4):
        syndrome ^= _SYNDROME[octet][(near >> np.uint32(8 * octet)) & np.uint32(255)]
    fix = np.where(syndrome > 0, np.uint32(1) << (syndrome.astype(np.uint32) - (syndrome > 0)), 0).astype(np.uint32)
    words = np.sort(near ^ fix, axis=1)
    fresh = np.ones(words.shape, bool)
    fresh[:, 1:] = words[:, 1:] != words[:, :-1]
    row, column = np.nonzero(fresh)
    return row, words[row, column].astype(np.int64)


def _half(points: np.ndarray, half: int) -> np.ndarray:
    return (points.view(np.uint64) >> np.uint64(32 * half)).astype(np.uint32) & np.uint32((1 << CODE_BITS) - 1)


def forest(members: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect exactly what all close pairs of distinct members connect.

    Points are reached from one another and leave the search when reached, so a
    dense group costs few comparisons and gives one link a point.
    """
    left, right = [], []
    unseen, frontier = members, members[:0]
    while unseen.size:
        if not frontier.size:
            frontier, unseen = unseen[:1], unseen[1:]
        block, frontier = frontier[:64], frontier[64:]
        hits, rest = [frontier], []
        for at in range(0, len(unseen), 65_536):
            part = unseen[at : at + 65_536]
            near = np.bitwise_count((block[:, None] ^ part[None, :]).view(np.uint64)) <= threshold
            hit = near.any(axis=0)
            left.append(block[near.argmax(axis=0)[hit]])
            right.append(part[hit])
            hits.append(part[hit])
            rest.append(part[~hit])
        frontier = np.concatenate(hits)
        unseen = np.concatenate(rest) if rest else unseen
    empty = np.zeros(0, members.dtype)
    return np.concatenate(left or [empty]), np.concatenate(right or [empty])


def _compare(batches: Iterator[pa.RecordBatch], threshold: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Links inside each anchor of rows sorted by anchor; larger anchors pass on as they are."""
    held_cell, held, over = None, np.zeros(0, np.int64), False

    def emit(cells, a, b, kind):
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(a), cells, np.int64)), pa.array(a), pa.array(b), pa.array(np.full(len(a), kind, np.int32))],
            ["cell", "a", "b", "kind"],
        )

    def close():
        if held.size > 1 and not over:
            a, b = forest(held, threshold)
            if a.size:
                yield emit(held_cell, a, b, 0)

    for batch in batches:
        cells, points = (batch.column(i).to_numpy() for i in (0, 1))
        if not len(cells):
            continue
        cuts = np.flatnonzero(cells[1:] != cells[:-1]) + 1
        starts, ends = np.r_[0, cuts], np.r_[cuts, len(cells)]
        if cells[0] != held_cell:
            yield from close()
            held_cell, held, over = cells[0], held[:0], False
        # The first group joins what is held; the last one is held in its turn.
        first = points[: ends[0]]
        if over or held.size + first.size > limit:
            out = np.concatenate([held, first])
            yield emit(held_cell, out, out, 1)
            held, over = held[:0], True
        else:
            held = np.concatenate([held, first])
        if len(starts) == 1:
            continue
        yield from close()
        sizes = ends - starts
        inner = np.arange(1, len(starts) - 1)
        two = starts[inner[sizes[inner] == 2]]
        near = two[np.bitwise_count((points[two] ^ points[two + 1]).view(np.uint64)) <= threshold]
        if near.size:
            yield emit(0, points[near], points[near + 1], 0)
        for i in inner[sizes[inner] > 2]:
            group = points[starts[i] : ends[i]]
            if group.size > limit:
                yield emit(cells[starts[i]], group, group, 1)
                continue
            a, b = forest(group, threshold)
            if a.size:
                yield emit(0, a, b, 0)
        held_cell, held, over = cells[starts[-1]], points[starts[-1] :], False
        if held.size > limit:
            yield emit(held_cell, held, held, 1)
            held, over = held[:0], True
    yield from close()


def fingerprint_links(prints: DataFrame, threshold: int = THRESHOLD, anchor_rows: int = ANCHOR_ROWS) -> DataFrame:
    """(a, b) links that connect all distinct ``fp`` within ``threshold`` bits."""
    if not 0 <= threshold <= 5:
        raise ValueError("anchors are laid out for thresholds up to 5")
    spark = prints.sparkSession
    near, far = (COVERING_RADIUS + (n + 1) // 2 for n in (threshold // 2, threshold))

    def replicate(batches):
        for batch in batches:
            points = batch.column(0).to_numpy()
            for half in (0, 1):
                for at in range(0, len(points), 4096):
                    part = points[at : at + 4096]
                    row, anchor = anchors(_half(part, half), max(near, 1))
                    yield pa.RecordBatch.from_arrays([pa.array(anchor | (half << CODE_BITS)), pa.array(part[row])], ["cell", "fp"])

    def split(batches):
        """An anchor above the limit is split by the anchors of the other half.

        A pair in it may differ by the whole threshold there.  What then still
        shares both anchors lies within a few bits of one point, so such a
        group has a largest size whatever the input.
        """
        for batch in batches:
            cells, points = (batch.column(i).to_numpy() for i in (0, 1))
            for at in range(0, len(points), 256):
                own, part = cells[at : at + 256], points[at : at + 256]
                for half in (0, 1):
                    mine = np.flatnonzero(own >> CODE_BITS == half)
                    row, anchor = anchors(_half(part[mine], 1 - half), far)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own[mine][row]), pa.array(anchor), pa.array(part[mine][row])], ["cell", "other", "fp"]
                    )

    out = "cell long, a long, b long, kind int"
    cells = prints.select("fp").distinct().mapInArrow(replicate, "cell long, fp long")
    found = materialize(
        cells.repartition("cell").sortWithinPartitions("cell")
        .mapInArrow(lambda batches: _compare(batches, threshold, anchor_rows), out),
        "anchor-links",
    )
    links = found.where("kind = 0").select("a", "b")
    large = found.where("kind = 1").select("cell", F.col("a").alias("fp"))
    if large.isEmpty():
        return links.distinct()
    finer = large.mapInArrow(split, "cell long, other long, fp long")
    again = (
        finer.select(F.xxhash64("cell", "other").alias("cell"), "fp").repartition("cell").sortWithinPartitions("cell")
        .mapInArrow(lambda batches: _compare(batches, threshold, 1 << 62), out)
    )
    return links.union(materialize(again.select("a", "b"), "anchor-links")).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, anchor_rows: int = ANCHOR_ROWS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    Fingerprints linked by at most ``threshold`` bits, directly or over others,
    form a component; its id is the smallest id in it.  Texts that are null or
    have no word get fingerprint zero and are linked like any other.  Repeated
    rows stay; rows without an id have the smallest other id of their component,
    or none.  No rows give no rows.  Other columns aren't read.
    """
    rows = materialize(fingerprints(docs, key, text), "fingerprints")
    roots = components(fingerprint_links(rows, threshold, anchor_rows))
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("first")).join(
        roots.withColumnRenamed("node", "fp"), "fp", "left"
    ).select("fp", "first", F.coalesce("root", "fp").alias("root"))
    nodes = materialize(nodes, "fingerprint-nodes")
    smallest = nodes.groupBy("root").agg(F.min("first").alias("component_id"))
    named = nodes.join(smallest, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """One row of each component of linked fingerprints, in all its columns.

    That is the row with the smallest id, rows without one coming last, and of
    rows that share the id the one with the smallest hash.  Rows are told apart
    by themselves and not by their ids, so an id with several texts keeps one
    row in each of their components.  Texts without a word are copies of each
    other.  No rows give no rows.
    """
    small_batches(docs.sparkSession)
    rows = materialize(
        docs.select(F.col(key).alias("id"), row_hash(docs).alias("hash"), print_of(F.col(text)).alias("fp")), "fingerprints"
    )
    roots = components(fingerprint_links(rows, threshold)).withColumnRenamed("node", "fp")
    rooted = rows.join(roots, "fp", "left").select("id", "hash", F.coalesce("root", "fp").alias("root"))
    return one_of_each(docs, rooted, key)
