"""b-bit MinHash near-duplicates, confirmed on whole shingle sets.

A text's set of word shingles gets MINIMA minima of hash functions.  Whole
minima, ROWS at a time, make the keys of BANDS bands; of every minimum itself
only the lowest BITS bits are kept, packed into a few numbers.  Sets that share
a band are candidates.  The bits that two signatures agree on, counted and
corrected for agreement by chance, estimate their similarity; a pair is only
dropped where the estimate lies more than five standard deviations below the
limit.  What is left is confirmed on the whole sets.

A band's members are compared with a few of them, its leaders, and what is then
one component needs no further comparison.  Leaders leave their band, and
rounds go on until no band holds members of two components that could still be
similar, so no pair is lost and copies are never compared all against all.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirelake.llm.common import small_batches
from hirelake.llm.links import components
from hirelake.session import materialize

SHINGLE_WORDS = 4
#: Least similarity of linked sets in percent.
PERCENT = 80
#: A pair of similarity 0.8 shares no band with a chance of (1 - 0.8 ** 5) ** 40, about one in eight million.
BANDS, ROWS = 40, 5
MINIMA = BANDS * ROWS
BITS = 4
_PER_LONG = 64 // BITS
LONGS = -(-MINIMA // _PER_LONG)
#: Minima of the texts that are still apart after the first round.
FINE = 1024
#: Standard deviations that an estimate may lie below the limit.
DEVIATIONS = 5.0
#: A band has one leader in the first round, and so many times more from round to round.
MORE = 8
#: Bits of the filter that tells which texts take part in any comparison; its size doesn't depend on the data.
FILTER_BITS = 1 << 26
_MASK = int.from_bytes(bytes([0x11] * 8), "big")
_rng = np.random.default_rng(12)
_FACTORS = _rng.integers(0, 1 << 63, SHINGLE_WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TURNS = _rng.integers(0, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALTS = _rng.integers(0, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2)
_JOINS = _rng.integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FINE_TURNS = _rng.integers(0, 1 << 63, FINE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FINE_SALTS = _rng.integers(0, 1 << 63, FINE, dtype=np.uint64) * np.uint64(2)


def least_agreement(percent: int = PERCENT, count: int = MINIMA) -> int:
    """Agreeing minima, of ``count``, below which a pair is surely not similar enough.

    Two minima agree if they are equal, or by chance in one of 2 ** BITS cases.
    """
    chance = 1.0 / (1 << BITS)
    agree = chance + (1 - chance) * percent / 100
    return int(np.floor(count * agree - DEVIATIONS * np.sqrt(count * agree * (1 - agree))))


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; none without a word."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < SHINGLE_WORDS:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))], np.uint64)
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
    n = len(words) - SHINGLE_WORDS + 1
    total = np.zeros(n, np.uint64)
    for k in range(SHINGLE_WORDS):
        total += hashes[k : k + n] * _FACTORS[k]
    return np.unique(total ^ (total >> np.uint64(31)))


def minima(own: np.ndarray, salts: np.ndarray = _SALTS, turns: np.ndarray = _TURNS) -> np.ndarray:
    """Smallest value of every hash function over a set."""
    least = np.full(len(salts), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 1024):
        np.minimum(least, ((own[at : at + 1024, None] ^ salts) * turns).min(axis=0), out=least)
    return least


def packed(least: np.ndarray) -> np.ndarray:
    """The lowest bits of all minima, side by side."""
    longs = -(-len(least) // _PER_LONG)
    low = np.zeros(longs * _PER_LONG, np.uint64)
    # The top of a product depends on all bits of its factors, the bottom on a few.
    low[: len(least)] = (least ^ (least >> np.uint64(40))) & np.uint64((1 << BITS) - 1)
    return (low.reshape(longs, _PER_LONG) << (np.arange(_PER_LONG, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64)


def bands(least: np.ndarray) -> np.ndarray:
    """Key of every band; the band's number is part of it."""
    key = (least.reshape(BANDS, ROWS) * _JOINS).sum(axis=1, dtype=np.uint64)
    return (key ^ (key >> np.uint64(29))) * _TURNS[:BANDS]


def _longs(values) -> pa.Array:
    return pa.array([v.view(np.int64) for v in values], pa.list_(pa.int64()))


def _node(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes()) - (1 << 63) if own.size else 0


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, node, n, sig, keys) of (doc_id, body); equal sets are one node."""
    for batch in batches:
        nodes, sizes, sigs, keys = [], [], [], []
        for body in batch.column(1):
            own = shingles(body.as_py())
            nodes.append(_node(own) if own.size else None)
            sizes.append(len(own))
            least = minima(own)
            sigs.append(packed(least))
            keys.append(bands(least) if own.size else np.zeros(0, np.uint64))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), _longs(sigs), _longs(keys)],
            ["doc_id", "node", "n", "sig", "keys"],
        )


def _differ(a: Column, b: Column) -> Column:
    """Minima whose low bits differ between two longs."""
    x = a.bitwiseXOR(b)
    any_bit = reduce(lambda u, v: u.bitwiseOR(v), (F.shiftrightunsigned(x, s) for s in range(1, BITS)), x)
    return F.bit_count(any_bit.bitwiseAND(F.lit(_MASK)))


def agreement(a: Column, b: Column) -> Column:
    """Minima whose low bits are equal in both signatures, by bit counts."""
    places = [F.lit(k) for k in range(LONGS)]
    return F.lit(MINIMA) - reduce(lambda u, v: u + v, (_differ(F.get(a, k), F.get(b, k)) for k in places))


def fine_agreement(a: Column, b: Column) -> Column:
    """``agreement`` of fine signatures, which are too long to be written out long by long."""
    return F.lit(FINE) - F.aggregate(F.zip_with(a, b, _differ), F.lit(0), lambda u, v: u + v)


def _refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, fine) of (node, shingles)."""
    for batch in batches:
        sets = (np.asarray(own.values).view(np.uint64) for own in batch.column(1))
        fine = [packed(minima(own, _FINE_SALTS, _FINE_TURNS)) for own in sets]
        yield pa.RecordBatch.from_arrays([batch.column(0), _longs(fine)], ["node", "fine"])


def _filter_of(nodes: DataFrame) -> np.ndarray:
    """Bit set of the nodes' hashes, put together by Spark's bitmap functions; of one size for all inputs."""
    place = F.pmod("node", F.lit(FILTER_BITS))
    parts = nodes.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")
    ).collect()
    bits = np.zeros(FILTER_BITS, bool)
    size = 8 * 4096
    for bucket, part in parts:
        # Bucket numbers start at one for positions above zero.
        at = (bucket - 1) * size + 1 if bucket > 0 else 0
        own = np.unpackbits(np.frombuffer(bytes(part), np.uint8), bitorder="little")
        if bucket > 0:
            end = min(at + size, FILTER_BITS)
            bits[at:end] |= own[: end - at].astype(bool)
        else:
            bits[0] |= bool(own[0])
    return np.packbits(bits, bitorder="little")


def _whole_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles) of the wanted nodes, once each, without moving the texts."""
    bits = docs.sparkSession.sparkContext.broadcast(_filter_of(wanted))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sets = [], []
            for body in batch.column(0):
                own = shingles(body.as_py())
                if not own.size:
                    continue
                node = _node(own)
                place = node % FILTER_BITS
                if bits.value[place >> 3] >> (place & 7) & 1:
                    nodes.append(node)
                    sets.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), _longs(sets)], ["node", "shingles"])

    # Copies of a text are one before and after the shuffle.
    found = docs.select("body").mapInArrow(gather, "node long, shingles array<long>")
    first = found.groupBy("node").agg(F.first("shingles").alias("shingles"))
    return materialize(first.join(wanted, "node", "left_semi"), "minhash-sets")


def _apart(met: DataFrame) -> DataFrame:
    """Rows of ``met`` (band, node, root, n, most, sig, degree, ...) that still have someone to be compared with.

    Members have to differ in their component, and a member needs one whose
    size is within its reach and which it is in reach of.
    """
    sizes = met.groupBy("band").agg(F.min("n").alias("least_n"), F.max("most").alias("most_most"))
    left = met.join(sizes, "band").where((F.col("most") >= F.col("least_n")) & (F.col("n") <= F.col("most_most")))
    left = left.drop("least_n", "most_most")
    roots = left.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("band")
    return materialize(left.join(roots, "band").select(*met.columns), "minhash-bands")


def reach(n: Column, shared: Column, percent: int) -> Column:
    """Largest set that a set of ``n`` shingles can be similar to if it shares at most ``shared`` with any."""
    return F.floor((100 + percent) * shared / percent - n).cast("long")


def _tighter(met: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``met`` with the reach of every node, from the shingles that no other node of it holds."""
    nodes = met.select("node").distinct()
    single = sets.join(nodes, "node", "left_semi").select("node", F.explode("shingles").alias("s")).groupBy("s").agg(
        F.count("*").alias("held"), F.min("node").alias("node")
    ).where("held = 1")
    own = single.groupBy("node").agg(F.count("*").alias("own"))
    most = reach(F.col("n"), F.col("n") - F.coalesce("own", F.lit(0)), percent)
    return met.join(own, "node", "left").withColumn("most", most).drop("own")


def set_links(signed: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b) links that connect all nodes whose sets are similar enough.

    ``signed`` holds (node, n, sig, keys) of every row with a word.  A band is
    led by those members that meet most others in all their bands, as the text
    that a group of copies was made from does.  After the first round members
    are also told apart by the shingles that only one of them holds: a set
    can't share those, which bounds the size of any set similar to it, and
    by finer signatures.
    """
    spark = signed.sparkSession
    links = spark.createDataFrame([], "a long, b long")
    rows = signed.select("node", F.explode("keys").alias("band")).distinct()
    shared = rows.groupBy("band").agg(F.count("*").alias("members")).where("members > 1")
    pairs_of = materialize(rows.join(shared, "band"), "minhash-members")
    degrees = pairs_of.groupBy("node").agg(F.sum("members").alias("degree"))
    nodes = materialize(
        signed.join(degrees, "node").groupBy("node").agg(F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("degree").alias("degree")),
        "minhash-nodes",
    )
    sets = _whole_sets(docs, nodes.select("node"))
    members = pairs_of.select("band", "node").join(nodes, "node")
    heads = members.groupBy("band").agg(F.min(F.struct(-F.col("degree"), F.col("node")))["node"].alias("head"))
    # Bands with the same first leader are one cell, so that its members meet it once and not in every band.
    met = materialize(
        members.join(heads, "band").where("node <> head").drop("band").withColumnRenamed("head", "band")
        .dropDuplicates(["band", "node"])
        .select("band", "node", F.col("node").alias("root"), "n", reach(F.col("n"), F.col("n"), percent).alias("most"), "sig", "degree"),
        "minhash-bands",
    )
    lead = nodes.select(
        F.col("node").alias("band"), F.col("node").alias("node2"), F.col("node").alias("root2"), F.col("n").alias("n2"),
        reach(F.col("n"), F.col("n"), percent).alias("most2"), F.col("sig").alias("sig2"), F.col("degree").alias("degree2"),
    )
    tested = spark.createDataFrame([], "a long, b long")
    least, least_fine, leaders = least_agreement(percent), least_agreement(percent, FINE), 1
    while not met.isEmpty():
        if leaders > 1:
            order = Window.partitionBy("band").orderBy(F.desc("degree"), "node")
            lead = materialize(
                met.withColumn("place", F.row_number().over(order)).where(F.col("place") <= leaders).select(
                    "band", *(F.col(c).alias(f"{c}2") for c in met.columns if c != "band")
                ),
                "minhash-leaders",
            )
        likely = (
            # Two leaders meet once: the first of them leads.
            ((F.col("degree2") > F.col("degree")) | ((F.col("degree2") == F.col("degree")) & (F.col("node2") < F.col("node"))))
            & (F.col("root") != F.col("root2")) & (F.col("n") <= F.col("most2")) & (F.col("n2") <= F.col("most"))
            & (agreement(F.col("sig"), F.col("sig2")) >= least)
        )
        if leaders > 1:
            likely &= fine_agreement(F.col("fine"), F.col("fine2")) >= least_fine
        close = met.join(lead, "band").where(likely).select(
            F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b"), (F.col("n") + F.col("n2")).alias("sizes")
        ).distinct()
        close = materialize(close.join(tested, ["a", "b"], "left_anti"), "minhash-pairs")
        both = close.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b").join(
            sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a"
        )
        common = F.size(F.array_intersect("x", "y"))
        judged = materialize(
            both.select("a", "b", ((100 + percent) * common >= percent * F.col("sizes")).alias("similar")), "minhash-judged"
        )
        tested = tested.union(judged.select("a", "b"))
        new = judged.where("similar").select("a", "b")
        # Leaders have been compared with their whole cell; the first ones were never members of theirs.
        if leaders > 1:
            met = met.join(lead.select("band", F.col("node2").alias("node")), ["band", "node"], "left_anti")
        if not new.isEmpty():
            links = links.union(new)
            named = met.drop("root").join(components(links), "node", "left")
            met = named.select("*", F.coalesce("root", "node").alias("now")).drop("root").withColumnRenamed("now", "root")
        met = _apart(met)
        if leaders == 1 and not met.isEmpty():
            met = _apart(_tighter(met, sets, percent))
            apart = sets.join(met.select("node").distinct(), "node", "left_semi").select("node", "shingles")
            met = met.join(apart.mapInArrow(_refine, "node long, fine array<long>"), "node")
            met = materialize(met, "minhash-fine")
        leaders *= MORE
    return links


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    ``n_shingles`` is the size of the set of distinct shingles; a text of fewer
    words is one shingle as a whole.  A null text, or one without a word, has
    none and is linked with nothing, not even with others like it.
    ``component_id`` is the smallest id linked, directly or over others, and a
    row is kept if that is its own: of rows that share the smallest id all are.
    Rows without an id take the smallest id of their component; where there is
    none they have no component and are kept.  Repeated rows get equal rows; no
    rows give no rows.  Other columns aren't read.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    texts = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").cast("binary").alias("body"))
    rows = materialize(
        texts.mapInArrow(_sign, f"doc_id {kind}, node long, n long, sig array<long>, keys array<long>"), "minhash-rows"
    )
    links = set_links(rows.where("node IS NOT NULL"), texts, percent)
    firsts = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first"))
    if not links.isEmpty():
        firsts = firsts.join(components(links), "node", "left")
        firsts = materialize(firsts.select("node", "first", F.coalesce("root", "node").alias("root")), "minhash-firsts")
        smallest = firsts.groupBy("root").agg(F.min("first").alias("first"))
        firsts = firsts.select("node", "root").join(smallest, "root").select("node", "first")
    named = rows.select("doc_id", "n", "node").join(firsts, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("first"))
    return named.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )
