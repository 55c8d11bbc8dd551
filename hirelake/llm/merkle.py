"""Merkle manifest of a dataset, with a proof for every row.

Rows are leaves, ranked inside their group; every two consecutive nodes become
one until a group has a single node, its subroot, and the subroots of all
groups in order become the root in the same way.

Ranks are cut into blocks of DIGITS digits.  Inside a block one digit column
after the other is grouped away: the rows that differ in it alone become one
struct that holds its children and their hashes level by level.  The roots of
the blocks are the leaves of the next tier, so no struct ever holds more than
one block.  On the way back the path above a block meets the block by a
grouping of both, and transforms walk the nested structs to the leaves: no join
brings a proof to its row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirelake.session import materialize

#: A digit has so many bits, hence a struct at most 16 children; a block has so many digits.
DIGIT_BITS, DIGITS = 4, 2
BLOCK_BITS = DIGIT_BITS * DIGITS
BLOCK = 1 << BLOCK_BITS
#: Copies of a row are dealt in two steps, the first over runs of so many ranks.
RUN_BITS = BLOCK_BITS + 16
#: Bits of ``monotonically_increasing_id`` that count rows inside a partition.
_ROW_BITS = 33
_PATH = "array<struct<h:string,left:boolean>>"
_UP = f"struct<path:{_PATH},subroot:string,root:string>"


def digest(*parts: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the parts put together."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_of(values: Sequence[Column]) -> Column:
    """Leaf hash of a row: every value as its byte count, a colon and its text, or as a dash if it is null."""
    texts = [v.cast("string") for v in values]
    return digest(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts))


def _ranked(leaves: DataFrame) -> DataFrame:
    """(g, n, block, lo, hi, h, item): the ranks that equal leaves take in a block, and the size of their group.

    Equal rows are one row until their ranks are dealt.  Order comes from a
    range-partitioned sort; only counts of partitions pass through a window of
    a group.
    """
    counted = leaves.groupBy("g", "key", "h", "item").agg(F.count("*").alias("copies"))
    row = F.monotonically_increasing_id()
    sorted_rows = counted.orderBy("g", F.col("key").asc_nulls_first(), "h", "item").withColumn("row", row).select(
        "g", "h", "item", "copies", F.shiftright("row", _ROW_BITS).alias("part"), "row"
    )
    placed = materialize(sorted_rows, "merkle-order")
    group, before = Window.partitionBy("g"), Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("g", "part").agg(F.sum("copies").alias("rows")).select(
        "g", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"), F.sum("rows").over(group).alias("n")
    )
    inside = Window.partitionBy("g", "part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    ranks = placed.withColumn("seen", F.coalesce(F.sum("copies").over(inside), F.lit(0))).join(parts, ["g", "part"]).select(
        "g", "n", "h", "item", (F.col("start") + F.col("seen")).alias("first"),
        (F.col("start") + F.col("seen") + F.col("copies") - 1).alias("last"),
    )
    runs = ranks.withColumn("run", F.explode(F.sequence(F.shiftright("first", RUN_BITS), F.shiftright("last", RUN_BITS))))
    lo = F.greatest("first", F.shiftleft("run", RUN_BITS))
    hi = F.least("last", F.shiftleft(F.col("run") + 1, RUN_BITS) - 1)
    blocks = runs.withColumn("block", F.explode(F.sequence(F.shiftright(lo, BLOCK_BITS), F.shiftright(hi, BLOCK_BITS))))
    return blocks.select(
        "g", "n", "block", F.greatest("first", F.shiftleft("block", BLOCK_BITS)).alias("lo"),
        F.least("last", F.shiftleft(F.col("block") + 1, BLOCK_BITS) - 1).alias("hi"), "h", "item",
    )


def _pairs(level: Column) -> Column:
    """The next level: every two consecutive hashes become one, a last single one alone."""
    last = F.shiftright(F.size(level) - 1, 1)
    return F.transform(
        F.sequence(F.lit(0), last), lambda i: digest(F.get(level, 2 * i), F.coalesce(F.get(level, 2 * i + 1), F.lit("")))
    )


def _nested(nodes: DataFrame) -> DataFrame:
    """(g, n, block, h, tree) of every block of ``nodes`` (g, n, block, pos, h, item).

    All rows of a block lie in one partition from the start, so the groupings
    need no further exchange.  A level is left out where the group has a single
    node already.
    """
    rows = nodes.select(
        "g", "n", "block", F.col("pos").bitwiseAND(BLOCK - 1).cast("int").alias("rest"), "h", F.col("item").alias("node")
    )
    for d in range(DIGITS):
        digit = F.col("rest").bitwiseAND((1 << DIGIT_BITS) - 1)
        kids = F.array_sort(F.collect_list(F.struct(digit.alias("digit"), "h", F.col("node").alias("kid"))),
                            lambda a, b: a["digit"] - b["digit"])
        rows = rows.groupBy("g", "n", "block", F.shiftright("rest", DIGIT_BITS).alias("rest")).agg(kids.alias("run"))
        rows = rows.withColumn("l0", F.transform("run", lambda x: x["h"]))
        for t in range(DIGIT_BITS):
            many = F.col("n") > (1 << (d * DIGIT_BITS + t))
            rows = rows.withColumn(f"l{t + 1}", F.when(many, _pairs(F.col(f"l{t}"))).otherwise(F.col(f"l{t}")))
        levels = F.struct(*(f"l{t}" for t in range(DIGIT_BITS))).alias("levels")
        node = F.struct(F.transform("run", lambda x: x["kid"]).alias("kids"), levels)
        rows = rows.select("g", "n", "block", "rest", F.get(f"l{DIGIT_BITS}", F.lit(0)).alias("h"), node.alias("node"))
    return rows.select("g", "n", "block", "h", F.col("node").alias("tree"))


def _tiers(nodes: DataFrame) -> list[DataFrame]:
    """Block tables from the leaves up; the roots of one are the leaves of the next."""
    tiers = [materialize(_nested(nodes), "merkle-blocks")]
    most = tiers[0].agg(F.max("n")).first()[0] or 0
    while most > BLOCK:
        most = (most + BLOCK - 1) // BLOCK
        up = tiers[-1].select(
            "g", F.ceil(F.col("n") / BLOCK).cast("long").alias("n"), F.shiftright("block", BLOCK_BITS).alias("block"),
            F.col("block").alias("pos"), "h", F.struct("block").alias("item"),
        )
        tiers.append(materialize(_nested(up.repartition("g", "block")), "merkle-blocks"))
    return tiers


def _steps(levels: Column, at: Column, n: Column, base: int) -> Column:
    """Siblings of child ``at`` on the levels of one digit; a null one where the run holds the child alone."""

    def step(t: int) -> Column:
        place = F.shiftright(at, t)
        sibling = F.get(levels[f"l{t}"], place.bitwiseXOR(F.lit(1)))
        return F.struct(sibling.alias("h"), (place.bitwiseAND(F.lit(1)) == 1).alias("left"))

    none = F.array().cast(_PATH)
    return F.concat(*(F.when(n > (1 << (base + t)), F.array(step(t))).otherwise(none) for t in range(DIGIT_BITS)))


def _walk(node: Column, d: int, n: Column, above: Column) -> Column:
    """(item, path) of every leaf under a node ``d`` digits high."""
    if d == 0:
        return F.array(F.struct(node.alias("item"), above.alias("path")))
    base = (d - 1) * DIGIT_BITS
    return F.flatten(F.transform(
        node["kids"], lambda kid, i: _walk(kid, d - 1, n, F.concat(_steps(node["levels"], i, n, base), above))
    ))


def _down(tiers: list[DataFrame], above: DataFrame) -> DataFrame:
    """(g, item, up) of every leaf; ``above`` holds (g, up) of every group.

    A block and what lies above it are brought together by a grouping.
    """
    above = above.select("g", F.lit(0).cast("long").alias("block"), "up")
    for tier in reversed(tiers):
        rows = tier.select("g", "block", "n", "tree").unionByName(above, allowMissingColumns=True)
        met = rows.groupBy("g", "block").agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("n", "tree", "up")))
        found = met.select("g", "up", F.explode(_walk(F.col("tree"), DIGITS, F.col("n"), F.col("up.path"))).alias("leaf"))
        up = F.struct("leaf.path", "up.subroot", "up.root").alias("up")
        found = found.select("g", F.col("leaf.item").alias("item"), up)
        if tier is not tiers[0]:
            above = found.select("g", "item.block", "up")
    return found


def manifest(docs: DataFrame, leaf: Column, key: str = "doc_id", group: str = "lang", carry: dict[str, Column] | None = None) -> DataFrame:
    """(key, leaf, carried columns, path, subroot, root) of every row.

    ``leaf`` is the row's hash, see ``leaf_of``.  Groups are ordered by the
    bytes of their text, a null group first.  In a group leaves ascend by the
    key, null keys first, and rows of one key by their leaf, so equal rows have
    neighbouring ranks and each gets its own proof.  ``path`` lists, from the
    leaf to the root, the sibling of the node on every level and whether it is
    on the left; it is null where a node is alone in its run.  A lone leaf is
    its group's subroot and a lone subroot the root; no rows give no rows.
    Other columns matter only as far as ``leaf`` and ``carry`` read them, and
    may have any name.
    """
    extra = [c.alias(n) for n, c in (carry or {}).items()]
    item = F.struct(F.col(key).alias("key"), leaf.alias("leaf"), *extra)
    rows = docs.select(F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("g"), item.alias("item"))
    ranked = _ranked(rows.select("g", F.col("item.key").alias("key"), F.col("item.leaf").alias("h"), "item"))
    ranked = ranked.repartition("g", "block").withColumn("pos", F.explode(F.sequence("lo", "hi")))
    tiers = _tiers(ranked)
    subroots = tiers[-1].select(F.lit("").alias("g"), F.col("g").alias("key"), "h", F.struct(F.col("g"), "h").alias("item"))
    over = _ranked(subroots).repartition("g", "block").withColumn("pos", F.explode(F.sequence("lo", "hi")))
    top = _tiers(over)
    none = F.array().cast(_PATH)
    root = top[-1].select("g", F.struct(none.alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("h").alias("root")).alias("up"))
    per_group = _down(top, root).select(
        F.col("item.g").alias("g"), F.struct("up.path", F.col("item.h").alias("subroot"), "up.root").alias("up")
    )
    found = _down(tiers, per_group)
    return found.select("item.*", "up.path", "up.subroot", "up.root")


def fold(leaf: Column, path: Column) -> Column:
    """Root that a leaf and the siblings on its path lead to."""
    return F.aggregate(path, leaf, lambda node, s: F.when(s["left"], digest(s["h"], node)).otherwise(
        digest(node, F.coalesce(s["h"], F.lit("")))
    ))


def siblings(path: Column) -> Column:
    """Hash of the siblings on a path, from the leaf to the root."""
    return digest(F.array_join(F.transform(path, lambda s: s["h"]), ""))


def audit(docs: DataFrame, tampered: Column, number: str = "n_chars", fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), key: str = "doc_id", group: str = "lang") -> DataFrame:
    """Proofs of all rows, each checked against its row after tampering.

    Rows for which ``tampered`` holds come back with ``number`` one higher; a
    null number stays, and so does a row whose test is null.  ``verified`` is
    false where the row's leaf no longer leads to the root.
    """
    changed = leaf_of([F.col(f) + 1 if f == number else F.col(f) for f in fields])
    proofs = manifest(docs, leaf_of([F.col(f) for f in fields]), key, group, {"changed": F.when(tampered, changed)})
    folded = fold(F.coalesce("changed", "leaf"), F.col("path"))
    return proofs.select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root", siblings(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
