"""Connected components of a link table, worked out by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.session import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b) that isn't its own root.

    The root is the component's smallest node.  Large-star and small-star
    rounds alternate until the links no longer change; each round is written,
    so it is neither recomputed nor lost with an executor.  Minima are combined
    before the shuffle and hot nodes are joined as skewed keys, never gathered.
    Self links, repeated links and null ends add nothing.
    """
    ordered = links.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
    kept = materialize(ordered.where("low < high").distinct(), "links")
    mark = None
    while True:
        now = kept.agg(F.count("*"), F.bit_xor(F.xxhash64("low", "high"))).first()
        if now[0] == 0 or now == mark:
            return kept.select(F.col("high").alias("node"), F.col("low").alias("root"))
        mark = now
        both = kept.select(F.col("high").alias("u"), F.col("low").alias("v")).union(kept.select("low", "high"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = materialize(
            both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(),
            "links-large",
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("m").alias("low"), F.col("v").alias("high"))
        star = least.select(F.col("m").alias("low"), F.col("u").alias("high"))
        kept = materialize(small.union(star).distinct(), "links")
