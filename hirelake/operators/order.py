"""Positions in a globally sorted table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirelake.session import materialize

# Rows are counted in blocks of so many bits: small numbers that repeat take little space.
_BLOCK_BITS = 14


def with_position(df: DataFrame, order: Sequence[Column | str], keep: Sequence[str] | None = None) -> DataFrame:
    """Add ``position`` (1, 2, ...) by ``order`` without one task seeing all
    rows.  Of the columns only those in ``keep`` are written, where given.

    A range-partitioned sort is written once; each row keeps its block of its
    partition and its place in it.  Only the row counts of the blocks pass
    through a single window; being a row in 16,384, they are broadcast to the rows.
    """
    row_id = F.monotonically_increasing_id()
    placed = df.orderBy(*order).withColumn("_row", row_id).select(
        *(df.columns if keep is None else keep),
        F.shiftright("_row", _BLOCK_BITS).alias("_part"),
        F.col("_row").bitwiseAND((1 << _BLOCK_BITS) - 1).cast("int").alias("_place"),
    )
    placed = materialize(placed, "positions", "zstd")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return placed.join(F.broadcast(starts), "_part").withColumn(
        "position", F.col("_start") + F.col("_place") + 1
    ).drop("_part", "_place", "_start")
