"""Number helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round1(x: Column) -> Column:
    """Round to one decimal on the exact binary value, ties to even.

    Built-in rounding works on the shortest decimal text and differs at near
    ties.  Here 10*x is split into a rounded sum and its exact error, so the
    distance to the tie is exact.  ``x`` should be a plain or bound column.
    """
    eight, two = x * 8, x * 2
    total = eight + two
    part = total - eight
    error = (eight - (total - part)) + (two - part)
    low = F.floor(total).cast("double")
    gap = ((total - low) - 0.5) + error
    odd = F.pmod(low, F.lit(2.0))
    step = F.when(gap > 0, F.lit(1.0)).when(gap < 0, F.lit(0.0)).otherwise(odd)
    return (low + step) / 10
