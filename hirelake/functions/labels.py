"""Score labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hirelake import fixed
from hirelake.functions.numbers import round1


def score_label(score: Column) -> Column:
    """One decimal, "--" when there is no score."""
    return F.when(score.isNull(), F.lit("--")).otherwise(F.format_string("%.1f", round1(score)))


def score_band(score: Column) -> Column:
    (high, high_name), (medium, medium_name) = fixed.SCORE_BANDS
    return (
        F.when(score >= high, F.lit(high_name))
        .when(score >= medium, F.lit(medium_name))
        .otherwise(F.lit("low"))
    )


def match_class(score: Column) -> Column:
    (high, high_name), (mid, mid_name) = fixed.MATCH_CLASSES
    return (
        F.when(score >= high, F.lit(high_name))
        .when(score >= mid, F.lit(mid_name))
        .otherwise(F.lit("low"))
    )
