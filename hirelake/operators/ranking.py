"""Top lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirelake import fixed
from hirelake.functions.company import company_group
from hirelake.operators.dedupe import first_per, with_key
from hirelake.schema import Vocabulary


def _top(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """Top ``n`` rows with their ``rank``; the rank window sees those rows only."""
    window = Window.orderBy(*order)
    return df.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(window))


def rank_diverse(
    scored: DataFrame,
    n: int = 10,
    cap: int = fixed.PER_COMPANY_CAP,
    relaxed: int = fixed.PER_COMPANY_RELAXED,
    ties: Sequence[Column | str] = ("unique_key",),
    vocab: Vocabulary | None = None,
) -> DataFrame:
    """Best ``n`` listings with at most ``cap`` per company group; places left
    over go to the groups' next ones up to ``relaxed``, after the others.

    Taking a listing depends only on its place within its group, so a ranked
    window with a rank limit replaces the greedy walk.  The limit is applied
    before the shuffle: a huge group sends ``relaxed`` rows per task.
    """
    vocab = vocab or Vocabulary()
    ties = [F.col(c) if isinstance(c, str) else c for c in ties]
    best = [F.col("total_score").desc(), *ties]
    group = company_group(F.col("company"), vocab.company_groups, vocab.legal_suffix)
    window = Window.partitionBy("company_group").orderBy(*best)
    placed = (
        with_key(scored)
        .withColumn("company_group", group)
        .withColumn("_place", F.row_number().over(window))
        .where(F.col("_place") <= relaxed)
        .withColumn("_extra", F.col("_place") > cap)
    )
    return _top(placed, [F.col("_extra"), *best], n).drop("_place", "_extra")


def remaining_by_score(
    scored: DataFrame, excluded: DataFrame | None, n: int = 100,
    ties: Sequence[Column | str] = ("unique_key",),
) -> DataFrame:
    """Best ``n`` listings outside ``excluded`` (by unique key), one per key."""
    ties = [F.col(c) if isinstance(c, str) else c for c in ties]
    best = [F.col("total_score").desc(), *ties]
    rows = with_key(scored)
    if excluded is not None:
        rows = rows.join(with_key(excluded).select("unique_key"), "unique_key", "left_anti")
    return _top(first_per(rows, ["unique_key"], best), best, max(1, n))
