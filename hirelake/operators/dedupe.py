"""Duplicates within a run and against the seen table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirelake import fixed
from hirelake.functions.dates import instant
from hirelake.functions.keys import unique_key


def with_key(df: DataFrame) -> DataFrame:
    return df if "unique_key" in df.columns else df.withColumn("unique_key", unique_key())


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row of every key.  The rank limit runs before the shuffle too, so
    each task sends at most one row per key however many copies it holds."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).where("_rn = 1").drop("_rn")


def dedupe_in_run(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """First listing of every unique key, by ``order`` (a total order, or one
    whose ties are equal rows)."""
    return first_per(with_key(df), ["unique_key"], order)


def filter_new(df: DataFrame, seen: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """Deduplicated listings whose key is not stored yet.  Both steps use the
    key's hash partitioning; only keys of the seen table are read."""
    return dedupe_in_run(df, order).join(seen.select("unique_key"), "unique_key", "left_anti")


def is_seen(df: DataFrame, seen: DataFrame) -> DataFrame:
    """Add the flag ``seen``; a key stored twice flags a listing once."""
    stored = seen.select("unique_key").distinct().withColumn("seen", F.lit(True))
    joined = with_key(df).join(stored, "unique_key", "left")
    return joined.withColumn("seen", F.coalesce("seen", F.lit(False)))


def seen_rows(df: DataFrame, as_of, score: Column | None = None) -> DataFrame:
    """Listings in stored form: run time as first_seen, long descriptions cut
    to the stored width, blank ones NULL."""
    if score is None:
        score = F.col("total_score") if "total_score" in df.columns else F.lit(None)
    stored = F.left(F.nullif(F.col("description"), F.lit("")), F.lit(fixed.STORED_DESCRIPTION_CHARS))
    return with_key(df).select(
        "unique_key", "title", "company", "location", "url", "source",
        F.col("posted_date").cast("timestamp").alias("posted_date"),
        instant(as_of).alias("first_seen"),
        score.cast("double").alias("score"),
        stored.alias("description"),
    )


def mark_seen(
    scored: DataFrame, seen: DataFrame, as_of, order: Sequence[Column | str],
    score: Column | None = None,
) -> DataFrame:
    """Rows an insert-or-ignore adds to the seen table: the first write of a
    key wins, keys already stored are left alone."""
    return seen_rows(filter_new(scored, seen, order), as_of, score)
