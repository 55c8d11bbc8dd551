"""Output tables of a run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.functions.dates import MINUTE_STAMP, digest_day
from hirelake.functions.labels import match_class
from hirelake.functions.text import safe_url, snippet
from hirelake.operators.browse import stats
from hirelake.operators.ranking import remaining_by_score

# Digest widths and defaults.
DIGEST_SKILLS = 8
DIGEST_SNIPPET = 200
REPORT_SNIPPET = 220


def _or(column: str, default: str) -> Column:
    return F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(default))


def digest_rows(ranked: DataFrame) -> DataFrame:
    """Rows of the daily digest, in rank order columns."""
    return ranked.select(
        "rank",
        "title",
        "company",
        _or("location", "Remote").alias("location"),
        safe_url(F.coalesce("url", F.lit(""))).alias("url"),
        digest_day(F.col("posted_date")).alias("posted_label"),
        "total_score",
        match_class(F.col("total_score")).alias("match_class"),
        F.slice("matching_skills", 1, DIGEST_SKILLS).alias("matching_skills"),
        snippet(F.col("description"), DIGEST_SNIPPET).alias("snippet"),
    )


def report_rows(
    scored: DataFrame, excluded: DataFrame | None, n: int = 100,
    ties: Sequence[Column | str] = ("unique_key",),
) -> DataFrame:
    """Rows of the report on the next-best listings."""
    stamp = F.coalesce(F.date_format("posted_date", MINUTE_STAMP), F.lit("Unknown"))
    return remaining_by_score(scored, excluded, n, ties).select(
        "rank",
        _or("title", "Unknown").alias("title"),
        _or("company", "Unknown").alias("company"),
        _or("location", "Remote/Unknown").alias("location"),
        safe_url(F.coalesce("url", F.lit(""))).alias("url"),
        F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce(F.format_string("%.1f", "total_score"), F.lit("")).alias("score"),
        snippet(F.col("description"), REPORT_SNIPPET).alias("snippet"),
        stamp.alias("posted_label"),
    )


def source_counts(listings: DataFrame) -> DataFrame:
    return listings.groupBy("source").agg(F.count(F.lit(1)).alias("listings"))


def source_summary(listings: DataFrame) -> DataFrame:
    """One row: "source: n" for every source, by name.  Only the counts per
    source meet in one place."""
    part = F.concat("source", F.lit(": "), F.col("listings").cast("string"))
    pairs = F.array_sort(F.collect_list(F.struct("source", part.alias("text"))))
    return source_counts(listings).agg(
        F.array_join(F.transform(pairs, lambda p: p["text"]), ", ").alias("source_summary")
    )


def digest_summary(
    scanned: DataFrame | int, new: DataFrame, shown: DataFrame, seen: DataFrame, as_of
) -> DataFrame:
    """One row of counters for the head and foot of a digest.  ``scanned`` may
    have been counted already."""

    def counted(df: DataFrame | int, name: str) -> DataFrame:
        if isinstance(df, int):
            return seen.sparkSession.createDataFrame([(name, df)], "name string, n long")
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")

    stored = stats(seen, as_of).select(
        F.explode(
            F.array(
                F.struct(F.lit("all_time_jobs").alias("name"), F.col("total_seen").alias("n")),
                F.struct(F.lit("all_time_companies").alias("name"), F.col("unique_companies").alias("n")),
            )
        ).alias("c")
    ).select("c.name", "c.n")
    rows = (
        counted(scanned, "scanned")
        .unionByName(counted(new, "new"))
        .unionByName(counted(shown, "shown"))
        .unionByName(stored)
    )

    def value(name: str) -> Column:
        return F.max(F.when(F.col("name") == name, F.col("n")))

    return rows.agg(
        value("shown").alias("shown"),
        value("scanned").alias("scanned"),
        value("new").alias("new"),
        (value("scanned") - value("new")).alias("filtered_out"),
        value("all_time_jobs").alias("all_time_jobs"),
        value("all_time_companies").alias("all_time_companies"),
    )
