"""Company board slugs: harvest, guess, resolve, validate and merge."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake import fixed
from hirelake.functions.words import captures
from hirelake.operators.dedupe import first_per


def _clean_slug(slug: Column) -> Column:
    slug = F.btrim(F.trim(F.lower(slug)), F.lit(fixed.SLUG_PUNCTUATION))
    return F.regexp_extract(slug, r"^([^?#]*)", 1)


def extract_slugs(df: DataFrame, text: Column, patterns: Iterable[str], ignored: Iterable[str] = ()) -> DataFrame:
    """Distinct slugs captured from the texts.  Repeats within a text are
    removed before the shuffle, repeats within a task by the partial
    aggregation."""
    found = df.select(F.explode(F.array_distinct(captures(text, patterns))).alias("slug"))
    return found.select(_clean_slug(F.col("slug")).alias("slug")).where(
        (F.col("slug") != "") & ~F.col("slug").isin(*ignored)
    ).distinct()


def harvest_slugs(
    df: DataFrame, text: Column,
    patterns: Mapping[str, Iterable[str]] = fixed.SLUG_PATTERNS,
    ignored: Mapping[str, Iterable[str]] = fixed.SLUG_IGNORED,
) -> DataFrame:
    """Distinct (ats, slug) of all board systems, from one pass over the texts."""

    def of(ats: str) -> Column:
        slugs = F.array_distinct(captures(text, list(patterns[ats])))
        return F.transform(slugs, lambda s: F.struct(F.lit(ats).alias("ats"), s.alias("slug")))

    found = F.concat(*map(of, patterns))
    rows = df.select(F.explode(found).alias("f")).select("f.ats", _clean_slug(F.col("f.slug")).alias("slug"))
    dropped = [(F.col("ats") == ats) & F.col("slug").isin(*words) for ats, words in ignored.items()]
    return rows.where((F.col("slug") != "") & ~reduce(or_, dropped, F.lit(False))).distinct()


def expand_slugs(
    df: DataFrame, text: Column, boards: DataFrame, existing: DataFrame, min_open_jobs: int = 1,
    patterns: Mapping[str, Iterable[str]] = fixed.SLUG_PATTERNS,
    ignored: Mapping[str, Iterable[str]] = fixed.SLUG_IGNORED,
) -> DataFrame:
    """(ats, slug, added): the slugs of ``existing`` (ats, slug) and those
    harvested from the texts whose board has enough open jobs."""
    harvested = harvest_slugs(df, text, patterns, ignored)
    valid = surviving_slugs(validate_slugs(harvested, boards, min_open_jobs))
    rows = existing.select("ats", "slug", F.lit(False).alias("added")).unionByName(
        valid.select("ats", "slug", F.lit(True).alias("added"))
    )
    return rows.groupBy("ats", "slug").agg(F.min("added").alias("added"))


def slug_candidates(df: DataFrame, company: str = "company") -> DataFrame:
    """(company, ord, slug): spellings to try for each company, best first."""
    base = F.trim(F.lower(company))
    clean = F.regexp_replace(base, "[^a-z0-9]", "")
    hyphen = F.btrim(F.regexp_replace(base, "[^a-z0-9]+", "-"), F.lit("-"))
    endings = ["careers", "-careers", "jobs", "-jobs"]
    spellings = F.array(
        clean,
        hyphen,
        *[F.concat(clean, F.lit(e)) for e in endings],
        *[F.concat(hyphen, F.lit(e)) for e in endings if e.startswith("-")],
    )
    return df.select(
        F.col(company).alias("company"),
        F.posexplode(F.array_distinct(spellings)).alias("ord", "slug"),
    )


def board_sizes(boards: DataFrame) -> DataFrame:
    """(ats, slug, open_jobs) from one row per open job."""
    return boards.groupBy("ats", "slug").agg(F.count("job_id").alias("open_jobs"))


def resolve_slugs(candidates: DataFrame, boards: DataFrame) -> DataFrame:
    """First candidate per company and board system whose board has a job."""
    open_boards = board_sizes(boards).where(F.col("open_jobs") >= 1)
    return (
        candidates.join(open_boards, "slug")
        .groupBy("company", "ats")
        .agg(F.min_by("slug", "ord").alias("slug"))
    )


def validate_slugs(slugs: DataFrame, boards: DataFrame, min_open_jobs: int = 1) -> DataFrame:
    """Add open_jobs, is_valid and a status text to (ats, slug, ...) rows."""
    enough = F.col("open_jobs") >= min_open_jobs
    return (
        slugs.join(board_sizes(boards), ["ats", "slug"], "left")
        .withColumn("open_jobs", F.coalesce("open_jobs", F.lit(0)))
        .withColumn("is_valid", enough)
        .withColumn(
            "status",
            F.concat(F.when(enough, "valid (").otherwise("INVALID ("), F.col("slug"), F.lit(")")),
        )
    )


def surviving_slugs(validated: DataFrame) -> DataFrame:
    return validated.where("is_valid").drop("open_jobs", "is_valid", "status")


def validation_totals(validated: DataFrame) -> DataFrame:
    return validated.agg(
        F.count_if("is_valid").alias("valid"), F.count_if(~F.col("is_valid")).alias("invalid")
    )


def merge_slug_sources(primary: DataFrame, extras: DataFrame) -> DataFrame:
    """(company, slug) from the named map (company, slug, ord) and the bare
    list (slug, ord).

    The first entry of a slug wins, named ones before bare ones.  A bare slug
    is its own display name; should that name be taken, the later entry
    replaces the earlier one.
    """
    slug = F.lower(F.trim("slug"))
    named = primary.select("company", slug.alias("slug"), F.lit(0).alias("tier"), "ord")
    bare = extras.select(slug.alias("company"), slug.alias("slug"), F.lit(1).alias("tier"), "ord")
    rows = named.unionByName(bare).where(F.col("slug") != "")
    kept = first_per(rows, ["slug"], ["tier", "ord", "company"])
    latest = first_per(kept, ["company"], [F.col("tier").desc(), F.col("ord").desc(), F.col("slug")])
    return latest.select("company", "slug")


def merge_slug_lists(existing: DataFrame, validated: DataFrame) -> DataFrame:
    """Sorted union of two slug lists with ``added`` for slugs that are new."""
    rows = existing.select("slug", F.lit(False).alias("added")).unionByName(
        validated.select("slug", F.lit(True).alias("added"))
    )
    return rows.groupBy("slug").agg(F.min("added").alias("added")).orderBy("slug")


def merge_totals(merged: DataFrame) -> DataFrame:
    return merged.agg(F.count(F.lit(1)).alias("total"), F.count_if("added").alias("added"))
