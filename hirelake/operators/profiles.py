"""Features of profile texts.

Every feature is computed inside its row, so a large number of texts needs no
shuffle at all.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake import fixed
from hirelake.functions.places import WORD_MARKER_CHARS
from hirelake.functions.text import SPACE_RUN, SPACES
from hirelake.functions.titles import digits_to_int
from hirelake.functions.words import bind, captures, quote


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE_RUN}|{SPACE_RUN}$", "")


def extract_skills(text: Column, vocabulary: Iterable[str] = fixed.SKILL_VOCABULARY) -> Column:
    """Vocabulary terms in the text, sorted.  Short terms must stand as words,
    longer ones match anywhere ("java" is in "javascript")."""

    def found(low: Column, term: str) -> Column:
        if len(term) <= WORD_MARKER_CHARS:
            return low.rlike(rf"(?U)\b{quote(term)}\b")
        return low.contains(term)

    terms = sorted(set(vocabulary))
    return bind(
        F.lower(text),
        lambda low: F.array_compact(F.array(*[F.when(found(low, t), F.lit(t)) for t in terms])),
    )


def explicit_years(text: Column, patterns: Iterable[str] = fixed.EXPLICIT_YEARS) -> Column:
    """First number of the first pattern that matches, NULL when none does."""
    first = [F.nullif(F.regexp_extract(text, "(?iU)" + p, 1), F.lit("")) for p in patterns]
    return digits_to_int(F.coalesce(*first))


#: A range of years is one number, its first year times this plus its last.
_SPAN = 10_000


def _year_ranges(line: Column, current_year: int) -> Column:
    """Year ranges of one line; an open range ends in the current year."""
    found = F.regexp_extract_all(line, F.lit(fixed.YEAR_RANGE), F.lit(0))

    # A range starts with its first year and ends with its last or with a word.
    def span(r: Column) -> Column:
        last = F.when(F.right(r, F.lit(1)) <= "9", F.right(r, F.lit(4)).cast("int")).otherwise(F.lit(current_year))
        return F.left(r, F.lit(4)).cast("int") * _SPAN + last

    def counts(r: Column) -> Column:
        return (r >= fixed.FIRST_WORK_YEAR * _SPAN) & (_first(r) <= _last(r)) & (_last(r) <= current_year)

    return F.filter(F.transform(found, span), counts)


def _first(r: Column) -> Column:
    return F.floor(r / _SPAN).cast("int")


def _last(r: Column) -> Column:
    return r % _SPAN


def work_years(text: Column, current_year: int) -> Column:
    """Years covered by the date ranges of the work sections.

    A short line without a year is a header: it opens an excluded section
    (education, projects, ...) or ends one.  A line naming an intern excludes
    what follows.  Overlapping ranges are merged before they are summed.
    """

    nothing = F.array().cast("array<int>")

    def headed(line: Column) -> Column:
        """Whether a line without a year opens (true) or ends (false) an excluded part."""
        return bind(
            F.length(F.btrim(line, F.lit(SPACES))),
            lambda size: F.when(
                (size > 0) & (size < fixed.SECTION_HEADER_BELOW) & line.rlike("(?iU)" + fixed.NON_WORK_SECTION), F.lit(True)
            ).when((size > 0) & (size < fixed.SECTION_RESET_BELOW), F.lit(False)),
        )

    def read(line: Column, interned: Column) -> Column:
        # Few texts name an intern, and lines with a year are no headers: most lines take two or three tests.
        dated = line.rlike(r"\d{4}") | line.rlike(r"(?U)\d{4}")
        outside = F.when(interned & line.rlike("(?iU)" + fixed.INTERN_WORD), F.lit(True)).when(~dated, headed(line))
        ranges = F.when(line.rlike(r"\d{4}\s*[-–—]"), _year_ranges(line, current_year)).otherwise(nothing)
        return F.struct(outside.alias("outside"), ranges.alias("ranges"))

    def collect(acc: Column, line: Column) -> Column:
        skip = F.coalesce(line["outside"], acc["outside"])
        more = ~skip & (F.size(line["ranges"]) > 0)
        kept = F.when(more, F.concat(acc["ranges"], line["ranges"])).otherwise(acc["ranges"])
        return F.struct(skip.alias("outside"), kept.alias("ranges"))

    def cover(acc: Column, r: Column) -> Column:
        """Years covered times _SPAN plus the last year reached, over ranges in order."""
        gained = F.greatest(F.lit(0), _last(r) - F.greatest(_first(r), _last(acc)))
        return acc + gained * _SPAN + F.greatest(F.lit(0), _last(r) - _last(acc))

    def total(ranges: Column) -> Column:
        return F.when(F.size(ranges) > 0, F.aggregate(ranges, F.lit(0), cover, _first))

    start = F.struct(F.lit(False).alias("outside"), nothing.alias("ranges"))
    ranges = bind(
        text.rlike("(?iU)" + fixed.INTERN_WORD),
        lambda interned: F.aggregate(
            F.transform(F.split(text, "\n"), lambda line: read(line, interned)),
            start, collect, lambda acc: F.sort_array(acc["ranges"]),
        ),
    )
    return F.when(text.rlike(fixed.YEAR_RANGE), bind(ranges, total))


def extract_titles(text: Column, patterns: Iterable[str] = fixed.JOB_TITLES) -> Column:
    """Distinct job titles, sorted."""
    found = F.transform(captures(text, patterns, "(?iU)"), strip)
    return F.array_sort(F.array_distinct(found))


def extract_keywords(text: Column) -> Column:
    """Distinct runs of capitalised words longer than two letters, sorted."""
    found = F.array_distinct(captures(text, [fixed.CAPITALISED_RUN], "(?U)"))
    wanted = F.filter(
        found, lambda w: (F.length(w) > 2) & ~w.isin(*fixed.KEYWORD_STOPWORDS)
    )
    return F.array_sort(wanted)


def parse_profiles(
    df: DataFrame,
    as_of_year: int,
    text: str = "raw_text",
    fallback_skills: Iterable[str] = (),
    vocabulary: Iterable[str] = fixed.SKILL_VOCABULARY,
    title_patterns: Iterable[str] = fixed.JOB_TITLES,
) -> DataFrame:
    """Add skills, keywords, job_titles, yoe, text_hash and parser_version.

    Stated years win over years read from date ranges; without any skill the
    fallback list is used.
    """
    body = F.col(text)
    skills = extract_skills(body, vocabulary)
    fallback = F.array(*map(F.lit, fallback_skills)).cast("array<string>")
    return df.withColumn("_skills", skills).select(
        *df.columns,
        F.when(F.size("_skills") > 0, F.col("_skills")).otherwise(fallback).alias("skills"),
        extract_keywords(body).alias("keywords"),
        extract_titles(body, title_patterns).alias("job_titles"),
        F.coalesce(explicit_years(body), work_years(body, as_of_year)).alias("yoe"),
        F.md5(body.cast("binary")).alias("text_hash"),
        F.lit(fixed.PARSER_VERSION).alias("parser_version"),
    )


def changed_only(
    df: DataFrame, cache: DataFrame, id_column: str = "profile_id", text: str = "raw_text",
    version: int = fixed.PARSER_VERSION,
) -> DataFrame:
    """Texts to parse again: those whose hash and parser version are not what
    the cache (id, text_hash, parser_version) holds for their id."""
    current = df.withColumn("text_hash", F.md5(F.col(text).cast("binary")))
    valid = cache.where(F.col("parser_version") == version).select(id_column, "text_hash")
    return current.join(valid, [id_column, "text_hash"], "left_anti")


def refresh_profiles(
    df: DataFrame, cache: DataFrame, as_of_year: int, id_column: str = "profile_id", text: str = "raw_text", **options
) -> DataFrame:
    """The cache after a run over ``df``: texts that are new, changed or known
    from another parser version are parsed again, all other entries stay.

    ``cache`` has the columns of ``df`` and of ``parse_profiles``, one row per
    id; ``options`` go to ``parse_profiles``.
    """
    changed = changed_only(df, cache, id_column, text).drop("text_hash")
    parsed = parse_profiles(changed, as_of_year, text, **options)
    kept = cache.join(changed.select(id_column), id_column, "left_anti")
    return kept.select(*cache.columns).unionByName(parsed.select(*cache.columns))
