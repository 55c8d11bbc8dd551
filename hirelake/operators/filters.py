"""Listing filters.

Each ``drop_*`` function is a boolean column, true where the listing is to be
dropped.  All of them are row-wise, so one pass without a shuffle applies the
lot, and each text is lowered and folded once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake import fixed
from hirelake.functions.company import company_group
from hirelake.functions.dates import instant
from hirelake.functions.places import has_foreign_marker, is_remote, looks_domestic
from hirelake.functions.text import ascii_fold
from hirelake.functions.titles import infer_seniority, is_wanted_role, required_years
from hirelake.functions.words import bind, contains_any, hits
from hirelake.schema import Preferences, Vocabulary


def search_intent(title: Column, description: Column, queries=(), vocab: Vocabulary | None = None) -> Column:
    """Kept when a query phrase occurs in title and description, when two
    distinct query words occur in the title, or a generic word does."""
    vocab = vocab or Vocabulary()
    phrases = [q.strip().lower() for q in queries if q.strip()]
    tokens = dict.fromkeys(t for q in phrases for t in re.findall(fixed.QUERY_TOKEN, q))
    terms = [t for t in tokens if len(t) >= 3 and t not in vocab.query_stopwords]

    def in_title(low: Column) -> Column:
        generic = contains_any(low, vocab.generic_title_words)
        return generic | (hits(low, terms) >= 2) if terms else generic

    # The title decides most rows before the description is lowered.
    found = bind(F.lower(title), in_title)
    if phrases:
        text = F.lower(F.concat(title, F.lit(" "), description))
        found = found | bind(text, lambda low: contains_any(low, phrases))
    return found


def matching_intent(df: DataFrame, queries=(), vocab: Vocabulary | None = None) -> DataFrame:
    return df.where(search_intent(F.col("title"), F.col("description"), queries, vocab))


def drop_companies(company: Column, excluded, vocab: Vocabulary | None = None) -> Column:
    vocab = vocab or Vocabulary()
    names = [c.lower() for c in excluded]
    if not names:
        return F.lit(False)
    group = company_group(company, vocab.company_groups, vocab.legal_suffix)
    return F.coalesce(F.lower(company).isin(names) | group.isin(names), F.lit(False))


def drop_generic_urls(url: Column, parts=fixed.GENERIC_URL_PARTS) -> Column:
    found = [url.contains(p) for p in parts]
    return F.coalesce(reduce(lambda a, b: a & b, found), F.lit(False))


def drop_early_career(title_lower: Column, pattern: str = fixed.EARLY_CAREER_TITLE) -> Column:
    return title_lower.rlike("(?U)" + pattern)


def drop_phrases(description_lower: Column, company_lower: Column, phrases) -> Column:
    phrases = [p.lower() for p in phrases]
    return contains_any(description_lower, phrases) | contains_any(company_lower, phrases)


def drop_over_years(yoe_required: Column, description: Column, max_years: int) -> Column:
    """Too many years asked.  A stated zero counts as not stated here."""
    years = F.coalesce(F.nullif(yoe_required, F.lit(0)), required_years(description))
    return F.coalesce(years > max_years + fixed.YEARS_BUFFER, F.lit(False))


def drop_other_roles(title_lower: Column, vocab: Vocabulary | None = None) -> Column:
    vocab = vocab or Vocabulary()
    return ~is_wanted_role(title_lower, vocab.role_terms, vocab.role_excludes)


def drop_mismatch(description_lower: Column, phrases=fixed.MISMATCH_PHRASES) -> Column:
    return hits(description_lower, phrases) >= fixed.MISMATCH_MIN_HITS


def drop_seniority(title_lower: Column, allowed, vocab: Vocabulary | None = None) -> Column:
    """Level known and not allowed; with no allowed levels nothing is dropped."""
    vocab = vocab or Vocabulary()
    allowed = [s.lower() for s in allowed]
    if not allowed:
        return F.lit(False)
    level = infer_seniority(title_lower, vocab.senior_terms, vocab.mid_terms, vocab.entry_terms)
    return F.coalesce(~level.isin(allowed), F.lit(False))


def drop_stale(posted_date: Column, as_of, max_age_days: int = fixed.STALE_AFTER_DAYS) -> Column:
    """More whole days old than allowed.  Written as a comparison with a
    literal instant, so that old row groups of a Parquet scan are skipped."""
    latest = instant(as_of) - F.make_dt_interval(F.lit(max_age_days + 1))
    return posted_date.isNotNull() & (posted_date <= latest)


def drop_places(
    location_lower: Column,
    country: str | None,
    include_remote: bool | None = None,
    vocab: Vocabulary | None = None,
    folded: Column | None = None,
) -> Column:
    """Outside the country "us"; no test for other countries or blank places.
    Remote places pass when remote is wanted and no foreign place is named."""
    vocab = vocab or Vocabulary()
    if (country or "").lower() != "us":
        return F.lit(False)
    if folded is None:
        return bind(
            ascii_fold(location_lower),
            lambda x: drop_places(location_lower, country, include_remote, vocab, x),
        )
    foreign = has_foreign_marker(location_lower, vocab.foreign_markers, folded)
    domestic = looks_domestic(
        location_lower, vocab.domestic_phrases, vocab.state_codes, vocab.domestic_cities,
        vocab.foreign_markers, folded,
    )
    remote_wanted = include_remote is None or include_remote
    remote = is_remote(location_lower, vocab.remote_words)
    dropped = F.when(remote, foreign if remote_wanted else F.lit(True)).otherwise(~domestic)
    return (location_lower != "") & dropped


Test = Callable[[Callable[[str], Column]], Column]


def _tests(prefs: Preferences, as_of, vocab: Vocabulary) -> dict[str, Test]:
    """Drop tests by name, in reporting order.  Each takes a lookup of columns
    by name; ``_title`` and the like are the lowered texts."""
    return {
        "company": lambda c: drop_companies(c("company"), prefs.excluded_companies, vocab),
        "generic_url": lambda c: drop_generic_urls(c("url"), vocab.generic_url_parts),
        "early_career": lambda c: drop_early_career(c("_title"), vocab.early_career_title),
        "phrase": lambda c: drop_phrases(c("_description"), c("_company"), prefs.excluded_company_types),
        "years": lambda c: drop_over_years(c("yoe_required"), c("description"), prefs.max_years),
        "role": lambda c: drop_other_roles(c("_title"), vocab),
        "mismatch": lambda c: drop_mismatch(c("_description"), vocab.mismatch_phrases),
        "seniority": lambda c: drop_seniority(c("_title"), prefs.seniority_levels, vocab),
        "stale": lambda c: drop_stale(c("posted_date"), as_of, prefs.max_age_days),
        "place": lambda c: drop_places(c("_location"), prefs.country, prefs.include_remote, vocab),
    }


def _lowered(name: str) -> Column:
    return F.lower(F.coalesce(F.col(name.removeprefix("_")), F.lit("")))


def _kept_by(tests: dict[str, Test], names: Sequence[str], *texts: str) -> Column:
    """None of the named tests drops the row; ``texts`` are lowered once."""

    def kept(bound: Column | None) -> Column:
        def column(name: str) -> Column:
            return bound[name] if name in texts else F.col(name)

        return reduce(and_, [~tests[n](column) for n in names])

    if not texts:
        return kept(None)
    return bind(F.struct(*[_lowered(n).alias(n) for n in texts]), kept)


def with_drop_reason(df: DataFrame, prefs: Preferences, as_of, vocab: Vocabulary | None = None) -> DataFrame:
    """Add ``reason``: the first test that drops the row, NULL for kept rows."""
    tests = _tests(prefs, as_of, vocab or Vocabulary())
    texts = ("_title", "_company", "_description", "_location")

    def first(bound: Column) -> Column:
        def column(name: str) -> Column:
            return bound[name] if name in texts else F.col(name)

        return F.coalesce(*[F.when(test(column), F.lit(name)) for name, test in tests.items()])

    reason = bind(F.struct(*[_lowered(n).alias(n) for n in texts]), first)
    return df.withColumn("reason", reason)


def filter_listings(df: DataFrame, prefs: Preferences, as_of, vocab: Vocabulary | None = None) -> DataFrame:
    """Rows no test drops.

    The conjunction stops at the first failing test, so the cheap ones come
    first: plain comparisons, which also reach the scan, then short texts,
    then whole descriptions, then the regular expressions over them.
    """
    tests = _tests(prefs, as_of, vocab or Vocabulary())
    return df.where(
        _kept_by(tests, ["stale"])
        & _kept_by(tests, ["generic_url"])
        & _kept_by(tests, ["role", "early_career", "seniority"], "_title")
        & _kept_by(tests, ["company"])
        & _kept_by(tests, ["place"], "_location")
        & _kept_by(tests, ["phrase", "mismatch"], "_description", "_company")
        & _kept_by(tests, ["years"])
    )


def filter_reasons(df: DataFrame, prefs: Preferences, as_of, vocab: Vocabulary | None = None) -> DataFrame:
    """Rows per reason; "kept" counts the survivors.  One partial aggregation."""
    reasons = with_drop_reason(df, prefs, as_of, vocab)
    return reasons.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(
        F.count(F.lit(1)).alias("listings")
    )
