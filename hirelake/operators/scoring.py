"""Listing scores, 0 to 100, for one profile and one set of preferences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake import fixed
from hirelake.functions.company import company_group
from hirelake.functions.dates import age_days
from hirelake.functions.numbers import round1
from hirelake.functions.places import is_remote, looks_domestic
from hirelake.functions.titles import required_years
from hirelake.functions.words import bind, contains_any, hits, quote
from hirelake.schema import Preferences, Profile, Vocabulary


def wanted_skills(profile: Profile, prefs: Preferences) -> list[str]:
    return list(profile.skills or prefs.skills)


def skill_text(title: Column, description: Column) -> Column:
    return F.lower(F.concat(description, F.lit(" "), title))


def skill_score(text: Column, skills) -> Column:
    """Share of skills found in the lowered text, tripled, at most 100."""
    skills = [s.lower() for s in skills]
    if not skills:
        return F.lit(fixed.NEUTRAL_SKILL_SCORE)
    found = bind(text, lambda low: hits(low, skills, distinct=False))
    return F.least(found.cast("double") / len(skills) * 100.0 * fixed.SKILL_SCALE, F.lit(100.0))


def matching_skills(text: Column, skills) -> Column:
    """Skills found in the lowered text, as written and in their own order."""
    if not skills:
        return F.array().cast("array<string>")
    return bind(
        text,
        lambda low: F.array_compact(
            F.array(*[F.when(low.contains(s.lower()), F.lit(s)) for s in skills])
        ),
    )


def company_score(company: Column, targets, vocab: Vocabulary | None = None) -> Column:
    """100 when a target and the company name, or its group, hold one another.
    A blank company is inside every target."""
    vocab = vocab or Vocabulary()
    targets = [t.lower() for t in targets]
    if not targets:
        return F.lit(0.0)
    group = company_group(company, vocab.company_groups, vocab.legal_suffix)

    wanted = F.array(*map(F.lit, targets))

    def match(names: Column) -> Column:
        return F.exists(
            wanted,
            lambda t: F.contains(names["low"], t) | F.contains(t, names["low"])
            | F.contains(names["group"], t) | F.contains(t, names["group"]),
        )

    found = bind(F.struct(F.lower(company).alias("low"), group.alias("group")), match)
    return F.when(found, F.lit(100.0)).otherwise(F.lit(0.0))


def location_score(location: Column, prefs: Preferences, vocab: Vocabulary | None = None) -> Column:
    vocab = vocab or Vocabulary()
    return bind(F.lower(location), lambda place: _place_score(place, prefs, vocab))


def _place_score(place: Column, prefs: Preferences, vocab: Vocabulary) -> Column:
    score = F.when(place == "", F.lit(30.0))
    if prefs.include_remote:
        score = score.when(is_remote(place, vocab.remote_words), F.lit(90.0))
    for rank, preferred in enumerate(prefs.preferred_locations):
        parts = [p.strip().lower() for p in preferred.split(",")]
        score = score.when(contains_any(place, parts), F.lit(100.0 - rank * 5))
    country = ("US" if prefs.country is None else prefs.country).lower()
    if country == "us":
        home = looks_domestic(
            place, vocab.domestic_phrases, vocab.state_codes, vocab.domestic_cities,
            vocab.foreign_markers,
        )
    else:
        home = place.rlike(rf"(?U)\b{quote(country)}\b")
    return score.when(home, F.lit(50.0)).otherwise(F.lit(20.0))


def years_score(yoe_required: Column, description: Column, max_years: int) -> Column:
    """Closer to the maximum from below is better, above it costs 15 a year.
    A stated zero is a value here."""
    stated = F.coalesce(yoe_required, required_years(description))
    return bind(stated, lambda years: _years_score(years, max_years))


def _years_score(years: Column, max_years: int) -> Column:
    near = F.lit(1.0) - F.abs(F.lit(max_years) - years).cast("double") / max(max_years, 1)
    over = F.greatest(F.lit(0.0), F.lit(60.0) - (years - max_years).cast("double") * 15.0)
    return (
        F.when(years.isNull(), F.lit(70.0))
        .when(years <= max_years, F.lit(60.0) + near * 40.0)
        .otherwise(over)
    )


def recency_score(posted_date: Column, as_of) -> Column:
    age = age_days(posted_date, as_of)
    score = F.when(posted_date.isNull(), F.lit(fixed.RECENCY_UNKNOWN))
    for days, value in fixed.RECENCY_STEPS:
        score = score.when(age <= days, F.lit(value))
    return score.otherwise(F.lit(fixed.RECENCY_OLD))


def score_listings(
    df: DataFrame, profile: Profile, prefs: Preferences, as_of, vocab: Vocabulary | None = None
) -> DataFrame:
    """Add the total, its five parts and the matching skills.  Row-wise."""
    vocab = vocab or Vocabulary()
    skills = wanted_skills(profile, prefs)
    raw = df.withColumn("_text", skill_text(F.col("title"), F.col("description"))).withColumns(
        {
            "_skill": skill_score(F.col("_text"), skills),
            "_company": company_score(F.col("company"), prefs.target_companies, vocab),
            "_location": location_score(F.col("location"), prefs, vocab),
            "_yoe": years_score(F.col("yoe_required"), F.col("description"), prefs.max_years),
            "_recency": recency_score(F.col("posted_date"), as_of),
            "_confidence": F.least(
                F.length("description").cast("double") / fixed.FULL_DESCRIPTION_CHARS, F.lit(1.0)
            ),
        }
    )
    # Thin descriptions pull the skill part towards the neutral score.
    weight = fixed.SCORE_WEIGHTS
    blended = F.col("_skill") * F.col("_confidence") + fixed.NEUTRAL_SKILL_SCORE * (
        1 - F.col("_confidence")
    )
    total = (
        blended * weight["skill"]
        + F.col("_company") * weight["company"]
        + F.col("_location") * weight["location"]
        + F.col("_yoe") * weight["yoe"]
        + F.col("_recency") * weight["recency"]
    )
    return raw.withColumn("_total", total).select(
        *df.columns,
        round1(F.col("_total")).alias("total_score"),
        round1(F.col("_skill")).alias("skill_score"),
        round1(F.col("_company")).alias("company_score"),
        round1(F.col("_location")).alias("location_score"),
        round1(F.col("_yoe")).alias("yoe_score"),
        round1(F.col("_recency")).alias("recency_score"),
        matching_skills(F.col("_text"), skills).alias("matching_skills"),
    )
