"""Record shapes and the driver-side settings operators take."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from typing import Any

from pyspark.sql import types as T

from hirelake import fixed


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_S = T.StringType()
_TS = T.TimestampType()

LISTING = _struct(
    title=_S, company=_S, location=_S, url=_S, description=_S, source=_S,
    posted_date=_TS, job_id=_S, seniority=_S, yoe_required=T.IntegerType(),
    salary=_S, team=_S, metadata=T.MapType(_S, _S),
)

# One landed response of a job board or search endpoint.
RAW_PAYLOAD = _struct(company=_S, slug=_S, payload=_S)

# One stored listing; attempt and seen_month are the partition columns.
SEEN = _struct(
    unique_key=_S, title=_S, company=_S, location=_S, url=_S, source=_S,
    posted_date=_TS, first_seen=_TS, score=T.DoubleType(), description=_S,
)
SEEN_STORED = T.StructType(
    SEEN.fields + [T.StructField("origin", _S), T.StructField("attempt", _S), T.StructField("seen_month", _S)]
)


@dataclass(frozen=True)
class Profile:
    """What a profile text yields and scoring needs."""

    skills: tuple[str, ...] = ()
    keywords: tuple[str, ...] = ()
    job_titles: tuple[str, ...] = ()
    yoe: int | None = None


@dataclass(frozen=True)
class Preferences:
    """User settings.

    ``include_remote`` and ``country`` are ``None`` when unset because the two
    readers differ: filtering then assumes remote is fine and applies no
    country test, scoring assumes no remote bonus and country "US".
    """

    search_queries: tuple[str, ...] = ()
    target_companies: tuple[str, ...] = ()
    preferred_locations: tuple[str, ...] = ()
    include_remote: bool | None = None
    country: str | None = None
    max_years: int = fixed.DEFAULT_MAX_YEARS
    max_age_days: int = fixed.STALE_AFTER_DAYS
    seniority_levels: tuple[str, ...] = ()
    excluded_company_types: tuple[str, ...] = ()
    excluded_companies: tuple[str, ...] = ()
    skills: tuple[str, ...] = ()
    results_per_day: int = 10

    @classmethod
    def from_mapping(cls, settings: Mapping[str, Any]) -> Preferences:
        """Preferences of a parsed settings file; keys it does not know are
        ignored, missing ones keep their defaults."""
        given = dict(settings)
        if "max_yoe_required" in given:
            given["max_years"] = given["max_yoe_required"]
        known = {f.name for f in fields(cls)}
        return cls(**{
            name: tuple(value) if isinstance(value, list) else value
            for name, value in given.items()
            if name in known and value is not None
        })


@dataclass(frozen=True)
class Vocabulary:
    """Word lists behind the heuristics, replaceable one by one."""

    company_groups: Mapping[str, tuple[str, ...]] = field(
        default_factory=lambda: dict(fixed.COMPANY_GROUPS)
    )
    legal_suffix: str = fixed.LEGAL_SUFFIX
    generic_title_words: tuple[str, ...] = fixed.GENERIC_TITLE_WORDS
    query_stopwords: tuple[str, ...] = fixed.QUERY_STOPWORDS
    role_terms: tuple[str, ...] = fixed.ROLE_TERMS
    role_excludes: tuple[str, ...] = fixed.ROLE_EXCLUDES
    senior_terms: tuple[str, ...] = fixed.SENIOR_TERMS
    mid_terms: tuple[str, ...] = fixed.MID_TERMS
    entry_terms: tuple[str, ...] = fixed.ENTRY_TERMS
    mismatch_phrases: tuple[str, ...] = fixed.MISMATCH_PHRASES
    early_career_title: str = fixed.EARLY_CAREER_TITLE
    generic_url_parts: tuple[str, ...] = fixed.GENERIC_URL_PARTS
    foreign_markers: tuple[str, ...] = fixed.FOREIGN_MARKERS
    state_codes: tuple[str, ...] = fixed.STATE_CODES
    domestic_phrases: tuple[str, ...] = fixed.DOMESTIC_PHRASES
    domestic_cities: tuple[str, ...] = fixed.DOMESTIC_CITIES
    remote_words: tuple[str, ...] = fixed.REMOTE_WORDS
