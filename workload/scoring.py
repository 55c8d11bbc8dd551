"""Scores."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from hirelake import Preferences, Profile, Vocabulary
from hirelake.operators import scoring as s
from workload.core import DOC, DOC_AS_OF, age_sql, any_sql, company_group_sql, hits_sql, query, round1_sql

SKILLS = ("The", "que", "der", "tion", "heit", "en ", "and", "Ing", "la ", "zzz", "with", "qqq")
PROFILE = Profile(skills=SKILLS)
PREFS = Preferences(
    target_companies=("Customer#000000007", "#00000001", "Customer#000000042 Holding"),
    preferred_locations=("NATION_3, AMERICA", "NATION_24, EUROPE"),
    include_remote=True,
    max_years=4,
)
VOCAB = replace(Vocabulary(), domestic_phrases=("asia",), remote_words=("nation_1",))

_LOW = [x.lower() for x in SKILLS]
_TEXT = "lower(description || ' ' || title)"
SKILL_SQL = f"least(CAST({hits_sql(_TEXT, _LOW)} AS DOUBLE) / {len(SKILLS)} * 100.0::DOUBLE * 3, 100.0::DOUBLE)"
_GROUP = company_group_sql("company")
_TARGETS = [x.lower() for x in PREFS.target_companies]
COMPANY_SQL = f"""CASE WHEN {any_sql('lower(company)', _TARGETS)} OR {any_sql(_GROUP, _TARGETS)}
  OR {" OR ".join(f"contains('{t}', lower(company)) OR contains('{t}', {_GROUP})" for t in _TARGETS)}
  THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END"""
LOCATION_SQL = """CASE WHEN location = '' THEN 30.0::DOUBLE WHEN contains(lower(location), 'nation_1') THEN 90.0::DOUBLE
  WHEN contains(lower(location), 'nation_3') OR contains(lower(location), 'america') THEN 100.0::DOUBLE
  WHEN contains(lower(location), 'nation_24') OR contains(lower(location), 'europe') THEN 95.0::DOUBLE
  WHEN contains(lower(location), 'asia') THEN 50.0::DOUBLE ELSE 20.0::DOUBLE END"""
YEARS_SQL = """CASE WHEN yoe_required IS NULL THEN 70.0::DOUBLE
  WHEN yoe_required <= 4 THEN 60.0::DOUBLE + (1.0::DOUBLE - CAST(abs(4 - yoe_required) AS DOUBLE) / 4) * 40.0::DOUBLE
  ELSE greatest(0.0::DOUBLE, 60.0::DOUBLE - CAST(yoe_required - 4 AS DOUBLE) * 15.0::DOUBLE) END"""


def recency_sql(as_of: str, ts: str = "posted_date") -> str:
    age = age_sql(ts, as_of)
    steps = " ".join(f"WHEN {age} <= {d} THEN {v}::DOUBLE" for d, v in
                     ((0, 100.0), (1, 90.0), (3, 70.0), (7, 50.0), (14, 30.0)))
    return f"CASE WHEN {ts} IS NULL THEN 40.0::DOUBLE {steps} ELSE 10.0::DOUBLE END"


def scored_sql(source: str, skill: str, company: str, location: str, years: str, recency: str) -> str:
    """CTEs ``parts`` and ``scored`` over ``source``."""
    return f"""parts AS (SELECT *, {skill} AS x_skill, {company} AS x_company, {location} AS x_location, {years} AS x_yoe,
  {recency} AS x_recency, least(CAST(length(description) AS DOUBLE) / 500, 1.0::DOUBLE) AS x_conf FROM {source}),
totals AS (SELECT *, (x_skill * x_conf + 50.0::DOUBLE * (1 - x_conf)) * 0.30::DOUBLE + x_company * 0.20::DOUBLE
  + x_location * 0.10::DOUBLE + x_yoe * 0.15::DOUBLE + x_recency * 0.25::DOUBLE AS x_total FROM parts),
scored AS (SELECT *, {round1_sql('x_total')} AS total_score, {round1_sql('x_skill')} AS skill_score,
  {round1_sql('x_company')} AS company_score, {round1_sql('x_location')} AS location_score,
  {round1_sql('x_yoe')} AS yoe_score, {round1_sql('x_recency')} AS recency_score FROM totals)"""


def matched_sql(skills, text: str = _TEXT) -> str:
    listed = ", ".join(f"'{x}'" for x in skills)
    return f"list_filter([{listed}], lambda k: contains({text}, lower(k)))"


DOC_SCORED = f"""{DOC}, {scored_sql('doc', SKILL_SQL, COMPANY_SQL, LOCATION_SQL, YEARS_SQL, recency_sql(DOC_AS_OF))}"""
SCORE_COLUMNS = ("total_score", "skill_score", "company_score", "location_score", "yoe_score", "recency_score")


def doc_scored(t):
    return s.score_listings(t.doc, PROFILE, PREFS, DOC_AS_OF, VOCAB)


@query("skill_score", f"WITH {DOC} SELECT doc_id, {SKILL_SQL} AS score FROM doc")
def _(t):
    return t.doc.select("doc_id", s.skill_score(s.skill_text(F.col("title"), F.col("description")), SKILLS).alias("score"))


@query("matching_skills", f"WITH {DOC} SELECT doc_id, array_to_string({matched_sql(SKILLS)}, '|') AS skills FROM doc")
def _(t):
    found = s.matching_skills(s.skill_text(F.col("title"), F.col("description")), SKILLS)
    return t.doc.select("doc_id", F.array_join(found, "|").alias("skills"))


@query("company_score", f"WITH {DOC} SELECT doc_id, {COMPANY_SQL} AS score FROM doc")
def _(t):
    return t.doc.select("doc_id", s.company_score(F.col("company"), PREFS.target_companies, VOCAB).alias("score"))


@query("location_score", f"WITH {DOC} SELECT doc_id, {LOCATION_SQL} AS score FROM doc")
def _(t):
    return t.doc.select("doc_id", s.location_score(F.col("location"), PREFS, VOCAB).alias("score"))


@query("years_score", f"WITH {DOC} SELECT doc_id, {YEARS_SQL} AS score FROM doc")
def _(t):
    return t.doc.select("doc_id", s.years_score(F.col("yoe_required"), F.col("description"), 4).alias("score"))


@query("recency_score", f"SELECT event_id, {recency_sql('2024-01-20 12:00:00', 'ts')} AS score FROM events")
def _(t):
    ts = F.col("ts").cast("timestamp")
    return t.events.select("event_id", s.recency_score(ts, "2024-01-20T12:00:00").alias("score"))


@query("score_listings", f"""WITH {DOC_SCORED} SELECT unique_key, {', '.join(SCORE_COLUMNS)},
  array_to_string({matched_sql(SKILLS)}, '|') AS matching_skills FROM scored""")
def _(t):
    return doc_scored(t).select(
        "unique_key", *SCORE_COLUMNS, F.array_join("matching_skills", "|").alias("matching_skills")
    )
