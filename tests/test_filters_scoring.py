from datetime import datetime

from conftest import listing
from hirelake import Preferences, Profile
from hirelake.operators.filters import filter_listings, filter_reasons, matching_intent, with_drop_reason
from hirelake.operators.scoring import score_listings

AS_OF = "2026-03-10T12:00:00"


def reasons(listings, prefs, *rows):
    given = [dict(r, job_id=str(i)) for i, r in enumerate(rows)]
    out = with_drop_reason(listings(*given), prefs, AS_OF).select("job_id", "reason").collect()
    kept = {r.job_id for r in filter_listings(listings(*given), prefs, AS_OF).select("job_id").collect()}
    found = {r.job_id: r.reason for r in out}
    assert kept == {k for k, v in found.items() if v is None}
    return [found[str(i)] for i in range(len(given))]


def test_search_intent(listings):
    rows = listings(
        dict(job_id="phrase", title="Cook", description="we want a Data Cruncher here"),
        dict(job_id="terms", title="cruncher of payroll", description=""),
        dict(job_id="one", title="cruncher", description=""),
        dict(job_id="generic", title="Platform person", description=""),
        dict(job_id="stop", title="the senior", description=""),
    )

    def ids(queries):
        return {r.job_id for r in matching_intent(rows, queries).collect()}

    assert ids(["data cruncher", "the senior payroll"]) == {"phrase", "terms", "generic"}
    assert ids([]) == ids(["  "]) == {"generic"}


def test_each_reason(listings):
    prefs = Preferences(
        excluded_companies=("Acme", "amazon"), excluded_company_types=("Staffing Agency",), max_years=4,
        seniority_levels=("entry", "mid"),
    )
    old = datetime(2026, 2, 7, 12)
    assert reasons(
        listings, prefs,
        dict(company="ACME"), dict(company="AWS Annapurna Labs"), dict(company="Acme2, Inc."),
        dict(company="b", url="https://x/jobs/search?gh_jid=1"), dict(company="b", url="https://x/jobs/search"),
        dict(company="b", title="New  Grad Software Engineer"), dict(company="b", title="Software Engineer Co-op"),
        dict(company="b", description="A STAFFING agency"), dict(company="My staffing agency"),
        dict(company="b", description="6 years of experience"), dict(company="b", description="5 years experience"),
        dict(company="b", yoe_required=0, description="9 yoe"), dict(company="b", yoe_required=6),
        dict(company="b", title="Accountant"), dict(company="b", title="Software Engineer, Enablement"),
        dict(company="b", description="incident response and sales quota"), dict(company="b", description="sales quota"),
        dict(company="b", title="Senior Software Engineer"), dict(company="b", title="Software Engineer II"),
        dict(company="b", posted_date=old), dict(company="b", posted_date=datetime(2026, 2, 7, 12, 0, 1)),
    ) == [
        "company", "company", None, "generic_url", None, "early_career", "early_career", "phrase", "phrase",
        "years", None, "years", "years", "role", "role", "mismatch", None, "seniority", None, "stale", None,
    ]


def test_places_of_the_country(listings):
    rows = [dict(company="b", location=x) for x in (
        "", "Remote", "Remote - Türkiye", "Seattle, WA", "Berlin", "Remote, London, UK", "Indiana", "Anywhere in the US")]
    with_remote = Preferences(country="US")
    assert reasons(listings, with_remote, *rows) == [None, None, "place", None, "place", "place", "place", None]
    assert reasons(listings, Preferences(country="us", include_remote=False), *rows[:4]) == [None, "place", "place", None]
    assert reasons(listings, Preferences(country="de"), *rows) == [None] * 8
    assert reasons(listings, Preferences(), *rows) == [None] * 8


def test_reason_counts(listings):
    rows = listings(dict(job_id="1"), dict(job_id="2", title="Cook"), dict(job_id="3", title="Chef"))
    assert {r.reason: r.listings for r in filter_reasons(rows, Preferences(), AS_OF).collect()} == {"kept": 1, "role": 2}


def scores(listings, prefs, profile, *rows):
    df = listings(*[dict(r, job_id=f"{i:02d}") for i, r in enumerate(rows)])
    return score_listings(df, profile, prefs, AS_OF).orderBy("job_id").collect()


def test_parts_of_the_score(listings):
    prefs = Preferences(
        target_companies=("Stripe", "Acme Holding"), preferred_locations=("Seattle, WA", "New York, NY"),
        include_remote=True, max_years=4, skills=("cobol",),
    )
    profile = Profile(skills=("Python", "Java", "Kafka", "SQL"))
    rows = scores(
        listings, prefs, profile,
        dict(title="Python dev", description="JavaScript and sql", company="acme", location="Remote"),
        dict(company="", location="", description="x" * 500),
        dict(company="Other", location="New York", yoe_required=0, posted_date=datetime(2026, 3, 9)),
        dict(company="Other", location="Sydney, Australia", yoe_required=6, posted_date=datetime(2026, 3, 11)),
        dict(company="Other", location="Denver", yoe_required=12, posted_date=datetime(2026, 3, 3, 12)),
    )
    assert [r.skill_score for r in rows] == [100.0, 0.0, 0.0, 0.0, 0.0]
    assert rows[0].matching_skills == ["Python", "Java", "SQL"] and rows[1].matching_skills == []
    assert [r.company_score for r in rows] == [100.0, 100.0, 0.0, 0.0, 0.0]
    # "wa" and "ny" are parts of preferred places and match anywhere.
    assert [r.location_score for r in rows] == [90.0, 30.0, 95.0, 20.0, 50.0]
    assert [r.yoe_score for r in rows] == [70.0, 70.0, 60.0, 30.0, 0.0]
    assert [r.recency_score for r in rows] == [40.0, 40.0, 90.0, 100.0, 50.0]
    thin = min(len("JavaScript and sql") / 500, 1.0)
    blended = 100.0 * thin + 50.0 * (1 - thin)
    assert rows[0].total_score == round(blended * 0.30 + 100 * 0.20 + 90 * 0.10 + 70 * 0.15 + 40 * 0.25, 1)


def test_unset_preferences_differ_between_filter_and_score(listings):
    rows = scores(listings, Preferences(), Profile(), dict(location="Remote"), dict(location="Remote, Austin"))
    assert [r.location_score for r in rows] == [20.0, 50.0]
    assert [r.skill_score for r in rows] == [50.0, 50.0]
    other = scores(listings, Preferences(country="France"), Profile(), dict(location="Paris, France"), dict(location="Francena"))
    assert [r.location_score for r in other] == [50.0, 20.0]


def test_config_skills_stand_in_for_a_profile_without_any(listings):
    row, = scores(listings, Preferences(skills=("Rust", "Go")), Profile(), dict(description="rusty"))
    assert row.skill_score == 100.0 and row.matching_skills == ["Rust"]


def test_filters_do_not_shuffle_and_push_dates(listings, tmp_path, spark):
    path = str(tmp_path / "l")
    listings(listing()).write.parquet(path)
    plan = filter_listings(spark.read.parquet(path), Preferences(), AS_OF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert "posted_date" in plan.split("PushedFilters")[1].split("]")[0]
