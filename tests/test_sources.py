import json
from datetime import datetime

from pyspark.sql import functions as F

from hirelake.operators.boards import (
    expand_slugs, extract_slugs, merge_slug_lists, merge_slug_sources, merge_totals, resolve_slugs, slug_candidates,
    surviving_slugs, validate_slugs, validation_totals,
)
from hirelake.fixed import SLUG_IGNORED, SLUG_PATTERNS
from hirelake.plans.intake import intake
from hirelake.sources import (
    jsonld_postings, normalize_amazon, normalize_ashby, normalize_greenhouse, normalize_lever,
    normalize_microsoft, normalize_structured, page_cutoff, sitemap_entries,
)
from hirelake.sources.microsoft import detailed_listings, enrich_with_details
from hirelake.sources.payloads import good_and_rejected


def raw(spark, *payloads, company="Acme", slug="acme"):
    rows = [(company, slug, p if isinstance(p, str) else json.dumps(p)) for p in payloads]
    return spark.createDataFrame(rows, "company string, slug string, payload string")


def test_lever(spark):
    payload = [
        {"id": "a", "text": "Dev", "createdAt": 1700000000000, "hostedUrl": "", "applyUrl": "u2",
         "workplaceType": "remote", "lists": [{"text": "Do", "content": "<li>x</li>"}, {"content": "y"}], "descriptionPlain": ""},
        {"categories": {"location": "", "team": "T", "commitment": "Full"}, "workplaceType": "remote", "descriptionPlain": "plain", "applyUrl": "u2"},
        "junk", 5, None, {"id": "c", "categories": "not an object"},
    ]
    first, second = normalize_lever(raw(spark, payload, '{"not": "an array"}', "{broken")).orderBy(F.desc("job_id")).collect()
    assert (first.title, first.location, first.url, first.description) == ("Dev", "remote", "", "Do <li>x</li>  y")
    assert first.posted_date == datetime(2023, 11, 14, 22, 13, 20) and first.metadata == {"commitment": ""}
    assert (second.title, second.location, second.url, second.team) == ("Unknown", "", "u2", "T")
    assert second.posted_date is None and second.metadata == {"commitment": "Full"}


def test_greenhouse(spark):
    payload = {"jobs": [
        {"id": 7, "title": "Dev", "location": {"name": "Oslo"}, "content": "&lt;p&gt;Hi&lt;/p&gt; &amp;eacute;", "updated_at": "2024-05-06T07:08:09-04:00",
         "departments": [{"name": "Eng"}, {"name": "Ops"}], "absolute_url": "u"},
        {"id": "8", "location": "text", "departments": [], "updated_at": "soon"},
    ]}
    one, two = normalize_greenhouse(raw(spark, payload)).orderBy("job_id").collect()
    assert (one.job_id, one.location, one.description, one.team) == ("7", "Oslo", "Hi &eacute;", "Eng")
    assert one.posted_date == datetime(2024, 5, 6, 11, 8, 9)
    assert (two.title, two.location, two.description, two.team, two.posted_date) == ("Unknown", "", "", "", None)


def test_ashby(spark):
    payload = {"jobs": [
        {"id": "1", "title": "A", "location": {"name": "Oslo"}, "descriptionPlain": "p", "description": "d", "team": "T"},
        {"id": "2", "title": "B", "location": "Bergen", "descriptionPlain": "", "description": "<b>d</b>", "departmentName": "D", "team": "T"},
    ]}
    one, two = normalize_ashby(raw(spark, payload)).orderBy("job_id").collect()
    assert (one.location, one.description, one.team, one.url) == ("Oslo", "p", "T", "https://jobs.ashbyhq.com/acme/1")
    assert (two.location, two.description, two.team) == ("Bergen", "d", "D")


def test_amazon(spark):
    payload = {"jobs": [
        {"id_icims": "", "id": "1", "title": "", "city": "Oslo", "state": "", "country_code": "NOR", "posted_date": "March 4, 2026", "job_path": "/en/1"},
        {"id_icims": "2", "company_name": "Sub", "location": "L", "posted_date": "Mar  x", "job_path": "en/2", "public_url": "p", "team": "", "job_category": "C"},
        {"id": "3", "url_next_step": "n", "posted_date": "May 14, 2026", "job_path": "en/3"}, {"id": "4", "url_next_step": "n"},
    ]}
    rows = normalize_amazon(raw(spark, payload)).orderBy("job_id").collect()
    assert [(r.title, r.company, r.location) for r in rows[:2]] == [("Unknown", "Amazon", "Oslo, NOR"), ("Unknown", "Sub", "L")]
    assert [r.url for r in rows] == ["https://www.amazon.jobs/en/1", "p", "https://www.amazon.jobs/en/3", "n"]
    assert [r.posted_date for r in rows] == [datetime(2026, 3, 4), None, datetime(2026, 5, 14), None]
    assert rows[1].team == "C" and rows[0].metadata["country_code"] == "NOR" and len(rows[0].metadata) == 7


def position(**given):
    base = {"id": 1, "name": "Software Engineer", "location": "Oslo", "positionUrl": "/p/1", "postedTs": 1700000000,
            "department": "Dep", "workLocationOption": "onsite", "displayJobId": "D1"}
    return {**base, **given}


def test_microsoft_summary(spark):
    payload = {"data": {"positions": [
        position(), position(id=None, atsJobId="x2", location=None, locations=["A", " ", "B"], publicUrl=" pub ", postedTs="oops", locationFlexibility="f"),
        position(id=3, location=" ", locations="text", positionUrl="https://abs", postedTs=0, name="", department=None),
    ]}}
    rows = normalize_microsoft(raw(spark, payload)).orderBy("job_id").collect()
    assert [r.location for r in rows] == ["Oslo", "", "A, B"]
    assert [r.url for r in rows] == ["https://apply.careers.microsoft.com/p/1", "https://abs", "pub"]
    assert [r.posted_date for r in rows] == [datetime(2023, 11, 14, 22, 13, 20), datetime(1970, 1, 1), None]
    assert [r.description for r in rows] == ["Dep onsite", "onsite", "Dep onsite f"]
    assert rows[1].title == "Unknown" and rows[0].metadata["domain"] == "microsoft.com" and len(rows[0].metadata) == 9


def test_details_overlay(spark):
    payload = {"data": {"positions": [position(), position(id=2), position(id=3), position(id=4, name="Cook", department="Kitchen")]}}
    details = spark.createDataFrame([
        ("1", json.dumps({"data": {"name": "", "jobDescription": "<p>New</p> &amp; big", "location": "", "locations": ["X", "Y"],
                                   "displayJobId": None, "efcustomTextRoletype": "IC", "postedTs": None}})),
        ("2", json.dumps({"data": {"name": "Cook", "jobDescription": "stew", "department": "Kitchen"}})),
        ("3", json.dumps({"data": {}})), ("4", json.dumps({"data": {"name": "Software Engineer"}})),
    ], "position_id string, payload string")
    one, two, three, _ = enrich_with_details(normalize_microsoft(raw(spark, payload)), details, ["payload"]).orderBy("job_id").collect()
    assert (one.title, one.description, one.location, one.company) == ("Software Engineer", "New & big", "X, Y", "Microsoft")
    assert one.posted_date == datetime(2023, 11, 14, 22, 13, 20)
    assert one.metadata["display_job_id"] is None and one.metadata["efcustom_text_roletype"] == "IC" and len(one.metadata) == 15
    assert (two.title, two.team, two.metadata["display_job_id"]) == ("Cook", "Kitchen", "D1")
    assert len(three.metadata) == 9 and three.description == "Dep onsite"
    # The intent is tested before and after the details are known.
    kept = detailed_listings(raw(spark, payload), details, ["payload"], ["software engineer"]).collect()
    assert {r.job_id for r in kept} == {"1", "3"}


def ld(body, tag='<script type="application/ld+json">'):
    return tag + (body if isinstance(body, str) else json.dumps(body)) + "</script>"


POST = {"@type": "JobPosting", "title": "Dev"}


def test_first_posting_of_a_page(spark):
    pages = {
        "plain": ld(POST), "list": ld([1, {"@type": "X"}, POST]), "graph": ld({"@graph": [{"@type": "X"}, POST]}),
        "list of graph": ld([{"@graph": [POST]}]), "deep": ld([[[[{"@graph": [[{"@graph": [POST]}]]}]]]]),
        "order": ld({"@graph": [{"@graph": [{**POST, "title": "A"}]}, {**POST, "title": "B"}]}),
        "second script": ld("{bad") + ld("  ") + ld({"@type": "X"}) + ld(POST), "lenient": ld('{"@type": "JobPosting", "title": "Dev", "v": NaN}'),
        "twice": ld('{"@type": "X", "@type": "JobPosting", "title": "Dev"}'), "attributes": ld(POST, "<SCRIPT id=a TYPE='application/ld+json' async>"),
        "comment": "<!-- " + ld(POST) + " -->", "other type": ld(POST, '<script type="application/ld+json2">'), "none": "<p>ld+json</p>",
        "type list": ld({"@type": ["JobPosting"], "title": "no"}), "in field": ld({"x": POST}),
        "comment in script": ld({**POST, "title": "<!-- Dev -->"}),
    }
    df = spark.createDataFrame(list(pages.items()), "url string, html string")
    found = {r.url: r.t for r in jsonld_postings(df).select("url", F.try_variant_get("posting", "$.title", "string").alias("t")).collect()}
    dev = ["plain", "list", "graph", "list of graph", "deep", "second script", "lenient", "twice", "attributes"]
    assert found == {**{k: "Dev" for k in dev}, "order": "A", "comment in script": "<!-- Dev -->"}


def test_structured_listing(spark):
    full = {
        **POST, "title": "Dev &amp; Ops", "description": "<p>Do</p>", "responsibilities": ["a", "", "b"], "qualifications": "",
        "datePosted": "2024-05-06", "validThrough": "2024-06-01", "employmentType": ["FULL", "<b></b>", "PART"], "directApply": True,
        "hiringOrganization": {"name": "Org &eacute;"},
        "jobLocation": [
            {"name": "HQ"}, {"name": "HQ"}, "text", {"address": {"addressLocality": "Paris", "addressCountry": ["FR", "", "EU"]}},
            {"address": {"addressLocality": "Rome", "addressRegion": "Lazio", "addressCountry": {"name": "IT"}}}, {"address": "x"},
        ],
    }
    pages = [
        ("https://m/job_details/12", ld(full)), ("https://m/job_details/x", "<title> Page &amp;amp; title </title>" +
            '<META content="Meta text" name="description">' + ld({"@type": "JobPosting", "jobLocation": {"name": "One"}, "employmentType": "TEMP"})),
        ("https://m/generic", ld({**POST, "title": "Meta Careers"})), ("https://m/untitled", ld({"@type": "JobPosting"})),
    ]
    sitemap = spark.createDataFrame([("https://m/job_details/x", datetime(2024, 1, 2)), ("https://m/job_details/12", datetime(2024, 1, 2))], "url string, lastmod timestamp")
    one, two = normalize_structured(spark.createDataFrame(pages, "url string, html string"), sitemap).orderBy("url").collect()
    assert (one.title, one.description, one.job_id, one.team) == ("Dev & Ops", "Do Responsibilities: a b", "12", "Org é")
    assert one.location == "HQ, Paris, FR, EU, Rome, Lazio, IT" and one.posted_date == datetime(2024, 5, 6)
    assert one.metadata == {"valid_through": "2024-06-01", "employment_type": "FULL, PART", "direct_apply": "true", "hiring_organization": "Org é"}
    assert (two.title, two.description, two.location, two.job_id) == ("Page & title", "Meta text", "One", "")
    assert two.posted_date == datetime(2024, 1, 2) and two.metadata["employment_type"] == "TEMP"


def test_sitemap(spark):
    head = '<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'
    entry = "<url><loc> {} </loc><lastmod>{}</lastmod></url>"
    good = head + entry.format("https://m/profile/job_details/1", "2024-05-06") + entry.format("https://m/about", "2024-05-06") + \
        entry.format("https://m/profile/job_details/1", "2025-01-01") + "<url><loc>https://m/profile/job_details/2</loc></url><url/></urlset>"
    df = spark.createDataFrame([("a", good), ("b", "<urlset><url>"), ("c", "text")], "sitemap_id string, xml string")
    rows = sitemap_entries(df).orderBy("position").collect()
    assert [(r.sitemap_id, r.url[-1], r.lastmod) for r in rows] == [("a", "1", datetime(2024, 5, 6)), ("a", "2", None)]
    assert [r.url[-1] for r in sitemap_entries(df, max_entries=1).collect()] == ["1"]


def test_intake(spark):
    lever = raw(spark, [{"id": "1", "text": "Data person"}, {"id": "2", "text": "Cook"}, {"id": "3", "text": "Chef", "descriptionPlain": "Site Cook"}])
    greenhouse = raw(spark, {"jobs": [{"id": 4, "title": "Site cook"}]})
    microsoft = raw(spark, {"data": {"positions": [position(), position(id=2, name="Cook")]}})
    page = lambda n: (f"https://m/profile/job_details/{n}", ld({**POST, "title": f"Developer {n}"}))
    pages = spark.createDataFrame([page(5), page(6)], "url string, html string")
    xml = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://m/profile/job_details/5</loc></url></urlset>'
    sitemaps = spark.createDataFrame([("a", xml)], "sitemap_id string, xml string")
    details = spark.createDataFrame([("1", '{"data": {"jobDescription": "more"}}')], "position_id string, payload string")
    landed = {"lever": lever, "greenhouse": greenhouse, "microsoft": microsoft}
    rows = intake(landed, ["site cook"], details=details, pages=pages, sitemaps=sitemaps).collect()
    assert {(r.source, r.job_id) for r in rows} == {("lever", "1"), ("lever", "3"), ("greenhouse", "4"), ("microsoft", "1"), ("meta", "5")}
    assert {r.description for r in rows if r.source == "microsoft"} == {"more"}


def test_page_cutoff_equals_the_page_by_page_walk(spark):
    import random

    rng = random.Random(3)
    pages = {(q, p): [rng.choice("abc") for _ in range(rng.choice([0, 2, 3, 3, 3, 3]))] for q in range(300) for p in range(6)}
    kept = set()
    for q in range(300):
        seen = set()
        for p in range(6):
            ids = pages[q, p]
            if not ids or tuple(ids[:3]) in seen:
                break
            seen.add(tuple(ids[:3]))
            kept.add((q, p))
            if len(ids) < 3:
                break
    df = spark.createDataFrame([(q, p, ids) for (q, p), ids in pages.items()], "query bigint, page bigint, ids array<string>")
    assert {(r.query, r.page) for r in page_cutoff(df, 3).collect()} == kept


def test_good_and_rejected(spark):
    good, bad = good_and_rejected(raw(spark, [{"k": 1}, "x", {"k": "no int"}, {"k": 2}], "[broken"), (), "k int")
    assert sorted(r.record.k for r in good.collect()) == [1, 2]
    assert sorted(r.record_text for r in bad.collect()) == ["x", '{"k":"no int"}']


def slugs(spark, *rows, schema="slug string"):
    return spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)


def test_extract_slugs(spark):
    texts = spark.createDataFrame([
        ("see https://boards.greenhouse.io/Acme, https://job-boards.greenhouse.io/beta/jobs",),
        ("boards-api.greenhouse.io/v1/boards/acme boards.greenhouse.io/embed",), (None,)], "t string")
    found = extract_slugs(texts, F.col("t"), SLUG_PATTERNS["greenhouse"], SLUG_IGNORED["greenhouse"])
    assert {r.slug for r in found.collect()} == {"acme", "beta"}


def test_candidates_and_resolution(spark):
    rows = slug_candidates(slugs(spark, " Foo & Bar Inc! ", "Solo", schema="company string"))
    spelled = {}
    for r in rows.orderBy("ord").collect():
        spelled.setdefault(r.company.strip(), []).append(r.slug)
    assert spelled["Foo & Bar Inc!"] == ["foobarinc", "foo-bar-inc", "foobarinccareers", "foobarinc-careers", "foobarincjobs",
                                         "foobarinc-jobs", "foo-bar-inc-careers", "foo-bar-inc-jobs"]
    assert spelled["Solo"] == ["solo", "solocareers", "solo-careers", "solojobs", "solo-jobs"]
    boards = slugs(spark, ("lever", "solo-jobs", "1"), ("lever", "solo", "2"), ("ashby", "solo-jobs", "3"), ("ashby", "x", "4"), schema="ats string, slug string, job_id string")
    assert {(r.ats, r.slug) for r in resolve_slugs(rows, boards).collect()} == {("lever", "solo"), ("ashby", "solo-jobs")}


def test_validation(spark):
    listed = slugs(spark, ("lever", "A", "a", False), ("lever", None, "b", True), ("ashby", "A", "a", False), schema="ats string, company string, slug string, is_extra boolean")
    boards = slugs(spark, ("lever", "a", "1"), ("lever", "a", "2"), ("lever", "b", "3"), schema="ats string, slug string, job_id string")
    checked = validate_slugs(listed, boards, 2)
    assert {(r.ats, r.slug, r.status) for r in checked.collect()} == {
        ("lever", "a", "valid (a)"), ("lever", "b", "INVALID (b)"), ("ashby", "a", "INVALID (a)")}
    assert validation_totals(checked).collect()[0].asDict() == {"valid": 1, "invalid": 2}
    assert [(r.ats, r.slug) for r in surviving_slugs(checked).collect()] == [("lever", "a")]


def test_merging(spark):
    primary = slugs(spark, ("Acme", " ACME ", 0), ("Acme Two", "acme", 1), ("beta", "b-slug", 2), ("None", " ", 3), schema="company string, slug string, ord int")
    extras = slugs(spark, ("acme", 0), ("beta", 1), ("Gamma ", 2), ("gamma", 3), ("", 4), schema="slug string, ord int")
    merged = {r.company: r.slug for r in merge_slug_sources(primary, extras).collect()}
    assert merged == {"Acme": "acme", "beta": "beta", "gamma": "gamma"}
    lists = merge_slug_lists(slugs(spark, "b", "a", "a"), slugs(spark, "c", "b"))
    assert [(r.slug, r.added) for r in lists.collect()] == [("a", False), ("b", False), ("c", True)]
    assert merge_totals(lists).collect()[0].asDict() == {"total": 3, "added": 1}


def test_the_landing_order_decides_among_details(spark):
    payload = json.dumps({"data": {"positions": [{"id": "7", "name": "software engineer"}, {"name": "a"}, {"name": "b"}]}})
    details = spark.createDataFrame(
        [("7", json.dumps({"data": {"name": "zz new"}}), 2), ("7", json.dumps({"data": {"name": "aa old"}}), 1)],
        "position_id string, payload string, landed int",
    )
    rows = enrich_with_details(normalize_microsoft(raw(spark, payload)), details, [F.col("landed").desc()])
    assert sorted(r.title for r in rows.collect()) == ["a", "b", "zz new"]


def test_search_pages_end_where_the_crawl_did(spark):
    def page(query, number, *ids):
        return query, number, json.dumps({"jobs": [{"id_icims": i, "id": "x", "title": f"software {query}{number}"} for i in ids]})

    landed = spark.createDataFrame([
        page("a", 0, "1", "2"), page("a", 1, "3", "4"), page("a", 2, "1", "2"), page("a", 3, "9", "8"),
        page("b", 0, "1"), page("b", 1, "2", "3"), ("c", 0, "{}"), page("c", 1, "5", "6"), ("d", 0, "no json"),
    ], "query string, page int, payload string")
    found = intake({"amazon": landed}, page_sizes={"amazon": 2}).collect()
    assert sorted((r.title, r.job_id) for r in found) == [
        ("software a0", "1"), ("software a0", "2"), ("software a1", "3"), ("software a1", "4"), ("software b0", "1")]


def test_harvested_slugs_are_validated_and_merged(spark):
    texts = spark.createDataFrame(
        [("https://boards.greenhouse.io/Acme?x jobs.ashbyhq.com/acme.",), ("boards.greenhouse.io/embed jobs.lever.co/beta",), (None,)], "text string")
    boards = spark.createDataFrame([("greenhouse", "acme", "1"), ("lever", "beta", "1"), ("ashby", "other", "1")], "ats string, slug string, job_id string")
    existing = spark.createDataFrame([("lever", "beta"), ("ashby", "old")], "ats string, slug string")
    merged = expand_slugs(texts, F.col("text"), boards, existing)
    assert sorted(tuple(r) for r in merged.collect()) == [("ashby", "old", False), ("greenhouse", "acme", True), ("lever", "beta", False)]


def test_cheap_filters_run_before_the_description_is_cleaned(spark):
    payload = {"jobs": [{"id": 1, "title": "zz_wanted", "content": "&lt;b&gt;caf&eacute; zz_body"}, {"id": 2, "title": "x", "content": "zz_body"}]}
    found = normalize_greenhouse(raw(spark, payload)).where("title = 'zz_wanted' AND description LIKE '%zz_body'")
    assert [r.description for r in found.collect()] == ["café zz_body"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and plan.count("zz_body") == 1
    # The tree is printed from its root: what runs first stands last.
    assert plan.index("zz_body") < plan.index("Generate explode") < plan.index("zz_wanted")


def test_texts_that_hold_no_record_are_rejected_unparsed(spark):
    """records within JSON strings still count, whatever space stands before them."""
    texts = [' \\n{\\"k\\": 1}', '\\t{\\"k\\": 2}', "x", "", "7", "null"]
    body = "[" + ", ".join(f'"{x}"' for x in texts) + ', {"k": 3}, 8, null]'
    df = spark.createDataFrame([(body,)], "payload string")
    good, bad = good_and_rejected(df, (), "k int")
    assert sorted(r.record.k for r in good.collect()) == [1, 2, 3]
    assert sorted(r.record_text or "" for r in bad.collect()) == ["", "", "7", "8", "null", "x"]
    # The test stands before the parser.
    assert "RLIKE" in good._jdf.queryExecution().optimizedPlan().toString()
