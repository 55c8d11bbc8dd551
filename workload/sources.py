"""Landed payloads.  They are written out of the tables in the shape of each
source and read back; the checks state the expected listings from the columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.operators.boards import (
    expand_slugs, extract_slugs, merge_slug_lists, merge_slug_sources, resolve_slugs, slug_candidates,
    validate_slugs, validation_totals,
)
from hirelake.operators.digest import source_counts
from hirelake.plans.intake import intake
from hirelake.sources import (
    jsonld_postings, normalize_amazon, normalize_ashby, normalize_greenhouse, normalize_lever,
    normalize_microsoft, normalize_structured, page_cutoff, sitemap_entries, union_sources,
)
from hirelake.sources.microsoft import enrich_with_details
from hirelake.sources.payloads import good_and_rejected
from workload.core import LINE, Tables, query, stamp, stamp_sql


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


def _wrapped(record: Column, head: str, tail: str) -> Column:
    """A payload with one record, followed by one that is not an object."""
    return F.concat(F.lit(head), record, F.lit(', "not a record"'), F.lit(tail))


def _listing(df: DataFrame, *metadata: str) -> DataFrame:
    shown = [F.col("metadata")[m].alias(m) for m in metadata]
    return df.select(
        "title", "company", "location", "url", "description", "source",
        stamp("posted_date").alias("posted"), "job_id", "team", *shown,
    )


def _line(t: Tables) -> DataFrame:
    return t.line.withColumn("even", F.col("l_partkey") % 2 == 0)


_ESCAPED = "&lt;p&gt;" "{0}" "&lt;/p&gt;&lt;br/&gt; R&amp;amp;D &amp;amp;lt;"


def _markup(text: Column) -> Column:
    """Escaped HTML around a text; entities are read once, so some stay."""
    head, tail = _ESCAPED.split("{0}")
    return F.concat(F.lit(head), text, F.lit(tail))


@query("norm_lever", f"""WITH {LINE} SELECT title, company,
  CASE WHEN l_partkey % 2 = 0 THEN location ELSE 'on-site' END AS location,
  CASE WHEN l_partkey % 2 = 0 THEN url ELSE url || '/apply' END AS url,
  CASE WHEN l_partkey % 2 = 0 THEN description ELSE 'Needs ' || description || ' Other ' END AS description,
  'lever' AS source, {stamp_sql('posted_date')} AS posted, job_id, source AS team, l_linestatus AS commitment FROM line""")
def _(t):
    even = F.col("even")
    blocks = F.array(
        F.struct(F.lit("Needs").alias("text"), F.col("description").alias("content")),
        F.struct(F.lit("Other").alias("text"), F.lit(None).cast("string").alias("content")),
    )
    record = _json(
        id=F.col("job_id"), text=F.col("title"), createdAt=F.unix_millis("posted_date"),
        hostedUrl=F.when(even, F.col("url")), applyUrl=F.concat("url", F.lit("/apply")),
        workplaceType=F.lit("on-site"),
        descriptionPlain=F.when(even, F.col("description")).otherwise(""), lists=blocks,
        categories=F.struct(
            F.when(even, F.col("location")).alias("location"), F.col("source").alias("team"),
            F.col("l_linestatus").alias("commitment"),
        ),
    )
    raw = _line(t).select("company", _wrapped(record, "[", "]").alias("payload"))
    return _listing(normalize_lever(raw), "commitment")


@query("norm_greenhouse", f"""WITH {LINE} SELECT title, company,
  CASE WHEN l_partkey % 2 = 0 THEN location ELSE '' END AS location, url,
  description || ' R&amp;D &amp;lt;' AS description, 'greenhouse' AS source,
  {stamp_sql('posted_date')} AS posted, CAST(l_orderkey AS VARCHAR) AS job_id,
  CASE WHEN l_partkey % 2 = 0 THEN source ELSE '' END AS team FROM line""")
def _(t):
    even = F.col("even")
    departments = F.when(even, F.array(F.struct(F.col("source").alias("name"))))
    record = _json(
        id=F.col("l_orderkey"), title=F.col("title"), absolute_url=F.col("url"),
        updated_at=F.date_format("posted_date", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        content=_markup(F.col("description")),
        location=F.when(even, F.struct(F.col("location").alias("name"))),
        departments=departments.otherwise(F.array().cast("array<struct<name:string>>")),
    )
    raw = _line(t).select("company", _wrapped(record, '{"jobs": [', "]}").alias("payload"))
    return _listing(normalize_greenhouse(raw))


@query("norm_ashby", f"""WITH {LINE} SELECT title, company, location,
  'https://jobs.ashbyhq.com/' || lower(replace(company, '#', '-')) || '/' || job_id AS url,
  description || CASE WHEN l_partkey % 2 = 0 THEN '' ELSE ' R&amp;D &amp;lt;' END AS description, 'ashby' AS source,
  {stamp_sql('posted_date')} AS posted, job_id,
  CASE WHEN l_partkey % 2 = 0 THEN source ELSE l_linestatus END AS team FROM line""")
def _(t):
    even = F.col("even")
    fields = dict(
        id=F.col("job_id"), title=F.col("title"),
        publishedAt=F.date_format("posted_date", "yyyy-MM-dd'T'HH:mm:ss'+00:00'"),
        descriptionPlain=F.when(even, F.col("description")),
        description=_markup(F.col("description")),
        departmentName=F.when(even, F.col("source")).otherwise(""), team=F.col("l_linestatus"),
    )
    named = _json(**fields, location=F.struct(F.col("location").alias("name")))
    record = F.when(even, named).otherwise(_json(**fields, location=F.col("location")))
    raw = _line(t).select(
        "company", F.lower(F.replace("company", F.lit("#"), F.lit("-"))).alias("slug"),
        _wrapped(record, '{"jobs": [', "]}").alias("payload"),
    )
    return _listing(normalize_ashby(raw))


@query("norm_amazon", f"""WITH {LINE} SELECT title,
  CASE WHEN l_partkey % 2 = 0 THEN company ELSE 'Amazon' END AS company,
  CASE WHEN l_partkey % 2 = 0 THEN location ELSE company || ', ' || source END AS location,
  CASE l_partkey % 4 WHEN 0 THEN url WHEN 1 THEN 'https://www.amazon.jobs/en/' || job_id
    WHEN 2 THEN 'https://www.amazon.jobs/x/' || job_id ELSE url || '/next' END AS url,
  description || ' R&amp;D &amp;lt;' AS description, 'amazon' AS source,
  {stamp_sql('posted_date')} AS posted, job_id,
  CASE WHEN l_partkey % 2 = 0 THEN l_linestatus ELSE source END AS team,
  company AS city, CAST(NULL AS VARCHAR) AS job_family, url || '/next' AS url_next_step FROM line""")
def _(t):
    even, n = F.col("even"), F.col("l_partkey") % 4
    record = _json(
        id_icims=F.when(even, F.col("job_id")).otherwise(""), id=F.col("job_id"), title=F.col("title"),
        company_name=F.when(even, F.col("company")), location=F.when(even, F.col("location")),
        city=F.col("company"), state=F.lit(""), country_code=F.col("source"),
        description=_markup(F.col("description")),
        posted_date=F.when(even, F.date_format("posted_date", "MMMM d, yyyy")).otherwise(
            F.date_format("posted_date", "MMM d, yyyy")
        ),
        public_url=F.when(n == 0, F.col("url")),
        job_path=F.when(n == 1, F.concat(F.lit("/en/"), "job_id")).when(n == 2, F.concat(F.lit("x/"), "job_id")),
        url_next_step=F.concat("url", F.lit("/next")),
        team=F.when(even, F.col("l_linestatus")), job_category=F.col("source"),
    )
    raw = _line(t).select(_wrapped(record, '{"jobs": [', "]}").alias("payload"))
    return _listing(normalize_amazon(raw), "city", "job_family", "url_next_step")


def _positions(t: Tables) -> DataFrame:
    return normalize_microsoft(_raw_positions(t))


def _raw_positions(t: Tables) -> DataFrame:
    even, n = F.col("even"), F.col("l_partkey") % 3
    record = _json(
        id=F.when(even, F.col("job_id")), atsJobId=F.concat(F.lit("ats-"), "job_id"), name=F.col("title"),
        location=F.when(even, F.col("location")).otherwise(" "),
        locations=F.array(F.col("company"), F.lit(" "), F.col("location")),
        postedTs=F.unix_seconds("posted_date"), department=F.col("source"),
        workLocationOption=F.when(even, F.lit("onsite")), locationFlexibility=F.lit("none"),
        publicUrl=F.when(n == 0, F.col("url")),
        positionUrl=F.when(n == 1, F.concat("url", F.lit("/p"))).otherwise(F.concat(F.lit("/p/"), "job_id")),
        displayJobId=F.col("l_orderkey"), isHot=F.lit(True),
        standardizedLocations=F.array(F.col("location")),
    )
    return _line(t).select(_wrapped(record, '{"data": {"positions": [', "]}}").alias("payload"))


_POSITION_SQL = """SELECT *, CASE WHEN l_partkey % 2 = 0 THEN location ELSE company || ', ' || location END AS p_location,
  CASE l_partkey % 3 WHEN 0 THEN url WHEN 1 THEN url || '/p'
    ELSE 'https://apply.careers.microsoft.com/p/' || job_id END AS p_url,
  source || CASE WHEN l_partkey % 2 = 0 THEN ' onsite' ELSE '' END || ' none' AS p_description,
  CASE WHEN l_partkey % 2 = 0 THEN job_id ELSE 'ats-' || job_id END AS p_id FROM line"""


@query("norm_microsoft", f"""WITH {LINE}, p AS ({_POSITION_SQL})
SELECT title, 'Microsoft' AS company, p_location AS location, p_url AS url, p_description AS description,
  'microsoft' AS source, {stamp_sql('posted_date')} AS posted, p_id AS job_id, source AS team,
  'microsoft.com' AS domain, CAST(l_orderkey AS VARCHAR) AS display_job_id, 'true' AS is_hot,
  CASE WHEN l_partkey % 2 = 0 THEN 'onsite' END AS work_location_option FROM p""")
def _(t):
    return _listing(_positions(t), "domain", "display_job_id", "is_hot", "work_location_option")


@query("enrich_details", f"""WITH {LINE}, p AS ({_POSITION_SQL}),
d AS (SELECT DISTINCT o_orderkey || '-' || n AS id, o_orderkey, o_orderstatus, o_orderpriority, o_orderdate
  FROM orders, range(1, 4) r(n))
SELECT CASE WHEN id IS NULL OR o_orderstatus = 'P' THEN title ELSE 'Order ' || o_orderkey END AS title, 'Microsoft' AS company,
  CASE WHEN id IS NULL THEN p_location ELSE o_orderpriority END AS location, p_url AS url,
  CASE WHEN id IS NULL OR o_orderstatus = 'P' THEN p_description ELSE o_orderpriority || ' R&D' END AS description,
  'microsoft' AS source, {stamp_sql("CASE WHEN id IS NULL THEN posted_date ELSE o_orderdate END")} AS posted, p_id AS job_id,
  CASE WHEN id IS NULL THEN source ELSE o_orderstatus END AS team, 'microsoft.com' AS domain,
  CASE WHEN id IS NULL OR o_orderstatus <> 'F' THEN CAST(l_orderkey AS VARCHAR) END AS display_job_id,
  CASE WHEN l_partkey % 2 = 0 THEN 'onsite' END AS work_location_option,
  CASE WHEN id IS NOT NULL THEN o_orderstatus END AS efcustom_text_roletype
FROM p LEFT JOIN d ON id = job_id AND l_partkey % 2 = 0""")
def _(t):
    status = F.col("o_orderstatus")
    shared = dict(
        jobDescription=F.when(status != "P", F.concat(F.lit("<p>"), "o_orderpriority", F.lit("</p> R&amp;D"))),
        name=F.when(status != "P", F.concat(F.lit("Order "), "o_orderkey")),
        location=F.col("o_orderpriority"), department=status,
        postedTs=F.unix_seconds(F.col("o_orderdate").cast("timestamp")), efcustomTextRoletype=status,
    )
    plain = _json(**shared)
    # Present as null in the details, so it replaces the summary's value.
    emptied = F.concat(F.lit('{"displayJobId": null, '), F.substr(plain, F.lit(2)))
    data = F.when(status == "F", emptied).otherwise(plain)
    details = t.orders.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).select(
        F.concat("o_orderkey", F.lit("-"), "n").alias("position_id"),
        F.concat(F.lit('{"data": '), data, F.lit("}")).alias("payload"),
    )
    # Half of the positions have an older answer too, which doesn't count.
    stale = details.where(F.length("position_id") % 2 == 0).withColumn(
        "payload", F.lit('{"data": {"name": "A stale name", "department": "none"}}')
    )
    landed = details.withColumn("landed", F.lit(2)).unionByName(stale.withColumn("landed", F.lit(1)))
    merged = enrich_with_details(_positions(t), landed, [F.col("landed").desc(), "payload"])
    return _listing(merged, "domain", "display_job_id", "work_location_option", "efcustom_text_roletype")


def _job_pages(t: Tables) -> DataFrame:
    """Pages with a posting put into their head: alone, in a graph, in a graph
    within a list, nested too deep for the usual walk, or none at all."""
    n = F.col("page_id") % 6
    posting = _json(**{
        "@type": F.lit("JobPosting"), "title": F.when(n != 1, F.concat(F.lit("Job &amp; "), F.col("page_id"))),
        "description": F.lit("<b>Do</b> things"),
        "responsibilities": F.when(n == 2, F.lit("own it")),
        "qualifications": F.when(n >= 2, F.array(F.lit("a"), F.lit("b &lt;i&gt;c"))),
        "datePosted": F.when(n != 3, F.lit("2024-02-03")),
        "validThrough": F.lit("2024-12-31"), "directApply": F.lit(True),
        "employmentType": F.array(F.lit("FULL_TIME"), F.lit("INTERN")),
        "hiringOrganization": F.struct(F.lit("Org").alias("name")),
        "jobLocation": F.array(
            F.struct(F.lit("Main &amp; 1st").alias("name"), F.lit(None).alias("address")),
            F.struct(F.lit(None).alias("name"), F.struct(
                F.lit("Paris").alias("addressLocality"), F.lit("").alias("addressRegion"),
                F.struct(F.lit("FR").alias("name")).alias("addressCountry")).alias("address")),
            F.struct(F.lit("Main &amp; 1st").alias("name"), F.lit(None).alias("address")),
        ),
    })
    org = F.lit('{"@type": "Organization"}')
    graph = F.concat(F.lit('{"@graph": ['), org, F.lit(", "), posting, F.lit("]}"))
    body = (
        F.when(n == 1, graph).when(n == 2, F.concat(F.lit("[1, "), graph, F.lit("]")))
        .when(n == 3, F.concat(F.lit("[[[["), graph, F.lit("]]]]"))).when(n == 4, org).otherwise(posting)
    )
    tag = '<script type="application/ld+json">'
    head = F.concat(
        F.lit(f"<!-- {tag}{{}}</script> -->{tag} </script>{tag}{{bad</script>{tag}"), body, F.lit("</script>")
    )
    injected = F.when(n == 5, F.col("html")).otherwise(F.concat(head, "html"))
    return t.pages.select("page_id", "url", injected.alias("html"))


@query("jsonld_postings", """SELECT page_id, CASE WHEN page_id % 6 <> 1 THEN 'Job &amp; ' || page_id END AS title,
  'JobPosting' AS kind FROM pages WHERE page_id % 6 NOT IN (4, 5)""")
def _(t):
    posting = F.col("posting")
    return jsonld_postings(_job_pages(t)).select(
        "page_id", F.try_variant_get(posting, "$.title", "string").alias("title"),
        F.try_variant_get(posting, '$["@type"]', "string").alias("kind"),
    )


@query("norm_structured", r"""WITH p AS (SELECT *, page_id % 6 AS n,
    trim(regexp_replace(regexp_replace(regexp_extract(html, '<title>(.*?)</title>', 1), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS page_title
  FROM pages WHERE page_id % 6 NOT IN (4, 5))
SELECT CASE WHEN n <> 1 THEN 'Job & ' || page_id ELSE page_title END AS title, 'Meta' AS company,
  'Main & 1st, Paris, FR' AS location, url,
  'Do things' || CASE WHEN n = 2 THEN ' Responsibilities: own it' ELSE '' END
    || CASE WHEN n >= 2 THEN ' Qualifications: a b c' ELSE '' END AS description, 'meta' AS source,
  CASE WHEN n <> 3 THEN '2024-02-03 00:00:00' ELSE '2024-01-01 10:00:00' END AS posted,
  regexp_extract(url, '/[a-z]+/(\d+)', 1) AS job_id, 'Org' AS team, '2024-12-31' AS valid_through,
  'FULL_TIME, INTERN' AS employment_type, 'true' AS direct_apply, 'Org' AS hiring_organization FROM p
WHERE CASE WHEN n <> 1 THEN TRUE ELSE page_title <> '' END""")
def _(t):
    dates = t.pages.select("url", F.lit("2024-01-01 10:00:00").cast("timestamp").alias("lastmod"))
    jobs = normalize_structured(_job_pages(t), dates, id_pattern=r"/[a-z]+/(\d+)")
    return _listing(jobs, "valid_through", "employment_type", "direct_apply", "hiring_organization")


@query("sitemap_entries", """WITH e AS (
  SELECT page_id AS sitemap_id, 0 AS position, url, strftime(TIMESTAMP '2024-01-01' + to_days(CAST(page_id % 300 AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS lastmod FROM pages
  UNION ALL SELECT page_id, 2, 'https://example.org/a/en/' || page_id, NULL FROM pages)
SELECT * FROM e WHERE contains(url, '/en/') AND sitemap_id % 10 <> 9""")
def _(t):
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 300).cast("int")), "yyyy-MM-dd")
    loc = F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("'"), F.lit("&apos;"))
    xml = F.concat(
        F.lit('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> '),
        loc, F.lit(" </loc><lastmod>"), day, F.lit("</lastmod></url><url><loc>"), loc,
        F.lit("</loc></url><url><loc>https://example.org/a/en/"), "page_id", F.lit("</loc></url></urlset>"),
    )
    broken = F.when(F.col("page_id") % 10 == 9, F.substring(xml, 1, 90)).otherwise(xml)
    maps = t.pages.select(F.col("page_id").alias("sitemap_id"), broken.alias("xml"))
    entries = sitemap_entries(maps, marker="/en/")
    return entries.select("sitemap_id", "position", "url", stamp("lastmod").alias("lastmod"))


_PAGE_SIZE = 3


_CRAWLED = f"""WITH pages_raw AS (
  SELECT o_custkey AS query, o_orderkey AS page, coalesce(list(id ORDER BY id) FILTER (id IS NOT NULL), []) AS ids FROM (
    SELECT DISTINCT o_custkey, o_orderkey, CAST(l_linenumber AS VARCHAR) AS id FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey)
  GROUP BY ALL),
flagged AS (SELECT *, len(ids) AS size, row_number() OVER (PARTITION BY query, ids[1:3] ORDER BY page) > 1 AS again FROM pages_raw),
stops AS (SELECT query, min(CASE WHEN size = 0 OR again THEN page END) AS before,
  min(CASE WHEN size BETWEEN 1 AND {_PAGE_SIZE - 1} THEN page END) AS after FROM flagged GROUP BY query),
crawled AS (SELECT query, page, ids FROM flagged JOIN stops USING (query)
WHERE (before IS NULL OR page < before) AND (after IS NULL OR page <= after))"""


def _landed_pages(t: Tables) -> DataFrame:
    # An order is a landed page of its customer's query; at most seven distinct
    # line numbers make up its ids.
    ids = F.array_sort(F.collect_set(F.col("l_linenumber").cast("string")))
    return (
        t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"), "left")
        .groupBy(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("page"))
        .agg(ids.alias("ids"))
    )


@query("page_cutoff", _CRAWLED + " SELECT query, page, array_to_string(ids, ',') AS ids FROM crawled")
def _(t):
    return page_cutoff(_landed_pages(t), _PAGE_SIZE).select("query", "page", F.array_join("ids", ",").alias("ids"))


@query("intake_crawl", _CRAWLED + " SELECT 'amazon' AS source, 'Order ' || page AS title, unnest(ids) AS job_id FROM crawled")
def _(t):
    # The id is found in either field; an empty page is a payload without records.
    n = F.col("page") % 2
    record = F.transform("ids", lambda i: F.struct(
        F.when(n == 0, i).otherwise("").alias("id_icims"), i.alias("id"), F.concat(F.lit("Order "), "page").alias("title")
    ))
    payload = F.when(F.size("ids") == 0, '{"hits": 0}').otherwise(F.to_json(F.struct(record.alias("jobs"))))
    landed = _landed_pages(t).select("query", "page", payload.alias("payload"))
    return intake({"amazon": landed}, ["order"], page_sizes={"amazon": _PAGE_SIZE}).select("source", "title", "job_id")


@query("source_counts", f"""WITH {LINE} SELECT source, count(*) AS listings FROM (
  SELECT source FROM line UNION ALL SELECT source FROM documents) GROUP BY source""")
def _(t):
    return source_counts(union_sources(t.line.select("title", "source"), t.documents.select("source", "lang")))


@query("intake", f"""WITH {LINE}, p AS ({_POSITION_SQL})
SELECT source, count(*) AS listings, count(DISTINCT title) AS titles FROM (
  SELECT 'lever' AS source, title FROM line WHERE contains(lower(title || ' ' || description), 'cold gear') OR (contains(lower(title), 'cold') AND contains(lower(title), 'gear'))
  UNION ALL SELECT 'microsoft', title FROM p WHERE contains(lower(title || ' ' || p_description), 'cold gear')) GROUP BY source""")
def _(t):
    record = _json(id=F.col("job_id"), text=F.col("title"), descriptionPlain=F.col("description"))
    lever = _line(t).select("company", _wrapped(record, "[", "]").alias("payload"))
    both = intake({"lever": lever, "microsoft": _raw_positions(t)}, ["cold gear"])
    return both.groupBy("source").agg(
        F.count(F.lit(1)).alias("listings"), F.count_distinct("title").alias("titles")
    )


_HOSTS = [r"https?://(?:[a-z]+\.)?([a-z0-9-]+)\.example\.(?:com|net)", r'href="/([A-Za-z0-9_-]+)"']


@query("extract_slugs", f"""WITH s AS (
  SELECT unnest(regexp_extract_all(url || ' ' || html, '{_HOSTS[0]}', 1) || regexp_extract_all(url || ' ' || html, '{_HOSTS[1]}', 1)) AS slug FROM pages)
SELECT DISTINCT lower(slug) AS slug FROM s WHERE lower(slug) NOT IN ('', 'the', 'and', 'to')""")
def _(t):
    text = F.concat("url", F.lit(" "), "html")
    return extract_slugs(t.pages, text, _HOSTS, ["the", "and", "to"])


@query("expand_slugs", """WITH jobs AS (SELECT l_suppkey AS k, lower(l_returnflag) AS flag, count(*) AS n FROM lineitem GROUP BY ALL),
found AS (SELECT 'greenhouse' AS ats, replace(lower(s_name), '#', '-') AS slug FROM supplier JOIN jobs ON k = s_suppkey AND flag = 'a' WHERE n >= 200
  UNION SELECT 'ashby', 'board_' || s_suppkey FROM supplier JOIN jobs ON k = s_suppkey AND flag = 'r' WHERE n >= 200),
existing AS (SELECT 'ashby' AS ats, 'board_' || s_suppkey AS slug FROM supplier WHERE s_suppkey % 3 = 0)
SELECT ats, slug, NOT bool_or(known) AS added FROM (SELECT *, FALSE AS known FROM found UNION ALL SELECT *, TRUE FROM existing) GROUP BY ats, slug""")
def _(t):
    board = F.replace("s_name", F.lit("#"), F.lit("-"))
    text = F.concat(
        F.lit("Apply: https://boards.greenhouse.io/"), board, F.lit("?gh_src=x, https://boards.greenhouse.io/embed or "),
        F.lit("jobs.ashbyhq.com/Board_"), "s_suppkey", F.lit(" (api.ashbyhq.com/posting-api/job-board/jobs)."),
    )
    jobs = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    green = F.col("l_returnflag") == "A"
    open_jobs = jobs.where("l_returnflag IN ('A', 'R')").select(
        F.when(green, "greenhouse").otherwise("ashby").alias("ats"),
        F.when(green, F.lower(board)).otherwise(F.concat(F.lit("board_"), "s_suppkey")).alias("slug"),
        F.concat("l_orderkey", F.lit("-"), "l_linenumber").alias("job_id"),
    )
    known = t.supplier.where("s_suppkey % 3 = 0").select(F.lit("ashby").alias("ats"), F.concat(F.lit("board_"), "s_suppkey").alias("slug"))
    return expand_slugs(t.supplier, text, open_jobs, known, min_open_jobs=200)


def _names_sql(table: str, column: str) -> str:
    """Spellings of names of letters, one '#' and digits."""
    clean = f"replace(lower({column}), '#', '')"
    hyphen = f"replace(lower({column}), '#', '-')"
    spellings = ", ".join(
        [clean, hyphen]
        + [f"{clean} || '{e}'" for e in ("careers", "-careers", "jobs", "-jobs")]
        + [f"{hyphen} || '{e}'" for e in ("-careers", "-jobs")]
    )
    return f"""SELECT company, CAST(ord - 1 AS INTEGER) AS ord, slug FROM (SELECT {column} AS company,
      unnest([{spellings}]) AS slug, generate_subscripts([{spellings}], 1) AS ord FROM {table})"""


@query("slug_candidates", f"{_names_sql('customer', 'c_name')} UNION ALL {_names_sql('supplier', 's_name')}")
def _(t):
    names = t.customer.select(F.col("c_name").alias("company")).unionByName(
        t.supplier.select(F.col("s_name").alias("company"))
    )
    return slug_candidates(names)


# A supplier's lines are the open jobs of one board per return flag; the
# spelling of its slug depends on the key, and some have no board.
_BOARDS = """boards AS (SELECT lower(l_returnflag) AS ats, CASE l_suppkey % 4 WHEN 0 THEN replace(lower(s_name), '#', '')
    WHEN 1 THEN replace(lower(s_name), '#', '-') || '-jobs' WHEN 2 THEN replace(lower(s_name), '#', '') || 'careers'
    ELSE 'other-' || s_suppkey END AS slug, l_orderkey || '-' || l_linenumber AS job_id
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""


def _boards(t: Tables) -> DataFrame:
    n = F.col("l_suppkey") % 4
    flat = F.replace(F.lower("s_name"), F.lit("#"), F.lit(""))
    hyphen = F.replace(F.lower("s_name"), F.lit("#"), F.lit("-"))
    slug = (
        F.when(n == 0, flat).when(n == 1, F.concat(hyphen, F.lit("-jobs")))
        .when(n == 2, F.concat(flat, F.lit("careers"))).otherwise(F.concat(F.lit("other-"), "s_suppkey"))
    )
    return t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.lower("l_returnflag").alias("ats"), slug.alias("slug"),
        F.concat("l_orderkey", F.lit("-"), "l_linenumber").alias("job_id"),
    )


@query("resolve_slugs", f"""WITH {_BOARDS}, candidates AS ({_names_sql('supplier', 's_name')})
SELECT company, ats, arg_min(slug, ord) AS slug FROM candidates JOIN (SELECT DISTINCT ats, slug FROM boards) USING (slug)
GROUP BY company, ats""")
def _(t):
    names = t.supplier.select(F.col("s_name").alias("company"))
    return resolve_slugs(slug_candidates(names), _boards(t))


_LISTED = """slugs AS (SELECT a.ats, s_name AS company, replace(lower(s_name), '#', '') AS slug, s_suppkey % 2 = 1 AS is_extra
  FROM supplier CROSS JOIN (VALUES ('a'), ('n'), ('r')) a(ats))"""


def _validated(t: Tables) -> DataFrame:
    slugs = t.supplier.select(
        F.explode(F.array(F.lit("a"), F.lit("n"), F.lit("r"))).alias("ats"),
        F.col("s_name").alias("company"),
        F.replace(F.lower("s_name"), F.lit("#"), F.lit("")).alias("slug"),
        (F.col("s_suppkey") % 2 == 1).alias("is_extra"),
    )
    return validate_slugs(slugs, _boards(t), min_open_jobs=195)


_VALIDATED = f"""{_BOARDS}, {_LISTED}, sized AS (SELECT ats, slug, count(*) AS open_jobs FROM boards GROUP BY ats, slug),
validated AS (SELECT slugs.*, coalesce(open_jobs, 0) AS open_jobs, coalesce(open_jobs, 0) >= 195 AS is_valid
  FROM slugs LEFT JOIN sized USING (ats, slug))"""


@query("validate_slugs", f"""WITH {_VALIDATED} SELECT *,
  CASE WHEN is_valid THEN 'valid (' ELSE 'INVALID (' END || slug || ')' AS status FROM validated""")
def _(t):
    return _validated(t)


@query("validate_totals", f"""WITH {_VALIDATED}
SELECT count(*) FILTER (is_valid) AS valid, count(*) FILTER (NOT is_valid) AS invalid FROM validated""")
def _(t):
    return validation_totals(_validated(t))


@query("merge_slugs", """WITH named AS (SELECT c_name AS company, trim(lower('s' || (c_custkey // 2))) AS slug, 0 AS tier, c_custkey AS ord FROM customer),
bare AS (SELECT lower(x) AS company, lower(x) AS slug, 1 AS tier, ord FROM (
  SELECT ' S' || (s_suppkey * 20) || ' ' AS x, s_suppkey AS ord FROM supplier UNION ALL SELECT s_name, 1000000000000 + s_suppkey FROM supplier
  UNION ALL SELECT '', -1) y(x, ord)),
kept AS (SELECT * FROM (SELECT trim(company) AS company, trim(slug) AS slug, tier, ord FROM (SELECT * FROM named UNION ALL SELECT * FROM bare))
  WHERE slug <> '' QUALIFY row_number() OVER (PARTITION BY slug ORDER BY tier, ord) = 1)
SELECT company, slug FROM kept QUALIFY row_number() OVER (PARTITION BY company ORDER BY tier DESC, ord DESC) = 1""")
def _(t):
    primary = t.customer.select(
        F.col("c_name").alias("company"),
        F.concat(F.lit(" S"), F.floor(F.col("c_custkey") / 2)).alias("slug"), F.col("c_custkey").alias("ord"),
    )
    extras = t.supplier.select(
        F.concat(F.lit(" S"), F.col("s_suppkey") * 20, F.lit(" ")).alias("slug"), F.col("s_suppkey").alias("ord")
    ).unionByName(
        t.supplier.select(F.col("s_name").alias("slug"), (F.lit(1_000_000_000_000) + F.col("s_suppkey")).alias("ord"))
    )
    return merge_slug_sources(primary, extras)


@query("merge_slug_lists", """WITH e AS (SELECT DISTINCT lower(c_mktsegment) || '-' || (c_custkey // 3) AS slug FROM customer WHERE c_acctbal > 5000),
v AS (SELECT DISTINCT lower(c_mktsegment) || '-' || (c_custkey // 3) AS slug FROM customer WHERE c_acctbal <= 6000)
SELECT slug, slug NOT IN (SELECT slug FROM e) AS added FROM (SELECT slug FROM e UNION SELECT slug FROM v)""")
def _(t):
    slug = F.concat(F.lower("c_mktsegment"), F.lit("-"), F.floor(F.col("c_custkey") / 3)).alias("slug")
    existing = t.customer.where("c_acctbal > 5000").select(slug)
    return merge_slug_lists(existing, t.customer.where("c_acctbal <= 6000").select(slug))


@query("reject_bad_payloads", """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) END AS k,
  CASE WHEN event_id % 7 = 0 THEN 'x' || props END AS rejected FROM events WHERE event_id % 11 <> 0
UNION ALL SELECT event_id, 0 - CAST(event_id AS INTEGER), NULL FROM events WHERE event_id % 11 <> 0""")
def _(t):
    # Two records each: one of them broken in some payloads, and in others
    # the payload as a whole.
    n = F.col("event_id")
    first = F.when(n % 7 == 0, F.to_json(F.array(F.concat(F.lit("x"), "props"))))
    first = first.otherwise(F.concat(F.lit("["), "props", F.lit("]")))
    payload = F.concat(F.rtrim(first, F.lit("]")), F.lit(', {"k": '), -n, F.lit("}]"))
    broken = F.when(n % 11 == 0, F.rtrim(payload, F.lit("]"))).otherwise(payload)
    raw = t.events.select("event_id", broken.alias("payload"))
    good, rejected = good_and_rejected(raw, (), "k int")
    return good.select("event_id", "record.k", F.lit(None).cast("string").alias("rejected")).unionByName(
        rejected.select("event_id", F.lit(None).cast("int").alias("k"), F.col("record_text").alias("rejected"))
    )
