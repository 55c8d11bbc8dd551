"""Browsing the seen table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake import fixed
from hirelake.operators import browse as b
from hirelake.operators.order import with_position
from hirelake.session import materialize
from workload.core import SEEN, query, round1_sql, stamp, stamp_sql
from workload.runs import REWRITTEN, rewritten_table

_TEXTS = ("unique_key", "title", "company", "location", "url", "source")
_SHOWN_SQL = f"""{', '.join(_TEXTS)}, {stamp_sql('posted_date')} AS posted, {stamp_sql('first_seen')} AS first_seen_at, score"""


def _shown(df: DataFrame, *extra: str) -> DataFrame:
    return df.select(
        *extra, *_TEXTS, stamp("posted_date").alias("posted"), stamp("first_seen").alias("first_seen_at"), "score"
    )


def _like(column: str, text: str) -> str:
    return f"{column} ILIKE '%{text}%'"


def _search(text: str) -> str:
    return "(" + " OR ".join(_like(c, text) for c in b.SEARCHED) + ")"


def _days(column: str, start: str, end: str) -> str:
    return f"CAST({column} AS DATE) BETWEEN DATE '{start}' AND DATE '{end}'"


def order_sql(sort: str, direction: str) -> str:
    recent = "posted_date IS NULL, posted_date DESC NULLS LAST, first_seen DESC, lower(coalesce(company, ''))"
    if sort == "posted_date":
        keys = f"posted_date IS NULL, posted_date {direction} NULLS LAST, first_seen {direction}, lower(coalesce(company, ''))"
    elif sort == "first_seen":
        keys = f"first_seen {direction}, {recent}"
    elif sort == "score":
        keys = f"score IS NULL, score {direction} NULLS LAST, {recent}"
    else:
        keys = f"lower(coalesce({sort}, '')) {direction}, {recent}"
    return keys + ", unique_key"


@query("all_listings", f"WITH {SEEN} SELECT {_SHOWN_SQL} FROM seen")
def _(t):
    return _shown(b.all_listings(t.seen))


@query("recent_jobs", f"WITH {SEEN} SELECT {_SHOWN_SQL} FROM seen ORDER BY coalesce(posted_date, first_seen) DESC, unique_key LIMIT 120")
def _(t):
    return _shown(b.recent_jobs(t.seen, 120))


@query("text_search", f"WITH {SEEN} SELECT {_SHOWN_SQL} FROM seen WHERE {_search('Cold%Rod needs _0+')}")
def _(t):
    return _shown(t.seen.where(b.text_search("Cold%Rod needs _0+")))


@query("column_filters", f"""WITH {SEEN} SELECT {_SHOWN_SQL} FROM seen
WHERE {_like('company', '#0000000_1')} AND {_like('location', 'a')} AND source = 'n'""")
def _(t):
    query_ = b.BrowseQuery.from_params({"company": " #0000000_1", "location": "a", "source": "n"})
    return _shown(t.seen.where(b.condition(query_)))


@query("date_range_filter", f"""WITH {SEEN} SELECT {_SHOWN_SQL} FROM seen
WHERE {_days('posted_date', '1998-03-05', '1998-06-10')} AND {_days('first_seen', '1998-03-10', '1998-06-01')}""")
def _(t):
    query_ = b.BrowseQuery.from_params({
        "posted_from": "1998-03-05", "posted_to": "1998-06-10",
        "first_seen_from": "1998-03-10", "first_seen_to": "1998-06-01", "min_score": "many",
    })
    return _shown(t.seen.where(b.condition(query_)))


@query("score_range_filter", f"WITH {SEEN} SELECT {_SHOWN_SQL} FROM seen WHERE score >= 85.5 AND score <= 95")
def _(t):
    return _shown(t.seen.where(b.within_scores(85.5, 95)))


_SORTS = [(sort, direction) for sort in fixed.SORT_FIELDS for direction in ("asc", "desc")]


@query("sort_jobs", f"WITH {SEEN} " + " UNION ALL ".join(
    f"""(SELECT '{s}' AS sort, '{d}' AS direction, row_number() OVER (ORDER BY {order_sql(s, d)}) AS position, unique_key
    FROM seen)""" for s, d in _SORTS))
def _(t):
    ranked = b.ranked(t.seen)

    def placed(sort, direction):
        # A sort moves the columns it looks at, and of those only the key is kept.
        rows, order = ranked.keyed(sort, direction)
        return with_position(b.sort_jobs(rows, sort, direction, order), order, keep=["unique_key"])

    pages = [
        placed(s, d).select(F.lit(s).alias("sort"), F.lit(d).alias("direction"), "position", "unique_key") for s, d in _SORTS
    ]
    return reduce(DataFrame.unionByName, pages)


# A middle page, a page behind the last one, a deep page and an empty result.
_REQUESTS = {
    "middle": {"search": "widget", "company": "0000000", "min_score": "10", "sort": "score",
               "direction": "ASC", "page": "3", "page_size": "25"},
    "behind": {"q": "gear", "source": "n", "posted_from": "1999-01-01", "sort": "company",
               "page": 100_000, "page_size": 40},
    "deep": {"sort": "title", "direction": "asc", "page": 60, "page_size": 5000},
    "nothing": {"location": "atlantis", "page": 7, "page_size": "x"},
}
_WHERE = {
    "middle": f"{_search('widget')} AND {_like('company', '0000000')} AND score >= 10",
    "behind": f"{_search('gear')} AND source = 'n' AND posted_date >= TIMESTAMP '1999-01-01'",
    "deep": "TRUE",
    "nothing": _like("location", "atlantis"),
}
_PAGES = {"middle": (3, 25, "score", "asc"), "behind": (100_000, 40, "company", "desc"),
          "deep": (60, 200, "title", "asc"), "nothing": (7, 50, "posted_date", "desc")}


def _summary_sql(name: str) -> str:
    page, size, _, _ = _PAGES[name]
    return f"""SELECT '{name}' AS request, total_count, filtered_count, page_count, least({page}, page_count) AS page,
      CAST({size} AS BIGINT) AS page_size, least({page}, page_count) > 1 AS has_previous, least({page}, page_count) < page_count AS has_next
    FROM (SELECT count(*) AS total_count, count(*) FILTER ({_WHERE[name]}) AS filtered_count,
      greatest(1, (count(*) FILTER ({_WHERE[name]}) + {size - 1}) // {size}) AS page_count FROM seen)"""


def _items_sql(name: str) -> str:
    _, size, sort, direction = _PAGES[name]
    return f"""SELECT '{name}' AS request, position, {_SHOWN_SQL} FROM (
      SELECT *, row_number() OVER (ORDER BY {order_sql(sort, direction)}) AS position FROM seen WHERE {_WHERE[name]})
    JOIN (SELECT page AS wanted FROM ({_summary_sql(name)})) ON (position - 1) // {size} = wanted - 1"""


@query("query_jobs", f"WITH {SEEN} " + " UNION ALL ".join(_items_sql(n) for n in _REQUESTS))
def _(t):
    seen = materialize(t.seen, "seen")
    pages = [
        _shown(b.query_jobs(seen, params).items.withColumn("request", F.lit(name)), "request", "position")
        for name, params in _REQUESTS.items()
    ]
    return reduce(DataFrame.unionByName, pages)


_SUMMARIES_SQL = f"WITH {SEEN}, s AS ({' UNION ALL '.join(_summary_sql(n) for n in _REQUESTS)})"


def _summaries(t):
    seen = materialize(t.seen, "seen")
    return {n: b.query_summary(seen, b.BrowseQuery.from_params(p)) for n, p in _REQUESTS.items()}


@query("query_jobs_summary", _SUMMARIES_SQL + " SELECT * FROM s")
def _(t):
    rows = [df.withColumn("request", F.lit(name)) for name, df in _summaries(t).items()]
    return reduce(DataFrame.unionByName, rows)


@query("display_range", _SUMMARIES_SQL + """ SELECT request, CASE WHEN filtered_count = 0 THEN 'No matching jobs' ELSE
  'Showing ' || ((page - 1) * page_size + 1) || '-' || least(page * page_size, filtered_count) || ' of ' || filtered_count
  END AS display_range FROM s""")
def _(t):
    rows = [b.display_range(df).withColumn("request", F.lit(name)) for name, df in _summaries(t).items()]
    return reduce(DataFrame.unionByName, rows)


def _facet_sql(column: str, limit: int) -> str:
    return f"""(SELECT '{column}' AS facet, CAST(row_number() OVER (ORDER BY lower({column}), {column}) AS INTEGER) AS position,
      {column} AS value FROM (SELECT DISTINCT {column} FROM seen WHERE trim({column}) <> '') ORDER BY position LIMIT {limit})"""


@query("facets", f"WITH {SEEN} " + " UNION ALL ".join(_facet_sql(c, n) for c, n in fixed.FACET_LIMITS.items()))
def _(t):
    return b.facets(t.seen)


@query("stats", f"""WITH {SEEN} SELECT count(*) AS total_seen,
  count(*) FILTER (CAST(first_seen AS DATE) = DATE '1999-07-04') AS added_today,
  count(DISTINCT company) AS unique_companies FROM seen""")
def _(t):
    return b.stats(t.seen, "1999-07-04T09:30:00")


_KEPT_SQL = f"WITH {SEEN.replace('seen AS', 'every AS', 1)}, seen AS (SELECT * FROM {REWRITTEN.replace('seen', 'every', 1)})"


@query("facets_kept", f"{_KEPT_SQL} " + " UNION ALL ".join(_facet_sql(c, n) for c, n in fixed.FACET_LIMITS.items()))
def _(t):
    return rewritten_table(t).facets()


@query("stats_kept", f"""{_KEPT_SQL} SELECT count(*) AS total_seen,
  count(*) FILTER (CAST(first_seen AS DATE) = DATE '1999-07-04') AS added_today,
  count(DISTINCT company) AS unique_companies FROM seen""")
def _(t):
    return rewritten_table(t).stats("1999-07-04T09:30:00")


@query("json_bundle", f"""WITH {SEEN}, hit AS (SELECT *, row_number() OVER (ORDER BY {order_sql('score', 'desc')}) AS position
  FROM seen WHERE {_search('gear')})
SELECT (SELECT count(*) FROM seen) AS total, (SELECT count(*) FROM hit) AS filtered, CAST(30 AS INTEGER) AS items,
  (SELECT unique_key FROM hit WHERE position = 31) AS first_item, (SELECT title FROM hit WHERE position = 60) AS last_label,
  CAST((SELECT least(500, count(DISTINCT company)) FROM seen) AS INTEGER) AS companies,
  'company,company_label,description,description_preview,first_seen,first_seen_label,location,location_label,posted_date,'
    || 'posted_label,score,score_band,score_label,source,source_label,title,title_label,unique_key,url' AS fields,
  'gear|score|desc|2|30|' AS asked""")
def _(t):
    # Counts, page, filters and stats each read the listings.
    bundle = b.json_bundle(materialize(t.seen, "seen"), {"q": "gear", "sort": "score", "page": 2, "page_size": 30}, "1999-07-04")

    def at(path: str):
        return F.get_json_object("json", path)

    return bundle.select(
        at("$.stats.total_seen").cast("bigint").alias("total"),
        at("$.result.filtered_count").cast("bigint").alias("filtered"),
        F.json_array_length(at("$.result.items")).alias("items"),
        at("$.result.items[0].unique_key").alias("first_item"),
        at("$.result.items[29].title_label").alias("last_label"),
        F.json_array_length(at("$.filters.companies")).alias("companies"),
        F.array_join(F.array_sort(F.json_object_keys(at("$.result.items[0]"))), ",").alias("fields"),
        F.concat_ws("|", *[at(f"$.result.query.{n}") for n in ("q", "sort", "direction", "page", "page_size", "min_score")]).alias("asked"),
    )


@query("browse_items", rf"""WITH {SEEN}, page AS (SELECT unique_key,
    CASE WHEN l % 5 = 0 THEN '' ELSE title END AS title, CASE WHEN l % 5 = 1 THEN NULL ELSE company END AS company,
    CASE WHEN l % 5 = 2 THEN '' ELSE location END AS location, CASE WHEN l % 5 = 3 THEN NULL ELSE source || 'ab-c1d' END AS source,
    CASE WHEN l % 5 = 4 THEN posted_date + INTERVAL 90 MINUTE ELSE posted_date END AS posted_date, first_seen, score, description
  FROM (SELECT *, length(title) AS l FROM seen)), r AS (SELECT *, {round1_sql('score')} AS rounded FROM page)
SELECT unique_key, coalesce(nullif(title, ''), 'Untitled role') AS title_label,
  coalesce(nullif(company, ''), 'Unknown company') AS company_label,
  coalesce(nullif(location, ''), 'Unknown location') AS location_label,
  CASE WHEN source IS NULL THEN 'Unknown' ELSE upper(source[1]) || 'ab-C1D' END AS source_label,
  CASE WHEN posted_date IS NULL THEN 'Unknown' WHEN posted_date = date_trunc('day', posted_date) THEN strftime(posted_date, '%Y-%m-%d')
    ELSE strftime(posted_date, '%Y-%m-%d %H:%M') END AS posted_label, strftime(first_seen, '%Y-%m-%d') AS first_seen_label,
  CASE WHEN score IS NULL THEN '--' ELSE printf('%.1f', rounded) END AS score_label,
  CASE WHEN score >= 85 THEN 'high' WHEN score >= 65 THEN 'medium' ELSE 'low' END AS score_band,
  description AS description_preview FROM r""")
def _(t):
    n = F.length("title") % 5
    rows = t.seen.withColumns({
        "title": F.when(n == 0, "").otherwise(F.col("title")),
        "company": F.when(n != 1, F.col("company")),
        "location": F.when(n == 2, "").otherwise(F.col("location")),
        "source": F.when(n != 3, F.concat("source", F.lit("ab-c1d"))),
        "posted_date": F.when(n == 4, F.col("posted_date") + F.expr("INTERVAL 90 MINUTE")).otherwise(F.col("posted_date")),
    })
    labels = ("title_label", "company_label", "location_label", "source_label", "posted_label",
              "first_seen_label", "score_label", "score_band", "description_preview")
    return b.browse_items(rows).select("unique_key", *labels)
