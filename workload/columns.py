"""Scalar column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from hirelake import fixed
from hirelake.functions.company import company_group
from hirelake.functions.dates import age_days, date_label, parse_instant, report_stamp
from hirelake.functions.keys import unique_key
from hirelake.functions.labels import match_class, score_band, score_label
from hirelake.functions.places import has_foreign_marker, looks_domestic
from hirelake.functions.text import ascii_fold, clean_html, compact_text, safe_url, snippet, url_id
from hirelake.functions.titles import infer_seniority, required_years
from workload.core import (
    LINE, LINE_VOCAB, SENIORITY_SQL, YEARS_SQL, age_sql, list_sql, query,
    round1_sql, stamp,
)

# The four entities the tables hold; a cut-off one may lack its semicolon.
CLEAN_SQL = r"""trim(regexp_replace(regexp_replace(
    regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '&quot;?', '"', 'g'), '&copy;?', '©', 'g'),
      '&middot;?', '·', 'g'), '&amp;?', '&', 'g'),
    '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"""


@query("clean_html", f"SELECT page_id, {CLEAN_SQL.format('html')} AS clean FROM pages")
def _(t):
    return t.pages.select("page_id", clean_html(F.col("html")).alias("clean"))


_NAMED = """named AS (
  SELECT c_custkey AS id, c_name || CASE c_custkey % 9 WHEN 0 THEN ' Inc.' WHEN 1 THEN ', LLC'
    WHEN 2 THEN ' Corp' WHEN 3 THEN ' Co., Ltd.' WHEN 4 THEN ' U.S. Services' WHEN 5 THEN ' AWS East'
    WHEN 6 THEN ' (LinkedIn)' WHEN 7 THEN '  ' ELSE '' END AS name FROM customer
  UNION ALL SELECT -1 - s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'YouTube ' || s_name
    WHEN 1 THEN 'Inc. ' WHEN 2 THEN s_name || ' L.P.' END FROM supplier)"""
_GROUPS_SQL = " ".join(
    f"WHEN {' OR '.join(f'contains(low, {chr(39)}{a}{chr(39)})' for a in aliases)} THEN '{group}'"
    for group, aliases in fixed.COMPANY_GROUPS.items()
)


@query("normalize_company", f"""WITH {_NAMED}, lowered AS (SELECT id, trim(lower(name)) AS low FROM named)
SELECT id, CASE {_GROUPS_SQL} ELSE coalesce(nullif(rtrim(trim(regexp_replace(low,
  '\\b(inc\\.?|llc|ltd|corp\\.?|co\\.?|l\\.?p\\.?|services|u\\.?s\\.?)\\b', '', 'g')), ',. '), ''), low) END
  AS company_group FROM lowered""")
def _(t):
    endings = [" Inc.", ", LLC", " Corp", " Co., Ltd.", " U.S. Services", " AWS East", " (LinkedIn)", "  ", ""]
    ending = F.element_at(F.array(*map(F.lit, endings)), (F.col("c_custkey") % 9 + 1).cast("int"))
    customers = t.customer.select(F.col("c_custkey").alias("id"), F.concat("c_name", ending).alias("name"))
    kind = F.col("s_suppkey") % 3
    suppliers = t.supplier.select(
        (-1 - F.col("s_suppkey")).alias("id"),
        F.when(kind == 0, F.concat(F.lit("YouTube "), "s_name"))
        .when(kind == 1, F.lit("Inc. "))
        .otherwise(F.concat("s_name", F.lit(" L.P.")))
        .alias("name"),
    )
    return customers.unionByName(suppliers).select("id", company_group(F.col("name")).alias("company_group"))


@query("ascii_fold", r"""SELECT doc_id, lower(regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g')) AS folded
FROM documents""")
def _(t):
    return t.documents.select("doc_id", ascii_fold(F.col("text")).alias("folded"))


@query("required_years", f"""WITH {LINE} SELECT unique_key, l_partkey, l_suppkey, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS day,
  CAST({YEARS_SQL} AS INTEGER) AS years FROM line""")
def _(t):
    return t.line.select(
        "unique_key", "l_partkey", "l_suppkey", stamp("l_shipdate").alias("day"),
        required_years(F.col("description")).alias("years"),
    )


@query("infer_seniority", f"""WITH titled AS (SELECT p_partkey, p_type || ' ' || p_name ||
  CASE p_partkey % 7 WHEN 1 THEN ' III' WHEN 2 THEN ' 2' WHEN 3 THEN ' i' WHEN 4 THEN ' (3)' ELSE '' END AS title FROM part)
SELECT p_partkey, title, {SENIORITY_SQL} AS level FROM titled""")
def _(t):
    n = F.col("p_partkey") % 7
    numeral = F.when(n == 1, " III").when(n == 2, " 2").when(n == 3, " i").when(n == 4, " (3)").otherwise("")
    titled = t.part.select("p_partkey", F.concat("p_type", F.lit(" "), "p_name", numeral).alias("title"))
    level = infer_seniority(
        F.lower("title"), LINE_VOCAB.senior_terms, LINE_VOCAB.mid_terms, LINE_VOCAB.entry_terms
    )
    return titled.select("p_partkey", "title", level.alias("level"))


_PLACES = """places AS (SELECT c_custkey, lower(n_name || ', ' || r_name || CASE c_custkey % 8
  WHEN 0 THEN ', US' WHEN 1 THEN ' (Uk)' WHEN 2 THEN ', Türkiye' WHEN 3 THEN ', WA' WHEN 4 THEN ', Seattle'
  WHEN 5 THEN ' / Ukraine' WHEN 6 THEN ', New Mexico, NM' ELSE '' END) AS loc
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
_SHORT = [m for m in fixed.FOREIGN_MARKERS if len(m) <= 3]
_LONG = [m for m in fixed.FOREIGN_MARKERS if len(m) > 3]
_FOREIGN = f"""(regexp_matches(strip_accents(loc), '{"|".join(_LONG)}')
  OR regexp_matches(strip_accents(loc), '\\b({"|".join(_SHORT)})\\b'))"""


def _places(t):
    n = F.col("c_custkey") % 8
    endings = [", US", " (Uk)", ", Türkiye", ", WA", ", Seattle", " / Ukraine", ", New Mexico, NM", ""]
    ending = F.element_at(F.array(*map(F.lit, endings)), (n + 1).cast("int"))
    return (
        t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", F.lower(F.concat("n_name", F.lit(", "), "r_name", ending)).alias("loc"))
    )


@query("foreign_marker", f"WITH {_PLACES} SELECT c_custkey, loc, {_FOREIGN} AS foreign_place FROM places")
def _(t):
    return _places(t).select("c_custkey", "loc", has_foreign_marker(F.col("loc")).alias("foreign_place"))


@query("looks_domestic", f"""WITH {_PLACES} SELECT c_custkey, loc, NOT {_FOREIGN} AND (
  contains(loc, 'united states') OR contains(loc, ', us')
  OR len(list_filter(regexp_extract_all(loc, '\\b([a-z][a-z])\\b', 1), lambda w: w IN ({list_sql(fixed.STATE_CODES)}))) > 0
  OR regexp_matches(loc, '{"|".join(fixed.DOMESTIC_CITIES)}')) AS domestic FROM places""")
def _(t):
    return _places(t).select("c_custkey", "loc", looks_domestic(F.col("loc")).alias("domestic"))


@query("parse_instant", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS from_iso,
  strftime(o_orderdate - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') AS from_offset,
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS from_seconds,
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS from_millis,
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS from_long_month,
  strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS from_short_month,
  CAST(NULL AS VARCHAR) AS from_junk FROM orders""")
def _(t):
    day = F.col("o_orderdate").cast("timestamp")
    iso = F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss")
    shown = {
        "from_iso": (F.concat(iso, F.lit("Z")), "iso"),
        "from_offset": (F.concat(iso, F.lit("+02:00")), "iso"),
        "from_seconds": (F.unix_seconds(day).cast("string"), "epoch_s"),
        "from_millis": (F.unix_millis(day).cast("string"), "epoch_ms"),
        "from_long_month": (F.date_format(day, "MMMM d, yyyy"), "month_name"),
        "from_short_month": (F.date_format(day, "MMM d, yyyy"), "month_name"),
        "from_junk": (F.concat(F.lit("on "), iso), "iso"),
    }
    return t.orders.select(
        "o_orderkey", *[stamp(parse_instant(x, kind)).alias(n) for n, (x, kind) in shown.items()]
    )


@query("unique_key", """SELECT o_orderkey, o_orderpriority || ':' || CASE WHEN o_orderkey % 3 = 0
  THEN 'https://example.org/' || o_orderkey ELSE 'id-' || o_orderkey END AS unique_key FROM orders""")
def _(t):
    n = F.col("o_orderkey") % 3
    job_id = F.when(n == 0, "").when(n == 1, F.concat(F.lit("id-"), "o_orderkey"))
    job_id = job_id.otherwise(F.concat(F.lit("id-"), "o_orderkey"))
    url = F.concat(F.lit("https://example.org/"), "o_orderkey")
    return t.orders.select("o_orderkey", unique_key(F.col("o_orderpriority"), job_id, url).alias("unique_key"))


@query("url_id", r"SELECT page_id, regexp_extract(url, '/[a-z]+/(\d+)', 1) AS id FROM pages")
def _(t):
    return t.pages.select("page_id", url_id(F.col("url"), r"/[a-z]+/(\d+)").alias("id"))


@query("safe_url", """WITH m AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN upper(url) WHEN 1 THEN '  ' || url || ' '
  WHEN 2 THEN 'ftp://' || url WHEN 3 THEN '' ELSE url END AS url FROM pages)
SELECT page_id, CASE WHEN starts_with(lower(trim(url)), 'http://') OR starts_with(lower(trim(url)), 'https://')
  THEN trim(url) ELSE '#' END AS safe_url FROM m""")
def _(t):
    n = F.col("page_id") % 5
    mutated = (
        F.when(n == 0, F.upper("url")).when(n == 1, F.concat(F.lit("  "), "url", F.lit(" ")))
        .when(n == 2, F.concat(F.lit("ftp://"), "url")).when(n == 3, "").otherwise(F.col("url"))
    )
    return t.pages.select("page_id", safe_url(mutated).alias("safe_url"))


def snippet_sql(source: str, keys: str, max_len: int, text: str = "description") -> str:
    """SELECT of ``keys`` and ``snippet``: sentences while they fit."""
    # The running text carries a leading mark once a sentence did not fit.
    return f"""SELECT {keys}, CASE WHEN coalesce({text}, '') = '' THEN '' ELSE
      coalesce(nullif(trim(ltrim(list_reduce(string_split(clean, '. '),
        lambda acc, s: CASE WHEN starts_with(acc, chr(1)) OR length(acc) + length(s) > {max_len}
          THEN chr(1) || ltrim(acc, chr(1)) ELSE acc || s || '. ' END, ''), chr(1))), ''),
        substring(clean, 1, {max_len}) || '...') END AS snippet
    FROM (SELECT *, {CLEAN_SQL.format(text)} AS clean FROM {source})"""


@query("snippet", snippet_sql("documents", "doc_id", 200, "text"))
def _(t):
    return t.documents.select("doc_id", snippet(F.col("text")).alias("snippet"))


@query("compact_text", r"""WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM documents)
SELECT doc_id, CASE WHEN length(flat) <= 240 THEN flat ELSE rtrim(substring(flat, 1, 237)) || '...' END AS preview FROM f""")
def _(t):
    return t.documents.select("doc_id", compact_text(F.col("text")).alias("preview"))


@query("date_label", """WITH x AS (
  SELECT 'o' || o_orderkey AS id, o_orderdate AS ts, o_orderkey % 4 AS k FROM orders
  UNION ALL SELECT 'e' || event_id, ts, event_id % 4 FROM events)
SELECT id, CASE WHEN k = 3 THEN CASE WHEN starts_with(id, 'o') THEN 'Unknown' ELSE left('seen on ' || strftime(ts, '%Y-%m-%dT%H:%M:%S'), 19) END
  WHEN date_trunc('second', ts) = date_trunc('day', ts) AND starts_with(id, 'o') THEN strftime(ts, '%Y-%m-%d')
  ELSE strftime(ts, '%Y-%m-%d %H:%M') END AS label,
  CASE WHEN k = 3 THEN CASE WHEN starts_with(id, 'o') THEN '' ELSE 'seen on ' || strftime(ts, '%Y-%m-%dT%H:%M:%S') END
  ELSE strftime(ts, '%Y-%m-%d %H:%M') END AS stamp FROM x""")
def _(t):
    orders = t.orders.select(
        F.concat(F.lit("o"), "o_orderkey").alias("id"), F.col("o_orderdate").alias("ts"),
        (F.col("o_orderkey") % 4).alias("k"), F.lit("  ").alias("odd"),
    )
    events = t.events.select(
        F.concat(F.lit("e"), "event_id").alias("id"), "ts", (F.col("event_id") % 4).alias("k"),
        F.concat(F.lit("seen on "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("odd"),
    )
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    text = (
        F.when(F.col("k") == 3, F.col("odd")).when(F.col("k") == 1, F.concat(iso, F.lit("Z")))
        .when(F.col("k") == 2, F.concat(iso, F.lit("-07:00"))).otherwise(F.replace(iso, F.lit("T"), F.lit(" ")))
    )
    rows = orders.unionByName(events)
    return rows.select("id", date_label(text).alias("label"), report_stamp(text).alias("stamp"))


@query("score_band", f"""WITH s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice / 5000 END AS score FROM orders),
r AS (SELECT *, {round1_sql('score')} AS rounded FROM s)
SELECT o_orderkey, CASE WHEN score IS NULL THEN '--' ELSE printf('%.1f', rounded) END AS label,
  CASE WHEN score >= 85 THEN 'high' WHEN score >= 65 THEN 'medium' ELSE 'low' END AS band,
  CASE WHEN score >= 70 THEN 'high' WHEN score >= 40 THEN 'mid' ELSE 'low' END AS match_class FROM r""")
def _(t):
    score = F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice") / 5000)
    return t.orders.select(
        "o_orderkey", score_label(score).alias("label"), score_band(score).alias("band"),
        match_class(score).alias("match_class"),
    )


@query("age_days", f"SELECT event_id, {age_sql('ts', '2024-01-15 12:00:00')} AS age FROM events")
def _(t):
    return t.events.select("event_id", age_days(F.col("ts"), "2024-01-15T12:00:00").alias("age"))
