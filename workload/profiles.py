"""Features of profile texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake import fixed
from hirelake.operators import profiles as p
from workload.core import Tables, list_sql, query

VOCABULARY = ("the", "of", "is", "que", "der", "ing", "tion", "heit", "ette", "and", "chs", "thth")
TITLE_PATTERNS = (r"((?:the|que|der)?\s*[a-z]+tion\s+(?:of|de|la|is))", r"((?:the|la)\s+[a-z]*ing)")
FALLBACK = ("none", "given")
AS_OF_YEAR = 2001

_LONG = [v for v in VOCABULARY if len(v) > 3]
_SHORT = [v for v in VOCABULARY if len(v) <= 3]
# Letters outside ASCII count as word characters for the boundaries.
_WORDS = r"regexp_replace(lower(text), '[^\x00-\x7F]', '_', 'g')"
SKILLS_SQL = f"""list_sort(list_filter([{list_sql(_LONG)}], lambda w: contains(lower(text), w))
  || list_filter([{list_sql(_SHORT)}], lambda w: regexp_matches({_WORDS}, '\\b' || w || '\\b')))"""
TITLES_SQL = f"""list_sort(list_distinct(list_transform(
  {" || ".join(f"regexp_extract_all(text, '(?i){pattern}', 1)" for pattern in TITLE_PATTERNS)},
  lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g'))))"""
KEYWORDS_SQL = rf"""list_sort(list_filter(list_distinct(regexp_extract_all(
  regexp_replace(text, '[^\x00-\x7F]', '_', 'g'), '\b([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*)\b', 1)),
  lambda w: length(w) > 2 AND w NOT IN ({list_sql(fixed.KEYWORD_STOPWORDS)})))"""


@query("extract_skills", f"SELECT doc_id, array_to_string({SKILLS_SQL}, '|') AS skills FROM documents")
def _(t):
    skills = p.extract_skills(F.col("text"), VOCABULARY)
    return t.documents.select("doc_id", F.array_join(skills, "|").alias("skills"))


@query("extract_titles", f"SELECT doc_id, array_to_string({TITLES_SQL}, '|') AS titles FROM documents")
def _(t):
    titles = p.extract_titles(F.col("text"), TITLE_PATTERNS)
    return t.documents.select("doc_id", F.array_join(titles, "|").alias("titles"))


@query("extract_keywords", f"SELECT doc_id, array_to_string({KEYWORDS_SQL}, '|') AS keywords FROM documents")
def _(t):
    return t.documents.select("doc_id", F.array_join(p.extract_keywords(F.col("text")), "|").alias("keywords"))


# One history per order: a header, the work in the years of its lines, then an
# education section, whose range does not count, and sometimes an intern line.
_LINES = """lines AS (SELECT l_orderkey, l_linenumber AS n, CAST(year(min(l_shipdate)) AS INTEGER) AS y FROM lineitem GROUP BY ALL),
texts AS (SELECT o_orderkey, o_orderstatus, o_custkey, list({'n': n, 'y': y} ORDER BY n) FILTER (n IS NOT NULL) AS parts
  FROM orders LEFT JOIN lines ON l_orderkey = o_orderkey GROUP BY ALL)"""


def _histories(t: Tables) -> DataFrame:
    lines = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.year(F.min("l_shipdate")).alias("y"))
    # At most seven line numbers per order.
    parts = F.array_sort(F.collect_list(F.when(F.col("y").isNotNull(), F.struct("l_linenumber", "y"))))
    joined = t.orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left").groupBy(
        "o_orderkey", "o_orderstatus", "o_custkey"
    ).agg(parts.alias("parts"))
    work = F.transform("parts", lambda x: F.concat(
        F.lit("Engineer, Firm   March "), x["y"] - x["l_linenumber"] % 4, F.lit(" – "),
        F.when((x["l_linenumber"] == 7), F.lit("present")).otherwise(x["y"].cast("string")),
    ))
    stated = F.when(F.col("o_custkey") % 10 == 0, F.concat(
        F.col("o_custkey") % 13, F.lit("+ years of professional experience\n"))).otherwise("")
    middle = F.when(F.col("o_orderstatus") == "P", "Summer intern at a firm, nothing with dates here\n").otherwise("")
    text = F.concat(
        F.lit("WORK HISTORY\n"), stated, middle, F.array_join(work, "\n"),
        F.lit("\nEDUCATION\nSome place 1991 - 1996\nOTHER\nVolunteering 1992 - 1993 in a long sentence about dates\n"),
    )
    return joined.select("o_orderkey", text.alias("raw_text"))


# Ranges of an order are covered year by year: a year boundary counts once.
_COVERED = f"""covered AS (SELECT o_orderkey, count(DISTINCT boundary) AS years FROM (
  SELECT o_orderkey, unnest(range(x.y - x.n % 4, CASE WHEN x.n = 7 THEN {AS_OF_YEAR} ELSE x.y END)) AS boundary FROM (
    SELECT o_orderkey, unnest(parts) AS x FROM texts WHERE o_orderstatus <> 'P')
  UNION ALL SELECT o_orderkey, 1992 FROM texts)
  GROUP BY o_orderkey)"""
_STATED = "CASE WHEN o_custkey % 10 = 0 THEN CAST(o_custkey % 13 AS INTEGER) END"


@query("explicit_years", f"SELECT o_orderkey, {_STATED} AS years FROM orders")
def _(t):
    return _histories(t).select("o_orderkey", p.explicit_years(F.col("raw_text")).alias("years"))


@query("work_years", f"""WITH {_LINES}, {_COVERED}
SELECT o_orderkey, CAST(years AS INTEGER) AS years FROM texts JOIN covered USING (o_orderkey)""")
def _(t):
    return _histories(t).select("o_orderkey", p.work_years(F.col("raw_text"), AS_OF_YEAR).alias("years"))


@query("parse_profiles", f"""SELECT doc_id, coalesce(nullif(array_to_string({SKILLS_SQL}, '|'), ''), '{"|".join(FALLBACK)}') AS skills,
  array_to_string({KEYWORDS_SQL}, '|') AS keywords, array_to_string({TITLES_SQL}, '|') AS job_titles,
  CAST(NULL AS INTEGER) AS yoe, md5(text) AS text_hash, {fixed.PARSER_VERSION} AS parser_version FROM documents""")
def _(t):
    texts = t.documents.select("doc_id", F.col("text").alias("raw_text"))
    parsed = p.parse_profiles(
        texts, AS_OF_YEAR, fallback_skills=FALLBACK, vocabulary=VOCABULARY, title_patterns=TITLE_PATTERNS
    )
    return parsed.select(
        "doc_id", *[F.array_join(c, "|").alias(c) for c in ("skills", "keywords", "job_titles")],
        "yoe", "text_hash", "parser_version",
    )


@query("changed_only", """SELECT doc_id, md5(text) AS text_hash FROM documents WHERE doc_id % 10 IN (0, 1, 2)""")
def _(t):
    docs = t.documents.select(F.col("doc_id").alias("profile_id"), F.col("text").alias("raw_text"))
    n = F.col("profile_id") % 10
    # The cache knows an older text, an older parser or nothing of some.
    cache = docs.where(n != 2).select(
        "profile_id",
        F.md5(F.when(n == 0, F.concat("raw_text", F.lit("."))).otherwise(F.col("raw_text")).cast("binary")).alias("text_hash"),
        F.when(n == 1, 1).otherwise(fixed.PARSER_VERSION).alias("parser_version"),
    )
    return p.changed_only(docs, cache).select(F.col("profile_id").alias("doc_id"), "text_hash")


# Every text states its years.  Of the cache's entries some are of an older
# text, some of an older parser, some are missing; one is of no given text.
_DATED = "d AS (SELECT doc_id, text || chr(10) || (doc_id % 40) || ' years of experience' AS text FROM documents)"


@query("refresh_profiles", f"""WITH {_DATED}
SELECT doc_id, CASE WHEN doc_id % 10 < 3 THEN coalesce(nullif(array_to_string({SKILLS_SQL}, '|'), ''), '{"|".join(FALLBACK)}') ELSE 'kept' END AS skills,
  CASE WHEN doc_id % 10 < 3 THEN array_to_string({TITLES_SQL}, '|') ELSE '' END AS job_titles,
  CASE WHEN doc_id % 10 < 3 THEN CAST(doc_id % 40 AS INTEGER) ELSE -1 END AS yoe, md5(text) AS text_hash, {fixed.PARSER_VERSION} AS parser_version FROM d
UNION ALL SELECT DISTINCT -1, 'kept', '', -1, md5(''), {fixed.PARSER_VERSION} FROM d""")
def _(t):
    years = F.concat(F.col("doc_id") % 40, F.lit(" years of experience"))
    texts = t.documents.select("doc_id", F.concat("text", F.lit("\n"), years).alias("raw_text"))
    n = F.col("doc_id") % 10
    gone = t.documents.select(F.lit(-1).cast("bigint").alias("doc_id"), F.lit("").alias("raw_text")).distinct()
    nothing = F.array().cast("array<string>")
    known = texts.where(n != 2).withColumn(
        "raw_text", F.when(n == 0, F.concat("raw_text", F.lit("."))).otherwise(F.col("raw_text"))
    ).unionByName(gone)
    cache = known.select(
        "doc_id", "raw_text", F.array(F.lit("kept")).alias("skills"), nothing.alias("keywords"), nothing.alias("job_titles"),
        F.lit(-1).alias("yoe"), F.md5(F.col("raw_text").cast("binary")).alias("text_hash"),
        F.when(n == 1, 1).otherwise(fixed.PARSER_VERSION).alias("parser_version"),
    )
    fresh = p.refresh_profiles(
        texts, cache, AS_OF_YEAR, "doc_id", fallback_skills=FALLBACK, vocabulary=VOCABULARY, title_patterns=TITLE_PATTERNS
    )
    lists = [F.array_join(c, "|").alias(c) for c in ("skills", "job_titles")]
    return fresh.select("doc_id", *lists, "yoe", "text_hash", "parser_version")
