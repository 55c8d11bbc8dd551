"""Registry, table access and the two listing views the queries start from."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake import Preferences, Profile, Vocabulary, configure
from hirelake.operators.dedupe import first_per

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LINE_AS_OF = "2001-11-05"
DOC_AS_OF = "2024-01-31"
SEEN_BEFORE = "2000-01-01"
INCOMING_FROM = "1999-06-01"

# Which copy of a listing counts: every column that can differ within a key.
LINE_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
              "l_discount", "l_tax", "l_linestatus"]

LINE_PREFS = Preferences(
    search_queries=("small widget promo", "cold gear"),
    target_companies=("Supplier#000000003", "#00000001"),
    preferred_locations=("NATION_3, AMERICA", "NATION_2, ASIA"),
    include_remote=True,
    country="US",
    max_years=30,
    max_age_days=400,
    seniority_levels=("entry", "mid"),
    excluded_company_types=("brand#13 ", "#000000042"),
    excluded_companies=("Supplier#000000007", "supplier#000000011"),
    results_per_day=25,
)
LINE_PROFILE = Profile(skills=("Widget", "gear", "brand#2", "needs 1", "Bolt", "ring", "cold", "economy"))
LINE_VOCAB = Vocabulary(
    role_terms=("widget", "gear", "ring", "rod", "bolt", "gizmo"),
    role_excludes=("hot ", "red "),
    senior_terms=("promo",),
    mid_terms=("economy", "standard"),
    entry_terms=("small",),
    mismatch_phrases=("brand#1", "gear", "needs 4", "needs 3"),
    early_career_title=r"\b(blue\s*ring|new\s*bolt|co-?ld)\b",
    generic_url_parts=("/j/1", "77"),
    domestic_phrases=("america", "asia"),
    domestic_cities=("nation_7",),
    remote_words=("nation_2",),
)


def query(name: str, oracle: str | None = None):
    """Register a query function taking ``Tables``; ``oracle`` checks it."""

    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return register


def stamp(column) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


_TEXT_PARTS = ("p_type", "p_name", "p_brand", "s_name", "n_name", "r_name")


def _job_id() -> Column:
    return F.concat("l_orderkey", F.lit("-"), "l_linenumber")


class Tables:
    """The given tables and the views built from them.  All views are lazy."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = configure(spark)
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _keyed(self, lineitem: DataFrame) -> DataFrame:
        return lineitem.withColumn("unique_key", F.concat(F.lower("l_returnflag"), F.lit(":"), _job_id()))

    def _joined(self, lines: DataFrame, of: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
        places = of(self.nation, "n_nationkey").join(of(self.region, "r_regionkey"), F.col("n_regionkey") == F.col("r_regionkey"))
        return (
            lines.join(of(self.part, "p_partkey"), F.col("l_partkey") == F.col("p_partkey"))
            .join(of(self.supplier, "s_suppkey"), F.col("l_suppkey") == F.col("s_suppkey"))
            .join(places, F.col("s_nationkey") == F.col("n_nationkey"))
            .select(*lines.columns, *_TEXT_PARTS)
        )

    def known_lines(self, lineitem: DataFrame) -> DataFrame:
        """Order lines that make a listing, with its key and without its texts."""
        nations = self.nation.join(self.region, F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
        suppliers = self.supplier.join(nations, F.col("s_nationkey") == F.col("n_nationkey"), "left_semi")
        lines = lineitem.join(self.part, F.col("l_partkey") == F.col("p_partkey"), "left_semi")
        return self._keyed(lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi"))

    def listings_of_first(self, first: DataFrame) -> DataFrame:
        """Listings of ``known_lines`` whose keys are distinct: one each, also where a part or supplier comes twice."""
        return self.listed(self._joined(first, lambda table, key: table.dropDuplicates([key])))

    @staticmethod
    def listed(joined: DataFrame) -> DataFrame:
        """Joined lines as listings.  Their texts are long, so they are made after rows have moved."""
        others = [c for c in joined.columns if c not in (*_TEXT_PARTS, "unique_key")]
        return joined.select(
            *others,
            F.concat("p_type", F.lit(" "), "p_name").alias("title"),
            F.col("s_name").alias("company"),
            F.concat("n_name", F.lit(", "), "r_name").alias("location"),
            F.concat(F.lit("https://example.org/j/"), "l_orderkey").alias("url"),
            F.concat(
                "p_brand", F.lit(" "), "p_name", F.lit(" needs "),
                F.col("l_quantity").cast("int"), F.lit("+ years of work experience"),
            ).alias("description"),
            F.lower("l_returnflag").alias("source"),
            F.col("l_shipdate").cast("timestamp").alias("posted_date"),
            _job_id().alias("job_id"),
            F.when(F.col("l_linenumber") == 1, F.lit(0))
            .when(F.col("l_linenumber") == 2, F.lit(3))
            .alias("yoe_required"),
            "unique_key",
        )

    def listings_of(self, lineitem: DataFrame) -> DataFrame:
        """Order lines as listings; lines with equal keys are duplicates."""
        return self.listed(self._joined(self._keyed(lineitem), lambda table, _: table))

    @cached_property
    def line(self) -> DataFrame:
        return self.listings_of(self.lineitem)

    @cached_property
    def doc(self) -> DataFrame:
        """Documents as listings.  Event and document numbers meet; the company
        is the customer who caused the event."""
        places = self.nation.join(self.region, F.col("n_regionkey") == F.col("r_regionkey"))
        stamps = self.events.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("posted_date"))
        years = F.when(F.col("doc_id") % 5 == 1, 0).when(F.col("doc_id") % 5 == 2, 3)
        years = years.when(F.col("doc_id") % 5 == 3, 4).when(F.col("doc_id") % 5 == 4, 9)
        return (
            self.documents.withColumnRenamed("text", "description")
            .join(stamps, F.col("event_id") == F.col("doc_id"))
            .join(self.customer, F.col("c_custkey") == F.col("user_id"))
            .join(places, F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                "doc_id", "lang", "n_chars", "description", "source", "posted_date",
                F.regexp_extract(F.left("description", F.lit(80)), r"^([^\n]*)", 1).alias("title"),
                F.col("c_name").alias("company"),
                F.concat("n_name", F.lit(", "), "r_name").alias("location"),
                F.concat(F.lit("https://example.org/d/"), "doc_id").alias("url"),
                F.col("doc_id").cast("string").alias("job_id"),
                years.cast("int").alias("yoe_required"),
            )
            .withColumn("unique_key", F.concat("source", F.lit(":"), "job_id"))
        )

    @cached_property
    def incoming(self) -> DataFrame:
        return self.line.where(F.col("l_shipdate") >= INCOMING_FROM)

    @cached_property
    def seen(self) -> DataFrame:
        """Stored listings: the first copy of every key shipped before 2000,
        some without a date or a score."""
        old = self.known_lines(self.lineitem.where(F.col("l_shipdate") < SEEN_BEFORE))
        days = F.make_dt_interval(F.col("l_linenumber"))
        return self.listings_of_first(first_per(old, ["unique_key"], LINE_ORDER)).select(
            "unique_key", "title", "company", "location", "url", "source",
            F.when(F.col("l_linenumber") != 7, F.col("posted_date")).alias("posted_date"),
            (F.col("posted_date") + days).alias("first_seen"),
            F.when(F.col("l_linenumber") != 6, F.col("l_extendedprice") / 1000).alias("score"),
            "description",
        )


# --- the same views for the SQL checks ---------------------------------------

_ORDER_SQL = ", ".join(LINE_ORDER)

LINE = """line AS (
  SELECT l.*, p_type || ' ' || p_name AS title, s_name AS company,
    n_name || ', ' || r_name AS location,
    'https://example.org/j/' || l_orderkey AS url,
    p_brand || ' ' || p_name || ' needs ' || CAST(l_quantity AS INTEGER)
      || '+ years of work experience' AS description,
    lower(l_returnflag) AS source, l_shipdate AS posted_date,
    l_orderkey || '-' || l_linenumber AS job_id,
    CASE l_linenumber WHEN 1 THEN 0 WHEN 2 THEN 3 END AS yoe_required,
    lower(l_returnflag) || ':' || l_orderkey || '-' || l_linenumber AS unique_key
  FROM lineitem l JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

DOC = """doc AS (
  SELECT doc_id, lang, n_chars, text AS description, source, ts AS posted_date,
    split_part(substring(text, 1, 80), chr(10), 1) AS title, c_name AS company,
    n_name || ', ' || r_name AS location, 'https://example.org/d/' || doc_id AS url,
    CAST(doc_id AS VARCHAR) AS job_id,
    CASE doc_id % 5 WHEN 1 THEN 0 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 9 END AS yoe_required,
    source || ':' || doc_id AS unique_key
  FROM documents JOIN events ON event_id = doc_id
  JOIN customer ON c_custkey = user_id
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def first_sql(name: str, source: str) -> str:
    return (
        f"{name} AS (SELECT * FROM {source} QUALIFY row_number() OVER "
        f"(PARTITION BY unique_key ORDER BY {_ORDER_SQL}) = 1)"
    )


SEEN = LINE + f""", old AS (SELECT * FROM line WHERE l_shipdate < TIMESTAMP '{SEEN_BEFORE}'),
""" + first_sql("old_first", "old") + """, seen AS (
  SELECT unique_key, title, company, location, url, source,
    CASE WHEN l_linenumber <> 7 THEN posted_date END AS posted_date,
    posted_date + to_days(l_linenumber) AS first_seen,
    CASE WHEN l_linenumber <> 6 THEN l_extendedprice / 1000 END AS score, description
  FROM old_first)"""

INCOMING = f"incoming AS (SELECT * FROM line WHERE l_shipdate >= TIMESTAMP '{INCOMING_FROM}')"


def stamp_sql(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"


def round1_sql(x: str) -> str:
    """One-decimal rounding of a plain column on its exact binary value."""
    total = f"({x} * 8 + {x} * 2)"
    part = f"({total} - {x} * 8)"
    error = f"(({x} * 8 - ({total} - {part})) + ({x} * 2 - {part}))"
    gap = f"((({total} - floor({total})) - 0.5) + {error})"
    odd = f"abs(CAST(floor({total}) AS BIGINT) % 2)"
    step = f"CASE WHEN {gap} > 0 THEN 1 WHEN {gap} < 0 THEN 0 ELSE {odd} END"
    return f"((floor({total}) + {step}) / 10.0)"


def any_sql(text: str, terms) -> str:
    tests = " OR ".join(f"contains({text}, '{t}')" for t in terms)
    return f"({tests})" if tests else "FALSE"


def hits_sql(text: str, terms) -> str:
    return "(" + " + ".join(f"CAST(contains({text}, '{t}') AS INTEGER)" for t in terms) + ")"


def list_sql(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


YEARS_SQL = r"""list_max(list_transform(
    regexp_extract_all(description, '(?i)(\d+)\+?\s*years?\s*of\s*[\w\s]*experience', 1)
    || regexp_extract_all(description, '(?i)(\d+)\+?\s*years?\s*(?:relevant\s*)?experience', 1)
    || regexp_extract_all(description, '(?i)(\d+)\+?\s*yoe', 1)
    || regexp_extract_all(description, '(?i)experience[:\s]*(\d+)\+?\s*years?', 1),
    lambda x: CAST(x AS INTEGER)))"""


def age_sql(ts: str, as_of: str) -> str:
    return f"CAST(floor((epoch_us(TIMESTAMP '{as_of}') - epoch_us({ts})) / 86400000000.0) AS BIGINT)"


def company_group_sql(company: str) -> str:
    """Grouping for names that hold no alias and no legal suffix."""
    return f"rtrim(trim(lower({company})), ',. ')"


SENIORITY_SQL = f"""CASE
    WHEN {any_sql('lower(title)', LINE_VOCAB.senior_terms)} OR regexp_matches(lower(title), '\\b(iii|3)\\b') THEN 'senior'
    WHEN {any_sql('lower(title)', LINE_VOCAB.mid_terms)} OR regexp_matches(lower(title), '\\b(ii|2)\\b') THEN 'mid'
    WHEN {any_sql('lower(title)', LINE_VOCAB.entry_terms)} OR regexp_matches(lower(title), '\\b(i|1)\\b') THEN 'entry' END"""

FOREIGN_SQL = "contains(lower(location), 'europe')"
DOMESTIC_SQL = f"""(NOT {FOREIGN_SQL} AND ({any_sql('lower(location)', LINE_VOCAB.domestic_phrases)}
    OR {any_sql('lower(location)', LINE_VOCAB.domestic_cities)}))"""

# Drop tests over listing columns, in reporting order.
DROPS = {
    "company": f"lower(company) IN ({list_sql(c.lower() for c in LINE_PREFS.excluded_companies)})",
    "generic_url": "(contains(url, '/j/1') AND contains(url, '77'))",
    "early_career": r"regexp_matches(lower(title), '\b(blue\s*ring|new\s*bolt|co-?ld)\b')",
    "phrase": f"""({any_sql('lower(description)', LINE_PREFS.excluded_company_types)}
        OR {any_sql('lower(company)', LINE_PREFS.excluded_company_types)})""",
    "years": f"coalesce(coalesce(nullif(yoe_required, 0), {YEARS_SQL}) > {LINE_PREFS.max_years + 1}, FALSE)",
    "role": f"""(NOT {any_sql('lower(title)', LINE_VOCAB.role_terms)}
        OR {any_sql('lower(title)', LINE_VOCAB.role_excludes)})""",
    "mismatch": f"{hits_sql('lower(description)', LINE_VOCAB.mismatch_phrases)} >= 2",
    "seniority": f"coalesce(({SENIORITY_SQL}) NOT IN ('entry', 'mid'), FALSE)",
    "stale": f"coalesce({age_sql('posted_date', LINE_AS_OF)} > {LINE_PREFS.max_age_days}, FALSE)",
    "place": f"""(location <> '' AND CASE WHEN contains(lower(location), 'nation_2')
        THEN {FOREIGN_SQL} ELSE NOT {DOMESTIC_SQL} END)""",
}
KEEP_SQL = " AND ".join(f"NOT {test}" for test in DROPS.values())
