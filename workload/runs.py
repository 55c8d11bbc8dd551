"""Duplicates, the seen table, whole runs and top lists."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.operators import dedupe as d
from hirelake.operators.ranking import rank_diverse, remaining_by_score
from hirelake.operators.scoring import score_listings
from hirelake.plans.daily import run_daily
from hirelake.session import fresh_path, materialize
from hirelake.store import SeenTable
from hirelake.streaming.daily_stream import start_daily_stream
from workload.core import (
    DOC_AS_OF, DOMESTIC_SQL, INCOMING, INCOMING_FROM, KEEP_SQL, LINE, LINE_AS_OF, LINE_ORDER,
    LINE_PREFS, LINE_PROFILE, LINE_VOCAB, SEEN, YEARS_SQL, Tables, any_sql, company_group_sql,
    first_sql, hits_sql, query, stamp, stamp_sql,
)
from workload.scoring import DOC_SCORED, SCORE_COLUMNS, doc_scored, matched_sql, recency_sql, scored_sql

_ROW = ("unique_key", "title", "company", *LINE_ORDER[1:])


@query("dedupe_in_run", f"WITH {LINE}, {first_sql('kept', 'line')} SELECT {', '.join(_ROW)} FROM kept")
def _(t):
    return d.dedupe_in_run(t.line, LINE_ORDER).select(*_ROW)


@query("filter_new", f"""WITH {SEEN}, {INCOMING}, {first_sql('kept', 'incoming')}
SELECT {', '.join(_ROW)} FROM kept WHERE unique_key NOT IN (SELECT unique_key FROM seen)""")
def _(t):
    return d.filter_new(t.incoming, t.seen, LINE_ORDER).select(*_ROW)


@query("is_seen", f"""WITH {SEEN}, {INCOMING} SELECT {', '.join(_ROW)},
  unique_key IN (SELECT unique_key FROM seen) AS seen FROM incoming""")
def _(t):
    return d.is_seen(t.incoming, t.seen).select(*_ROW, "seen")


@query("mark_seen", f"""WITH {DOC_SCORED} SELECT unique_key, title, company, location, url, source,
  {stamp_sql('posted_date')} AS posted, '2024-01-31 00:00:00' AS first_seen, total_score AS score,
  md5(substring(description, 1, 2000)) AS description FROM scored WHERE doc_id % 3 <> 0""")
def _(t):
    scored = doc_scored(t)
    # Every listing comes twice, the copies with other scores and later.
    copies = scored.withColumn("total_score", F.col("total_score") + 1).withColumn("copy", F.lit(2))
    batch = scored.withColumn("copy", F.lit(1)).unionByName(copies)
    stored = t.documents.where("doc_id % 3 = 0").select(
        F.concat("source", F.lit(":"), "doc_id").alias("unique_key")
    )
    added = d.mark_seen(batch, stored, DOC_AS_OF, ["copy"])
    return added.select(
        "unique_key", "title", "company", "location", "url", "source",
        stamp("posted_date").alias("posted"), stamp("first_seen").alias("first_seen"), "score",
        F.md5(F.col("description").cast("binary")).alias("description"),
    )


# --- scored lines for the checks ---------------------------------------------

_TEXT = "lower(description || ' ' || title)"
_SKILLS = [s.lower() for s in LINE_PROFILE.skills]
_SKILL = f"least(CAST({hits_sql(_TEXT, _SKILLS)} AS DOUBLE) / {len(_SKILLS)} * 100.0::DOUBLE * 3, 100.0::DOUBLE)"
_TARGETS = [c.lower() for c in LINE_PREFS.target_companies]
_COMPANY = f"CASE WHEN {any_sql('lower(company)', _TARGETS)} THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END"
_LOCATION = f"""CASE WHEN contains(lower(location), 'nation_2') THEN 90.0::DOUBLE
  WHEN contains(lower(location), 'nation_3') OR contains(lower(location), 'america') THEN 100.0::DOUBLE
  WHEN contains(lower(location), 'asia') THEN 95.0::DOUBLE
  WHEN {DOMESTIC_SQL} THEN 50.0::DOUBLE ELSE 20.0::DOUBLE END"""
_MAX = LINE_PREFS.max_years
_Y = f"coalesce(yoe_required, {YEARS_SQL})"
_YEARS = f"""CASE WHEN {_Y} <= {_MAX} THEN 60.0::DOUBLE + (1.0::DOUBLE - CAST(abs({_MAX} - {_Y}) AS DOUBLE) / {_MAX}) * 40.0::DOUBLE
  ELSE greatest(0.0::DOUBLE, 60.0::DOUBLE - CAST({_Y} - {_MAX} AS DOUBLE) * 15.0::DOUBLE) END"""


def line_scored_sql(source: str) -> str:
    return scored_sql(source, _SKILL, _COMPANY, _LOCATION, _YEARS, recency_sql(LINE_AS_OF))


def ranked_sql(name: str, source: str, n: int) -> str:
    """CTE with the diverse top list of a scored relation."""
    return f"""{name}_placed AS (SELECT *, row_number() OVER (PARTITION BY {company_group_sql('company')}
    ORDER BY total_score DESC, unique_key) AS place FROM {source}),
{name} AS (SELECT *, CAST(row_number() OVER (ORDER BY place > 2, total_score DESC, unique_key) AS INTEGER) AS rank
  FROM {name}_placed WHERE place <= 3 ORDER BY place > 2, total_score DESC, unique_key LIMIT {n})"""


NEW_SCORED = f"""{SEEN}, {INCOMING}, wanted AS (SELECT * FROM incoming WHERE {KEEP_SQL}),
{first_sql('wanted_first', 'wanted')},
fresh AS (SELECT * FROM wanted_first WHERE unique_key NOT IN (SELECT unique_key FROM seen)),
{line_scored_sql('fresh')}"""


def stored_table(t: Tables) -> SeenTable:
    """A seen table holding the view ``seen``."""
    table = SeenTable(t.spark, fresh_path(t.spark, "seen"))
    table.append(t.seen, "history", rebalance=True)
    return table


def daily(t: Tables, **options):
    return run_daily(
        t.incoming, stored_table(t), LINE_PROFILE, LINE_PREFS, LINE_AS_OF, run_id="today",
        order=LINE_ORDER, vocab=LINE_VOCAB, **options,
    )


_SHOWN = ("rank", "unique_key", "title", "company", "location", *SCORE_COLUMNS)
_MATCHED = f"array_to_string({matched_sql(LINE_PROFILE.skills)}, '|') AS matching_skills"


def _top(df: DataFrame) -> DataFrame:
    return df.select(*_SHOWN, F.array_join("matching_skills", "|").alias("matching_skills"))


@query("run_daily", f"""WITH {NEW_SCORED}, {ranked_sql('top', 'scored', LINE_PREFS.results_per_day)}
SELECT {', '.join(_SHOWN)}, {_MATCHED} FROM top""")
def _(t):
    return _top(daily(t).top)


@query("run_daily_stored", f"""WITH {NEW_SCORED} SELECT unique_key, {stamp_sql('first_seen')} AS first_seen, score FROM seen
UNION ALL SELECT unique_key, '2001-11-05 00:00:00', total_score FROM scored""")
def _(t):
    return daily(t).seen.select("unique_key", stamp("first_seen").alias("first_seen"), "score")


@query("run_counters", f"""WITH {NEW_SCORED} SELECT (SELECT count(*) FROM incoming) AS scanned,
  (SELECT count(*) FROM wanted) AS kept, (SELECT count(*) FROM wanted) - (SELECT count(*) FROM wanted_first) AS in_run_duplicates,
  (SELECT count(*) FROM wanted_first) - (SELECT count(*) FROM fresh) AS stored, (SELECT count(*) FROM fresh) AS new,
  (SELECT string_agg(source || ': ' || n, ', ' ORDER BY source) FROM (SELECT source, count(*) AS n FROM incoming GROUP BY source))
    AS source_summary""")
def _(t):
    run = daily(t, dry_run=True, sources=("a", "n", "r"))
    return run.counters().crossJoin(run.sources())


@query("filter_new_indexed", f"""WITH {SEEN}, {INCOMING}, {first_sql('kept', 'incoming')}
SELECT {', '.join(_ROW)} FROM kept WHERE unique_key NOT IN (SELECT unique_key FROM seen)""")
def _(t):
    batch = materialize(d.dedupe_in_run(t.incoming, LINE_ORDER).select(*_ROW), "batch")
    return stored_table(t).without_stored(batch)


#: What ``rewritten_table`` holds.
REWRITTEN = "seen WHERE NOT (source = 'n' AND unique_key LIKE '%1')"


def rewritten_table(t: Tables) -> SeenTable:
    """Two runs over the same months, rewritten; then one of them is replaced, repeated and rewritten."""
    table = SeenTable(t.spark, fresh_path(t.spark, "seen"))
    # Four appends read the listings; they are joined and deduplicated once.
    seen = materialize(t.seen, "listings")
    late = F.col("source") == "n"
    table.append(seen.where(~late), "first", rebalance=True)
    table.append(seen.where(late), "second", rebalance=True)
    table.compact(date(2030, 1, 1))
    fewer = seen.where(late & ~F.col("unique_key").endswith("1"))
    table.append(fewer, "second", rebalance=True, replace=True)
    table.append(fewer, "second", rebalance=True)
    table.compact(date(2030, 1, 1))
    return table


@query("compact_seen", f"""WITH {SEEN} SELECT unique_key, title, company, {stamp_sql('first_seen')} AS first_seen, score
FROM {REWRITTEN}""")
def _(t):
    return rewritten_table(t).read().select("unique_key", "title", "company", stamp("first_seen").alias("first_seen"), "score")


@query("run_backfill", f"""WITH {LINE}, {INCOMING}, wanted AS (SELECT * FROM incoming WHERE {KEEP_SQL}),
{first_sql('fresh', 'wanted')}, {line_scored_sql('fresh')}, {ranked_sql('top', 'scored', LINE_PREFS.results_per_day)}
SELECT {', '.join(_SHOWN)}, {_MATCHED} FROM top""")
def _(t):
    return _top(daily(t, backfill=True, dry_run=True).top)


def _streamed(t: Tables, **options) -> DataFrame:
    table = stored_table(t)
    # Landed in three parts, the first of which comes again.  An order is in one file, and a batch takes a file a core.
    landing, part = fresh_path(t.spark, "landing"), F.pmod("l_orderkey", F.lit(3))
    files = t.spark.sparkContext.defaultParallelism

    def land(n: int) -> None:
        t.lineitem.where(part == n).repartition(files, "l_orderkey").write.mode("append").parquet(landing)

    land(0)
    # The files of the first part alone: what is landed later is not among them.
    first = t.spark.read.schema(t.lineitem.schema).parquet(landing)
    land(1)
    land(2)
    first.coalesce(files).write.mode("append").parquet(landing)
    stream = t.spark.readStream.schema(t.lineitem.schema).option("maxFilesPerTrigger", files).parquet(landing)
    lines = t.listings_of(stream.where(F.col("l_shipdate") >= INCOMING_FROM))
    start_daily_stream(
        lines, table, LINE_PROFILE, LINE_PREFS, LINE_AS_OF, order=LINE_ORDER, vocab=LINE_VOCAB,
        checkpoint=fresh_path(t.spark, "stream"), **options,
    ).awaitTermination()
    added = table.read(except_run="history")
    return added.select("unique_key", "title", "score")


_STREAMED_SQL = f"WITH {NEW_SCORED} SELECT unique_key, title, total_score AS score FROM scored"


@query("run_stream", _STREAMED_SQL)
def _(t):
    return _streamed(t)


@query("run_stream_state", _STREAMED_SQL)
def _(t):
    return _streamed(t, remember=timedelta(days=7))


@query("rank_diverse", f"""WITH {LINE}, {first_sql('kept', 'line')}, {line_scored_sql('kept')}, {ranked_sql('top', 'scored', 250)}
SELECT {', '.join(_SHOWN)} FROM top""")
def _(t):
    kept = t.listings_of_first(d.dedupe_in_run(t.known_lines(t.lineitem), LINE_ORDER))
    scored = score_listings(kept, LINE_PROFILE, LINE_PREFS, LINE_AS_OF, LINE_VOCAB)
    return rank_diverse(scored, 250, vocab=LINE_VOCAB).select(*_SHOWN)


@query("remaining_by_score", f"""WITH {DOC_SCORED}, {ranked_sql('top', 'scored', 10)}
SELECT CAST(row_number() OVER (ORDER BY total_score DESC, unique_key) AS INTEGER) AS rank, unique_key, total_score
FROM scored WHERE unique_key NOT IN (SELECT unique_key FROM top) ORDER BY rank LIMIT 100""")
def _(t):
    scored = doc_scored(t)
    lesser = scored.withColumn("total_score", F.col("total_score") - 1)
    rest = remaining_by_score(scored.unionByName(lesser), rank_diverse(scored, 10), 100)
    return rest.select("rank", "unique_key", "total_score")
