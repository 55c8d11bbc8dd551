"""Output tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from hirelake.operators.digest import digest_rows, digest_summary, report_rows, source_summary
from hirelake.operators.ranking import rank_diverse
from workload.columns import snippet_sql
from workload.core import SEEN, query
from workload.runs import ranked_sql
from workload.scoring import DOC_SCORED, SKILLS, doc_scored, matched_sql


@query("digest_rows", f"""WITH {DOC_SCORED}, {ranked_sql('top', 'scored', 60)}, s AS ({snippet_sql('top', '*', 200)})
SELECT rank, title, company, coalesce(nullif(location, ''), 'Remote') AS location, url,
  coalesce(strftime(posted_date, '%b %d'), '') AS posted_label, total_score,
  CASE WHEN total_score >= 70 THEN 'high' WHEN total_score >= 40 THEN 'mid' ELSE 'low' END AS match_class,
  array_to_string({matched_sql(SKILLS)}[1:8], '|') AS matching_skills, snippet FROM s""")
def _(t):
    rows = digest_rows(rank_diverse(doc_scored(t), 60))
    return rows.withColumn("matching_skills", F.array_join("matching_skills", "|"))


@query("report_rows", f"""WITH {DOC_SCORED}, {ranked_sql('top', 'scored', 10)},
rest AS (SELECT *, CAST(row_number() OVER (ORDER BY total_score DESC, unique_key) AS INTEGER) AS rank FROM scored
  WHERE unique_key NOT IN (SELECT unique_key FROM top)), s AS ({snippet_sql('rest', '*', 220)})
SELECT rank, coalesce(nullif(title, ''), 'Unknown') AS title, coalesce(nullif(company, ''), 'Unknown') AS company,
  coalesce(nullif(location, ''), 'Remote/Unknown') AS location, url, source, printf('%.1f', total_score) AS score, snippet,
  coalesce(strftime(posted_date, '%Y-%m-%d %H:%M'), 'Unknown') AS posted_label FROM s WHERE rank <= 100""")
def _(t):
    scored = doc_scored(t)
    return report_rows(scored, rank_diverse(scored, 10), 100)


@query("source_summary", """SELECT string_agg(source || ': ' || n, ', ' ORDER BY source) AS source_summary
FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)""")
def _(t):
    return source_summary(t.documents)


@query("digest_summary", f"""WITH {DOC_SCORED}, {SEEN},
c AS (SELECT count(*) AS scanned, count(*) FILTER (total_score >= 50) AS new FROM scored)
SELECT CAST(10 AS BIGINT) AS shown, scanned, new, scanned - new AS filtered_out,
  (SELECT count(*) FROM seen) AS all_time_jobs, (SELECT count(DISTINCT company) FROM seen) AS all_time_companies FROM c""")
def _(t):
    scored = doc_scored(t)
    new = scored.where("total_score >= 50")
    return digest_summary(t.doc, new, rank_diverse(new, 10), t.seen, "1999-07-04")
