"""Listing filters."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from hirelake.operators import filters as f
from workload.core import (
    DOC, DOC_AS_OF, DROPS, KEEP_SQL, LINE, LINE_AS_OF, LINE_PREFS, LINE_VOCAB, Tables, any_sql,
    hits_sql, query,
)

_ROW = "unique_key, l_partkey, l_suppkey, l_quantity, l_extendedprice"
_COLUMNS = _ROW.split(", ")


def _kept(t: Tables, drop):
    """Lines the test keeps."""
    lowered = {f"_{c}": F.lower(c) for c in ("title", "company", "description", "location")}
    return t.line.withColumns(lowered).where(~drop).select(*_COLUMNS)


def _kept_sql(name: str) -> str:
    return f"WITH {LINE} SELECT {_ROW} FROM line WHERE NOT {DROPS[name]}"


_QUERY_TERMS = ["small", "widget", "promo", "cold", "gear"]


@query("search_intent", f"""WITH {LINE} SELECT {_ROW} FROM line WHERE
  {any_sql("lower(title) || ' ' || lower(description)", [q.lower() for q in LINE_PREFS.search_queries])}
  OR {hits_sql('lower(title)', _QUERY_TERMS)} >= 2 OR {any_sql('lower(title)', ['anvil', 'platform', 'data'])}""")
def _(t):
    vocab = replace(LINE_VOCAB, generic_title_words=("anvil", "platform", "data"))
    return f.matching_intent(t.line, LINE_PREFS.search_queries, vocab).select(*_COLUMNS)


@query("drop_companies", _kept_sql("company"))
def _(t):
    return _kept(t, f.drop_companies(F.col("company"), LINE_PREFS.excluded_companies))


@query("drop_generic_urls", _kept_sql("generic_url"))
def _(t):
    return _kept(t, f.drop_generic_urls(F.col("url"), LINE_VOCAB.generic_url_parts))


@query("drop_title_regex", _kept_sql("early_career"))
def _(t):
    return _kept(t, f.drop_early_career(F.col("_title"), LINE_VOCAB.early_career_title))


@query("drop_phrases", _kept_sql("phrase"))
def _(t):
    phrases = LINE_PREFS.excluded_company_types
    return _kept(t, f.drop_phrases(F.col("_description"), F.col("_company"), phrases))


@query("drop_over_years", _kept_sql("years"))
def _(t):
    return _kept(t, f.drop_over_years(F.col("yoe_required"), F.col("description"), LINE_PREFS.max_years))


@query("role_filter", _kept_sql("role"))
def _(t):
    return _kept(t, f.drop_other_roles(F.col("_title"), LINE_VOCAB))


_MISMATCH = ("thention", "enle", "que la", "der die", "oridor", "tion")


@query("drop_mismatch", f"SELECT doc_id FROM documents WHERE NOT {hits_sql('lower(text)', _MISMATCH)} >= 2")
def _(t):
    return t.documents.where(~f.drop_mismatch(F.lower("text"), _MISMATCH)).select("doc_id")


@query("seniority_filter", _kept_sql("seniority"))
def _(t):
    return _kept(t, f.drop_seniority(F.col("_title"), LINE_PREFS.seniority_levels, LINE_VOCAB))


@query("drop_stale", f"""WITH {DOC} SELECT doc_id FROM doc WHERE NOT coalesce(
  CAST(floor((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(posted_date)) / 86400000000.0) AS BIGINT) > 28, FALSE)""")
def _(t):
    return t.doc.where(~f.drop_stale(F.col("posted_date"), DOC_AS_OF, 28)).select("doc_id")


@query("geo_filter", _kept_sql("place"))
def _(t):
    place = f.drop_places(F.col("_location"), "US", True, LINE_VOCAB)
    return _kept(t, place)


@query("filter_listings", f"WITH {LINE} SELECT {_ROW} FROM line WHERE {KEEP_SQL}")
def _(t):
    return f.filter_listings(t.line, LINE_PREFS, LINE_AS_OF, LINE_VOCAB).select(*_COLUMNS)


_REASON_SQL = "CASE " + " ".join(f"WHEN {test} THEN '{name}'" for name, test in DROPS.items()) + " ELSE 'kept' END"


@query("filter_reasons", f"WITH {LINE} SELECT {_REASON_SQL} AS reason, count(*) AS listings FROM line GROUP BY 1")
def _(t):
    return f.filter_reasons(t.line, LINE_PREFS, LINE_AS_OF, LINE_VOCAB)
