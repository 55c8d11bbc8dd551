"""From landed payloads of several sources to one table of wanted listings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame

from hirelake import sources
from hirelake.operators.filters import matching_intent
from hirelake.schema import Vocabulary
from hirelake.sources.microsoft import detailed_listings

_NORMALIZERS = {
    "lever": sources.normalize_lever,
    "greenhouse": sources.normalize_greenhouse,
    "ashby": sources.normalize_ashby,
    "amazon": sources.normalize_amazon,
    "microsoft": sources.normalize_microsoft,
}
# Search results: where their records are, and the fields that identify one.
_SEARCHES = {
    "amazon": (("jobs",), ("id_icims", "id")),
    "microsoft": (("data", "positions"), ("id", "atsJobId")),
}


def intake(
    landed: Mapping[str, DataFrame],
    queries: Sequence[str] = (),
    *,
    details: DataFrame | None = None,
    details_order: Sequence[Column | str] = ("payload",),
    page_sizes: Mapping[str, int] | None = None,
    pages: DataFrame | None = None,
    sitemaps: DataFrame | None = None,
    vocab: Vocabulary | None = None,
) -> DataFrame:
    """Listings that match the search intent, of every source given.

    ``landed`` maps source names to raw payload tables; a source that is left
    out is off.  ``details`` completes the microsoft summaries, the first of a
    position by ``details_order`` counts.  A search source named in
    ``page_sizes`` has (query, page) columns and ends each query where the
    crawl would have, before anything is normalised.  ``pages`` and
    ``sitemaps`` are the job pages with structured data and their sitemap.
    """
    found = []
    for name, raw in landed.items():
        if name in (page_sizes or {}):
            raw = sources.crawled_pages(raw, *_SEARCHES[name], page_sizes[name]).drop("query", "page")
        if name == "microsoft" and details is not None:
            found.append(detailed_listings(raw, details, details_order, queries, vocab).drop("position_id"))
        else:
            rows = _NORMALIZERS[name](raw).drop("position_id")
            found.append(matching_intent(rows, queries, vocab))
    if pages is not None:
        dates = None if sitemaps is None else sources.sitemap_entries(sitemaps)
        if dates is not None:
            # Only pages the sitemap lists are looked at.
            pages = pages.join(dates.select("url"), "url", "left_semi")
        found.append(matching_intent(sources.normalize_structured(pages, dates), queries, vocab))
    return sources.union_sources(*found)
