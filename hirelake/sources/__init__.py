"""Landed payloads to listing rows."""

from hirelake.sources.amazon import normalize_amazon
from hirelake.sources.ashby import normalize_ashby
from hirelake.sources.greenhouse import normalize_greenhouse
from hirelake.sources.lever import normalize_lever
from hirelake.sources.microsoft import enrich_with_details, normalize_microsoft
from hirelake.sources.paging import crawled_pages, page_cutoff
from hirelake.sources.payloads import union_sources
from hirelake.sources.sitemap import sitemap_entries
from hirelake.sources.structured import jsonld_postings, normalize_structured

__all__ = [
    "crawled_pages", "enrich_with_details", "jsonld_postings", "normalize_amazon", "normalize_ashby",
    "normalize_greenhouse", "normalize_lever", "normalize_microsoft", "normalize_structured",
    "page_cutoff", "sitemap_entries", "union_sources",
]
