"""Sitemap entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hirelake import fixed
from hirelake.functions.dates import parse_instant
from hirelake.functions.text import drop_tags

URLSET = "url array<struct<loc: string, lastmod: string>>"


def sitemap_entries(
    sitemaps: DataFrame, marker: str = fixed.STRUCTURED_PATH_MARKER, max_entries: int = 0
) -> DataFrame:
    """(sitemap_id, position, url, lastmod) of (sitemap_id, xml) rows.

    Entries whose URL holds ``marker``, the first of each URL; text that is
    not XML yields nothing.  ``max_entries`` keeps the first entries of every
    sitemap, 0 keeps all.
    """
    parsed = F.from_xml("xml", URLSET, {"ignoreNamespace": "true"})
    entries = (
        sitemaps.select("sitemap_id", F.posexplode(parsed["url"]).alias("position", "entry"))
        .select("sitemap_id", "position", F.trim("entry.loc").alias("url"), "entry.lastmod")
        .where((F.col("url") != "") & F.col("url").contains(marker))
        .groupBy("sitemap_id", "url")
        .agg(F.min(F.struct("position", "lastmod")).alias("first"))
    )
    lastmod = parse_instant(drop_tags(F.coalesce("first.lastmod", F.lit(""))), "iso")
    rows = entries.select("sitemap_id", "first.position", "url", lastmod.alias("lastmod"))
    if max_entries:
        place = F.row_number().over(Window.partitionBy("sitemap_id").orderBy("position"))
        rows = rows.withColumn("_n", place).where(F.col("_n") <= max_entries).drop("_n")
    return rows
