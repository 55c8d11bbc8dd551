"""Where a paged crawl ends."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirelake.sources.payloads import array_at, filled

SIGNATURE_IDS = 3


def page_cutoff(pages: DataFrame, page_size: int) -> DataFrame:
    """Landed pages (query, page, ids) that a crawl would have kept.

    Page by page, a query ends before an empty page, before a page whose first
    ids were seen on an earlier page, and after a page that is not full.

    The stop points are found by aggregation and joined back, so that a query
    with very many pages is spread over tasks: the repeat search ranks within
    (query, signature) and passes on two rows of each per task.
    """
    rows = pages.withColumns(
        {"_size": F.size("ids"), "_signature": F.slice("ids", 1, SIGNATURE_IDS)}
    )
    by_signature = Window.partitionBy("query", "_signature").orderBy("page")
    repeats = (
        rows.select("query", "page", "_signature")
        .withColumn("_nth", F.row_number().over(by_signature))
        .where("_nth = 2")
        .select("query", F.col("page").alias("before"), F.lit(None).cast("bigint").alias("after"))
    )
    ends = rows.where(F.col("_size") < page_size).select(
        "query",
        F.when(F.col("_size") == 0, F.col("page")).alias("before"),
        F.when(F.col("_size") > 0, F.col("page")).alias("after"),
    )
    stops = ends.unionByName(repeats).groupBy("query").agg(
        F.min("before").alias("before"), F.min("after").alias("after")
    )
    open_end = F.col("before").isNull() | (F.col("page") < F.col("before"))
    open_short = F.col("after").isNull() | (F.col("page") <= F.col("after"))
    return pages.join(stops, "query", "left").where(open_end & open_short).drop("before", "after")


def crawled_pages(raw: DataFrame, path: Sequence[str], id_fields: Sequence[str], page_size: int) -> DataFrame:
    """Landed search payloads (query, page, payload, ...) that the crawl would
    have kept, by the ids of the records at ``path``: the first filled one of
    ``id_fields``.  A payload without records there is an empty page."""
    records = reduce(lambda c, n: c[n], path, F.from_json("payload", array_at(path)))

    def record_id(record: Column) -> Column:
        return filled(*[F.get_json_object(record, f"$.{n}") for n in id_fields])

    ids = F.coalesce(F.transform(records, record_id), F.array().cast("array<string>"))
    return page_cutoff(raw.withColumn("ids", ids), page_size).select(*raw.columns)
