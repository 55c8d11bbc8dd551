"""Boards with a ``jobs`` array and escaped HTML content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.functions.dates import parse_instant
from hirelake.functions.text import clean_html
from hirelake.sources.payloads import as_listings, good_records, present

JOB = """
    id string, title string, absolute_url string, updated_at string, content string,
    location string, departments array<struct<name: string>>
"""


def normalize_greenhouse(raw: DataFrame) -> DataFrame:
    """Listings of (company, payload) rows."""
    r = F.col("record")
    first_department = F.try_element_at(r["departments"], F.lit(1))
    return as_listings(
        good_records(raw, ("jobs",), JOB),
        title=present(r["title"], default="Unknown"),
        company=F.col("company"),
        # A location that is no object has no name.
        location=present(F.get_json_object(r["location"], "$.name")),
        url=present(r["absolute_url"]),
        description=clean_html(present(r["content"])),
        source=F.lit("greenhouse"),
        posted_date=parse_instant(r["updated_at"], "iso"),
        job_id=present(r["id"]),
        team=present(first_department["name"]),
    )
