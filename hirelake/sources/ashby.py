"""Boards whose location is a text or an object."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake import fixed
from hirelake.functions.dates import parse_instant
from hirelake.functions.text import clean_html
from hirelake.sources.payloads import as_listings, filled, good_records, present

JOB = """
    id string, title string, location string, descriptionPlain string, description string,
    publishedAt string, departmentName string, team string
"""


def normalize_ashby(raw: DataFrame, base_url: str = fixed.ASHBY_BOARD_URL) -> DataFrame:
    """Listings of (company, slug, payload) rows; the URL is built from the slug."""
    r = F.col("record")
    named = F.when(r["location"].startswith("{"), F.get_json_object(r["location"], "$.name"))
    return as_listings(
        good_records(raw, ("jobs",), JOB),
        title=present(r["title"], default="Unknown"),
        company=F.col("company"),
        location=present(named, r["location"]),
        url=F.concat(F.lit(base_url + "/"), F.col("slug"), F.lit("/"), present(r["id"])),
        description=clean_html(filled(r["descriptionPlain"], r["description"])),
        source=F.lit("ashby"),
        posted_date=parse_instant(r["publishedAt"], "iso"),
        job_id=present(r["id"]),
        team=filled(r["departmentName"], r["team"]),
    )
