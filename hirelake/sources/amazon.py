"""Search results with a month-name posting date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake import fixed
from hirelake.functions.dates import parse_instant
from hirelake.functions.text import clean_html
from hirelake.sources.payloads import as_listings, filled, good_records, text_map

JOB = """
    id_icims string, id string, title string, company_name string, location string,
    city string, state string, country_code string, description string,
    posted_date string, public_url string, job_path string, url_next_step string,
    team string, job_category string, job_family string, job_schedule_type string,
    source_system string
"""


def normalize_amazon(raw: DataFrame, base_url: str = fixed.AMAZON_BASE_URL) -> DataFrame:
    """Listings of (payload) rows."""
    r = F.col("record")
    place = F.array_compact(
        F.array(*[F.nullif(r[n], F.lit("")) for n in ("city", "state", "country_code")])
    )
    path = F.nullif(r["job_path"], F.lit(""))
    slash = F.when(path.startswith("/"), F.lit("")).otherwise(F.lit("/"))
    return as_listings(
        good_records(raw, ("jobs",), JOB),
        title=filled(r["title"], default="Unknown"),
        company=filled(r["company_name"], default="Amazon"),
        location=filled(r["location"], F.array_join(place, ", ")),
        url=filled(r["public_url"], F.concat(F.lit(base_url), slash, path), r["url_next_step"]),
        description=clean_html(filled(r["description"])),
        source=F.lit("amazon"),
        posted_date=parse_instant(r["posted_date"], "month_name"),
        job_id=filled(r["id_icims"], r["id"]),
        team=filled(r["team"], r["job_category"]),
        metadata=text_map(
            country_code=r["country_code"], state=r["state"], city=r["city"],
            job_family=r["job_family"], job_schedule_type=r["job_schedule_type"],
            source_system=r["source_system"], url_next_step=r["url_next_step"],
        ),
    )
