"""Postings boards that answer with a plain array."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.functions.dates import parse_instant
from hirelake.sources.payloads import as_listings, filled, good_records, present, text_map

POSTING = """
    id string, text string, createdAt string, hostedUrl string, applyUrl string,
    workplaceType string, descriptionPlain string,
    lists array<struct<text: string, content: string>>,
    categories struct<location: string, team: string, commitment: string>
"""


def normalize_lever(raw: DataFrame) -> DataFrame:
    """Listings of (company, payload) rows.  Without a plain description the
    headed lists are joined; their text is taken as it is."""
    r = F.col("record")
    blocks = F.transform(
        r["lists"], lambda b: F.array(present(b["text"]), present(b["content"]))
    )
    return as_listings(
        good_records(raw, (), POSTING),
        title=present(r["text"], default="Unknown"),
        company=F.col("company"),
        location=present(r["categories"]["location"], r["workplaceType"]),
        url=present(r["hostedUrl"], r["applyUrl"]),
        description=filled(r["descriptionPlain"], F.array_join(F.flatten(blocks), " ")),
        source=F.lit("lever"),
        posted_date=parse_instant(r["createdAt"], "epoch_ms"),
        job_id=present(r["id"]),
        team=present(r["categories"]["team"]),
        metadata=text_map(commitment=present(r["categories"]["commitment"])),
    )
