"""Listing identity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unique_key(source="source", job_id="job_id", url="url") -> Column:
    """``source:job_id``, or ``source:url`` where the listing has no id."""
    source, job_id, url = (F.col(c) if isinstance(c, str) else c for c in (source, job_id, url))
    return F.concat(source, F.lit(":"), F.coalesce(F.nullif(job_id, F.lit("")), url))
