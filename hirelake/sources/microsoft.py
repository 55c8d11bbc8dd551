"""Search results with a separate detail record per position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake import fixed
from hirelake.functions.dates import parse_instant
from hirelake.functions.text import clean_html
from hirelake.operators.dedupe import first_per
from hirelake.operators.filters import matching_intent
from hirelake.schema import Vocabulary
from hirelake.sources.payloads import as_listings, computed_once, filled, good_records, text_map

_SHARED = """
    name string, location string, locations string, publicUrl string, positionUrl string,
    postedTs string, department string, displayJobId string, atsJobId string,
    workLocationOption string, locationFlexibility string
"""
POSITION = "id string, standardizedLocations string, stars string, isHot string, solrScore string," + _SHARED
DETAIL = (
    "jobDescription string, efcustomTextWorkSite string, efcustomTextRequiredTravel string,"
    "efcustomTextCurrentProfession string, efcustomTextTaDisciplineName string,"
    "efcustomTextRoletype string, efcustomTextEmploymentType string," + _SHARED
)

# Metadata name -> field.  The first group keeps the summary's value unless
# the field is present in the details; the second exists in details only.
KEPT_METADATA = {
    "display_job_id": "displayJobId", "ats_job_id": "atsJobId",
    "work_location_option": "workLocationOption", "location_flexibility": "locationFlexibility",
}
DETAIL_METADATA = {
    "efcustom_text_work_site": "efcustomTextWorkSite",
    "efcustom_text_required_travel": "efcustomTextRequiredTravel",
    "efcustom_text_current_profession": "efcustomTextCurrentProfession",
    "efcustom_text_ta_discipline_name": "efcustomTextTaDisciplineName",
    "efcustom_text_roletype": "efcustomTextRoletype",
    "efcustom_text_employment_type": "efcustomTextEmploymentType",
}


def _place(r: Column) -> Column:
    many = F.transform(F.from_json(r["locations"], "array<string>"), lambda x: F.trim(x))
    joined = F.array_join(F.filter(many, lambda x: x != ""), ", ")
    return filled(F.trim(r["location"]), joined)


def _link(r: Column, base_url: str) -> Column:
    relative = r["positionUrl"]
    absolute = F.when(relative.rlike("^https?://"), F.trim(relative)).otherwise(
        F.concat(F.lit(base_url), relative)
    )
    return filled(F.trim(r["publicUrl"]), F.when(F.trim(relative) != "", absolute))


def normalize_microsoft(
    raw: DataFrame, base_url: str = fixed.MICROSOFT_BASE_URL, domain: str = fixed.MICROSOFT_DOMAIN
) -> DataFrame:
    """Listings of (payload) rows, plus ``position_id``, the id that details
    are looked up by (blank when only the other id is known)."""
    r = F.col("record")
    words = [F.nullif(r[n], F.lit("")) for n in ("department", "workLocationOption", "locationFlexibility")]
    return as_listings(
        good_records(raw, ("data", "positions"), POSITION),
        F.trim(filled(r["id"])).alias("position_id"),
        title=filled(r["name"], default="Unknown"),
        company=F.lit("Microsoft"),
        location=_place(r),
        url=_link(r, base_url),
        description=F.trim(F.array_join(F.array(*words), " ")),
        source=F.lit("microsoft"),
        posted_date=parse_instant(r["postedTs"], "epoch_s"),
        job_id=filled(r["id"], r["atsJobId"]),
        team=filled(r["department"]),
        metadata=text_map(
            domain=F.lit(domain),
            standardized_locations=r["standardizedLocations"], stars=r["stars"],
            is_hot=r["isHot"], solr_score=r["solrScore"],
            **{name: r[field] for name, field in KEPT_METADATA.items()},
        ),
    )


def position_details(raw: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """(position_id, detail, detail_fields) of landed (position_id, payload)
    detail responses: the first per position by ``order``, a total one over
    columns of ``raw``, of those with at least one field."""
    rows = raw.withColumn("data", F.from_json("payload", "struct<data: string>")["data"])
    rows = rows.withColumn("detail_fields", F.json_object_keys("data")).where(
        F.size("detail_fields") > 0
    )
    return first_per(rows, ["position_id"], order).select(
        "position_id", F.from_json("data", DETAIL).alias("detail"), "detail_fields"
    )


def enrich_with_details(
    summaries: DataFrame, raw_details: DataFrame, order: Sequence[Column | str],
    base_url: str = fixed.MICROSOFT_BASE_URL,
) -> DataFrame:
    """Overlay detail records on summaries with the same position id; ``order``
    decides which of several records counts.

    A detail field wins when it is not blank; company, source and id stay.
    Metadata fields win as soon as the details hold them, even as null.
    Summaries without details pass unchanged.
    """
    d = F.col("detail")
    merged = d.isNotNull()
    base = F.col("metadata")
    override = F.create_map(
        *[x for name, field in KEPT_METADATA.items() for x in (
            F.lit(name),
            F.when(F.array_contains("detail_fields", field), d[field]).otherwise(base[name]),
        )],
        *[x for name, field in DETAIL_METADATA.items() for x in (F.lit(name), d[field])],
    )
    untouched = F.map_filter(base, lambda k, _: ~k.isin(*KEPT_METADATA, *DETAIL_METADATA))
    posted = F.coalesce(parse_instant(d["postedTs"], "epoch_s"), F.col("posted_date"))

    def pick(column: str, value: Column) -> Column:
        return F.when(merged, value).otherwise(F.col(column)).alias(column)

    columns = {
        "title": pick("title", filled(d["name"], F.col("title"))),
        "location": pick("location", filled(_place(d), F.col("location"))),
        "url": pick("url", filled(_link(d, base_url), F.col("url"))),
        "description": computed_once(F.when(
            merged, clean_html(filled(d["jobDescription"], F.col("description")))
        ).otherwise(F.col("description"))).alias("description"),
        "posted_date": pick("posted_date", posted),
        "team": pick("team", filled(d["department"], F.col("team"))),
        "metadata": pick("metadata", F.map_concat(untouched, override)),
    }
    # Summaries without an id have no details; keys made of their content
    # spread them over the tasks instead of having them meet in one.
    content = F.xxhash64("job_id", "title", "location", "url", "description", "posted_date").cast("string")
    no_id = F.concat(F.lit("\x00"), content)
    keyed = summaries.withColumn("_id", F.coalesce(F.nullif(F.col("position_id"), F.lit("")), no_id))
    details = position_details(raw_details, order).withColumnRenamed("position_id", "_id")
    joined = keyed.join(details, "_id", "left")
    return joined.select(*[columns.get(c, F.col(c)) for c in summaries.columns])


def detailed_listings(
    raw: DataFrame, raw_details: DataFrame, order: Sequence[Column | str], queries=(),
    vocab: Vocabulary | None = None,
) -> DataFrame:
    """Search results with details.  The intent test runs on the summaries, so
    that only wanted rows are joined, and again on the merged rows."""
    wanted = matching_intent(normalize_microsoft(raw), queries, vocab)
    return matching_intent(enrich_with_details(wanted, raw_details, order), queries, vocab)
