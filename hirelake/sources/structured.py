"""Job pages with embedded JSON-LD."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirelake import fixed
from hirelake.functions.dates import parse_instant
from hirelake.functions.text import drop_tags, unescape_each, unescape_html, url_id
from hirelake.sources.payloads import as_listings, computed_once, filled, text_map

# A comment swallows the scripts inside it.
SCRIPT_OR_COMMENT = r"(?is)<!--.*?-->|<script\b([^>]*)>(.*?)</script\s*>"
LD_TYPE = r"""(?:^|\s)(?i:type)\s*=\s*["']?application/ld\+json["']?(?=\s|/|$)"""
PAGE_TITLE = r"(?is)<title\b[^>]*>(.*?)</title\s*>"
META_DESCRIPTION = r"""(?is)<meta\b[^>]*\bname\s*=\s*["']?description["'\s/>][^>]*>"""
CONTENT_ATTRIBUTE = r"""(?is)\bcontent\s*=\s*(?:"([^"]*)"|'([^']*)')"""

_NATIVE_LEVELS = 2
# Shapes that may nest deeper than the native walk goes.
_DEEP = r'(?s)[\[,]\s*\[|"@graph".*"@graph"'


def _walk(item: Column, levels: int) -> Column:
    """``item`` and what it contains, in document order."""
    children = F.coalesce(
        F.try_variant_get(item, "$", "array<variant>"),
        F.try_variant_get(item, '$["@graph"]', "array<variant>"),
    )
    if not levels:
        return F.array(item)
    below = F.flatten(F.transform(children, lambda c: _walk(c, levels - 1)))
    return F.when(children.isNull(), F.array(item)).otherwise(F.concat(F.array(item), below))


def _deep_posting():
    """Batch function over scripts of any depth; shipped by value."""

    def in_order(payload) -> Iterator[dict]:
        stack = [payload]
        while stack:
            item = stack.pop()
            if isinstance(item, dict):
                yield item
                graph = item.get("@graph")
                item = graph if isinstance(graph, list) else []
            if isinstance(item, list):
                stack.extend(reversed(item))

    def first(bodies) -> str | None:
        for body in bodies:
            try:
                payload = json.loads(body, parse_constant=lambda _: None)
            except ValueError:
                continue
            for item in in_order(payload):
                if item.get("@type") == "JobPosting":
                    return json.dumps(item, ensure_ascii=False)
        return None

    def postings(scripts: pd.Series) -> pd.Series:
        return scripts.map(first, na_action="ignore")

    # Non-deterministic on paper: filters on a posting must not repeat its search.
    return F.pandas_udf(postings, T.StringType()).asNondeterministic()


def ld_scripts(html: Column) -> Column:
    """Bodies of the JSON-LD scripts, in page order, blank ones left out."""
    tags = F.regexp_extract_all(html, F.lit(SCRIPT_OR_COMMENT), F.lit(1))
    bodies = F.regexp_extract_all(html, F.lit(SCRIPT_OR_COMMENT), F.lit(2))
    wanted = F.zip_with(tags, bodies, lambda t, b: F.when(t.rlike(LD_TYPE) & (F.trim(b) != ""), b))
    return F.array_compact(wanted)


def first_posting(scripts: Column) -> Column:
    """First JobPosting object of the scripts as a VARIANT, NULL without one.

    Everything up to a graph within a list is walked in the JVM.  Scripts that
    may nest deeper, or that only a more lenient JSON reader takes, go to a
    batch function, which sees NULL for all other pages.
    """
    parsed = F.transform(scripts, lambda b: F.try_parse_json(b))
    items = F.flatten(F.transform(F.array_compact(parsed), lambda v: _walk(v, _NATIVE_LEVELS)))
    is_posting = lambda v: F.try_variant_get(v, '$["@type"]', "string") == "JobPosting"
    native = F.try_element_at(F.filter(items, is_posting), F.lit(1))
    other = F.exists(scripts, lambda b: b.rlike(_DEEP) | F.try_parse_json(b).isNull())
    deep = F.try_parse_json(_deep_posting()(F.when(other, scripts)))
    return F.when(other, deep).otherwise(native)


def jsonld_postings(pages: DataFrame) -> DataFrame:
    """Pages that carry a JobPosting, with it as VARIANT column ``posting``.
    Row-wise: nothing is exploded or shuffled."""
    return (
        pages.where(F.col("html").contains("ld+json"))
        .withColumn("_scripts", ld_scripts(F.col("html")))
        .where(F.size("_scripts") > 0)
        .withColumn("posting", first_posting(F.col("_scripts")))
        .where(F.col("posting").isNotNull())
        .drop("_scripts")
    )


def _text(item: Column, path: str) -> Column:
    """Text at ``path``; the elements of a list are joined by spaces."""
    many = F.try_variant_get(item, path, "array<string>")
    one = F.try_variant_get(item, path, "string")
    return F.coalesce(F.array_join(F.filter(many, lambda x: x != ""), " "), one, F.lit(""))


def _country(item: Column) -> Column:
    """Countries of one address: a text, a named object or a list."""
    path = "$.address.addressCountry"
    one = F.try_variant_get(item, path, "string")
    named = F.try_variant_get(item, path + ".name", "string")
    return F.coalesce(
        F.when(named.isNotNull(), F.array(named)),
        F.try_variant_get(item, path, "array<string>"),
        F.when(~one.startswith("{"), F.array(one)),
    )


def _as_list(posting: Column, path: str, kind: str) -> Column:
    one = F.try_variant_get(posting, path, kind)
    return F.coalesce(
        F.try_variant_get(posting, path, f"array<{kind}>"),
        F.when(one.isNotNull(), F.array(one)),
        F.array().cast(f"array<{kind}>"),
    )


_SEP = "\x1f"


def _joined(parts: Column, sep: str) -> Column:
    return F.array_join(F.filter(parts, lambda p: F.coalesce(p, F.lit("")) != ""), sep)


def _clean_each(texts: Column) -> Column:
    return F.transform(unescape_each(texts), lambda t: drop_tags(F.coalesce(t, F.lit(""))))


def with_location(df: DataFrame) -> DataFrame:
    """Add ``location``: the places' names, or locality, region and country,
    distinct and in order."""
    def place(item: Column) -> Column:
        one_country = F.array_join(F.coalesce(
            F.filter(_country(item), lambda c: c.isNotNull()), F.array().cast("array<string>")), _SEP)
        return F.array(
            _text(item, "$.name"), _text(item, "$.address.addressLocality"),
            _text(item, "$.address.addressRegion"), one_country,
        )

    items = _as_list(F.col("posting"), "$.jobLocation", "variant")
    texts = unescape_each(F.flatten(F.transform(items, place)))
    parts = df.select("*", computed_once(texts).alias("_parts"))

    def text_at(i: Column) -> Column:
        return drop_tags(F.element_at("_parts", i))

    def label(i: Column) -> Column:
        countries = F.transform(F.split(F.element_at("_parts", i + 3), _SEP), drop_tags)
        address = F.array(text_at(i + 1), text_at(i + 2), _joined(countries, ", "))
        return filled(text_at(i), _joined(address, ", "))

    count = F.size("_parts")
    starts = F.when(count > 0, F.sequence(F.lit(1), count, F.lit(4)))
    labels = F.array_distinct(F.transform(starts, label))
    return parts.withColumn("location", F.coalesce(_joined(labels, ", "), F.lit(""))).drop("_parts")


def normalize_structured(
    pages: DataFrame,
    sitemap: DataFrame | None = None,
    company: str = "Meta",
    source: str = "meta",
    generic_title: str = fixed.STRUCTURED_GENERIC_TITLE,
    id_pattern: str = fixed.STRUCTURED_ID_PATTERN,
) -> DataFrame:
    """Listings of (url, html) pages; ``sitemap`` (url, lastmod) supplies the
    date of postings without one.  Pages left without a title, or with the
    site's generic one, are dropped."""
    p = F.col("posting")
    fields = {
        "title": "$.title", "description": "$.description", "responsibilities": "$.responsibilities",
        "qualifications": "$.qualifications", "posted": "$.datePosted",
        "organization": "$.hiringOrganization.name", "valid_through": "$.validThrough",
    }
    texts = unescape_each(F.array(*[_text(p, path) for path in fields.values()]))
    cleaned = {name: drop_tags(F.element_at("_texts", i + 1)) for i, name in enumerate(fields)}

    meta_tag = F.regexp_extract(F.col("html"), META_DESCRIPTION, 0)
    meta_text = F.concat(
        F.regexp_extract(meta_tag, CONTENT_ATTRIBUTE, 1), F.regexp_extract(meta_tag, CONTENT_ATTRIBUTE, 2)
    )
    page_title = F.regexp_extract(F.col("html"), PAGE_TITLE, 1)

    found = jsonld_postings(pages).select("*", computed_once(texts).alias("_texts"))
    found = found.select("*", *[c.alias(f"_{name}") for name, c in cleaned.items()]).drop("_texts")
    # Page texts are markup: their entities are read once as such, and once
    # more by the cleaning every text gets.
    fallback = {"_page_title": ("_title", page_title), "_page_description": ("_body", meta_text)}
    parts = F.array(
        F.col("_description"),
        F.when(F.col("_responsibilities") != "", F.concat(F.lit("Responsibilities: "), "_responsibilities")),
        F.when(F.col("_qualifications") != "", F.concat(F.lit("Qualifications: "), "_qualifications")),
    )
    found = found.withColumn("_body", F.trim(_joined(parts, " ")))
    for name, (needed_by, raw) in fallback.items():
        wanted = F.when(F.col(needed_by) == "", raw)
        text = drop_tags(unescape_html(unescape_html(wanted)))
        found = found.select("*", computed_once(text).alias(name))
    found = with_location(found)

    jobs = found.withColumn("_title", filled(F.col("_title"), F.col("_page_title"))).where(
        (F.col("_title") != "") & (F.lower("_title") != generic_title)
    )
    if sitemap is not None:
        dates = sitemap.groupBy("url").agg(F.max("lastmod").alias("lastmod"))
        jobs = jobs.join(dates, "url", "left")
    else:
        jobs = jobs.withColumn("lastmod", F.lit(None).cast("timestamp"))

    kinds = _joined(_clean_each(_as_list(p, "$.employmentType", "string")), ", ")
    return as_listings(
        jobs,
        title=F.col("_title"),
        company=F.lit(company),
        location=F.col("location"),
        url=F.col("url"),
        description=filled(F.col("_body"), F.col("_page_description")),
        source=F.lit(source),
        posted_date=F.coalesce(parse_instant(F.col("_posted"), "iso"), F.col("lastmod")),
        job_id=url_id(F.col("url"), id_pattern),
        team=F.col("_organization"),
        metadata=text_map(
            valid_through=F.col("_valid_through"),
            employment_type=kinds,
            direct_apply=F.try_variant_get(p, "$.directApply", "string"),
            hiring_organization=F.col("_organization"),
        ),
    )
