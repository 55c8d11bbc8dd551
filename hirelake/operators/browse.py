"""Filter, sort, page and summarise the seen table."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass, replace
from datetime import date, timedelta
from functools import reduce
from math import isnan
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirelake import fixed
from hirelake.functions.dates import instant, instant_label
from hirelake.functions.labels import score_band, score_label
from hirelake.functions.text import compact_text
from hirelake.operators.order import with_position
from hirelake.session import materialize

SEARCHED = ("title", "company", "location", "source", "description")
LISTED = ("unique_key", "title", "company", "location", "url", "source", "posted_date",
          "first_seen", "score")

# Columns any sort order looks at, besides the one sorted by.
ORDERING = ("unique_key", "posted_date", "first_seen", "company")
# Sort fields that are texts.
TEXTS = ("company", "title", "location", "source")
# Bits of a long that two numbers may fill.
LONG_BITS = 62


def _text(value: Any) -> str:
    return str(value or "").strip()


def _day(value: Any) -> date | None:
    try:
        return date.fromisoformat(_text(value))
    except ValueError:
        return None


def _number(value: Any) -> float | None:
    try:
        return float(_text(value))
    except ValueError:
        return None


def _count(value: Any, default: int) -> int:
    try:
        return int(value)
    except (TypeError, ValueError):
        return default


@dataclass(frozen=True)
class BrowseQuery:
    """A browse request after clean-up; build it with ``from_params``."""

    q: str = ""
    company: str = ""
    location: str = ""
    source: str = ""
    posted_from: date | None = None
    posted_to: date | None = None
    first_seen_from: date | None = None
    first_seen_to: date | None = None
    min_score: float | None = None
    max_score: float | None = None
    sort: str = fixed.SORT_FIELDS[0]
    direction: str = "desc"
    page: int = 1
    page_size: int = fixed.PAGE_SIZE_DEFAULT

    @classmethod
    def from_params(cls, params: Mapping[str, Any] | None = None) -> BrowseQuery:
        """Unreadable dates and numbers count as absent, unknown sort keys and
        directions as the defaults; page numbers and sizes are brought into
        range.  ``search`` is another name of ``q``."""
        given = dict(params or {})
        sort = _text(given.get("sort"))
        direction = _text(given.get("direction")).lower()
        size = _count(given.get("page_size"), fixed.PAGE_SIZE_DEFAULT)
        return cls(
            q=_text(given.get("q") or given.get("search")),
            **{name: _text(given.get(name)) for name in ("company", "location", "source")},
            **{
                name: _day(given.get(name))
                for name in ("posted_from", "posted_to", "first_seen_from", "first_seen_to")
            },
            **{name: _number(given.get(name)) for name in ("min_score", "max_score")},
            sort=sort if sort in fixed.SORT_FIELDS else cls.sort,
            direction=direction if direction in ("asc", "desc") else cls.direction,
            page=max(1, _count(given.get("page"), 1)),
            page_size=max(1, min(fixed.PAGE_SIZE_MAX, size)),
        )


def like(column: str, text: str) -> Column:
    """Case-insensitive "contains"; % and _ in the text are wildcards, the
    backslash is an ordinary character."""
    return F.col(column).ilike("%" + text.replace("\\", "\\\\") + "%")


def text_search(text: str) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(like(c, text), F.lit(False)) for c in SEARCHED])


def within_days(column: str, start: date | None = None, end: date | None = None) -> Column:
    """Instant on a UTC day of the inclusive range.  Plain comparisons with
    literals, so they reach the Parquet scan."""
    tests = [F.col(column).isNotNull()]
    if start:
        tests.append(F.col(column) >= instant(start))
    if end:
        tests.append(F.col(column) < instant(end + timedelta(days=1)))
    return reduce(and_, tests)


def within_scores(low: float | None = None, high: float | None = None) -> Column:
    # NaN compares with nothing; as a bound it lets no listing through.
    if any(bound is not None and isnan(bound) for bound in (low, high)):
        return F.lit(False)
    tests = [F.col("score").isNotNull()]
    if low is not None:
        tests.append(F.col("score") >= low)
    if high is not None:
        tests.append(F.col("score") <= high)
    return reduce(and_, tests)


def condition(query: BrowseQuery) -> Column:
    """All filters of a request as one condition."""
    tests = []
    if query.q:
        tests.append(text_search(query.q))
    tests += [like(c, getattr(query, c)) for c in ("company", "location") if getattr(query, c)]
    if query.source:
        tests.append(F.col("source") == query.source)
    if query.posted_from or query.posted_to:
        tests.append(within_days("posted_date", query.posted_from, query.posted_to))
    if query.first_seen_from or query.first_seen_to:
        tests.append(within_days("first_seen", query.first_seen_from, query.first_seen_to))
    if query.min_score is not None or query.max_score is not None:
        tests.append(within_scores(query.min_score, query.max_score))
    return reduce(and_, tests) if tests else F.lit(True)


def flat(column: str) -> Column:
    return F.lower(F.coalesce(column, F.lit("")))


def _way(column: str, direction: str, nulls_last: bool = False) -> Column:
    name = direction if direction == "asc" else "desc"
    return getattr(F.col(column), f"{name}_nulls_last" if nulls_last else name)()


def sort_order(sort: str = "posted_date", direction: str = "desc") -> list[Column]:
    """Sort columns: unknown dates and scores last either way, texts without
    case, recent listings first among equals, the key as last resort."""
    recent = [_way("posted_date", "desc", True), F.col("first_seen").desc(), flat("company").asc()]
    last = [F.col("unique_key").asc()]
    if sort == "posted_date":
        return [_way(sort, direction, True), _way("first_seen", direction), flat("company").asc(), *last]
    if sort == "first_seen":
        return [_way(sort, direction), *recent, *last]
    if sort == "score":
        return [_way(sort, direction, True), *recent, *last]
    return [flat(sort).asc() if direction == "asc" else flat(sort).desc(), *recent, *last]


def all_listings(seen: DataFrame) -> DataFrame:
    return seen.select(*LISTED)


def recent_jobs(seen: DataFrame, limit: int = 100) -> DataFrame:
    """Newest listings by posting date, else by the date they were first seen."""
    n = max(1, min(limit, fixed.RECENT_MAX))
    newest = F.coalesce("posted_date", "first_seen").desc()
    return seen.orderBy(newest, "unique_key").limit(n)


def sort_jobs(
    seen: DataFrame, sort: str = "posted_date", direction: str = "desc", order: Sequence[Column] | None = None,
) -> DataFrame:
    """``order`` says the same over other columns, as ``Ranked.keyed`` gives it."""
    return seen.orderBy(*(sort_order(sort, direction) if order is None else order))


@dataclass(frozen=True)
class Ranked:
    """Listings made ready for many sorts, by ``ranked``.

    ``rows`` holds key, dates, score, each text as its number among all texts of
    its column, and ``recent``: the place by date, newest first, which is what
    every other order falls back on.  ``bits`` is the width of ``recent`` where
    it fits into one long beside a text's number.
    """

    rows: DataFrame
    bits: int | None

    def keyed(self, sort: str, direction: str) -> tuple[DataFrame, list[Column]]:
        """Keys with the columns that a sort looks at, and ``sort_order`` over those."""
        if sort in TEXTS:
            number = F.col(sort) if direction == "asc" else -F.col(sort)
            if self.bits is None:
                return self.rows.select("unique_key", number.alias("number"), "recent"), [F.col("number").asc(), F.col("recent").asc()]
            # Rows with a single number to sort by need no comparisons.
            place = F.shiftleft(number, self.bits) + F.col("recent")
            return self.rows.select("unique_key", place.alias("place")), [F.col("place").asc()]
        looked_at = [sort]
        if sort == "posted_date":
            looked_at = ["posted_date", "first_seen"] if direction == "asc" else []
        order = [_way(c, direction, c != "first_seen") for c in looked_at]
        return self.rows.select("unique_key", *looked_at, "recent"), [*order, F.col("recent").asc()]


def ranked(seen: DataFrame) -> Ranked:
    """Make listings ready for many sorts: texts are folded and compared once
    and become numbers, and one sort settles the order among equals."""
    kept = [c for c in dict.fromkeys((*ORDERING, *fixed.SORT_FIELDS)) if c not in TEXTS]
    rows = materialize(seen.select(*kept, *[flat(c).alias(c) for c in TEXTS]), "seen", "zstd")
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in TEXTS])
    texts = materialize(with_position(rows.select(F.inline(pairs)).distinct(), ["field", "value"]), "texts")
    for c in TEXTS:
        numbers = texts.where(F.col("field") == c).select(F.col("value").alias(c), F.col("position").alias("_number"))
        rows = rows.join(numbers, c).drop(c).withColumnRenamed("_number", c)
    order = [_way("posted_date", "desc", True), F.col("first_seen").desc(), F.col("company").asc(), F.col("unique_key").asc()]
    newest = with_position(sort_jobs(rows, "posted_date", "desc", order), order)
    newest = materialize(newest.withColumnRenamed("position", "recent"), "ranked", "zstd")
    bits = newest.count().bit_length()
    return Ranked(newest, bits if bits + texts.count().bit_length() <= LONG_BITS else None)


def query_summary(seen: DataFrame, query: BrowseQuery) -> DataFrame:
    """One row: both counts from one pass, the page brought into range, the
    number of pages and whether there are neighbours."""
    kept = F.coalesce(condition(query), F.lit(False))
    counts = seen.agg(
        F.count(F.lit(1)).alias("total_count"), F.count_if(kept).alias("filtered_count")
    )
    pages = F.greatest(F.lit(1), F.ceil(F.col("filtered_count") / query.page_size)).cast("bigint")
    return (
        counts.withColumn("page_count", pages)
        .withColumn("page", F.least(F.lit(query.page).cast("bigint"), F.col("page_count")))
        .withColumn("page_size", F.lit(query.page_size).cast("bigint"))
        .withColumn("has_previous", F.col("page") > 1)
        .withColumn("has_next", F.col("page") < F.col("page_count"))
    )


def page_items(seen: DataFrame, query: BrowseQuery, page: int) -> DataFrame:
    """Rows of one page, with their ``position`` in the whole result.

    Positions are worked out over the sort columns and the key alone, wherever
    the page lies; the page's keys, at most a page size, then fetch its rows.
    """
    rows = seen.where(condition(query))
    offset = (page - 1) * query.page_size
    keys = rows.select(*dict.fromkeys([*ORDERING, query.sort]))
    placed = with_position(keys, sort_order(query.sort, query.direction))
    wanted = placed.where(F.col("position").between(offset + 1, offset + query.page_size))
    return rows.join(F.broadcast(wanted.select("unique_key", "position")), "unique_key").select(*seen.columns, "position")


@dataclass(frozen=True)
class BrowseResult:
    query: BrowseQuery
    items: DataFrame
    summary: DataFrame


def query_jobs(
    seen: DataFrame, params: Mapping[str, Any] | None = None,
    matching: Callable[[BrowseQuery], DataFrame] | None = None,
) -> BrowseResult:
    """Answer a browse request.  Its page is read from ``matching`` of the
    request where given, as ``SeenTable.matching``, else from ``seen``.

    The requested page can lie behind the last one, so one counting job runs
    first and returns a single row.
    """
    asked = BrowseQuery.from_params(params)
    summary = query_summary(seen, asked)
    query = asked if asked.page == 1 else replace(asked, page=summary.first()["page"])
    rows = matching(query) if matching else seen
    return BrowseResult(query, page_items(rows, query, query.page), summary)


def facets(seen: DataFrame, limits: Mapping[str, int] = fixed.FACET_LIMITS) -> DataFrame:
    """(facet, position, value): distinct non-blank values by lower case.

    One scan serves all facets; values are made distinct before the shuffle.
    """
    pairs = F.array(*[F.struct(F.lit(n).alias("facet"), F.col(n).alias("value")) for n in limits])
    return first_values(seen.select(F.inline(pairs)).where(F.trim("value") != "").distinct(), limits)


def first_values(values: DataFrame, limits: Mapping[str, int]) -> DataFrame:
    """(facet, position, value) of distinct (facet, value) rows, blank ones
    left out.  Each task passes on at most the largest limit per facet."""
    place = F.row_number().over(Window.partitionBy("facet").orderBy(F.lower("value"), "value"))
    allowed = F.element_at(
        F.create_map(*[F.lit(x) for pair in limits.items() for x in pair]), F.col("facet")
    )
    return (
        values.where(F.trim("value") != "")
        .withColumn("position", place)
        .where(F.col("position") <= max(limits.values()))
        .where(F.col("position") <= allowed)
        .select("facet", "position", "value")
    )


def stats(seen: DataFrame, as_of) -> DataFrame:
    """One row: stored listings, those first seen on the as-of day, companies."""
    day = F.date_trunc("day", instant(as_of))
    today = (F.col("first_seen") >= day) & (F.col("first_seen") < day + F.expr("INTERVAL 1 DAY"))
    return seen.agg(
        F.count(F.lit(1)).alias("total_seen"),
        F.count_if(today).alias("added_today"),
        F.count_distinct("company").alias("unique_companies"),
    )


# Facets under their names in the bundle; null fields stay in it.
BUNDLE_FACETS = {"company": "companies", "location": "locations", "source": "sources"}
_JSON = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ssxxx"}


def query_json(query: BrowseQuery) -> str:
    """The cleaned request as JSON, absent values as ""."""
    given = {n: "" if v is None else v for n, v in asdict(query).items()}
    return json.dumps({n: str(v) if isinstance(v, date) or v != v else v for n, v in given.items()}, ensure_ascii=False)


def json_bundle(
    seen: DataFrame, params: Mapping[str, Any] | None, as_of, path: str = "", *,
    choices: DataFrame | None = None, totals: DataFrame | None = None,
    matching: Callable[[BrowseQuery], DataFrame] | None = None,
) -> DataFrame:
    """One row, column ``json``: ``db_path``, ``stats``, ``filters`` and
    ``result`` with its counts, the labelled ``items`` of the page and the
    cleaned ``query``.  Everything in it is bounded: a page, the facet limits
    and single rows.  ``choices`` and ``totals`` are facets and stats kept
    elsewhere, as by ``SeenTable.bundle``; else they are read from ``seen``."""
    answer = query_jobs(seen, params, matching)

    def part(name: str, df: DataFrame, body: Column) -> DataFrame:
        return df.agg(F.to_json(body, _JSON).alias("json")).select(F.lit(name).alias("name"), "json")

    items = browse_items(answer.items)
    shown = F.struct(*[c for c in items.columns if c != "position"])
    in_order = F.array_sort(F.collect_list(F.struct("position", shown.alias("item"))))
    page = F.transform(in_order, lambda x: x["item"])
    choices = facets(seen) if choices is None else choices
    of = F.array_sort(F.collect_list(F.struct("facet", "position", "value")))

    def values(facet: str) -> Column:
        mine = F.filter(of, lambda x: x["facet"] == facet)
        return F.transform(mine, lambda x: x["value"]).alias(BUNDLE_FACETS[facet])

    choice = F.struct(*[values(n) for n in fixed.FACET_LIMITS])

    def single(df: DataFrame) -> Column:
        return F.struct(*[F.first(c).alias(c) for c in df.columns])

    counts, total = answer.summary, stats(seen, as_of) if totals is None else totals
    parts = [
        part("stats", total, single(total)), part("filters", choices, choice),
        part("items", items, page), part("counts", counts, single(counts)),
    ]
    texts = reduce(DataFrame.unionByName, parts).agg(
        *[F.max(F.when(F.col("name") == n, F.col("json"))).alias(n) for n in ("stats", "filters", "items", "counts")]
    )
    return texts.select(F.concat(
        F.lit(f'{{"db_path":{json.dumps(path)},"stats":'), "stats", F.lit(',"filters":'), "filters", F.lit(',"result":'),
        F.rtrim(F.col("counts"), F.lit("}")), F.lit(',"items":'), "items", F.lit(f',"query":{query_json(answer.query)}}}}}'),
    ).alias("json"))


def title_case(text: Column) -> Column:
    """Every run of letters capitalised, also after digits and hyphens."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def browse_items(items: DataFrame) -> DataFrame:
    """Add the display columns of a result page."""

    def label(column: str, default: str) -> Column:
        return F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(default))

    return items.withColumns(
        {
            "title_label": label("title", "Untitled role"),
            "company_label": label("company", "Unknown company"),
            "location_label": label("location", "Unknown location"),
            "source_label": title_case(label("source", "unknown")),
            "posted_label": instant_label(F.col("posted_date")),
            "first_seen_label": instant_label(F.col("first_seen")),
            "score_label": score_label(F.col("score")),
            "score_band": score_band(F.col("score")),
            "description_preview": compact_text(F.col("description")),
        }
    )


def display_range(summary: DataFrame) -> DataFrame:
    """One row with the text above a result page."""
    start = (F.col("page") - 1) * F.col("page_size") + 1
    end = F.least(start + F.col("page_size") - 1, F.col("filtered_count"))
    shown = F.format_string("Showing %d-%d of %d", start, end, F.col("filtered_count"))
    return summary.select(
        F.when(F.col("filtered_count") == 0, F.lit("No matching jobs")).otherwise(shown).alias("display_range")
    )
