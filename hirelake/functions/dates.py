"""Instants.  All of them are UTC; sessions run with timeZone=UTC."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from hirelake.functions.words import bind

# Accepted text shapes and output formats.
ISO_SHAPE = (
    r"^\d{4}-\d{2}-\d{2}"
    r"([T ]\d{2}(:\d{2}(:\d{2}([.,]\d+)?)?)?(Z|[+-]\d{2}:?\d{2}(:?\d{2})?)?)?$"
)
LONG_MONTH, SHORT_MONTH = "MMMM d, yyyy", "MMM d, yyyy"
DAY_STAMP, MINUTE_STAMP, DIGEST_DAY = "yyyy-MM-dd", "yyyy-MM-dd HH:mm", "MMM dd"

_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def instant(at: datetime | date | str | Column) -> Column:
    """A literal instant; naive values are UTC, whatever the driver's zone is."""
    if isinstance(at, Column):
        return at
    if isinstance(at, str):
        at = datetime.fromisoformat(at.replace("Z", "+00:00"))
    if not isinstance(at, datetime):
        at = datetime(at.year, at.month, at.day)
    if at.tzinfo is None:
        at = at.replace(tzinfo=timezone.utc)
    return F.timestamp_micros(F.lit((at - _EPOCH) // timedelta(microseconds=1)).cast("bigint"))


def _from_iso(text: Column) -> Column:
    def read(iso: Column) -> Column:
        # Hour-only times, offsets without a colon and decimal commas are not
        # read as they are; they take the longer way.
        longer = F.regexp_replace(iso, r"^(.{10}[T ]\d{2})(?=$|Z|[+-])", "$1:00")
        longer = F.regexp_replace(longer, r"([+-]\d{2})(\d{2})$", "$1:$2")
        longer = F.translate(longer, ",", ".")
        parsed = F.coalesce(F.try_to_timestamp(iso), F.try_to_timestamp(longer))
        return F.when(iso.rlike(ISO_SHAPE), parsed)

    return bind(F.trim(text), read)


def _from_seconds(value: Column) -> Column:
    return F.timestamp_seconds(value.try_cast("bigint"))


def _from_millis(value: Column) -> Column:
    whole = F.coalesce(value.try_cast("bigint"), value.try_cast("double").try_cast("bigint"))
    return F.when(whole != 0, F.timestamp_millis(whole))


def _from_month_name(text: Column) -> Column:
    text = F.trim(text)
    short = F.try_to_timestamp(text, F.lit(SHORT_MONTH))
    # A failing parse costs far more than this test, and "May" is the one name that has three letters in full.
    return F.when(text.rlike("^[A-Za-z]{3} "), short).otherwise(
        F.coalesce(F.try_to_timestamp(text, F.lit(LONG_MONTH)), short)
    )


_READERS = {
    "iso": _from_iso,
    "epoch_s": _from_seconds,
    "epoch_ms": _from_millis,
    "month_name": _from_month_name,
}


def parse_instant(value: Column, kind: str) -> Column:
    """Read ``value`` as ``iso``, ``epoch_s``, ``epoch_ms`` or ``month_name``;
    NULL where it cannot be read.  A zero millisecond stamp means "no date"."""
    return _READERS[kind](value)


def age_days(ts: Column, as_of) -> Column:
    """Whole days elapsed, rounded down, so negative for the future."""
    micros = F.unix_micros(instant(as_of)) - F.unix_micros(ts.cast("timestamp"))
    return F.floor(micros / F.lit(86_400_000_000)).cast("bigint")


def _wall_clock(text: Column) -> Column:
    return F.regexp_replace(text, r"^(.{10}[T ][\d:.,]+)(Z|[+-][\d:]+)$", "$1")


def date_label(text: Column) -> Column:
    """Browse label of an ISO text: "Unknown" when blank, the day at midnight,
    the minute otherwise, the first 19 characters when unreadable.  The wall
    clock of the text is shown, without moving it to another zone."""
    text = F.trim(F.coalesce(text, F.lit("")))
    wall = _wall_clock(text)
    ts = _from_iso(wall)
    midnight = F.unix_micros(ts) % F.lit(86_400_000_000) == 0
    return (
        F.when(text == "", F.lit("Unknown"))
        .when(~text.rlike(ISO_SHAPE) | ts.isNull(), F.left(text, F.lit(19)))
        .when(midnight, F.date_format(ts, DAY_STAMP))
        .otherwise(F.date_format(ts, MINUTE_STAMP))
    )


def instant_label(ts: Column) -> Column:
    """``date_label`` of a stored instant."""
    midnight = F.unix_micros(ts) % F.lit(86_400_000_000) == 0
    return (
        F.when(ts.isNull(), F.lit("Unknown"))
        .when(midnight, F.date_format(ts, DAY_STAMP))
        .otherwise(F.date_format(ts, MINUTE_STAMP))
    )


def report_stamp(text: Column) -> Column:
    """Report label of an ISO text: the minute, the raw text when unreadable,
    "" when blank."""
    text = F.trim(F.coalesce(text, F.lit("")))
    wall = _wall_clock(text)
    ts = F.when(text.rlike(ISO_SHAPE), _from_iso(wall))
    return F.coalesce(F.date_format(ts, MINUTE_STAMP), text)


def digest_day(ts: Column) -> Column:
    """Digest label: abbreviated month and day, "" when unknown."""
    return F.coalesce(F.date_format(ts, DIGEST_DAY), F.lit(""))
