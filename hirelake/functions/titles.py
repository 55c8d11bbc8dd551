"""Seniority, role and required-years heuristics."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from hirelake import fixed
from hirelake.functions.words import bind, captures, contains_any

_INT_MAX = float(2**31 - 1)


def digits_to_int(text: Column) -> Column:
    """Digits as INT; numbers past the type's range stay at its maximum."""
    number = text.try_cast("double")
    return F.when(number > _INT_MAX, F.lit(_INT_MAX)).otherwise(number).cast("int")


def required_years(text: Column, patterns: Iterable[str] = fixed.REQUIRED_YEARS) -> Column:
    """Largest number of years any pattern finds, NULL when none does."""
    # One cheap search spares most texts the four expensive ones.
    needed = "(?i)year|yoe" if patterns is fixed.REQUIRED_YEARS else "(?U)\\d"

    def largest(plain: Column) -> Column:
        return F.array_max(F.transform(captures(plain, patterns, "(?iU)"), digits_to_int))

    return F.when(text.rlike(needed), bind(F.translate(text, "\xa0\u200b", "  "), largest))


def infer_seniority(
    title: Column,
    senior: Iterable[str] = fixed.SENIOR_TERMS,
    mid: Iterable[str] = fixed.MID_TERMS,
    entry: Iterable[str] = fixed.ENTRY_TERMS,
) -> Column:
    """Level of a lower-cased title.  Terms match anywhere, numerals as words;
    the first rule that fires decides."""
    return (
        F.when(contains_any(title, senior) | title.rlike("(?U)" + fixed.SENIOR_NUMERAL), F.lit("senior"))
        .when(contains_any(title, mid) | title.rlike("(?U)" + fixed.MID_NUMERAL), F.lit("mid"))
        .when(contains_any(title, entry) | title.rlike("(?U)" + fixed.ENTRY_NUMERAL), F.lit("entry"))
    )


def is_wanted_role(
    title: Column,
    terms: Iterable[str] = fixed.ROLE_TERMS,
    excludes: Iterable[str] = fixed.ROLE_EXCLUDES,
) -> Column:
    return contains_any(title, terms) & ~contains_any(title, excludes)
