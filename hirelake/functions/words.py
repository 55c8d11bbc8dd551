"""Substring and word tests against lists known when the plan is built."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    Filters and conditional branches do not share common subexpressions, so a
    lowered or cleaned text used by many tests is bound to a lambda variable.
    """
    return F.transform(F.array(value), body)[0]


def contains_any(text: Column, terms: Iterable[str]) -> Column:
    """True when any term is a substring; stops at the first hit.  ``text``
    should be a plain or bound column.  The terms are one array literal: a chain
    of tests would be rewritten by every optimizer pass."""
    terms = list(dict.fromkeys(terms))
    if not terms:
        return F.lit(False)
    return F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(text, t))


def hits(text: Column, terms: Iterable[str], distinct: bool = True) -> Column:
    """How many (distinct) terms are substrings."""
    terms = list(dict.fromkeys(terms) if distinct else terms)
    if not terms:
        return F.lit(0)
    return F.size(F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(text, t)))


def quote(word: str) -> str:
    """``word`` as a literal inside a Java regular expression."""
    return re.sub(r"([^\w\s])", r"\\\1", word)


def word_any(text: Column, words: Iterable[str]) -> Column:
    """True when any word occurs between word boundaries."""
    words = list(words)
    if not words:
        return F.lit(False)
    return text.rlike(r"(?U)\b(?:" + "|".join(quote(w) for w in words) + r")\b")


def captures(text: Column, patterns: Iterable[str], flags: str = "") -> Column:
    """First-group captures of all patterns, pattern by pattern."""
    lists = [F.regexp_extract_all(text, F.lit(flags + p), F.lit(1)) for p in patterns]
    return lists[0] if len(lists) == 1 else F.concat(*lists)
