"""Location heuristics on lower-cased location text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column

from hirelake import fixed
from hirelake.functions.text import ascii_fold
from hirelake.functions.words import bind, contains_any, word_any

# Markers this short must stand alone as words.
WORD_MARKER_CHARS = 3


def has_foreign_marker(
    location: Column, markers: Iterable[str] = fixed.FOREIGN_MARKERS, folded: Column | None = None
) -> Column:
    """A foreign place is named.  Long markers match anywhere in the folded
    text ("indiana" holds "india"); short ones only as whole words, in the
    raw or the folded text."""
    if folded is None:
        return bind(ascii_fold(location), lambda x: has_foreign_marker(location, markers, x))
    markers = list(markers)
    short = [m for m in markers if len(m) <= WORD_MARKER_CHARS]
    long = [m for m in markers if len(m) > WORD_MARKER_CHARS]
    return contains_any(folded, long) | word_any(location, short) | word_any(folded, short)


def looks_domestic(
    location: Column,
    phrases: Iterable[str] = fixed.DOMESTIC_PHRASES,
    states: Iterable[str] = fixed.STATE_CODES,
    cities: Iterable[str] = fixed.DOMESTIC_CITIES,
    markers: Iterable[str] = fixed.FOREIGN_MARKERS,
    folded: Column | None = None,
) -> Column:
    """No foreign marker, and a country phrase, a state code word or a city."""
    if folded is None:
        return bind(
            ascii_fold(location),
            lambda x: looks_domestic(location, phrases, states, cities, markers, x),
        )
    named = contains_any(folded, phrases) | word_any(folded, states) | contains_any(folded, cities)
    return ~has_foreign_marker(location, markers, folded) & named


def is_remote(location: Column, remote_words: Iterable[str] = fixed.REMOTE_WORDS) -> Column:
    return contains_any(location, remote_words)
