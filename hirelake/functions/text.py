"""Text cleaning and shortening."""

from __future__ import annotations

import html
import json
import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache, reduce
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from hirelake import fixed

# Whitespace as text tools usually see it: Unicode spaces plus the four
# information separators, which Java's class leaves out.
SPACE_RUN = "(?U)[\\s\x1c-\x1f]+"
# The same characters one by one.
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
TAG = "<[^>]+>"
_NON_ASCII = r"([^\x00-\x7F])"

# Entities most texts stop at; the ampersand must come last.
COMMON_ENTITIES = {
    "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'",
    "&nbsp;": "\xa0", "&copy;": "©", "&middot;": "·", "&bull;": "•",
    "&ndash;": "–", "&mdash;": "—", "&lsquo;": "‘", "&rsquo;": "’",
    "&ldquo;": "“", "&rdquo;": "”", "&hellip;": "…", "&amp;": "&",
}
# An ampersand that starts none of them.
_OTHER_ENTITY = "&(?!" + "|".join(e[1:] for e in COMMON_ENTITIES) + ")"
# Names that also count without their semicolon, longest first.
_OPEN_NAME = "^(?:" + "|".join(
    sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))) + ")"
_UNKNOWN = "\ufffd"
_PAST_UNICODE = 0x110000


@lru_cache(maxsize=1)
def _entity_table() -> str:
    """JSON of {first letter: {name: text}}; "#" holds the numbers below 160,
    which do not all stand for their own code point."""
    table: dict[str, dict[str, str]] = {
        "#": {str(n): html.unescape(f"&#{n};") for n in range(0xA0)}
    }
    for name, text in html5.items():
        table.setdefault(name[0], {})[name] = text
    return json.dumps(table)


def _entity(group: Column, name: Column) -> Column:
    # Two short look-ups: a map is searched from its start.
    table = F.from_json(F.lit(_entity_table()), "map<string,map<string,string>>")
    return F.try_element_at(F.try_element_at(table, group), name)


def _char(code: Column) -> Column:
    """The character a numeric reference stands for."""
    def units(*values: Column) -> Column:
        words = [F.lpad(F.hex(v), 4, "0") for v in values]
        return F.decode(F.unhex(F.concat(*words)), "UTF-16BE")

    above = code - 0x10000
    pair = units(F.shiftright(above, 10) + 0xD800, above.bitwiseAND(0x3FF) + 0xDC00)
    no_character = code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(0xFFFE) == 0xFFFE)
    return (
        F.when(code < 0xA0, _entity(F.lit("#"), code.cast("string")))
        .when(code.between(0xD800, 0xDFFF) | (code >= _PAST_UNICODE), F.lit(_UNKNOWN))
        .when(no_character, F.lit(""))
        .when(code < 0x10000, units(code))
        .otherwise(pair)
    )


def _decoded(part: Column) -> Column:
    """``part``, the text behind an ampersand, with the reference it may start
    with decoded; the ampersand comes back where there is none."""
    def number(pattern: str, base: int, digits: int) -> Column:
        found = F.regexp_extract(part, pattern, 1)
        code = F.conv(found, base, 10).try_cast("int")
        return F.when(F.length(found) > digits, F.lit(_PAST_UNICODE)).when(found != "", code)

    def taken(pattern: str, text: Callable[[Column], Column]) -> Column:
        found = F.regexp_extract(part, pattern, 0)
        return F.concat(text(found), F.substring(part, F.length(found) + 1, F.length(part)))

    code = F.coalesce(number("^#0*([0-9]+)", 10, 7), number("^#[xX]0*([0-9a-fA-F]+)", 16, 6))
    return F.coalesce(
        taken("^[A-Za-z0-9]{1,32};", lambda name: _entity(F.left(name, F.lit(1)), name)),
        taken(_OPEN_NAME, lambda name: _entity(F.left(name, F.lit(1)), name)),
        taken("^#(?:[0-9]+|[xX][0-9a-fA-F]+);?", lambda _: _char(code)),
        F.concat(F.lit("&"), part),
    )


def unescape_html(text: Column) -> Column:
    """Unescape HTML entities once: every name of HTML 5 and numbers, with the
    lenient reading of missing semicolons and numbers that are no character.

    Texts that hold only common entities are done by plain replacement.  A
    reference never reaches past the next ampersand, so the others are split
    there and decoded part by part.
    """
    replaced = reduce(
        lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), COMMON_ENTITIES.items(), text
    )
    parts = F.split(text, "&")
    rest = F.transform(F.slice(parts, 2, F.size(parts)), _decoded)
    decoded = F.concat(F.get(parts, F.lit(0)), F.array_join(rest, ""))
    return F.when(text.rlike(_OTHER_ENTITY), decoded).when(text.contains("&"), replaced).otherwise(text)


def unescape_each(texts: Column) -> Column:
    """``unescape_html`` of every element of an array."""
    return F.transform(texts, unescape_html)


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE_RUN, " "))


def drop_tags(text: Column) -> Column:
    """Tags become spaces, then whitespace collapses."""
    return collapse_spaces(F.regexp_replace(text, TAG, " "))


def clean_html(text: Column) -> Column:
    """Plain text of an HTML fragment.  Entities go first, so that an escaped
    tag is dropped like a written one."""
    return drop_tags(unescape_html(text))


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """Compatibility folding derived from the Unicode database: characters
    with a one-letter ASCII form, those letters, and the longer forms."""
    one, letters, longer = [], [], {}
    for code in range(0x80, sys.maxunicode + 1):
        char = chr(code)
        if not unicodedata.decomposition(char):
            continue
        ascii_form = unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode()
        if len(ascii_form) == 1:
            one.append(char)
            letters.append(ascii_form)
        elif ascii_form:
            longer[char] = ascii_form
    return "".join(one), "".join(letters), longer


def ascii_fold(text: Column) -> Column:
    """Lower-case ASCII form: accents and compatibility forms are reduced to
    their letters, everything else outside ASCII is dropped."""
    one, letters, longer = _fold_tables()
    # Most texts are done after the first steps; only what is still outside
    # ASCII is looked up character by character.
    single = F.translate(text, one, letters)
    rest = F.array_distinct(F.regexp_extract_all(single, F.lit(_NON_ASCII), F.lit(1)))
    table = F.from_json(F.lit(json.dumps(longer)), "map<string,string>")
    expanded = F.aggregate(
        F.filter(rest, lambda c: F.map_contains_key(table, c)),
        single,
        lambda out, c: F.replace(out, c, F.try_element_at(table, c)),
    )
    folded = F.when(single.rlike(_NON_ASCII), F.regexp_replace(expanded, _NON_ASCII, ""))
    folded = folded.otherwise(single)
    return F.lower(F.when(text.rlike(_NON_ASCII), folded).otherwise(text))


def url_id(url: Column, pattern: str = fixed.STRUCTURED_ID_PATTERN) -> Column:
    """Digits captured by ``pattern``, else ""."""
    return F.regexp_extract(url, pattern, 1)


def safe_url(url: Column) -> Column:
    """Trimmed http(s) URL, "#" for anything else."""
    url = F.trim(url)
    return F.when(url.rlike("(?i)^https?://"), url).otherwise(F.lit("#"))


def snippet(text: Column, max_len: int = 200) -> Column:
    """Leading sentences of the cleaned text.

    A sentence is added with its ". " while the text so far plus the sentence
    fits; the first one that does not fit ends it.  With nothing taken, the
    first ``max_len`` characters and "..." are returned.
    """
    clean = clean_html(text)

    def take(acc: Column, sentence: Column) -> Column:
        stop = acc["stop"] | (F.length(acc["out"]) + F.length(sentence) > max_len)
        out = F.when(stop, acc["out"]).otherwise(F.concat(acc["out"], sentence, F.lit(". ")))
        return F.struct(out.alias("out"), stop.alias("stop"))

    start = F.struct(F.lit("").alias("out"), F.lit(False).alias("stop"))
    taken = F.aggregate(F.split(clean, r"\. "), start, take, lambda acc: F.trim(acc["out"]))
    fallback = F.concat(F.left(clean, F.lit(max_len)), F.lit("..."))
    whole = F.coalesce(F.nullif(taken, F.lit("")), fallback)
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit("")).otherwise(whole)


def compact_text(text: Column, limit: int = 240) -> Column:
    """Whitespace collapsed; cut to ``limit`` with "..." when longer."""
    flat = collapse_spaces(F.coalesce(text, F.lit("")))
    cut = F.concat(F.rtrim(F.left(flat, F.lit(limit - 3))), F.lit("..."))
    return F.when(F.length(flat) <= limit, flat).otherwise(cut)
