import html
import random
import re
import unicodedata
from datetime import datetime
from html.entities import html5

import pytest

from hirelake.functions.company import company_group
from hirelake.functions.dates import age_days, date_label, instant, parse_instant, report_stamp
from hirelake.functions.labels import score_band, score_label
from hirelake.functions.numbers import round1
from hirelake.functions.places import has_foreign_marker, looks_domestic
from hirelake.functions.text import ascii_fold, clean_html, compact_text, safe_url, snippet, unescape_each, unescape_html
from hirelake.functions.titles import infer_seniority, is_wanted_role, required_years


def test_clean_html_matches_a_plain_python_reading(value):
    texts = [
        "", "plain", "&lt;p&gt;Hi&lt;/p&gt;  you", "a &amp;lt;b&gt; c", "&eacute;t&eacute; &#8364; &#x41;", "R&D &ampx; &notit;",
        "<a href='x'>y</a>\n\tz\xa0 end\x1c.", "a < b > c", "&nbsp;&nbsp;x", "&amp;amp;lt;", "&bogus; &lt", "AT&amp;T &copy;",
    ]

    def plain(text):
        return re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", html.unescape(text))).strip()

    assert value(clean_html, texts) == [plain(t) for t in texts]
    assert value(clean_html, None) is None


def test_unescape_each_keeps_nulls_and_order(value):
    given = [["a &amp; b", None, "&eacute;"], [], None, ["&lt;"]]
    assert value(unescape_each, given, "array<string>") == [["a & b", None, "é"], [], None, ["<"]]


def test_every_entity_is_read_as_python_reads_it(value):
    names = sorted(html5)
    texts = [f"a &{n} b" for n in names] + [f"&{n}x;&{n}" for n in names] + [f"&{n[:-1]}=1&amp{n}" for n in names]
    assert value(unescape_html, texts) == [html.unescape(t) for t in texts]


def test_every_kind_of_number_is_read_as_python_reads_it(value):
    codes = [*range(0x180), 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDCF, 0xFDD0, 0xFDEF, 0xFDF0, 0xFEFF, 0xFFFD, 0xFFFE, 0xFFFF]
    codes += [0x10000, 0x1F600, 0x1FFFE, 0x1FFFF, 0x10FFFD, 0x10FFFF, 0x110000, 9999999, 10**7, 2**31, 2**64, 10**40]
    texts = [t for c in codes for t in (f"&#{c};", f"&#00{c}z", f"&#x{c:x};&#X0{c:X};", f"&#x{c:x} &#{c}&#{c};")]
    odd = ["&", "&&", "&#", "&#;", "&#x;", "&#xg;", "& amp;", "&;", "&#-1;", "&#٣;", "a&b&c;", "&lt&gt", "&#60&#62;"]
    odd += ["&" + "a" * 40 + ";", "&" + "lt" * 30, "&lt;" * 999 + "&eacute;", "&notin;&notinx;", "&amp;eacute;", "&é;"]
    texts += odd
    assert value(unescape_html, texts) == [html.unescape(t) for t in texts]


def test_ascii_fold_is_the_compatibility_fold_for_every_character(value):
    chars = [chr(c) for c in range(0x80, 0x3000)] + list("ﬁﬀ①⑩½™ＡＢ㎏ℌ𝐀𝟘")
    texts = ["".join(chars[i:i + 97]) for i in range(0, len(chars), 97)] + ["Türkiye", "straße", "ÀB", "", "İzmir"]

    def fold(text):
        return unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().lower()

    assert value(ascii_fold, texts) == [fold(t) for t in texts]


def test_round1_equals_exact_half_even_rounding(value):
    rng = random.Random(7)
    numbers = [rng.uniform(0, 100) for _ in range(3000)] + [k / 4 for k in range(400)] + [
        0.15, 0.25, 0.35, 66.25, 90.35, 2.675, 0.05, 1.45, 99.95, -0.25, -1.35, 49.95000000000001,
    ] + [k / 20 for k in range(2000)]
    assert value(round1, numbers, "double") == [round(x, 1) + 0.0 for x in numbers]
    assert value(round1, None, "double") is None


def test_company_group(value):
    names = ["  Amazon Web Services, Inc.", "GitHub", "Acme, Inc.", "Foo Corp. LLC", "Inc.", "Meta Platforms",
             "Metalworks Ltd", "Pineapple Co", "U.S. Steel", ""]
    assert value(company_group, names) == [
        "amazon", "microsoft", "acme", "foo", "inc.", "meta", "meta", "apple", ". steel", "",
    ]


def test_required_years_takes_the_largest(value):
    texts = ["5+ years of professional experience and 10 years experience", "experience: 7 years", "3 YOE", "none",
             "12\xa0years​of experience", "2 years", "99999999999 years experience", None, "8 yrs experience"]
    assert value(required_years, texts) == [10, 7, 3, None, 12, None, 2147483647, None, None]


def test_infer_seniority_order_and_quirks(value):
    titles = ["senior dev", "leading dev", "engineer iii", "dev 3", "midwife", "engineer ii", "dev 2", "l1 dev", "junior",
              "engineer i", "dev", "radii", "staff engineer 1"]
    assert value(infer_seniority, titles) == [
        "senior", "senior", "senior", "senior", "mid", "mid", "mid", "entry", "entry", "entry", None, "mid", "senior",
    ]


def test_wanted_role(value):
    titles = ["sre lead", "lead sre", "software engineer", "software engineer, enablement", "cook"]
    assert value(is_wanted_role, titles) == [True, False, True, False, False]


def test_places(value):
    places = ["sydney, australia", "indiana", "new mexico", "london, uk", "ukraine", "türkiye", "tokyo", "eu", "neu",
              "seattle, wa", "berlin"]
    assert value(has_foreign_marker, places) == [True, True, True, True, False, True, True, True, False, False, False]
    home = ["seattle", "ny", "austin, tx", "remote, us", "united states", "toronto, on", "indiana", "berlin", "in", "",
            "washington dc", "portland, germany"]
    assert value(looks_domestic, home) == [True, True, True, True, True, False, False, False, True, False, True, False]


def test_parse_instant(value):
    iso = ["2024-05-06T07:08:09Z", "2024-05-06T07:08:09+02:00", "2024-05-06", "2024-05-06 07:08", "2024-05-06T07",
           "2024-05-06T07:08:09.123456789+0200", "2024", "05/06/2024", "", None, "2024-13-01", "2024-05-06T07:08:09-07:00"]
    assert value(lambda c: parse_instant(c, "iso"), iso) == [
        datetime(2024, 5, 6, 7, 8, 9), datetime(2024, 5, 6, 5, 8, 9), datetime(2024, 5, 6), datetime(2024, 5, 6, 7, 8),
        datetime(2024, 5, 6, 7), datetime(2024, 5, 6, 5, 8, 9, 123456), None, None, None, None, None,
        datetime(2024, 5, 6, 14, 8, 9),
    ]
    assert value(lambda c: parse_instant(c, "epoch_ms"), ["1700000000000", "0", "x", None]) == [
        datetime(2023, 11, 14, 22, 13, 20), None, None, None]
    assert value(lambda c: parse_instant(c, "epoch_s"), ["0", "1700000000", ""]) == [
        datetime(1970, 1, 1), datetime(2023, 11, 14, 22, 13, 20), None]
    assert value(lambda c: parse_instant(c, "month_name"), ["March 4, 2026", "Mar 04, 2026", "4 March 2026", ""]) == [
        datetime(2026, 3, 4), datetime(2026, 3, 4), None, None]


@pytest.mark.parametrize("given", [datetime(2024, 1, 31), "2024-01-31", "2024-01-31T00:00:00Z"])
def test_instant_ignores_the_driver_zone(value, given):
    assert value(lambda c: instant(given), "x") == datetime(2024, 1, 31)


def test_age_days_rounds_down(value):
    stamps = [datetime(2024, 1, 30, 13), datetime(2024, 1, 30, 12), datetime(2024, 1, 31, 12, 0, 1), datetime(2024, 1, 1), None]
    assert value(lambda c: age_days(c, "2024-01-31T12:00:00"), stamps, "timestamp") == [0, 1, -1, 30, None]


def test_labels(value):
    texts = ["", None, "2024-05-06", "2024-05-06T00:00:00Z", "2024-05-06T07:08:09-07:00", "sometime in the last week", "2024-05-06 00:00:01"]
    assert value(date_label, texts) == [
        "Unknown", "Unknown", "2024-05-06", "2024-05-06", "2024-05-06 07:08", "sometime in the las", "2024-05-06 00:00"]
    assert value(report_stamp, texts) == [
        "", "", "2024-05-06 00:00", "2024-05-06 00:00", "2024-05-06 07:08", "sometime in the last week", "2024-05-06 00:00"]
    scores = [None, 90.25, 85.0, 84.99, 65.0, 12.0]
    assert value(score_label, scores, "double") == ["--", "90.2", "85.0", "85.0", "65.0", "12.0"]
    assert value(score_band, scores, "double") == ["low", "high", "high", "medium", "medium", "low"]


def test_safe_url(value):
    urls = [" HTTPS://x ", "http://y", "ftp://z", "javascript:alert(1)", "", "  "]
    assert value(safe_url, urls) == ["HTTPS://x", "http://y", "#", "#", "#", "#"]


def test_snippet(value):
    def plain(text, n):
        if not text:
            return ""
        clean = re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", html.unescape(text))).strip()
        out = ""
        for sentence in clean.split(". "):
            if len(out) + len(sentence) > n:
                break
            out += sentence + ". "
        return out.strip() or clean[:n] + "..."

    texts = ["", None, "Hello.", "One. Two. Three is much longer. Four.", "x" * 50, "<br>", "a. " * 30, "short. " + "y" * 40 + ". z"]
    assert value(lambda c: snippet(c, 20), texts) == [plain(t, 20) for t in texts]


def test_compact_text(value):
    texts = [None, "  a \n b\t", "word " * 10, "x" * 20, "x" * 21]
    assert value(lambda c: compact_text(c, 20), texts) == ["", "a b", "word word word wo...", "x" * 20, "x" * 17 + "..."]
