import numpy as np
import pytest

from hirelake.llm import urls
from hirelake.llm.queries import URL_RULES

CASES = [
    (None, "", "", None, "allow"),
    ("", "", "", None, "allow"),
    ("no scheme.com/en/", "", "", None, "allow"),
    ("http://WWW.Example.com/en/1?x#y", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
    ("http://m.example.com/en/1", "m.example.com", "/en/1", "example.com/en/", "block"),
    ("http://example.com/EN/1", "example.com", "/EN/1", "com/", "allow"),
    ("http://notexample.com/en/1", "notexample.com", "/en/1", "com/", "allow"),
    ("http://example.com", "example.com", "", None, "allow"),
    ("http://example.com?a://b.net/es/", "example.com", "", None, "allow"),
    ("x://a.net/es/é", "a.net", "/es/é", "net/es/", "block"),
    ("x://net/fr/", "net", "/fr/", "net/fr/", "block"),
    ("x://a.net:80/fr/", "a.net:80", "/fr/", None, "allow"),
    ("x://.net/fr/" + "y" * 5000, ".net", "/fr/" + "y" * 5000, "net/fr/", "block"),
]


def test_longest_rule_wins(spark):
    rows = [(i, c[0], "z", "z") for i, c in enumerate(CASES)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    got = sorted(tuple(r) for r in urls.filter_urls(pages, URL_RULES).collect())
    assert got == sorted((i, *c[1:]) for i, c in enumerate(CASES) for _ in "ab")


def test_no_rules_and_no_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert [r.verdict for r in urls.filter_urls(pages, []).collect()] == ["allow"]
    assert urls.filter_urls(pages.limit(0), URL_RULES).count() == 0


def test_equal_digests_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(urls.xxhash, "xxh64_intdigest", lambda text: 5)
    rules = urls.DigestRules(spark, URL_RULES)
    assert rules.judge(["net", "a.org"], ["/fr/x", "/"]) == [("net/fr/", "block"), (None, "allow")]


def test_too_many_rules(spark, monkeypatch):
    monkeypatch.setattr(urls, "MAX_RULES", 2)
    with pytest.raises(ValueError):
        urls.DigestRules(spark, URL_RULES)
    assert np.uint64(0) == 0
