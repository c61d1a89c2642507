"""The index of literal parts against trying every pattern on every URL."""

import random
import re

import pytest

from quillwatch.operators import fragments, trackers
from quillwatch.sources.catalog import DEFAULT_RULES, Rule, catalog_frame

REQUESTS = "page_id long, page_url string, seq long, url string"


@pytest.mark.parametrize(
    ("pattern", "want"),
    [
        ("connect[.]facebook[.]net|facebook\\.com/tr", ["connect.facebook.net", "facebook.com/tr"]),
        ("ABCdefg", ["abcdefg"]),
        ("abcdef?gh", None),
        ("abcdef+ghijkl", ["abcdef"]),
        ("abcde+fghijklm", ["fghijklm"]),
        ("abcdef{0,3}gh", None),
        ("xy(abcdefgh)zz", None),
        ("(?:abc|def)longer-part[0-9]+", ["longer-part"]),
        ("longer-part|x", None),
        ("a.b", None),
        ("abcd\\defghij", ["efghij"]),
        ("[abc]defghi", ["defghi"]),
        ("[^a]{3}bcdefg$", ["bcdefg"]),
        ("same-part|same-part", ["same-part"]),
        ("\\Qa.b.c.d\\E", None),
        ("grün-und-blau", ["n-und-blau"]),
        ("(unbalanced", None),
        ("abcdef*?ghijkl", ["ghijkl"]),
        ("", None),
        ("(?x)abc def ghi", None),
    ],
)
def test_literal_parts(pattern, want):
    assert fragments.literal_parts(pattern) == want


def test_parts_stand_in_every_match():
    rng = random.Random(8)
    bits = ["abc", "d", "[.]", "\\.", "e?", "f+", "g*", "(?:hi|j)", "[kl]", "m{2}", "|", "nopqrs", ".", "\\d", "tu/v"]
    for _ in range(3_000):
        pattern = "".join(rng.choice(bits) for _ in range(rng.randint(1, 9)))
        parts = fragments.literal_parts(pattern)
        text = "".join(rng.choice(["abc", "d", ".", "e", "ff", "g", "hi", "j", "k", "mm", "nopqrs", "7", "tu/v", "ABC"]) for _ in range(12))
        if parts and (m := re.search(pattern, text, re.I)):
            assert any(p in m[0].lower() for p in parts), (pattern, text)


def brute(urls, rules):
    return sorted((k, seq) for seq, u in enumerate(urls) if u for k, r in enumerate(rules) if re.search(r.pattern, u, re.I))


def run(spark, urls, rules, **options):
    df = spark.createDataFrame([(1, "p", k, u) for k, u in enumerate(urls)], REQUESTS)
    out = fragments.match_catalog(df, catalog_frame(spark, rules), **options)
    assert out.columns == ["page_id", "page_url", "seq", "url", "cat_idx", "name", "vendor", "risk", "description", "baa"]
    return sorted((r["cat_idx"], r["seq"]) for r in out.collect())


@pytest.mark.parametrize("options", [{}, {"broadcast_pieces": 0}])
def test_equal_rows_by_either_join(spark, options):
    rng = random.Random(1)
    rules = (*DEFAULT_RULES, *(Rule(f"host{k}[.]example|other-{k}[.]test/[a-z]+", f"H{k}", "v", "low", False) for k in range(400)), Rule("a.c", "short", "v", "low", False), Rule("x1", "shorter", "v", "low", False))
    urls = [None, "", "short", "HTTPS://CONNECT.FACEBOOK.NET/tr", "https://host7.example/", "https://host7.example/", "https://host77.example/other-77.test/q", "https://abc.net/x1/x1", "https://connect.facebook.net/facebook.com/tr", "x" * 20_000 + "drift.com"]
    urls += [f"https://{rng.choice(['host', 'other-', 'cdn'])}{rng.randint(0, 500)}{rng.choice(['.example', '.test/q', '.net'])}" for _ in range(300)]
    assert run(spark, urls, rules, **options) == brute(urls, rules)


def test_plan_of_a_large_catalog_has_no_nested_loop(spark):
    df = spark.createDataFrame([(1, "p", 0, "https://t4999.example.net/"), (1, "p", 1, "https://x.org")], REQUESTS)
    rules = tuple(Rule(f"t{k}[.]example", f"T{k}", "v", "high", False) for k in range(6_000))
    found = trackers.match_rules(df, rules)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and [r["name"] for r in found.collect()] == ["T4999"]
    assert [r["host"] for r in trackers.unknown_hosts(df, rules).collect()] == ["x.org"]


def test_empty_catalogs_and_logs(spark):
    assert run(spark, ["https://a.org"], ()) == [] and run(spark, [], DEFAULT_RULES) == []
