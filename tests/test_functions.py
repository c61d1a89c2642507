"""Column and scalar functions on the cases that tell implementations apart."""

import pytest
from hypothesis import HealthCheck, given
from hypothesis import settings as limits
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillwatch.functions import settings, text, urls
from quillwatch.operators import telemetry, verdicts


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://A.Example.com:8080/x", "a.example.com"), ("http://u:p@h.org/?q=a|b", "h.org"), ("HTTPS://x_y.org", "x_y.org"), ("https://h.org?q={}", "h.org"), ("https://[::1]:80/", "[::1]"),
        ("data:image/gif;base64,R0", None), ("not a url", None), ("", None), (None, None), ("chrome-extension://abc/x", None), ("ftp://h.org/", None),
    ],
)
def test_host(spark, url, want):
    assert one(spark, urls.host(F.col("u")), u=url) == want


@pytest.mark.parametrize(("name", "want"), [("a.b.example.com", "example.com"), ("example.com", "example.com"), ("localhost", "localhost"), ("10.0.0.1", "0.1"), ("A.CO.UK", "co.uk"), ("x..y.", "x.y"), ("", "")])
def test_registrable(spark, name, want):
    assert one(spark, urls.registrable(F.col("h")), h=name) == want


@given(st.lists(st.lists(st.text("abcXYZ019-", max_size=5), max_size=6), min_size=1, max_size=50))
@limits(deadline=None, max_examples=10, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_registrable_is_the_last_two_labels(spark, many):
    hosts = [".".join(labels) for labels in many]
    df = spark.createDataFrame([(h,) for h in hosts], "h string").select(urls.registrable(F.col("h")).alias("r"))
    assert [r["r"] for r in df.collect()] == [".".join([x for x in h.lower().split(".") if x][-2:]) for h in hosts]


@pytest.mark.parametrize(
    ("reference", "base", "want"),
    [
        ("/privacy", "https://h.org/a/b", "https://h.org/privacy"), ("p.html", "https://h.org/a/b", "https://h.org/a/p.html"), ("//o.org/x", "http://h.org", "http://o.org/x"), ("https://O.org", "http://h.org", "https://o.org/"),
        ("#top", "https://h.org/a", "https://h.org/a#top"), ("mailto:x@y.z", "https://h.org", None), ("javascript:void(0)", "https://h.org", None), ("http://", "https://h.org", None), ("/x", "not a base", None), (None, "https://h.org", None), ("https://h.org:443/x", "http://a.b", "https://h.org/x"),
    ],
)
def test_resolve_policy(reference, base, want):
    assert urls.resolve_policy(reference, base) == want


@pytest.mark.parametrize(
    ("action", "base", "want"),
    [("", "https://h.org", ("", True)), ("", "http://h.org", ("", False)), ("/go", "https://h.org/x", ("https://h.org/go", True)), ("http://o.org/s", "https://h.org", ("http://o.org/s", False)), ("mailto:a@b.c", "https://h.org", ("mailto:a@b.c", False)), ("http://[bad", "https://h.org", ("http://[bad", False)), ("", "nonsense", ("", False))],
)
def test_resolve_action(action, base, want):
    assert urls.resolve_action(action, base) == want


def test_visible_text(spark):
    page = "<html><head><title>T</title></head><body><nav>menu</nav><!-- x --><p>One  &amp; two</p>\n<script>a<b</script><div>three</div><footer>f</footer></body></html>"
    assert one(spark, text.visible_text(F.col("h")), h=page) == "One & two three"
    assert one(spark, text.visible_text(F.col("h"), 5), h=page) == "One &"
    assert one(spark, text.visible_text(F.col("h")), h=None) == ""


@pytest.mark.parametrize(("n", "size"), [(499, 499), (500, 500), (501, 501), (2000, 501)])
def test_shorten(spark, n, size):
    out = one(spark, telemetry.short(F.col("t")), t="x" * n)
    assert len(out) == size and out.endswith("…") == (n > 500)


@pytest.mark.parametrize(("value", "want"), [("", 30000), ("0", 30000), ("abc", 30000), (None, 30000), ("12abc", 5000), (" 7000 ", 7000), ("-9", 5000)])
def test_number_setting(spark, value, want):
    assert one(spark, settings.number_setting(F.col("v").cast("string"), 30000, 5000), v=value) == want


def test_other_settings(spark):
    assert one(spark, settings.interval_text(F.col("v")), v=180_500) == "181 seconds"
    assert one(spark, settings.strip_slashes(F.col("v")), v="http://h:1//") == "http://h:1"
    assert [one(spark, settings.count_or_zero(F.col("v")), v=x) for x in ("3", "x", "NaN", "Infinity")] == [3.0, 0.0, 0.0, 0.0]
    assert one(spark, settings.worker_id(F.col("h"), F.lit(7), F.lit("abc123"), F.lit("bot")), h="") == "bot-unknown-host:7:abc123"


def test_log_levels(spark):
    rank = lambda level, least: one(spark, telemetry.passes(F.col("v"), least), v=level)
    assert rank("warn", "info") and rank("info", "info") and not rank("debug", "info") and not rank("loud", "debug") and not rank("error", "nonsense")


@pytest.mark.parametrize(("raw", "want"), [("```json\n{}\n```", "{}"), ("```\n{}```", "{}"), ("```JSON {}```", "{}"), (" {} ", "{}"), ("{}```", "{}```"), ("", "")])
def test_fences(spark, raw, want):
    assert verdicts.strip_fence(raw) == want == one(spark, verdicts.fence_free(F.col("r")), r=raw)


@pytest.mark.parametrize("score", ['"3"', "3.5", "6", "-1", "true", "null", "NaN", "Infinity", "1e400", "[3]"])
def test_bad_scores(score):
    with pytest.raises(verdicts.VerdictError) as e:
        verdicts.parse_reply('{"privacyPolicyScore": %s, "phiFormRiskLevel": "low"}' % score)
    assert str(e.value) in ("bad score", "not json") and score not in str(e.value)


def test_good_replies():
    assert verdicts.parse_reply('{"privacyPolicyScore": 3.0, "phiFormRiskLevel": ["high"]}')["form_risk"] == "high"
    full = verdicts.parse_reply('{"privacyPolicyScore": 0, "phiFormRiskLevel": "none", "unknownTrackerClassifications": {"a": {"phiRisk": ["low"]}, "b": 3, "c": null}, "x": 1}')
    assert full["classifications"] == {"a": {"likely_vendor": "unknown", "phi_risk": "unknown", "reasoning": ""}}
    assert verdicts.stub() == {"score": 0, "missing": [], "form_risk": "none", "form_reasoning": "", "classifications": {}, "error": None}


@given(st.text(max_size=60))
def test_any_reply_gives_a_verdict_or_a_code(raw):
    try:
        verdicts.parse_reply(raw)
    except verdicts.VerdictError as e:
        assert str(e) in {"empty", "not json", "not an object", "bad score", "bad form risk"}
