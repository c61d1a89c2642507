"""The nested result of a scan, and the payload that a reviewer gets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.catalog import DEFAULT_RULES, Rule
from . import html, trackers, verdicts

# Fixed value: the version that results carry.
RULESET = "2026.04.11-deep"
TRACKER_TYPE = "array<struct<name:string,vendor:string,risk:string,description:string,baa:boolean,example_url:string,request_count:bigint>>"


def reviewer_input(text: Column, runtime_trackers: Column, unknown_hosts: Column, form: Column) -> Column:
    """Policy text, trackers by name, vendor and example, unknown hosts, and the form's summary."""
    short = F.transform(runtime_trackers, lambda t: F.struct(t["name"].alias("name"), t["vendor"].alias("vendor"), t["example_url"].alias("exampleUrl")))
    return F.struct(text.alias("privacyPolicyText"), short.alias("detectedTrackers"), unknown_hosts.alias("unknownTrackerDomains"), form.alias("formSummary"))


def prompt_payload(ai_input: Column) -> Column:
    """The reviewer's input as JSON. The text's size is its length in UTF-16 units, whatever the field is called."""
    text = F.coalesce(ai_input["privacyPolicyText"], F.lit(""))
    units = F.length(text) + F.length(F.regexp_replace(text, "[^\\x{10000}-\\x{10FFFF}]", ""))
    return F.to_json(
        F.struct(
            text.alias("privacyPolicyText"),
            units.alias("privacyPolicyBytes"),
            ai_input["formSummary"].alias("formSummary"),
            F.coalesce(ai_input["detectedTrackers"], F.array().cast("array<struct<name:string,vendor:string,exampleUrl:string>>")).alias("detectedTrackers"),
            F.coalesce(ai_input["unknownTrackerDomains"], F.array().cast("array<string>")).alias("unknownTrackerDomains"),
        ),
        {"ignoreNullFields": "false"},
    )


def scan(pages: DataFrame, requests: DataFrame, policies: DataFrame, scanned_at: Column, rules: tuple[Rule, ...] = DEFAULT_RULES, make_reviewer=None, bare: bool = True) -> DataFrame:
    """One result document a page.

    pages (page_id, url, html, tls_version); requests (page_id, page_url, seq, url); policies (url, ok, body). All
    parts are aggregated by page_id before they are joined to pages, so each is shuffled once. bare: whether references
    without a semicolon count in policy texts, as in browsers.
    """
    listed = trackers.tracker_list(trackers.detect_trackers(requests, rules))
    hosts = trackers.unknown_hosts(requests, rules).groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("place", "host"))).alias("h"))
    hosts = hosts.select("page_id", F.col("h.host").alias("unknown_hosts"))
    read = html.fetch_policies(html.page_features(pages), policies, bare=bare).select("page_id", "url", "tls_version", "policy_text", "form")
    joined = read.join(listed, "page_id", "left").join(hosts, "page_id", "left")
    joined = joined.withColumns({"runtime_trackers": F.coalesce("runtime_trackers", F.array().cast(TRACKER_TYPE)), "unknown_hosts": F.coalesce("unknown_hosts", F.array().cast("array<string>"))})
    joined = joined.withColumn("ai_input", reviewer_input(F.col("policy_text"), F.col("runtime_trackers"), F.col("unknown_hosts"), F.col("form")))
    if make_reviewer is not None:
        joined = joined.withColumn("payload", prompt_payload(F.col("ai_input")))
    judged = verdicts.run_reviews(joined, make_reviewer)
    warnings = F.size("runtime_trackers").cast("long")
    none = F.array().cast("array<string>")
    return judged.select(
        "page_id", F.col("url").alias("scanned_url"), scanned_at.alias("scanned_at"), trackers.status(warnings).alias("overall_status"), none.alias("checks"),
        F.lit(0).cast("long").alias("critical_count"), warnings.alias("warning_count"), F.lit(0).cast("long").alias("info_count"), none.alias("recommendations"),
        "tls_version", "runtime_trackers", F.lit(True).alias("deep_scan"), F.lit(RULESET).alias("ruleset_version"), "ai_input", F.col("verdict").alias("ai_verification"),
    )


def result_json(results: DataFrame) -> Column:
    """A row of scan as the JSON that a finished job carries."""
    tracker = lambda t: F.struct(t["name"].alias("name"), t["vendor"].alias("vendor"), t["risk"].alias("riskLevel"), t["description"].alias("description"), t["baa"].alias("baaAvailable"), t["example_url"].alias("exampleUrl"), t["request_count"].alias("requestCount"))
    verdict = F.struct(
        F.col("ai_verification.score").alias("privacyPolicyScore"), F.col("ai_verification.missing").alias("privacyPolicyMissing"), F.col("ai_verification.form_risk").alias("phiFormRiskLevel"), F.col("ai_verification.form_reasoning").alias("phiFormReasoning"),
        F.transform_values("ai_verification.classifications", lambda _, c: F.struct(c["likely_vendor"].alias("likelyVendor"), c["phi_risk"].alias("phiRisk"), c["reasoning"].alias("reasoning"))).alias("unknownTrackerClassifications"),
        F.col("ai_verification.provider").alias("provider"), F.col("ai_verification.latency_ms").alias("latencyMs"),
    )
    named = {
        "scanned_url": "scannedUrl", "scanned_at": "scannedAt", "overall_status": "overallStatus", "checks": "checks", "critical_count": "criticalCount", "warning_count": "warningCount", "info_count": "infoCount", "recommendations": "recommendations",
        "tls_version": "tlsVersion",
    }
    values = [F.col(c).alias(n) for c, n in named.items()]
    rest = [F.transform("runtime_trackers", tracker).alias("runtimeTrackers"), F.col("deep_scan").alias("deepScan"), F.col("ruleset_version").alias("rulesetVersion"), F.col("ai_input").alias("aiInput"), verdict.alias("aiVerification")]
    return F.to_json(F.struct(*values, *rest), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "timeZone": "UTC"})
