"""The tracker rule catalog: which request URLs belong to which known tracker."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Rule(NamedTuple):
    pattern: str
    name: str
    vendor: str
    risk: str
    baa: bool
    description: str = ""


# Patterns (unanchored, matched without regard to case), names, vendors, risks and whether a business
# associate agreement is on offer. Results depend on them and on their order. Dots are written [.], since one text
# serves two SQL dialects of which one drops a lone backslash.
DEFAULT_RULES: tuple[Rule, ...] = (
    Rule("connect[.]facebook[.]net|fbevents[.]js|facebook[.]com/tr", "Facebook Pixel", "Meta", "high", False, "Advertising pixel that links visits to social accounts"),
    Rule("analytics[.]tiktok[.]com|tiktok[.]com/i18n/pixel", "TikTok Pixel", "TikTok", "high", False, "Advertising pixel for short-video campaigns"),
    Rule("google-analytics[.]com/analytics[.]js|google-analytics[.]com/ga[.]js", "Google Analytics (Universal)", "Google", "high", False, "Older web analytics script"),
    Rule("googletagmanager[.]com/gtag|google-analytics[.]com/g/collect", "Google Analytics 4", "Google", "high", False, "Event-based web analytics"),
    Rule("googletagmanager[.]com/gtm[.]js", "Google Tag Manager", "Google", "high", False, "Container that loads other tags"),
    Rule("static[.]hotjar[.]com|hotjar[.]com/c/hotjar", "Hotjar", "Hotjar", "high", False, "Heat maps and session recordings"),
    Rule("fullstory[.]com/s/fs[.]js|edge[.]fullstory[.]com", "FullStory", "FullStory", "high", False, "Session replay"),
    Rule("clarity[.]ms/tag|clarity[.]ms/s", "Microsoft Clarity", "Microsoft", "high", False, "Session replay and heat maps"),
    Rule("snap[.]licdn[.]com/li[.]lms-analytics|linkedin[.]com/px", "LinkedIn Insight Tag", "LinkedIn", "high", False, "Advertising conversions for a business network"),
    Rule("static[.]ads-twitter[.]com|t[.]co/i/adsct|platform[.]twitter[.]com/widgets", "Twitter/X Pixel", "X Corp", "high", False, "Advertising conversions and embedded widgets"),
    Rule("js[.]hs-scripts[.]com|js[.]hs-analytics[.]net|js[.]hubspot[.]com", "HubSpot Tracking", "HubSpot", "warning", True, "Marketing automation and visitor analytics"),
    Rule("widget[.]intercom[.]io|js[.]intercomcdn[.]com", "Intercom", "Intercom", "warning", True, "Chat and visitor profiles"),
    Rule("js[.]driftt[.]com|drift[.]com", "Drift", "Drift/Salesloft", "warning", False, "Sales chat"),
    Rule("cdn[.]livechatinc[.]com|livechat[.]com", "LiveChat", "LiveChat", "warning", False, "Support chat"),
    Rule("static[.]zdassets[.]com|zendesk[.]com/embeddable", "Zendesk", "Zendesk", "warning", True, "Support widget"),
    Rule("cdn[.]mouseflow[.]com|mouseflow[.]com", "Mouseflow", "Mouseflow", "high", False, "Session replay and form analytics"),
    Rule("cdn[.]heapanalytics[.]com|heapanalytics[.]com", "Heap Analytics", "Heap", "high", False, "Automatic capture of interactions"),
    Rule("cdn[.]segment[.]com|api[.]segment[.]io", "Segment", "Twilio", "warning", True, "Collects events and forwards them"),
    Rule("redditstatic[.]com/ads|reddit[.]com/api/v2/pixel|events[.]redditmedia[.]com", "Reddit Pixel", "Reddit", "high", False, "Advertising conversions"),
    Rule("s[.]pinimg[.]com/ct|ct[.]pinterest[.]com", "Pinterest Tag", "Pinterest", "high", False, "Advertising conversions"),
    Rule("sc-static[.]net/scevent|tr[.]snapchat[.]com", "Snapchat Pixel", "Snap", "high", False, "Advertising conversions"),
    Rule("bat[.]bing[.]com|bat[.]r[.]msn[.]com", "Microsoft Bing UET", "Microsoft", "high", False, "Search advertising conversions"),
    Rule("doubleclick[.]net|googleadservices[.]com|googlesyndication[.]com", "Google Ads / DoubleClick", "Google", "high", False, "Advertising network"),
    Rule("static[.]criteo[.]net|criteo[.]com/js", "Criteo", "Criteo", "high", False, "Retargeting"),
    Rule("widgets[.]outbrain[.]com|cdn[.]taboola[.]com", "Outbrain / Taboola", "Outbrain/Taboola", "high", False, "Content recommendation advertising"),
)

SCHEMA = "cat_idx int, pattern string, name string, vendor string, risk string, description string, baa boolean"


def catalog_frame(spark: SparkSession, rules: tuple[Rule, ...] = DEFAULT_RULES) -> DataFrame:
    """Rules with their place in the catalog, which breaks ties."""
    return spark.createDataFrame([(k, r.pattern, r.name, r.vendor, r.risk, r.description, r.baa) for k, r in enumerate(rules)], SCHEMA)


def load_rules(spark: SparkSession, path: str) -> tuple[Rule, ...]:
    """A catalog from a JSON array of objects (pattern, name, vendor, riskLevel, description, baaAvailable), in file order."""
    rows = spark.read.option("multiLine", True).schema("pattern string, name string, vendor string, riskLevel string, description string, baaAvailable boolean").json(path).collect()
    return tuple(Rule(r["pattern"], r["name"], r["vendor"], r["riskLevel"], bool(r["baaAvailable"]), r["description"] or "") for r in rows)


def known_pattern(rules: tuple[Rule, ...] = DEFAULT_RULES) -> str:
    """One pattern that fits what any rule fits."""
    return "(?i)" + "|".join(f"(?:{r.pattern})" for r in rules) if rules else "(?!)"
