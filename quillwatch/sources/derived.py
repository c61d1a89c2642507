"""Synthetic scan inputs derived from the test tables, which hold no request logs, forms, policy links or jobs.

Each derivation is SQL that Spark and other engines read alike, so a query's SQL twin starts from the same rows.
Columns that Spark uses again and again are written once per session (`once`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .catalog import DEFAULT_RULES
from .storage import once

# One URL that each rule of the default catalog matches, in catalog order.
SAMPLE_URLS = (
    "https://connect.facebook.net/en_US/fbevents.js",
    "https://analytics.tiktok.com/i18n/pixel/events.js",
    "https://www.google-analytics.com/analytics.js",
    "https://www.googletagmanager.com/gtag/js?id=G-1",
    "https://www.googletagmanager.com/gtm.js?id=GTM-1",
    "https://static.hotjar.com/c/hotjar-1.js",
    "https://edge.fullstory.com/s/fs.js",
    "https://www.clarity.ms/tag/abc",
    "https://snap.licdn.com/li.lms-analytics/insight.min.js",
    "https://static.ads-twitter.com/uwt.js",
    "https://js.hs-scripts.com/1.js",
    "https://widget.intercom.io/widget/abc",
    "https://js.driftt.com/include/1/abc.js",
    "https://cdn.livechatinc.com/tracking.js",
    "https://static.zdassets.com/ekr/snippet.js",
    "https://cdn.mouseflow.com/projects/abc.js",
    "https://cdn.heapanalytics.com/js/heap-1.js",
    "https://cdn.segment.com/analytics.js/v1/abc/analytics.min.js",
    "https://www.redditstatic.com/ads/pixel.js",
    "https://s.pinimg.com/ct/core.js",
    "https://sc-static.net/scevent.min.js",
    "https://BAT.BING.com/bat.js",
    "https://googleads.g.doubleclick.net/pagead/id",
    "https://static.criteo.net/js/ld/ld.js",
    "https://widgets.outbrain.com/outbrain.js",
)
assert len(SAMPLE_URLS) == len(DEFAULT_RULES)

_SAMPLES = " ".join(f"WHEN {k} THEN '{u}'" for k, u in enumerate(SAMPLE_URLS))

#: The host part of a page's URL, without port and user.
PAGE_HOSTS = "SELECT page_id, url AS page_url, lower(regexp_extract(url, '^[Hh][Tt][Tt][Pp][Ss]?://([^/?#:]+)', 1)) AS page_host FROM pages"

REQUESTS = f"""
SELECT p.page_id, p.page_url, e.event_id AS seq,
  CASE
    WHEN e.k < 25 THEN concat(CASE e.k {_SAMPLES} END, '?e=', CAST(e.event_id AS STRING))
    WHEN e.k < 33 THEN concat('https://cdn.vendor', CAST(e.user_id AS STRING), '.net/x.js?e=', CAST(e.event_id AS STRING))
    WHEN e.k < 36 THEN concat('https://assets.', regexp_extract(p.page_host, '([^.]+[.][^.]+)$', 1), '/a.css')
    WHEN e.k = 36 THEN 'data:image/gif;base64,R0lGOD'
    WHEN e.k = 37 THEN 'not a url'
    WHEN e.k = 38 THEN ''
    ELSE p.page_url
  END AS url
FROM (SELECT event_id, user_id, event_id % 40 AS k, (event_id * 7 + user_id) % (SELECT count(*) FROM pages) AS page_no FROM events) e
JOIN ({PAGE_HOSTS}) p ON p.page_id = e.page_no
"""

# Forms of every kind that the primary-form rule tells apart, by page_id % 6.
FORMS = (
    '<form action="/contact"><input type="text" name="full_name"><input type="EMAIL" name=" email "><input type="hidden" name="token"><textarea id="message"></textarea></form>',
    '<form action="https://forms.partner.org/book?x=1"><label>Book an Appointment</label><input id="pt_name"><input id="pt_dob"><select name="slot"></select></form>',
    '<form action="http://plain.example.org/send"><input name="first"><input name="phoneNumber"><input type="submit" name="go"></form>',
    '<form action="/search"><input type="text" name="q"><label>Search</label></form>',
    '<form action="/search"><input name="q"></form><form><input type="hidden" id="home_phone"><input name="note"><input name="note"></form>',
    '<p>no form here</p>',
)
# What the rule finds in each of them: fields, action as written, and whether the target is encrypted (null: as the page).
FORM_FIELDS = ("full_name,email,message", "pt_name,pt_dob,slot", "first,phoneNumber,go", None, "note", None)
FORM_ACTIONS = ("/contact", "https://forms.partner.org/book?x=1", "http://plain.example.org/send", None, "", None)

_FORM_CASE = " ".join(f"WHEN {k} THEN '{f}'" for k, f in enumerate(FORMS))

# Markup that isn't well formed, by page_id % 7, with what a browser's tree makes of it: text, policy link, the primary
# form's fields, and every link and form (kind, place, address, fields, chosen). {n} is the page's number.
ODD_MARKUP = (
    ("<nav/>gone {n}", "", None, None, ()),
    ("<textarea><nav>{n}</nav></textarea>y", "<nav>{n}</nav>y", None, None, ()),
    ('<a href="/p{n}">one<a href="/privacy/{n}">two</a> three', "onetwo three", "/privacy/{n}", None, (("link", 0, "/p{n}", None, False), ("link", 1, "/privacy/{n}", None, True))),
    ('<div><form action="https://f.org/{n}"><input type=email name=a{n}></div><input name=b></form>z', "z", None, "a{n}", (("form", 0, "https://f.org/{n}", "a{n}", True),)),
    ("<nav><footer>a</nav>b{n}", "b{n}", None, None, ()),
    ("<title>T</title><table><form><tr><td><input type=email name=q></td></tr></form></table>x{n}<noscript><a href=/privacy>n</a></noscript>", "x{n}", None, None, (("form", 0, "", "", False),)),
    ('<form action="https://g.org/{n}"><label>Con<b>tact</b> {n}</label><select name=s><option>1<option>2</select>', "Contact {n}12", None, "s", (("form", 0, "https://g.org/{n}", "s", True),)),
)

# Policy links by page_id % 5: relative, absolute to another page, a mail address, found by its text, none.
POLICY_LINK = """
CASE page_id % 5
  WHEN 0 THEN '<a href="/legal/privacy?v=2">Terms</a>'
  WHEN 1 THEN concat('<a href="', other_url, '">Our PRIVACY notice</a>')
  WHEN 2 THEN '<a href="mailto:privacy@example.org">write to us</a><a href="/privacy">later</a>'
  WHEN 3 THEN '<a href="  ">privacy</a><a href=" notices/hipaa.html "> Notice of practices </a>'
  ELSE '<a href="/about">About</a>'
END
"""

SNAPSHOTS = f"""
SELECT p.page_id, p.url, CASE WHEN p.page_id % 7 = 0 THEN NULL WHEN p.page_id % 7 < 4 THEN 'TLS 1.3' ELSE 'TLS 1.2' END AS tls_version, p.html AS raw_html, o.url AS other_url,
  concat(p.html, CASE p.page_id % 6 {_FORM_CASE} END, {POLICY_LINK.replace('page_id', 'p.page_id').replace('other_url', 'o.url')}) AS html
FROM pages p JOIN pages o ON o.page_id = (p.page_id * 3 + 1) % (SELECT count(*) FROM pages)
"""

#: The fixed instant that stands for now.
NOW = "TIMESTAMP '1998-08-02 00:02:00'"
JOBS = """
SELECT CAST(o_orderkey AS STRING) AS id, concat('https://site', CAST(o_custkey AS STRING), '.example.org/') AS url, 'tester' AS requested_by,
  CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'running' ELSE 'complete' END AS status,
  CASE WHEN o_orderstatus = 'O' THEN NULL ELSE concat('w', CAST(o_custkey % 5 AS STRING)) END AS claimed_by,
  CAST(o_custkey % 4 AS INT) AS claim_count, o_orderdate AS created_at,
  CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderdate + make_interval_seconds END AS started_at,
  o_custkey % 600 AS run_seconds
FROM orders
"""

#: The page that each job asks for.
JOB_PAGES = "SELECT CAST(o.o_orderkey AS STRING) AS job_id, p.url AS url FROM (SELECT o_orderkey, o_custkey % (SELECT count(*) FROM pages) AS page_no FROM orders) o JOIN pages p ON p.page_id = o.page_no"
#: How long each page took to load and whether that failed; some pages were never captured.
CAPTURES = "SELECT url, page_id, page_id * 7919 % 100000 AS duration_ms, CASE WHEN page_id % 13 = 0 THEN 'net::ERR_NAME_NOT_RESOLVED' END AS error FROM pages WHERE page_id % 17 <> 3"

# Replies of a reviewer, valid and not, by doc_id % 14.
REPLIES = (
    '{"privacyPolicyScore": 3, "privacyPolicyMissing": ["breach notice"], "phiFormRiskLevel": "low", "phiFormReasoning": "contact only", "unknownTrackerClassifications": {"a.example.org": {"likelyVendor": "Ads", "phiRisk": "high", "reasoning": "pixel"}}}',
    '```json\n{"privacyPolicyScore": 5, "phiFormRiskLevel": "none"}\n```',
    '{"privacyPolicyScore": 3.0, "phiFormRiskLevel": "medium", "privacyPolicyMissing": "no list"}',
    '{"privacyPolicyScore": "3", "phiFormRiskLevel": "low"}',
    '{"privacyPolicyScore": 3.5, "phiFormRiskLevel": "low"}',
    '{"privacyPolicyScore": 6, "phiFormRiskLevel": "low"}',
    '{"privacyPolicyScore": true, "phiFormRiskLevel": "low"}',
    '{"privacyPolicyScore": 2, "phiFormRiskLevel": "severe"}',
    '[1, 2]',
    'not json',
    '',
    '{"privacyPolicyScore": 1, "phiFormRiskLevel": "high", "phiFormReasoning": 7, "privacyPolicyMissing": ["a", 4, null, "b"], "unknownTrackerClassifications": {"x.org": {"phiRisk": "odd"}, "y.org": null, "z.org": {"likelyVendor": 9, "phiRisk": "low", "reasoning": []}}}',
    '{"privacyPolicyScore": 4, "privacyPolicyScore": 0, "phiFormRiskLevel": ["high"], "extra": 1}',
    'null',
)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "requests", lambda: _sql(spark, sf_dir, REQUESTS, "pages", "events"))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, sf_dir, "snapshots", lambda: _sql(spark, sf_dir, SNAPSHOTS, "pages"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, JOBS.replace("make_interval_seconds", "make_dt_interval(0, 0, 0, o_custkey % 600)"), "orders")


def job_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, JOB_PAGES, "orders", "pages")


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, CAPTURES, "pages")


JOBS_SQL = JOBS.replace("make_interval_seconds", "to_seconds(o_custkey % 600)")


def _sql(spark: SparkSession, sf_dir: str, text: str, *names: str) -> DataFrame:
    """text over the named tables, without leaving views behind."""
    return spark.sql(_braced(text, names), **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


def _braced(text: str, names: tuple[str, ...]) -> str:
    """Table names after FROM and JOIN become the placeholders that spark.sql fills; other braces are doubled."""
    import re

    text = text.replace("{", "{{").replace("}", "}}")
    return re.sub(rf"\b(FROM|JOIN) ({'|'.join(names)})\b", r"\1 {\2}", text)
