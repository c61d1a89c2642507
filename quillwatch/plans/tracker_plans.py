"""Queries over request logs, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import trackers
from ..operators.fragments import match_catalog
from ..sources import derived
from ..sources.catalog import DEFAULT_RULES, Rule

_text = lambda s: "'" + s.replace("'", "''") + "'"
CATALOG_SQL = "SELECT * FROM (VALUES " + ", ".join(f"({k}, {_text(r.pattern)}, {_text(r.name)}, {_text(r.vendor)}, {_text(r.risk)}, {str(r.baa).lower()})" for k, r in enumerate(DEFAULT_RULES)) + ") c(cat_idx, pattern, name, vendor, risk, baa)"

#: The request log, its matches and each page's trackers, as common table expressions.
BASE_SQL = f"""
requests AS ({derived.REQUESTS}),
catalog AS ({CATALOG_SQL}),
matches AS (SELECT r.page_id, r.seq, r.url, c.* FROM requests r JOIN catalog c ON r.url <> '' AND regexp_matches(r.url, concat('(?i)', c.pattern))),
trackers AS (
  SELECT page_id, name, count(*) AS request_count, min(seq) AS first_seq,
    arg_min(url, seq * 100 + cat_idx) AS example_url, arg_min(vendor, seq * 100 + cat_idx) AS vendor,
    arg_min(risk, seq * 100 + cat_idx) AS risk, arg_min(baa, seq * 100 + cat_idx) AS baa, arg_min(cat_idx, seq * 100 + cat_idx) AS first_idx
  FROM matches GROUP BY page_id, name)
"""
HOST_SQL = "nullif(lower(regexp_extract(url, '(?i)^https?://([^/?#:@ ]+)', 1)), '')"
REG_SQL = "regexp_extract({0}, '([^.]+[.][^.]+)$', 1)"
UNKNOWN_SQL = f"""
{BASE_SQL},
hosts AS (SELECT r.*, {HOST_SQL} AS host, lower(regexp_extract(page_url, '(?i)^https?://([^/?#:]+)', 1)) AS page_host FROM requests r WHERE url <> ''),
third AS (SELECT * FROM hosts WHERE host IS NOT NULL AND host <> page_host AND {REG_SQL.format('host')} <> {REG_SQL.format('page_host')}),
unknown AS (SELECT t.* FROM third t WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.seq = t.seq AND m.page_id = t.page_id)),
unknown_hosts AS (SELECT page_id, host, first_seq, row_number() OVER (PARTITION BY page_id ORDER BY first_seq, host) AS place
  FROM (SELECT page_id, host, min(seq) AS first_seq FROM unknown GROUP BY page_id, host) u)
"""


#: A catalog of 150 rules, each for the URLs that hold two certain digits in a row or the name of a page.
OWN_RULES = tuple(Rule(f"/{k // 2 % 10}{k % 10}" if k < 100 else f"page{k}[^0-9]", f"R{k}", "v", "low", False) for k in range(150))


#: URLs with a plain host.
_PLAIN_URL = "^https?://[a-z0-9.-]+[.][a-z]+/"
#: Rules of the large catalog beside the known ones.
_VENDORS = 50_000


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.requests(spark, sf_dir)


def _trackers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trackers.detect_trackers(_requests(spark, sf_dir))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")


def rule_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trackers.catalog_frame(spark).select("cat_idx", "pattern", "name", "vendor", "risk", "baa")


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _requests(spark, sf_dir).select("page_id", "seq", "url")


def tracker_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trackers.match_rules(_requests(spark, sf_dir)).select("page_id", "seq", "cat_idx", "name")


def tracker_match_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same matches through the index of literal parts, as for catalogs too large for literal patterns."""
    return trackers.match_rules(_requests(spark, sf_dir), literal_rules=0).select("page_id", "seq", "cat_idx", "name")


def tracker_large_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of 50,000 rules: the known ones, one for each of many vendors' hosts, and some that have no literal part."""
    own = trackers.catalog_frame(spark)
    vendors = spark.range(_VENDORS).select(
        (F.col("id") + 1000).cast("int").alias("cat_idx"), F.format_string("(?:cdn|assets)[.]vendor%d[.]net|vendor%d[.]example[.]org/[a-z]+", "id", "id").alias("pattern"), F.format_string("Vendor %d", "id").alias("name"),
        *[F.lit(x).alias(c) for c, x in (("vendor", "v"), ("risk", "low"), ("description", "")) ], F.lit(False).alias("baa"),
    )
    short = spark.createDataFrame([(900, "e=[0-9]*77$", "Short", "v", "low", "", False)], own.schema)
    return match_catalog(_requests(spark, sf_dir), own.union(vendors).union(short)).select("page_id", "seq", "cat_idx", "name")


def tracker_own_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of a caller's own catalog, larger than one batch of rules."""
    return trackers.match_rules(_requests(spark, sf_dir), OWN_RULES).select("page_id", "seq", "cat_idx", "name")


def tracker_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trackers(spark, sf_dir).select("page_id", "name", "request_count")


def tracker_first_example(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trackers(spark, sf_dir).select("page_id", "name", "vendor", "risk", "baa", "example_url", "first_seq")


def tracker_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trackers.ordered(_trackers(spark, sf_dir)).select("page_id", "name", "place")


def tracker_rank_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opt-in order by risk (extension)."""
    return trackers.ordered(_trackers(spark, sf_dir), by_risk=True).select("page_id", "name", "risk", "place")


def tracker_by_vendor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and requests by vendor and risk with totals (extension)."""
    found = _trackers(spark, sf_dir)
    out = found.rollup("vendor", "risk").agg(F.count_distinct("page_id").alias("pages"), F.sum("request_count").alias("requests"), F.grouping_id().alias("level"))
    return out.select(F.coalesce("vendor", F.lit("*")).alias("vendor"), F.coalesce("risk", F.lit("*")).alias("risk"), "pages", "requests", F.col("level").cast("int").alias("level"))


def detected_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reviewer is told of each page's trackers, as one text."""
    listed = trackers.tracker_list(_trackers(spark, sf_dir))
    return listed.select("page_id", F.array_join(F.transform("runtime_trackers", lambda t: F.concat_ws("|", t["name"], t["vendor"], t["example_url"])), ";").alias("trackers"))


def page_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = trackers.page_status(_pages(spark, sf_dir), _trackers(spark, sf_dir))
    return out.select("page_id", F.col("url").alias("scanned_url"), "overall_status", "critical_count", "warning_count", "info_count")


def page_warning_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trackers.page_status(_pages(spark, sf_dir), _trackers(spark, sf_dir)).groupBy("warning_count").agg(F.count("*").alias("pages"))


def no_tracker_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).join(trackers.match_rules(_requests(spark, sf_dir)).select("page_id"), "page_id", "left_anti")


def url_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _requests(spark, sf_dir).select("page_id", "seq", urls.host(F.col("url")).alias("host"))


def url_host_odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts of URLs that are written in ways that browsers put right, or refuse."""
    url, k = F.col("url"), F.col("seq") % 8
    web, start, named = "^https?://", "^(https?://)([^/?#]+)", _requests(spark, sf_dir).filter(F.col("url").rlike(_PLAIN_URL))
    odd = (
        F.when(k == 0, F.concat(F.lit(" \t"), url, F.lit("\n ")))
        .when(k == 1, F.regexp_replace(url, web, "HTTPS:\\\\\\\\"))
        .when(k == 2, F.regexp_replace(url, web, "http://user:p@ss@"))
        .when(k == 3, F.regexp_replace(url, web, "https:"))
        .when(k == 4, F.regexp_replace(url, start, "$1$2.:65535"))
        .when(k == 5, F.concat(F.lit("http://"), F.col("page_id").cast("string"), F.lit("."), F.format_string("0x%x", F.col("seq")), F.lit("/")))
        .when(k == 6, F.regexp_replace(url, start, "$1$2 x"))
        .otherwise(F.regexp_replace(url, start, "$1bücher。$2"))
    )
    return named.select("page_id", "seq", urls.host(odd).alias("host"))


def url_scheme_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _requests(spark, sf_dir).filter(urls.is_web(F.col("url"))).select("page_id", "seq", "url")


def empty_urls_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _requests(spark, sf_dir).filter("url <> ''").groupBy("page_id").agg(F.count("*").alias("requests"))


def registrable_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = _requests(spark, sf_dir).select(urls.host(F.col("url")).alias("host")).filter("host is not null")
    return hosts.groupBy("host", urls.registrable(F.col("host")).alias("registrable")).agg(F.count("*").alias("requests"))


def first_party_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = _requests(spark, sf_dir).withColumn("host", urls.host(F.col("url"))).filter("host is not null")
    return hosts.filter(~urls.is_third_party(F.col("host"), urls.host(F.col("page_url")))).select("page_id", "seq", "host")


def known_rule_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trackers.unknown_requests(_requests(spark, sf_dir)).select("page_id", "seq", "host")


def unknown_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trackers.unknown_hosts(_requests(spark, sf_dir), limit=None).select("page_id", "host", "first_seq")


def unknown_hosts_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trackers.unknown_hosts(_requests(spark, sf_dir)).select("page_id", "host", "place")


def unknown_host_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On how many pages each unknown host is (extension)."""
    return trackers.unknown_hosts(_requests(spark, sf_dir), limit=None).groupBy("host").agg(F.count("*").alias("pages"))


QUERIES = {
    f.__name__: f
    for f in (
        rule_catalog, request_log, tracker_match, tracker_match_join, tracker_large_catalog, tracker_own_rules, tracker_counts, tracker_first_example, tracker_order, tracker_rank_order, tracker_by_vendor, detected_short,
        page_status, page_warning_count, no_tracker_pages, url_host, url_host_odd, url_scheme_filter, empty_urls_dropped, registrable_domain, first_party_filter, known_rule_exclusion, unknown_hosts, unknown_hosts_top20, unknown_host_spread,
    )
}

_STATUS_SQL = "SELECT p.page_id, p.url AS scanned_url, count(DISTINCT t.name) AS warning_count FROM pages p LEFT JOIN trackers t ON t.page_id = p.page_id GROUP BY p.page_id, p.url"
_RISK_SQL = "CASE risk WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END"
ORACLES = {
    "rule_catalog": CATALOG_SQL,
    "request_log": f"WITH {BASE_SQL} SELECT page_id, seq, url FROM requests",
    "tracker_match": f"WITH {BASE_SQL} SELECT page_id, seq, cat_idx, name FROM matches",
    "tracker_match_join": f"WITH {BASE_SQL} SELECT page_id, seq, cat_idx, name FROM matches",
    "tracker_large_catalog": f"""WITH {BASE_SQL} SELECT page_id, seq, cat_idx, name FROM matches
      UNION ALL SELECT page_id, seq, 1000 + k, concat('Vendor ', k) FROM (SELECT page_id, seq, nullif(regexp_extract(lower(url), '(?:cdn|assets)[.]vendor([0-9]+)[.]net', 1), '')::INT AS k FROM requests) WHERE k < {_VENDORS}
      UNION ALL SELECT page_id, seq, 900, 'Short' FROM requests WHERE regexp_matches(url, 'e=[0-9]*77$')""",
    "tracker_own_rules": f"WITH requests AS ({derived.REQUESTS}) SELECT r.page_id, r.seq, c.cat_idx, c.name FROM requests r JOIN (SELECT * FROM (VALUES {', '.join(f'({k}, {_text(r.pattern)}, {_text(r.name)})' for k, r in enumerate(OWN_RULES))}) v(cat_idx, pattern, name)) c ON r.url <> '' AND regexp_matches(r.url, concat('(?i)', c.pattern))",
    "tracker_counts": f"WITH {BASE_SQL} SELECT page_id, name, request_count FROM trackers",
    "tracker_first_example": f"WITH {BASE_SQL} SELECT page_id, name, vendor, risk, baa, example_url, first_seq FROM trackers",
    "tracker_order": f"WITH {BASE_SQL} SELECT page_id, name, row_number() OVER (PARTITION BY page_id ORDER BY first_seq, first_idx) AS place FROM trackers",
    "tracker_rank_order": f"WITH {BASE_SQL} SELECT page_id, name, risk, row_number() OVER (PARTITION BY page_id ORDER BY {_RISK_SQL}, first_seq, first_idx) AS place FROM trackers",
    "tracker_by_vendor": f"WITH {BASE_SQL} SELECT coalesce(vendor, '*') AS vendor, coalesce(risk, '*') AS risk, count(DISTINCT page_id) AS pages, sum(request_count)::BIGINT AS requests, grouping(vendor, risk)::INT AS level FROM trackers GROUP BY ROLLUP (vendor, risk)",
    "detected_short": f"WITH {BASE_SQL} SELECT page_id, string_agg(concat_ws('|', name, vendor, example_url), ';' ORDER BY first_seq, first_idx) AS trackers FROM trackers GROUP BY page_id",
    "page_status": f"WITH {BASE_SQL} SELECT page_id, scanned_url, CASE WHEN warning_count > 0 THEN 'warning' ELSE 'pass' END AS overall_status, 0::BIGINT AS critical_count, warning_count, 0::BIGINT AS info_count FROM ({_STATUS_SQL})",
    "page_warning_count": f"WITH {BASE_SQL} SELECT warning_count, count(*) AS pages FROM ({_STATUS_SQL}) GROUP BY warning_count",
    "no_tracker_pages": f"WITH {BASE_SQL} SELECT page_id, url FROM pages WHERE page_id NOT IN (SELECT page_id FROM matches)",
    "url_host": f"WITH {BASE_SQL} SELECT page_id, seq, {HOST_SQL} AS host FROM requests",
    "url_host_odd": f"""WITH {BASE_SQL}, plain AS (SELECT page_id, seq, {HOST_SQL} AS h FROM requests WHERE regexp_matches(url, '{_PLAIN_URL}'))
      SELECT page_id, seq, CASE seq % 8 WHEN 4 THEN concat(h, '.') WHEN 5 THEN CASE WHEN page_id < 256 THEN concat(page_id, '.', seq // 65536 % 256, '.', seq // 256 % 256, '.', seq % 256) END WHEN 6 THEN NULL WHEN 7 THEN concat('xn--bcher-kva.', h) ELSE h END AS host FROM plain""",
    "url_scheme_filter": f"WITH {BASE_SQL} SELECT page_id, seq, url FROM requests WHERE lower(url) LIKE 'http://%' OR lower(url) LIKE 'https://%'",
    "empty_urls_dropped": f"WITH {BASE_SQL} SELECT page_id, count(*) AS requests FROM requests WHERE url <> '' GROUP BY page_id",
    "registrable_domain": f"WITH {BASE_SQL} SELECT host, {REG_SQL.format('host')} AS registrable, count(*) AS requests FROM (SELECT {HOST_SQL} AS host FROM requests) WHERE host IS NOT NULL GROUP BY host",
    "first_party_filter": f"WITH {UNKNOWN_SQL} SELECT page_id, seq, host FROM hosts WHERE host IS NOT NULL AND (host = page_host OR {REG_SQL.format('host')} = {REG_SQL.format('page_host')})",
    "known_rule_exclusion": f"WITH {UNKNOWN_SQL} SELECT page_id, seq, host FROM unknown",
    "unknown_hosts": f"WITH {UNKNOWN_SQL} SELECT page_id, host, first_seq FROM unknown_hosts",
    "unknown_hosts_top20": f"WITH {UNKNOWN_SQL} SELECT page_id, host, place FROM unknown_hosts WHERE place <= 20",
    "unknown_host_spread": f"WITH {UNKNOWN_SQL} SELECT host, count(*) AS pages FROM unknown_hosts GROUP BY host",
}
