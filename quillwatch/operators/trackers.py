"""Request logs against the rule catalog: which trackers a page uses, and which hosts nothing explains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import urls
from ..sources.catalog import DEFAULT_RULES, Rule, catalog_frame, known_pattern
from .fragments import match_catalog

#: Up to so many rules are tested by literal patterns, which are compiled once; a larger catalog is joined through an index
#: of its literal parts. They are tried in batches, of which one pattern tells first whether any of them matches.
LITERAL_RULES, BATCH_RULES = 5_000, 100
UNKNOWN_HOSTS = 20
# What a page may be judged, by whether anything was found.
STATUS_FOUND, STATUS_CLEAN = "warning", "pass"
RISK_RANK = {"high": 0, "medium": 1, "low": 2}


def match_rules(requests: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES, url: str = "url", literal_rules: int = LITERAL_RULES) -> DataFrame:
    """requests with a row for each rule that its URL matches, and the rule's columns. Empty URLs match nothing.

    The catalog is broadcast: it is the caller's tuple, so its size is known.
    """
    if len(rules) > literal_rules:
        return match_catalog(requests, catalog_frame(requests.sparkSession, rules), url)
    catalog = F.broadcast(catalog_frame(requests.sparkSession, rules))
    real = requests.filter(F.col(url) != "")
    none = F.array().cast("array<int>")
    hits = []
    for first in range(0, len(rules), BATCH_RULES):
        batch = rules[first : first + BATCH_RULES]
        each = F.array_compact(F.array(*[F.when(F.col(url).rlike(f"(?i){r.pattern}"), F.lit(first + k)) for k, r in enumerate(batch)]))
        hits.append(each if len(rules) <= BATCH_RULES else F.when(F.col(url).rlike(known_pattern(batch)), each).otherwise(none))
    hits = F.concat(*hits) if hits else none
    return real.filter(F.col(url).rlike(known_pattern(rules))).withColumn("cat_idx", F.explode(hits)).join(catalog, "cat_idx").drop("pattern")


def detect_trackers(requests: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES) -> DataFrame:
    """A row for each page and tracker name: the first match's rule and URL, the number of matches, and their place.

    One shuffle on (page, name); counts and minima are partial aggregates, so a page with a huge log is no hot task.
    """
    first = F.struct("seq", "cat_idx")
    found = match_rules(requests, rules)
    return found.groupBy("page_id", "name").agg(
        F.min_by(F.struct("vendor", "risk", "description", "baa", "url"), first).alias("r"),
        F.min(first).alias("f"),
        F.count("*").alias("request_count"),
    ).select("page_id", "name", "r.vendor", "r.risk", "r.description", "r.baa", F.col("r.url").alias("example_url"), "request_count", F.col("f.seq").alias("first_seq"), F.col("f.cat_idx").alias("first_idx"))


def ordered(trackers: DataFrame, by_risk: bool = False) -> DataFrame:
    """Each page's trackers with their place: by first match, or by risk first (unknown risks last)."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for p in RISK_RANK.items() for x in p])[F.col("risk")], F.lit(len(RISK_RANK)))
    order = [rank] * by_risk + [F.col("first_seq"), F.col("first_idx")]
    return trackers.withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy(*order)))


def tracker_list(trackers: DataFrame) -> DataFrame:
    """(page_id, runtime_trackers): each page's trackers in order of first match; one entry a catalog name at most."""
    entry = F.struct("first_seq", "first_idx", "name", "vendor", "risk", "description", "baa", "example_url", "request_count")
    listed = trackers.groupBy("page_id").agg(F.sort_array(F.collect_list(entry)).alias("t"))
    return listed.select("page_id", F.transform("t", lambda x: F.struct(*[x[c].alias(c) for c in ("name", "vendor", "risk", "description", "baa", "example_url", "request_count")])).alias("runtime_trackers"))


def page_status(pages: DataFrame, trackers: DataFrame) -> DataFrame:
    """Every page with warning_count, critical_count, info_count and overall_status."""
    counts = trackers.groupBy("page_id").agg(F.count_distinct("name").alias("warning_count"))
    joined = pages.join(counts, "page_id", "left").withColumn("warning_count", F.coalesce("warning_count", F.lit(0).cast("long")))
    return joined.withColumns({"critical_count": F.lit(0).cast("long"), "info_count": F.lit(0).cast("long"), "overall_status": status(F.col("warning_count"))})


def status(warnings: Column) -> Column:
    return F.when(warnings > 0, STATUS_FOUND).otherwise(STATUS_CLEAN)


def unknown_requests(requests: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES) -> DataFrame:
    """Requests to third parties that no rule explains, with their host. requests: (page_id, page_url, seq, url)."""
    hosts = requests.filter(F.col("url") != "").withColumn("host", urls.host(F.col("url"))).filter("host is not null")
    third = hosts.filter(urls.is_third_party(F.col("host"), urls.host(F.col("page_url"))))
    if len(rules) > LITERAL_RULES:
        return third.join(match_rules(third.select("url").distinct(), rules).select("url").distinct(), "url", "left_anti").select(*third.columns)
    return third.filter(~F.col("url").rlike(known_pattern(rules)))


def unknown_hosts(requests: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES, limit: int | None = UNKNOWN_HOSTS) -> DataFrame:
    """(page_id, host, first_seq, place): distinct unknown hosts of each page in order of appearance, limit a page."""
    first = unknown_requests(requests, rules).groupBy("page_id", "host").agg(F.min("seq").alias("first_seq"))
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy("first_seq", "host")))
    return placed if limit is None else placed.filter(F.col("place") <= limit)
