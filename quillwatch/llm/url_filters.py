"""URL filters: rules first, then path-template trees by host.

A URL's host and path are cut out, and the longest rule that fits decides. All URLs, decided or not, go into a tree
of path segments per host. Level by level, segments that vary (many values with few URLs each) become a wildcard,
and branches that differ statistically little from their siblings in labelled rate are merged into it. What is left
of a path is its template; labelled URLs give each template a purity, smoothed toward one half. A template without
labels takes the purity of its siblings, which are the templates that differ in the last segment only, and where they
have none either, that of its host. URLs that no rule decides are blocked where this purity is low. Built-in functions
only.

Labels come from the rules' own verdicts unless a label column is given (1 bad, 0 good, null none).

Skew: URLs are counted by (host, shape) before any level, counts are partial aggregates, and joins on hosts are
sort-merge joins, which adaptive execution splits.

Cases: null URLs and those without ``://`` have an empty host and path, form a host of their own and get a verdict
like any other; repeated rows count each; very long URLs are read whole, and the tree goes on until no path has a
further segment; an empty table gives an empty table; input columns named like the outputs are replaced, and no other
name is taken.

Depth: below MAX_DEPTH levels each round takes the paths of a template over all that they share to where they branch
next, so the rounds are as many as a path has branchings, not segments. Only paths not yet at their end are written again.
"""

from __future__ import annotations

from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import fresh
from .storage import Scratch

# The rules of the registered query, as (verdict, host and path).
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
#: Up to so many rules are literals of the plan, which tries one after the other; more are looked up by host.
LITERAL_RULES = 200
#: Levels dealt with one by one, with all paths, which are all that the SQL twin has; the tree itself has no last level.
MAX_DEPTH = 4
#: A level varies when it has at least so many values, and fewer than so many URLs for each of them.
MIN_VALUES, MAX_URLS_A_VALUE = 8, 3
#: Branches may merge where a level has at least so many of them; their rate may differ from their siblings' by so many standard errors.
MIN_BRANCHES, MAX_DEVIATION = 3, 2.0
#: Half of this many labels of either kind are added to each template.
SMOOTHING = 4
MIN_PURITY = 0.3


def host_of(url: Column) -> Column:
    found = F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit(""))
    return F.translate(found, ascii_uppercase, ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null. The first of two equally long ones wins."""
    ordered = sorted(rules, key=lambda r: -len(r[1]))
    if len(ordered) > LITERAL_RULES:
        return _longest_by_host(host, path, ordered)

    def fits(rule: str) -> Column:
        own, slash, rest = rule.partition("/")
        return ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)

    none = F.lit(None).cast("struct<rule:string,verdict:string>")
    return reduce(lambda tail, r: F.when(fits(r[1]), F.struct(F.lit(r[1]).alias("rule"), F.lit(r[0]).alias("verdict"))).otherwise(tail), reversed(ordered), none)


def _longest_by_host(host: Column, path: Column, ordered: list[tuple[str, str]]) -> Column:
    """longest_rule for any number of rules, the best first: those of the host and of each domain above it are tried."""
    by_host: dict[str, list] = {}
    for rank, (verdict, rule) in enumerate(ordered):
        own, slash, rest = rule.partition("/")
        by_host.setdefault(own, []).append((rank, slash + rest, rule, verdict))
    rows = lambda found: F.array(*[F.struct(F.lit(k).alias("rank"), F.lit(p).alias("path"), F.lit(r).alias("rule"), F.lit(v).alias("verdict")) for k, p, r, v in found])
    table = F.map_from_arrays(F.array(*[F.lit(h) for h in by_host]), F.array(*[rows(found) for found in by_host.values()]))
    none = F.array().cast("array<struct<rank:int,path:string,rule:string,verdict:string>>")
    labels = F.split(host, "[.]", -1)
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    fits = F.filter(F.flatten(F.transform(domains, lambda d: F.coalesce(table[d], none))), lambda r: path.startswith(r["path"]))
    best = F.array_min(fits)
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def _general(segment: Column) -> Column:
    """Numbers and long hexadecimal names vary by nature."""
    number = F.regexp_extract(segment, "^[0-9]+([.][a-z0-9]{1,5})?$", 1)
    return F.when(segment.rlike("^[0-9]+([.][a-z0-9]{1,5})?$"), F.concat(F.lit("{n}"), number)).when(segment.rlike("^[0-9a-fA-F-]{16,}$"), F.lit("{h}")).otherwise(segment)


def _shape(path: Column) -> Column:
    """All segments, general."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/", -1)
    return F.when(path == "", F.array().cast("array<string>")).otherwise(F.transform(parts, _general))


def _branch(level: DataFrame, scratch: Scratch) -> DataFrame:
    """level with the first segment of rest moved to the template, as ``*`` where it merges."""
    here = level.withColumn("segment", F.get("rest", F.lit(0)))
    branch = here.filter("segment is not null").groupBy("host", "template", "segment").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled"))
    branch = scratch.keep(branch)
    whole = branch.groupBy("host", "template").agg(F.count("*").alias("branches"), F.sum("n").alias("all_n"), F.sum("bad").alias("all_bad"), F.sum("labelled").alias("all_labelled"))
    both = branch.join(whole, ["host", "template"])
    siblings = (F.col("all_bad") - F.col("bad") + 1) / (F.col("all_labelled") - F.col("labelled") + 2)
    apart = F.abs((F.col("bad") + 1) / (F.col("labelled") + 2) - siblings)
    # a branch without labels is no evidence, and only joins siblings that have none either
    compared = (F.col("labelled") > 0) & (F.col("all_labelled") > F.col("labelled"))
    similar = (F.col("all_labelled") == 0) | compared & (apart <= MAX_DEVIATION * F.sqrt(siblings * (1 - siblings) / (F.col("labelled") + 2)))
    varies = (F.col("branches") >= MIN_VALUES) & (F.col("all_n") < MAX_URLS_A_VALUE * F.col("branches"))
    merges = (F.col("branches") >= MIN_BRANCHES) & (2 * F.col("n") < F.col("all_n")) & similar
    merged = both.select("host", "template", "segment", (varies | merges).alias("wild"))
    joined = here.join(merged, ["host", "template", "segment"], "left")
    name = F.when(F.col("segment").isNull(), "").when(F.coalesce("wild", F.lit(False)), "/*").otherwise(F.concat(F.lit("/"), F.col("segment")))
    rest = F.when(F.col("segment").isNull(), F.col("rest")).otherwise(F.expr("slice(rest, 2, size(rest))"))
    out = scratch.keep(joined.withColumn("template", F.concat("template", name)).withColumn("rest", rest).select(*level.columns))
    scratch.drop(branch)
    return out


def _to_next_branch(level: DataFrame, scratch: Scratch) -> DataFrame:
    """level with the segments up to where a template's paths first differ moved to the template; a path that ends before is no difference."""
    longest = level.groupBy("host", "template").agg(F.max("rest").alias("_most"))
    both = scratch.keep(level.join(longest, ["host", "template"]))
    differs = F.expr("array_position(zip_with(rest, slice(_most, 1, size(rest)), (x, y) -> x <=> y), false)")
    shared = both.groupBy("host", "template").agg(F.min(F.when(differs > 0, differs - 1).otherwise(F.size("_most"))).cast("int").alias("_shared"))
    out = both.join(shared, ["host", "template"])
    name = F.concat(F.col("template"), F.expr("array_join(transform(slice(rest, 1, _shared), x -> concat('/', x)), '')"))
    out = scratch.keep(out.withColumn("template", name).withColumn("rest", F.expr("slice(rest, _shared + 1, size(rest))")).select(*level.columns))
    scratch.drop(both)
    return out


def template_tree(counts: DataFrame, scratch: Scratch) -> DataFrame:
    """counts: (host, shape, n, bad, labelled). Adds template: the shape with merged segments as ``*``."""
    level = scratch.keep(counts.withColumn("template", F.lit("")).withColumn("rest", F.col("shape")))
    for _ in range(MAX_DEPTH):
        last, level = level, _branch(level, scratch)
        scratch.drop(last)
    ended = []
    while not (deeper := level.filter(F.size("rest") > 0)).isEmpty():
        ended.append(level.filter(F.size("rest") == 0))
        if len(ended) > 16:
            ended = [scratch.keep(reduce(DataFrame.union, ended))]
        level = _to_next_branch(deeper, scratch)
        if not (deeper := level.filter(F.size("rest") > 0)).isEmpty():
            ended.append(level.filter(F.size("rest") == 0))
            level = _branch(deeper, scratch)
    return reduce(DataFrame.union, [*ended, level]).drop("rest")


def _purity(labelled: Column, bad: Column) -> Column:
    return (labelled - bad + SMOOTHING / 2) / (labelled + SMOOTHING)


def judge_urls(df: DataFrame, url: str = "url", rules=RULES, label: str | None = None) -> DataFrame:
    """df with host, path, rule, template, purity and verdict (allow or block)."""
    out = df.drop("host", "path", "rule", "template", "purity", "verdict")
    found, shape, own_host, own_shape = fresh([*df.columns, "host", "path", "rule", "template", "purity", "verdict"], "_found", "_shape", "_own_host", "_own_shape")
    out = out.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    out = out.withColumn(found, longest_rule(F.col("host"), F.col("path"), rules)).withColumn(shape, _shape(F.col("path")))
    bad = F.col(label) if label else F.when(F.col(f"{found}.verdict") == "block", 1).when(F.col(f"{found}.verdict") == "allow", 0)
    scratch = Scratch(df.sparkSession)
    counts = out.groupBy("host", F.col(shape).alias("shape")).agg(F.count("*").alias("n"), F.coalesce(F.sum(bad), F.lit(0)).cast("long").alias("bad"), F.count(bad).alias("labelled"))
    tree = template_tree(counts, scratch)
    totals = tree.groupBy("host", "template").agg(F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled")).withColumn("above", F.regexp_replace("template", "/[^/]*$", ""))
    totals = scratch.keep(totals)
    beside = totals.groupBy("host", "above").agg(F.sum("bad").alias("bad_beside"), F.sum("labelled").alias("labelled_beside"))
    whole = beside.groupBy("host").agg(F.sum("bad_beside").alias("bad_host"), F.sum("labelled_beside").alias("labelled_host"))
    backed = totals.join(beside, ["host", "above"]).join(whole, "host")
    purity = F.when(F.col("labelled") > 0, _purity(F.col("labelled"), F.col("bad"))).when(F.col("labelled_beside") > 0, _purity(F.col("labelled_beside"), F.col("bad_beside"))).otherwise(_purity(F.col("labelled_host"), F.col("bad_host")))
    judged = tree.select("host", "template", "shape").join(backed.select("host", "template", purity.alias("purity")), ["host", "template"])
    judged = scratch.keep(judged.select(F.col("host").alias(own_host), F.col("shape").alias(own_shape), "template", "purity"))
    joined = out.join(judged, (F.col("host") == F.col(own_host)) & (F.col(shape) == F.col(own_shape)), "left").drop(own_host, own_shape)
    method = F.when(F.col("purity") < MIN_PURITY, "block").otherwise("allow")
    return joined.withColumn("rule", F.col(f"{found}.rule")).withColumn("verdict", F.coalesce(F.col(f"{found}.verdict"), method)).drop(found, shape)
