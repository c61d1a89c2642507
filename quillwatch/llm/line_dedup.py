"""Line dedup by site-relative frequency.

For each host, the number of its pages that hold a line is divided by the host's page total; lines above a ratio
that stand on a least number of pages are boilerplate and are dropped from every page of that host, however small.

Cases: a null text stays null and counts as a page without lines; a null host is a host of its own; a line without
any character but white space is never dropped; a line counts once a page however often it stands there; repeated
rows count as pages of their own; a page may be left with an empty text, and stays; an empty table gives an empty
table. Lines are those between ``\\n`` characters; the kept ones are joined again in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import fresh
from .storage import Scratch

MAX_RATIO = 0.1
#: A line on fewer pages than this says nothing of what is common on a host; from 20 pages on the ratio asks for as many.
MIN_LINE_PAGES = 3
#: Boilerplate lists of all hosts together up to this many lines (16 bytes each) are broadcast; above, both sides are shuffled.
BROADCAST_LINES = 100_000


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    """128 bits, so that two lines of one host never meet by chance."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def _is_blank(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\n\x0b\f\r")) == ""


def boilerplate(df: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_host_pages: int = 1, min_line_pages: int = MIN_LINE_PAGES) -> DataFrame:
    """Rows (host, key, n_pages, host_pages) of the lines above the ratio.

    A page's lines are reduced to distinct 16-byte keys before the shuffle and counted by partial aggregates, so
    neither a hot host nor a hot line gathers in one task.
    """
    pages = df.select(F.col(host).alias("host"), F.col(text).alias("text"))
    # lines are made distinct as strings, which are hashed; structs would be compared each with each
    keys = F.transform(F.array_distinct(F.filter(_lines(F.col("text")), lambda x: ~_is_blank(x))), _key)
    counts = pages.select("host", F.explode(keys).alias("key")).groupBy("host", "key").agg(F.count("*").alias("n_pages"))
    totals = pages.groupBy("host").agg(F.count("*").alias("host_pages")).filter(F.col("host_pages") >= min_host_pages)
    # both least numbers bound what a line must reach on any host, so most lines go before the join
    counts = counts.filter((F.col("n_pages") >= min_line_pages) & (F.col("n_pages") > max_ratio * min_host_pages))
    joined = counts.alias("c").join(totals.alias("t"), F.expr("c.host <=> t.host"))
    return joined.select("c.host", "key", "n_pages", "host_pages").filter(F.col("n_pages") > F.lit(max_ratio) * F.col("host_pages"))


def drop_boilerplate(df: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_host_pages: int = 1, broadcast_lines: int = BROADCAST_LINES, min_line_pages: int = MIN_LINE_PAGES) -> DataFrame:
    """df with the text less its host's boilerplate, and n_lines_dropped. A column of that name is replaced.

    Hosts with fewer than min_host_pages pages, none by default, keep all lines.
    """
    scratch = Scratch(df.sparkSession)
    found = scratch.keep(boilerplate(df, host, text, max_ratio, min_host_pages, min_line_pages).groupBy("host").agg(F.collect_list("key").alias("keys"), F.count("*").alias("n")))
    n_lines = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    of, keys, left = fresh([*df.columns, "n_lines_dropped"], "_host", "_keys", "_left")
    lists = found.select(F.col("host").alias(of), F.col("keys").alias(keys))
    lists = F.broadcast(lists) if n_lines <= broadcast_lines else lists
    joined = df.join(lists, F.col(host).eqNullSafe(F.col(of)), "left")
    # which of a page's lines may be listed is found by hashing, so only those are held against the list one by one
    listed = F.array_intersect(F.transform(_lines(F.col(text)), lambda x: F.xxhash64(x)), F.transform(keys, lambda k: k["a"]))
    gone = lambda near, x: ~_is_blank(x) & F.array_contains(near, F.xxhash64(x)) & F.array_contains(F.col(keys), _key(x))
    kept = F.transform(F.array(listed), lambda near: F.filter(_lines(F.col(text)), lambda x: ~gone(near, x)))[0]
    has = F.col(keys).isNotNull() & F.col(text).isNotNull()
    joined = joined.withColumn(left, F.when(has, kept))
    dropped = F.when(has, F.size(_lines(F.col(text))) - F.size(left)).otherwise(0).cast("long")
    out = joined.withColumn("n_lines_dropped", dropped).withColumn(text, F.when(has, F.array_join(left, "\n")).otherwise(F.col(text)))
    return out.drop(of, keys, left)
