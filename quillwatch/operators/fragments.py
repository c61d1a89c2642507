"""Request logs against catalogs of any size, through an index of literal fragments.

A pattern can match only where one of its alternatives' literal parts stands in the URL. Of each alternative's longest
literal part the index holds one piece of ``PIECE`` characters, the one that the catalog has least often. URLs are cut
into pieces too and meet the rules by an equi-join on them; the patterns are tried on what meets, and nowhere else. Rules
with an alternative that has no such part can't be indexed and are tried on every URL, in batches of literal patterns.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIECE = 6
#: Up to so many indexed pieces are broadcast with their patterns; above that distinct URLs are shuffled by piece.
BROADCAST_PIECES = 200_000
#: Pieces of these stand in many URLs and are taken only where an alternative has no others.
COMMON = ("https://www.", "http://www.", "://cdn.", ".com/", ".net/", ".org/", "/js/", ".min.js", "script", "static")

_TOKEN = re.compile(r"\\(?P<escaped>[^A-Za-z0-9])|\\.|\[(?P<single>[^\]^\\])\]|\[\^?\]?(?:\\.|[^\]\\])*\]|(?P<plain>[^\\\[\](){}|?*+.^$])|(?P<other>.)", re.S)
_REPEAT = re.compile(r"[?*+]|\{\d*,?\d*\}")


def literal_parts(pattern: str) -> list[str] | None:
    """The longest literal part of each alternative of a pattern in lower case; None if any has none that can be indexed.

    Only what every match must hold counts: groups, classes and optional characters end a part, and patterns that need
    more understanding than that have no parts.
    """
    if "\\Q" in pattern or pattern.count("(") != pattern.count(")") or "(?x" in pattern or re.search(r"\(\?[a-zA-Z]*-", pattern):
        return None
    parts, longest, run, depth, at = [], "", "", 0, 0

    def end_run() -> None:
        nonlocal longest, run
        longest, run = max(longest, run, key=len), ""

    while at < len(pattern):
        token = _TOKEN.match(pattern, at)
        at = token.end()
        repeat = _REPEAT.match(pattern, at)
        at = repeat.end() if repeat else at
        while repeat and at < len(pattern) and pattern[at] in "?+":  # reluctant and possessive
            at += 1
        letter = token["escaped"] or token["single"] or token["plain"]
        if token["other"] == "(":
            end_run()
            depth += 1
        elif token["other"] == ")":
            depth -= 1
        elif depth:
            continue
        elif token["other"] == "|":
            end_run()
            parts.append(longest)
            longest = ""
        elif letter is None or not letter.isascii():
            end_run()
        elif repeat is None:
            run += letter.lower()
        elif repeat[0] == "+" or re.match(r"\{[1-9]", repeat[0]):
            run += letter.lower()
            end_run()
        else:
            end_run()
    end_run()
    parts.append(longest)
    return list(dict.fromkeys(parts)) if all(len(p) >= PIECE for p in parts) else None


@F.pandas_udf(T.ArrayType(T.StringType()))
def _literals(pattern: pd.Series) -> pd.Series:
    return pattern.map(lambda p: literal_parts(p) if p is not None else None)


def pieces(text: Column) -> Column:
    """The different pieces of a text, in lower case."""
    low = F.lower(text)
    begins = F.when(F.length(low) >= PIECE, F.sequence(F.lit(1), F.length(low) - PIECE + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(begins, lambda k: F.substr(low, k, F.lit(PIECE))))


def index_rules(catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(piece, place, pieces, cat_idx, pattern) of rules that can be indexed, one row for each piece; and the other rules.

    pieces are a rule's in the order of its alternatives, and place is where in them a row's own is.
    """
    parsed = catalog.withColumn("literals", _literals("pattern")).persist()
    each = parsed.filter("literals IS NOT NULL").select("cat_idx", F.posexplode("literals").alias("alternative", "literal"))
    own = F.slice(pieces(F.col("literal")), 1, 1 << 16)  # of longer parts the first are choice enough
    cut = each.select("cat_idx", "alternative", F.posexplode(own).alias("place", "piece"))
    often = cut.groupBy("piece").agg(F.count("*").alias("n"))
    usual = sorted({t[k : k + PIECE] for t in COMMON for k in range(len(t) - PIECE + 1)})
    common = F.col("piece").isin(usual) | F.col("piece").rlike("|".join(re.escape(t) for t in COMMON if len(t) <= PIECE))
    # one number says whether a piece is common, how often it comes, and where it is, so that its least is a plain minimum
    rank = F.when(common, 1 << 56).otherwise(0) + F.least("n", F.lit(1 << 39)) * (1 << 16) + F.col("place")
    best = cut.join(often, "piece").groupBy("cat_idx", "alternative").agg(F.min(rank).alias("best"))
    picked = each.join(best, ["cat_idx", "alternative"]).select("cat_idx", "alternative", F.get(own, (F.col("best") % (1 << 16)).cast("int")).alias("piece"))
    chosen = picked.groupBy("cat_idx").agg(F.sort_array(F.collect_list(F.struct("alternative", "piece"))).alias("p")).join(parsed.select("cat_idx", "pattern"), "cat_idx")
    listed = chosen.select("cat_idx", "pattern", F.array_distinct(F.col("p.piece")).alias("pieces"))  # a rule's own alternatives only
    return listed.select("cat_idx", "pattern", "pieces", F.posexplode("pieces").alias("place", "piece")), parsed.filter("literals IS NULL").drop("literals")


def _meeting(urls: DataFrame, index: DataFrame, url: str) -> DataFrame:
    """urls with the rules (cat_idx) that match them: those that a piece leads to, each by the first of its pieces only."""
    met = urls.withColumn("piece", F.explode(pieces(F.col(url)))).join(index, "piece")
    low = F.lower(F.col(url))
    first = F.forall(F.slice("pieces", 1, F.col("place")), lambda p: ~F.contains(low, p))
    return met.filter(first & F.rlike(F.col(url), F.concat(F.lit("(?i)"), "pattern"))).drop("piece", "place", "pieces", "pattern")


def match_catalog(requests: DataFrame, catalog: DataFrame, url: str = "url", broadcast_pieces: int = BROADCAST_PIECES) -> DataFrame:
    """requests with a row for each rule of a catalog (as catalog_frame gives it, of any size) that its URL matches, and the
    rule's columns but the pattern. Null and empty URLs match nothing; repeated requests match each."""
    index, others = index_rules(catalog)
    index = index.persist()  # a few dozen bytes a rule, spilled where memory is short
    n = index.count()
    real = requests.filter(F.col(url) != "")
    if n <= broadcast_pieces:
        found = _meeting(real, F.broadcast(index), url)
    else:
        of_urls = _meeting(real.select(url).distinct(), index, url)
        found = real.join(of_urls, url)
    found = found.select(*requests.columns, "cat_idx")
    slow = [(r["cat_idx"], r["pattern"]) for r in others.select("cat_idx", "pattern").toLocalIterator()]
    for first in range(0, len(slow), 100):
        batch = slow[first : first + 100]
        hits = F.array_compact(F.array(*[F.when(F.col(url).rlike(f"(?i){p}"), F.lit(k)) for k, p in batch]))
        found = found.unionByName(real.withColumn("cat_idx", F.explode(hits)))
    return found.join(catalog.drop("pattern"), "cat_idx").select(*requests.columns, *[c for c in catalog.columns if c != "pattern"])
