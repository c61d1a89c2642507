"""Importance resampling towards a target distribution.

A text's features are its runs of words, hashed into buckets. A bucket's gain is the log of how much likelier the target
is to hold it than the corpus; a text's weight is the mean gain of its features. Texts are drawn by Gumbel noise: of
weight plus noise, seeded by the id, the highest go into the sample, which so is one without replacement by weight.

Identical texts are collapsed first, by grouping on the full text: features and weight are computed once for each
different text, its counts go into the corpus' histogram times its copies, and weights are joined back to the rows
before the noise of each row comes in. Histograms have one row a bucket, and scores one a distinct number (an integer of
some tens of thousands), so both are bounded. Ranks come from a range-partitioned sort of the rows at or above the last
drawn score, whose partitions' sizes give each its first rank; no task sees all rows.

Cases: null and empty texts, and texts without words, have no features, weight 0 and are never drawn where min_words is 1
or more; very long texts are read whole; rows repeated with one id have one noise and, if their texts agree, one score,
and rank one after the other; a null id is read as an empty one and comes last of a tie; an empty target or corpus gives
gains of smoothing alone; an empty table gives an empty table; input columns named like the outputs are replaced, others
may have any name.
"""

from __future__ import annotations

import math
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import numbered, renamed
from .storage import Scratch

BUCKETS = 10_000
#: Documents with fewer words are not drawn.
MIN_WORDS = 20
#: Hundredths of the others that are.
PERCENT = 10
SEED = 2024
NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased."""
    plain = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase), NOT_WORD, " ")
    return F.filter(F.split(plain, " ", -1), lambda w: w != "")


def _runs(words: Column, longest: int) -> Column:
    """All runs of 1 to longest consecutive words, each joined by one space."""
    runs = [words]
    for k in range(2, longest + 1):  # the last run of k - 1 has no word after it
        longer = F.zip_with(runs[-1], F.slice(words, k, F.size(words)), lambda run, word: F.concat(run, F.lit(" "), word))
        runs.append(F.filter(longer, lambda run: run.isNotNull()))
    return F.concat(*runs)


def distinct_texts(texts: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(key, n, n_words, buckets) of each different text of a one-column DataFrame: its digest, how often it comes, its
    number of words, and the bucket of each of its features."""
    counted = texts.toDF("text").groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.count("*").alias("n"))
    counted = counted.select("text", "n", words_of(F.col("text")).alias("words"))
    hashed = F.transform(_runs(F.col("words"), longest), lambda f: F.pmod(F.crc32(f.cast("binary")), F.lit(buckets)).cast("int"))
    return counted.select(_digest(F.col("text")).alias("key"), "n", F.size("words").cast("long").alias("n_words"), hashed.alias("buckets"))


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def histogram(distinct: DataFrame) -> DataFrame:
    """(bucket, n): features of all rows by bucket, copies counted by multiplying."""
    return distinct.select("n", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Each bucket's log ratio of smoothed shares, in thousandths."""
    s_all, t_all = float(sum(corpus.values())), float(sum(target.values()))
    return [math.floor(1000 * math.log((target.get(b, 0) + 1.0) * (s_all + buckets) / ((corpus.get(b, 0) + 1.0) * (t_all + buckets)))) for b in range(buckets)]


def weigh(df: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """df with n_words, n_features and weight of each text."""
    scratch = Scratch(df.sparkSession)
    names = df.columns
    rows = numbered(df)
    own = F.col(f"c{names.index(text)}")
    corpus = scratch.keep(distinct_texts(rows.select(own), longest, buckets))
    aim = distinct_texts(numbered(target).select(f"c{target.columns.index(target_text)}"), longest, buckets)
    found = [{r["bucket"]: r["n"] for r in histogram(x).collect()} for x in (corpus, aim)]  # at most a row a bucket
    gain = F.split(F.lit(",".join(map(str, gains(*found, buckets)))), ",").cast("array<long>")  # folded to a literal
    total, n = F.aggregate("buckets", F.lit(0).cast("long"), lambda sum_, b: sum_ + F.get(gain, b)), F.size("buckets").cast("long")
    weights = corpus.select("key", "n_words", n.alias("n_features"), total.alias("total"))
    mean = F.expr("CASE WHEN n_features = 0 THEN 0L ELSE (total - pmod(total, n_features)) DIV n_features END")
    weights = weights.select("key", "n_words", "n_features", mean.alias("weight"))
    return renamed(rows.withColumn("key", _digest(own)).join(weights, "key"), names, "n_words", "n_features", "weight")


def noise(id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, by the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def draw(weighed: DataFrame, id: str = "doc_id", min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """weigh's rows with score, and rank where drawn: 1 for the highest score, ties to the lesser id."""
    scratch = Scratch(weighed.sparkSession)
    names = weighed.columns
    own_id, weight, n_words = (F.col(f"c{names.index(c)}") for c in (id, "weight", "n_words"))
    scored = scratch.keep(numbered(weighed).withColumn("score", weight + noise(own_id, seed)))
    able = scored.filter(n_words >= min_words)
    by_score = sorted(((r["score"], r["n"]) for r in able.groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    drawn = percent * sum(n for _, n in by_score) // 100
    last, above = math.inf, 0  # the last score that any drawn row has
    for score, n in by_score:
        if above >= drawn:
            break
        last, above = score, above + n
    if not drawn:
        return renamed(scored.withColumn("rank", F.lit(None).cast("long")), names, "score", "rank")
    near = F.coalesce((n_words >= min_words) & (F.col("score") >= last), F.lit(False))
    order = (F.col("score").desc(), own_id.asc_nulls_last(), F.col("tie"))
    ordered = scored.filter(near).withColumn("tie", F.monotonically_increasing_id()).orderBy(*order)
    ordered = scratch.keep(ordered.drop("tie").withColumn("place", F.monotonically_increasing_id()))  # partition and place in it
    part = F.shiftright("place", 33)
    first, sizes = 0, []
    for r in ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():  # one row a partition
        sizes.append((r["part"], first))
        first += r["n"]
    starts = F.broadcast(weighed.sparkSession.createDataFrame(sizes, "part long, first long"))
    rank = F.col("first") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranked = ordered.withColumn("part", part.cast("long")).join(starts, "part").withColumn("rank", F.when(rank <= drawn, rank))
    every = ranked.drop("part", "first", "place").unionByName(scored.filter(~near).withColumn("rank", F.lit(None).cast("long")))
    return renamed(every, names, "score", "rank")


def resample(df: DataFrame, target: DataFrame, id: str = "doc_id", text: str = "text", target_text: str = "text", longest: int = 1, buckets: int = BUCKETS, **options) -> DataFrame:
    """The rows of df that are drawn, with df's columns."""
    names = df.columns
    weighed = weigh(numbered(df), target, f"c{names.index(text)}", target_text, longest, buckets)
    return renamed(numbered(draw(weighed, f"c{names.index(id)}", **options).filter("rank IS NOT NULL")), names)
