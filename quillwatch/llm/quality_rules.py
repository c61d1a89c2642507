"""Quality rules with verdicts by host.

Each document gets counts from its whole text and fails or passes a few rules on them. Failures are added up by
host, each host's failure rate of each rule is shrunk toward a beta prior fitted to all hosts, and hosts whose
shrunk rate stays high pass their verdict on to all their documents. Built-in functions only.

Cases: a null or empty text has no words and fails; a null host is a host of its own; repeated rows count each; an
empty table gives an empty table; input columns named like the outputs are replaced, others may have any name; very
long texts are counted whole. Words are runs of ``[^\\x20\\x09-\\x0D]``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import fresh, numbered, quoted, renamed
from .storage import Scratch

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A host is rejected when its shrunk rate of failures of any one rule is above this.
MAX_HOST_RATE = 0.5
#: Up to so many hosts' verdicts (tens of bytes each) are broadcast; above, the join shuffles.
BROADCAST_HOSTS = 100_000
#: So many repeated windows of a text at most are looked up one after the other; beyond, positions are sorted.
FEW_WINDOWS = 32

BLANK = " \t\n\x0b\f\r"
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RULES = {
    "few_words": f"n_words < {MIN_WORDS}",
    "repeats": f"100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "20 * n_dup_lines > n_words",
    "word_length": "word_chars < 3 * n_words or word_chars > 12 * n_words",
}


def _let(value: Column, body) -> Column:
    """body(value) with value computed once: lambda arguments are bound, not copied."""
    return F.transform(F.array(value), body)[0]


def _covered(positions: Column) -> Column:
    """Words in the union of 3-word windows that start at ascending positions."""
    def step(acc: Column, p: Column) -> Column:
        return F.struct((acc["n"] + F.least(F.lit(3), p + 3 - acc["end"])).cast("long").alias("n"), (p + 3).alias("end"))

    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("end"))
    return F.aggregate(positions, start, step, lambda acc: acc["n"])


def _repeat_words(windows: Column) -> Column:
    """windows: one 64-bit key a 3-word window, in order, some of which stand there twice or more."""
    def few(again: Column) -> Column:
        return _covered(F.filter(F.transform(windows, lambda w, i: F.when(F.array_contains(again, w), i)), lambda i: i.isNotNull()))

    def many(pairs: Column) -> Column:
        def twin(x: Column, i: Column) -> Column:
            return (F.get(pairs, i - 1)["w"] == x["w"]) | (F.get(pairs, i + 1)["w"] == x["w"])
        return _covered(F.sort_array(F.transform(F.filter(pairs, lambda x, i: F.coalesce(twin(x, i), F.get(pairs, i + 1)["w"] == x["w"], F.lit(False))), lambda x: x["i"])))

    def choose(again: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        return F.when(F.size(again) <= FEW_WINDOWS, few(again)).otherwise(_let(pairs, many))

    ordered = F.sort_array(windows)
    again = _let(ordered, lambda o: F.array_distinct(F.filter(o, lambda w, i: (i > 0) & (F.get(o, i - 1) == w))))
    return _let(again, choose)


def count_features(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the columns of FEATURES (long), from each whole text."""
    plain = F.coalesce(F.col(quoted(text)), F.lit(""))
    out = df.drop(*FEATURES)
    kept = out.columns
    words, lines, keys = fresh([*df.columns, *FEATURES], "_words", "_lines", "_windows")
    # each array is named by a projection of its own and used twice or more, so that it is computed once
    trimmed = F.btrim(plain, F.lit(BLANK))
    out = out.withColumn(words, F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \t\n\x0b\f\r]+", -1)))
    out = out.withColumn(lines, F.filter(F.split(plain, "\n", -1), lambda x: F.btrim(x, F.lit(BLANK)) != ""))
    word = F.col(words)
    out = out.withColumn(keys, F.when(F.size(word) >= 3, F.transform(F.sequence(F.lit(0), F.size(word) - 3), lambda i: F.xxhash64(F.get(word, i), F.get(word, i + 1), F.get(word, i + 2)))).otherwise(F.array().cast("array<bigint>")))
    windows = F.col(keys)
    return out.select(
        *[F.col(quoted(c)) for c in kept],
        F.size(word).cast("long").alias("n_words"),
        F.length(F.array_join(word, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(plain, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(_repeat_words(windows)).cast("long").alias("n_repeat_words"),
    )


def _prior(rates: DataFrame) -> dict[str, tuple[float, float]]:
    """For each rule a beta prior (a, b) by moments over the hosts: one row comes to the driver, whatever their number."""
    sums = [F.sum("n").alias("n")]
    for r in RULES:
        sums += [F.sum(r).alias(f"{r}_k"), F.sum(F.col(r) * F.col(r) / F.col("n")).alias(f"{r}_kk")]
    row = rates.agg(*sums).first()
    prior = {}
    for r in RULES:
        n, k, kk = row["n"] or 0, row[f"{r}_k"] or 0, row[f"{r}_kk"] or 0.0
        mean = (k + 0.5) / (n + 1)
        spread = max((kk - k * k / n) / n, 0.0) if n else 0.0  # of the hosts' rates, weighted by documents
        strength = min(max(mean * (1 - mean) / spread - 1, 1.0), 1e4) if spread > 0 else 1e4
        prior[r] = (mean * strength, (1 - mean) * strength)
    return prior


def failures(features: DataFrame, host: str = "source") -> DataFrame:
    """Rows (host, n, each rule's number of failures)."""
    failed = features.select(F.col(quoted(host)).alias("host"), *[F.expr(rule).cast("long").alias(r) for r, rule in RULES.items()])
    return failed.groupBy("host").agg(F.count("*").alias("n"), *[F.sum(r).alias(r) for r in RULES])


def host_verdicts(rates: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Rows (host, n, each rule's shrunk failure rate, host_rejected), from failures."""
    prior = _prior(rates)
    shrunk = {r: (F.col(r) + a) / (F.col("n") + a + b) for r, (a, b) in prior.items()}
    return rates.select("host", "n", *[v.alias(r) for r, v in shrunk.items()], F.greatest(*shrunk.values()).__gt__(max_rate).alias("host_rejected"))


def _judge(df: DataFrame, carry: list[str], text: str, host: str, max_rate: float, broadcast_hosts: int) -> DataFrame:
    """(carried: df's columns of carry, FEATURES, base_failed, host_rejected, kept), a row for each of df's.

    The counts are written once; hosts are aggregated from them, and the verdicts joined to them.
    """
    rows = df.select(F.struct(*[F.col(quoted(c)) for c in carry]).alias("carried"), F.col(quoted(host)).alias("host"), F.col(quoted(text)).alias("_text"))
    counted = Scratch(df.sparkSession).keep(count_features(rows, "_text").drop("_text"))
    verdicts = host_verdicts(failures(counted, "host"), max_rate).select(F.col("host").alias("_host"), "host_rejected")
    n_hosts = counted.agg(F.approx_count_distinct("host")).first()[0]
    verdicts = F.broadcast(verdicts) if n_hosts <= broadcast_hosts else verdicts
    joined = counted.join(verdicts, F.col("host").eqNullSafe(F.col("_host")), "left").drop("_host", "host")
    return _with_verdict(joined)


def _with_verdict(joined: DataFrame) -> DataFrame:
    failed = F.expr(f"({RULES['few_words']}) or ({RULES['repeats']})")
    return joined.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def apply_quality_rules(df: DataFrame, text: str = "text", host: str = "source", max_rate: float = MAX_HOST_RATE, broadcast_hosts: int = BROADCAST_HOSTS, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of carry, then FEATURES, base_failed, host_rejected and kept, a row for each of df's."""
    judged = _judge(df, list(carry), text, host, max_rate, broadcast_hosts)
    return judged.select("carried.*", *FEATURES, "base_failed", "host_rejected", "kept")


def drop_rejected(df: DataFrame, text: str = "text", host: str = "source", max_rate: float = MAX_HOST_RATE, broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """The rows of df that are kept, with df's columns, whatever their names.

    Texts are counted twice, for the hosts' failures and for the rows themselves, so that nothing but a row a host is
    written.
    """
    names, rows = df.columns, numbered(df)
    own_text, own_host = (f"c{names.index(c)}" for c in (text, host))
    def counted(part: DataFrame) -> DataFrame:
        """Counts as a generator's columns, into which no filter above is pushed: each is computed once."""
        return count_features(part, own_text).select(*part.columns, F.inline(F.array(F.struct(*FEATURES))))

    rates = Scratch(df.sparkSession).keep(failures(counted(rows.select(own_text, own_host)), own_host))
    verdicts = host_verdicts(rates, max_rate).select(F.col("host").alias("_host"), "host_rejected")
    verdicts = F.broadcast(verdicts) if rates.count() <= broadcast_hosts else verdicts
    joined = counted(rows).join(verdicts, F.col(own_host).eqNullSafe(F.col("_host")), "left")
    return renamed(_with_verdict(joined).filter("kept"), names)
