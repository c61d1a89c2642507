"""Queries over reviewers' replies, with SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import verdicts
from ..sources.derived import REPLIES


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reply for each document, by doc_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return docs.withColumn("raw", F.array(*map(F.lit, REPLIES))[(F.col("doc_id") % len(REPLIES)).cast("int")])


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replies(spark, sf_dir).withColumn("p", verdicts.parse_verdict(F.col("raw")))


def verdict_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).select("doc_id", "p.score", "p.form_risk", "p.form_reasoning", F.array_join("p.missing", ",").alias("missing"), "p.error")


def verdict_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _replies(spark, sf_dir).select("doc_id", verdicts.fence_free(F.col("raw")).alias("inner"))


def verdict_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many replies each check rejects."""
    return _parsed(spark, sf_dir).groupBy(F.coalesce("p.error", F.lit("valid")).alias("outcome")).agg(F.count("*").alias("replies"))


def verdict_classifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.classification_rows(_parsed(spark, sf_dir).withColumnRenamed("p", "verdict"), "doc_id")


def verdict_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reply's verdict, or the stub where it has none."""
    v = verdicts.with_fallback(F.col("p"), F.lit("gemini-2.5-flash"), (F.col("doc_id") % 1000))
    out = _parsed(spark, sf_dir).withColumn("v", v)
    return out.select("doc_id", "v.score", "v.form_risk", F.array_join("v.missing", ",").alias("missing"), F.size("v.classifications").alias("n_classified"), "v.provider", "v.latency_ms")


def verdict_disabled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a reviewer."""
    out = verdicts.run_reviews(_replies(spark, sf_dir), None)
    return out.select("doc_id", "verdict.score", "verdict.form_risk", "verdict.provider", "verdict.latency_ms")


class _Echo:
    """A reviewer without a network: it answers with its payload, and fails where that says so."""

    name = "echo"

    def classify(self, payload: str) -> str:
        if payload.startswith("not"):
            raise ConnectionError
        return payload


def verdict_reviewer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pluggable reviewer over all rows; its errors and its invalid replies give the stub."""
    out = verdicts.run_reviews(_replies(spark, sf_dir).withColumnRenamed("raw", "payload"), _Echo)
    return out.select("doc_id", "verdict.score", "verdict.form_risk", "verdict.provider")


def verdict_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of two hosts each verdict classifies (extension)."""
    hosts = _replies(spark, sf_dir).select("doc_id", F.explode(F.array(F.lit("x.org"), F.lit("q.org"))).alias("host"))
    return verdicts.classify_hosts(hosts, _parsed(spark, sf_dir).withColumnRenamed("p", "verdict"), "doc_id").select("doc_id", "host", "phi_risk", "classified")


QUERIES = {f.__name__: f for f in (verdict_parse, verdict_fence, verdict_enum, verdict_classifications, verdict_stub, verdict_disabled, verdict_reviewer, verdict_coverage)}

# What each of REPLIES comes to, in order: score, form risk, reasoning, missing, error, classified hosts.
_WANT = (
    (3, "low", "contact only", "breach notice", None, 1), (5, "none", "", "", None, 0), (3, "medium", "", "", None, 0),
    (None, None, None, None, "bad score", 0), (None, None, None, None, "bad score", 0), (None, None, None, None, "bad score", 0), (None, None, None, None, "bad score", 0),
    (None, None, None, None, "bad form risk", 0), (None, None, None, None, "bad score", 0), (None, None, None, None, "not json", 0), (None, None, None, None, "empty", 0),
    (1, "high", "", "a,b", None, 2), (0, "high", "", "", None, 0), (None, None, None, None, "not an object", 0),
)
_v = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else _sql_text(x)
_WANT_SQL = "SELECT * FROM (VALUES " + ", ".join(f"({k}, {', '.join(map(_v, row))})" for k, row in enumerate(_WANT)) + ") w(k, score, form_risk, form_reasoning, missing, error, n_classified)"
_JOINED = f"FROM documents d JOIN ({_WANT_SQL}) w ON w.k = d.doc_id % {len(REPLIES)}"
_FENCED = ", ".join(f"({k}, {_sql_text('{' + r.split('{', 1)[1].rsplit('}', 1)[0] + '}' if r.startswith('```') else r.strip())})" for k, r in enumerate(REPLIES))
_STUB = "SELECT d.doc_id, coalesce(w.score, 0) AS score, coalesce(w.form_risk, 'none') AS form_risk, coalesce(w.missing, '') AS missing, w.n_classified, "
ORACLES = {
    "verdict_parse": f"SELECT d.doc_id, w.score, w.form_risk, w.form_reasoning, w.missing, w.error {_JOINED}",
    "verdict_fence": f'SELECT d.doc_id, f.t AS "inner" FROM documents d JOIN (VALUES {_FENCED}) f(k, t) ON f.k = d.doc_id % {len(REPLIES)}',
    "verdict_enum": f"SELECT coalesce(w.error, 'valid') AS outcome, count(*) AS replies {_JOINED} GROUP BY 1",
    "verdict_classifications": f"SELECT d.doc_id, c.* EXCLUDE (k) FROM documents d JOIN (VALUES (0, 'a.example.org', 'Ads', 'high', 'pixel'), (11, 'x.org', 'unknown', 'unknown', ''), (11, 'z.org', 'unknown', 'low', '')) c(k, domain, likely_vendor, phi_risk, reasoning) ON c.k = d.doc_id % {len(REPLIES)}",
    "verdict_stub": f"{_STUB} CASE WHEN w.error IS NULL THEN 'gemini-2.5-flash' ELSE 'disabled' END AS provider, CASE WHEN w.error IS NULL THEN d.doc_id % 1000 ELSE 0 END::BIGINT AS latency_ms {_JOINED}",
    "verdict_disabled": "SELECT doc_id, 0 AS score, 'none' AS form_risk, 'disabled' AS provider, 0::BIGINT AS latency_ms FROM documents",
    "verdict_reviewer": f"SELECT d.doc_id, coalesce(w.score, 0) AS score, coalesce(w.form_risk, 'none') AS form_risk, CASE WHEN w.error IS NULL THEN 'echo' ELSE 'disabled' END AS provider {_JOINED}",
    "verdict_coverage": f"SELECT d.doc_id, h.host, 'unknown' AS phi_risk, h.host = 'x.org' AND d.doc_id % {len(REPLIES)} = 11 AS classified FROM documents d CROSS JOIN (VALUES ('x.org'), ('q.org')) h(host)",
}
