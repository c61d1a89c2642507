"""Runs of claimed jobs from their start to their end: outcome, transition and telemetry of each.

A run's outcome is a row OUTCOME: what the scan of the job's page gave, or its error, and how long it took. A run beyond
the cap is an error whatever it gave, and so is one without any outcome. Errors release the job, or fail it on its last
claim.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import jobs, telemetry
from .results import result_json

# How long a run may take, and what is said of one that takes longer.
SCAN_CAP_MS = 90_000
CAP_ERROR = "deep scan exceeded 90s cap"
NO_OUTCOME = "scan gave no result"
OUTCOME = "job_id string, url string, result string, error string, duration_ms long, overall_status string, score int, ai_provider string, ai_latency_ms long"


def outcomes(requests: DataFrame, captures: DataFrame, results: DataFrame, whole: bool = True) -> DataFrame:
    """OUTCOME of jobs. requests (job_id, url); captures (url, page_id, duration_ms, error), the last of a URL by page_id
    counts; results as results.scan gives them, of which each is made once however many jobs ask for its page.

    Not whole: a job's result is its page_id, by which the results' rows are found, so that no document moves with each
    job that asks for its page; of results only page_id, overall_status and ai_verification are read."""
    last = captures.groupBy("url").agg(F.max_by(F.struct("page_id", "duration_ms", "error"), "page_id").alias("c"))
    shown = results.select("page_id", (result_json(results) if whole else F.col("page_id").cast("string")).alias("result"), "overall_status", F.col("ai_verification").alias("v"))
    seen = requests.join(last, "url", "left").select("job_id", "url", "c.*").join(shown, "page_id", "left")
    return seen.select("job_id", "url", "result", "error", "duration_ms", "overall_status", F.col("v.score").cast("int").alias("score"), F.col("v.provider").alias("ai_provider"), F.col("v.latency_ms").cast("long").alias("ai_latency_ms"))


def ended(held: DataFrame, outcome: DataFrame, cap_ms: int = SCAN_CAP_MS) -> DataFrame:
    """held (as jobs.fold gives it) with its outcome as run_error (null: none) and the OUTCOME columns, each job once."""
    late = F.col("duration_ms") > cap_ms
    out = held.join(outcome.withColumnRenamed("result", "run_result").withColumnRenamed("error", "said"), "job_id", "left")
    error = F.when(late, F.lit(CAP_ERROR)).when(F.col("said").isNotNull(), F.col("said")).when(F.col("run_result").isNull(), F.lit(NO_OUTCOME))
    return out.withColumn("run_error", error).withColumn("duration_ms", F.when(late, F.lit(cap_ms)).otherwise(F.coalesce("duration_ms", F.lit(0))).cast("long"))


def transitions(runs: DataFrame, now: Column) -> DataFrame:
    """The event of each run's end, for the log."""
    return jobs.settle(runs, now, F.col("run_result"), F.col("run_error"))


def lines(runs: DataFrame, now: Column, provider: str = "disabled") -> DataFrame:
    """(job_id, place, line): each run's start, and its completion or failure, as telemetry."""
    worker = jobs.worker_of(F.col("claimed_by"))
    started = telemetry.event_json("scan_started", F.col("started_at"), jobId=F.col("job_id"), url=F.col("url"), provider=F.lit(provider), workerId=worker)
    completed = telemetry.event_json(
        "scan_completed", now, jobId=F.col("job_id"), durationMs=F.col("duration_ms"), score=F.coalesce("score", F.lit(0)), overallStatus=F.col("overall_status"), aiProvider=F.coalesce("ai_provider", F.lit("disabled")), aiLatencyMs=F.col("ai_latency_ms"),
    )
    failed = telemetry.event_json(
        "scan_failed", now, jobId=F.col("job_id"), durationMs=F.col("duration_ms"), error=F.col("run_error"), claimCount=F.col("claim_count"), willRetry=jobs.will_retry(F.col("claim_count")),
    )
    both = F.array(F.struct(F.lit(0).alias("place"), started.alias("line")), F.struct(F.lit(1).alias("place"), F.when(F.col("run_error").isNull(), completed).otherwise(failed).alias("line")))
    return runs.select("job_id", F.inline(both))


def reaped_line(reaped: DataFrame, now: Column) -> DataFrame:
    """One line that tells how many jobs were reaped, if any were."""
    return reaped.agg(F.count("*").alias("n")).filter("n > 0").select(telemetry.event_json("scan_reaped", now, reapedCount=F.col("n")).alias("line"))
