"""Runs of jobs move references to results, not the documents."""

from pyspark.sql import functions as F

from quillwatch.operators import runs
from quillwatch.plans import scan_plans


def test_jobs_carry_no_documents(spark, small):
    ended = scan_plans._ended(spark, small, scan_plans._said(spark, small)).filter("run_result is not null")
    assert ended.agg(F.max(F.length("run_result"))).first()[0] < 20 and ended.count() > 0
    assert ended.filter("overall_status is null").count() == 0


def test_a_reference_finds_its_result(spark):
    asked = spark.createDataFrame([("j1", "u1"), ("j2", "u1"), ("j3", "u2")], "job_id string, url string")
    seen = spark.createDataFrame([("u1", 7, 5, None)], "url string, page_id long, duration_ms long, error string")
    found = spark.createDataFrame([(7, "pass", (1, "p", 2))], "page_id long, overall_status string, ai_verification struct<score:int,provider:string,latency_ms:long>")
    out = runs.outcomes(asked, seen, found, whole=False).select("job_id", "result", "overall_status", "score", "ai_provider").collect()
    assert sorted(map(tuple, out)) == [("j1", "7", "pass", 1, "p"), ("j2", "7", "pass", 1, "p"), ("j3", None, None, None, None)]
