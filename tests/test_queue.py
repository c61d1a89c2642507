"""The job log's commits, repeated batches, runs of claimed jobs, and telemetry of both."""

import json

import pytest
from pyspark.sql import functions as F

from quillwatch.operators import jobs, runs
from quillwatch.streaming import jobs as streams


def t0():
    return F.lit("2026-01-01 00:10:00").cast("timestamp")


def inserted(spark, *rows):
    """rows: (id, status, claim_count, started_at, claimed_by)."""
    df = spark.createDataFrame(list(rows), "id string, status string, claim_count int, started_at string, claimed_by string")
    return df.withColumn("started_at", F.col("started_at").cast("timestamp")).withColumn("created_at", F.lit("2026-01-01").cast("timestamp"))


def seen(log):
    return sorted((r["job_id"], r["status"], r["claimed_by"], r["claim_count"], r["version"]) for r in log.state().collect())


START = [("old", "running", 1, "2026-01-01 00:00:00", "gone"), ("last", "running", 3, "2026-01-01 00:00:00", "gone"), *[(f"p{k}", "pending", 0, None, None) for k in range(5)]]


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    log, batch = streams.JobLog(spark, str(tmp_path / "log")), inserted(spark, *START)
    streams.run_batch(batch, log, "000000000000", ["a"], t0(), concurrency=2)
    once = seen(log)
    assert [r[1] for r in once].count("running") == 2 and ("last", "failed", "gone", 3, 1) in once and sum(r[4] for r in once) == 4
    for _ in range(2):
        streams.run_batch(batch, log, "000000000000", ["a"], t0(), concurrency=2)
        assert seen(log) == once
    streams.run_batch(batch, log, "000000000001", ["a"], t0(), concurrency=2)  # the same rows again, no place is free
    assert seen(log) == once
    log.compact("000000000001")
    log.compact("000000000001")
    for name in ("000000000000", "000000000001"):
        streams.run_batch(batch, log, name, ["a"], t0(), concurrency=2)
    assert seen(log) == once and log.committed("000000000000-take")


@pytest.mark.parametrize("step", ["1-created", "2-reaped", "3-claimed", "rename"])
def test_a_batch_that_breaks_off_leaves_nothing_and_is_made_up_for(spark, tmp_path, step, monkeypatch):
    log, batch = streams.JobLog(spark, str(tmp_path / "log")), inserted(spark, *START)
    with monkeypatch.context() as m:
        write = streams.Transaction.write

        def breaking(self, events, name):
            write(self, events, name)
            if name == step:
                raise RuntimeError("lost")

        m.setattr(streams.Transaction, "write", breaking)
        if step == "rename":
            m.setattr(streams.JobLog, "_rename", lambda *_: 1 / 0)
        with pytest.raises((RuntimeError, ZeroDivisionError)):
            streams.run_batch(batch, log, "000000000000", ["a"], t0(), concurrency=2)
        assert log.state().count() == 0
    streams.run_batch(batch, log, "000000000000", ["a"], t0(), concurrency=2)
    other = streams.JobLog(spark, str(tmp_path / "other"))
    streams.run_batch(batch, other, "000000000000", ["a"], t0(), concurrency=2)
    assert seen(log) == seen(other)


def test_an_append_behind_a_snapshot_is_seen(spark, tmp_path):
    log = streams.JobLog(spark, str(tmp_path / "log"))
    log.append(jobs.created(inserted(spark, *START)), "zz-any-name")
    log.append(jobs.claim(log.state(), ["a"], t0(), 2), "claims")
    log.compact(streams.batch_name(99))
    done = jobs.complete(log.state().filter("claimed_by = 'a'"), t0(), F.lit("{}"))
    log.append(done, "000000000099-4-done")
    log.append(done, "000000000099-4-done")
    assert [r[1] for r in seen(log)].count("complete") == 2 and log.open_jobs().count() == 5


def test_writers_that_meet_get_a_number_each_and_claims_are_computed_anew(spark, tmp_path):
    log = streams.JobLog(spark, str(tmp_path / "log"))
    log.append(jobs.created(inserted(spark, *START)), "seed")
    tries = []

    def claim(t):
        tries.append(1)
        t.write(jobs.claim(t.open_jobs(), ["a"], t0(), 2), "claimed")
        if len(tries) == 1:  # another worker comes first
            streams.JobLog(spark, log.path).append(jobs.claim(log.open_jobs(), ["b"], t0(), 2), "other")

    assert log.transact("mine", claim) and len(tries) == 2
    claimed = {r[0]: r[2] for r in seen(log) if r[2] in ("a", "b")}
    assert sorted(claimed.values()) == ["a", "a", "b", "b"] and log.events().count() == len(START) + 4


def test_a_number_that_a_compaction_freed_is_not_used(spark, tmp_path, monkeypatch):
    log = streams.JobLog(spark, str(tmp_path / "log"))
    log.append(jobs.created(inserted(spark, *START)), "seed")
    rename, went = streams.JobLog._rename, []

    def slow(self, source, target):
        if target == "commit=000000000001" and not went:  # between looking and renaming another commits and compacts
            went.append(1)
            log.append(jobs.claim(log.state(), ["b"], t0(), 1), "other")
            log.compact("000000000005")
        return rename(self, source, target)

    late = jobs.claim(log.state(), ["a"], t0(), 1)
    monkeypatch.setattr(streams.JobLog, "_rename", slow)
    streams.JobLog(spark, log.path).append(late, "late")
    assert went and log.committed("late") and len(log._now().commits) == 1 and [r[2] for r in seen(log)].count("b") + [r[2] for r in seen(log)].count("a") == 1


def test_finished_jobs_stay_finished_and_are_not_folded_again(spark, tmp_path):
    log = streams.JobLog(spark, str(tmp_path / "log"))
    log.append(jobs.created(inserted(spark, *START)), "seed")
    log.append(jobs.complete(log.state().filter("job_id = 'old'"), t0(), F.lit("{}")), "done")
    log.compact("000000000000")
    assert spark.read.parquet(f"{log.path}/snapshot=000000000000/finished").select("job_id").distinct().count() == 1
    before = seen(log)
    late = log.state().filter("job_id = 'old'").withColumn("version", F.lit(0).cast("long"))
    log.append(jobs.release(late, t0() + F.expr("INTERVAL 1 SECOND"), F.lit("late")), "late")
    streams.run_batch(inserted(spark, START[0]), log, "000000000001", [], t0(), after_s=10**9)  # a repeated insert of a finished job
    assert [r for r in seen(log) if r[0] == "old"] == [r for r in before if r[0] == "old"] and log.open_jobs().filter("job_id = 'old'").count() == 0
    log.compact("000000000001")
    assert seen(log) == before


def scanned(held):
    """p0 is fine, p1 takes too long, p2 fails, p3 gives nothing, p4 is fine at the cap."""
    one = lambda k, result, error, ms: F.struct(F.lit(k).alias("job_id"), F.lit(f"https://{k}.org/").alias("url"), F.lit(result).cast("string").alias("result"), F.lit(error).cast("string").alias("error"), F.lit(ms).cast("long").alias("duration_ms"))
    rows = [one("p0", '{"x":1}', None, 5), one("p1", "{}", None, 90_001), one("p2", None, "e" * 3_000, 7), one("p4", "{}", None, 90_000)]
    rest = {"overall_status": F.lit("pass"), "score": F.lit(4), "ai_provider": F.lit("m"), "ai_latency_ms": F.lit(3).cast("long")}
    return held.limit(1).select(F.inline(F.array(*rows))).withColumns(rest)


def test_runs_end_in_one_commit_with_their_telemetry(spark, tmp_path):
    log, sink = streams.JobLog(spark, str(tmp_path / "log")), str(tmp_path / "sink")
    for _ in range(2):  # the second time everything is there
        streams.run_batch(inserted(spark, *START), log, "000000000000", ["a", "b"], t0(), concurrency=2, scan=scanned, provider="m")
        log.publish(sink)
        log.publish(sink)
    rows = {r["job_id"]: r for r in log.state().collect()}
    assert {k: r["status"] for k, r in rows.items()} == {"p0": "complete", "p4": "complete", "last": "failed", **dict.fromkeys(["old", "p1", "p2", "p3"], "failed")}
    assert rows["p0"]["result"] == '{"x":1}' and rows["p0"]["error"] is None and rows["p0"]["claim_count"] == 1
    assert rows["p1"]["error"] == runs.CAP_ERROR and rows["p2"]["error"] == "e" * 2_000 and rows["p3"]["error"] == runs.NO_OUTCOME and {rows[k]["claim_count"] for k in ("p1", "p2", "p3")} == {3}
    said = [json.loads(r["value"]) for r in spark.read.option("recursiveFileLookup", True).text(sink).collect()]
    count = lambda name, **own: sum(e["event"] == name and own.items() <= e.items() for e in said)
    assert count("scan_started") == count("scan_completed") + count("scan_failed") and count("scan_completed") == 2 and count("scan_reaped", reapedCount=2) == 1 == count("scan_reaped")
    assert count("scan_failed", jobId="p1", willRetry=True, durationMs=90_000) == 2 and count("scan_failed", jobId="p1", willRetry=False, claimCount=3) == 1
    assert [len(e["error"]) for e in said if e["event"] == "scan_failed" and e["jobId"] == "p2"] == [501] * 3
    assert list(next(e for e in said if e["event"] == "scan_completed")) == ["event", "ts", "jobId", "durationMs", "score", "overallStatus", "aiProvider", "aiLatencyMs"]


def test_a_run_that_breaks_off_is_run_again(spark, tmp_path):
    log, tries = streams.JobLog(spark, str(tmp_path / "log")), []

    def breaking(held):
        tries.append(1)
        if len(tries) == 1:
            raise RuntimeError("browser")
        return scanned(held)

    go = lambda: streams.run_batch(inserted(spark, *START), log, "000000000000", ["a"], t0(), concurrency=7, scan=breaking)
    with pytest.raises(RuntimeError):
        go()
    assert [r[1] for r in seen(log)].count("running") == 6
    go()
    assert [r[1] for r in seen(log)].count("running") == 0 and {r[1] for r in seen(log) if r[0] in ("p0", "p4")} == {"complete"}


def test_a_stream_that_runs_its_jobs(spark, tmp_path):
    inserted(spark, *START).write.parquet(str(tmp_path / "in"))
    log = streams.JobLog(spark, str(tmp_path / "log"))
    inserts = streams.pending_inserts(spark, str(tmp_path / "in"), "id string, status string, created_at timestamp")
    streams.run_queue(inserts, log, ["a"], lambda n: t0(), str(tmp_path / "cp"), scan=scanned, sink=str(tmp_path / "sink"), compact_every=1).awaitTermination()
    assert sorted(r[1] for r in seen(log)) == ["complete"] * 2 + ["failed"] * 3
    assert spark.read.option("recursiveFileLookup", True).text(str(tmp_path / "sink")).count() == 2 * 2 + 3 * 3 * 2
