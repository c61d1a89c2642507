"""Keyed job state and its timers against the fold of the same log."""

import time

from pyspark.sql import functions as F

from quillwatch.operators import jobs
from quillwatch.streaming import keyed


def t0():
    return F.lit("2026-01-01 00:10:00").cast("timestamp")


def created(spark, *rows):
    df = spark.createDataFrame(list(rows), "id string, status string, claim_count int, started_at string, claimed_by string")
    return jobs.created(df.withColumn("started_at", F.col("started_at").cast("timestamp")).withColumn("created_at", F.lit("2026-01-01").cast("timestamp")))


def latest(spark, path):
    rows = spark.read.parquet(path).collect()
    out = {}
    for r in sorted(rows, key=lambda r: r["n"]):
        out[r["job_id"]] = r
    return out


def to(path):
    return lambda changes, number: changes.write.mode("overwrite").parquet(f"{path}/n={number}")


def test_states_are_the_folds_whatever_the_order(spark, tmp_path):
    log = created(spark, *[(f"j{k}", "pending", k % 4, None, None) for k in range(12)])
    claims = jobs.claim(jobs.fold(log), ["a", "b"], t0(), 4)
    held = jobs.fold(log.union(claims)).filter("status = 'running'")
    done, late = jobs.complete(held.filter("claimed_by = 'a'"), t0(), F.lit("{}")), jobs.settle_errors(held, t0() + F.expr("INTERVAL 1 SECOND"), F.lit("e"))
    events = log.union(claims).union(done).union(late).coalesce(1).cache()
    events.orderBy(F.rand(3)).coalesce(1).sortWithinPartitions(F.rand(5)).write.option("maxRecordsPerFile", 4).parquet(str(tmp_path / "log"))
    keyed.run_states(keyed.event_stream(spark, str(tmp_path / "log"), 2), to(tmp_path / "out"), str(tmp_path / "cp"), after_s=10**9).awaitTermination()
    got = {k: tuple(r[c] for c in ("version", "created_at", *jobs.STATE)) for k, r in latest(spark, str(tmp_path / "out")).items()}
    assert got == {r["job_id"]: tuple(r)[1:] for r in jobs.fold(events).collect()} and len(got) == 12


def test_timers_reap_without_inserts_and_after_a_restart(spark, tmp_path):
    now = spark.sql("SELECT current_timestamp() AS t").first()["t"]
    at = lambda s: spark.sql(f"SELECT date_format(TIMESTAMP '{now}' + INTERVAL {s} SECOND, 'yyyy-MM-dd HH:mm:ss') AS t").first()["t"]
    log, out, cp = str(tmp_path / "log"), str(tmp_path / "out"), str(tmp_path / "cp")
    start = created(spark, ("old", "running", 1, at(-500), "w"), ("used", "running", 3, at(-500), "w"), ("soon", "running", 1, at(0), "w"), ("done", "running", 1, at(0), "w"), ("idle", "pending", 0, None, None))
    start.coalesce(1).write.parquet(log)
    keyed.run_states(keyed.event_stream(spark, log), to(out), cp, after_s=25).awaitTermination()
    states = {k: r["status"] for k, r in latest(spark, out).items()}
    assert states == {"old": "pending", "used": "failed", "soon": "running", "done": "running", "idle": "pending"}
    jobs.complete(jobs.fold(start).filter("job_id = 'done'"), F.current_timestamp(), F.lit("{}")).coalesce(1).write.mode("append").parquet(log)
    query = keyed.run_states(keyed.event_stream(spark, log), to(out), cp, after_s=25, period_s=1)  # goes on from the checkpoint
    until = time.monotonic() + 90
    while time.monotonic() < until and latest(spark, out)["soon"]["status"] == "running":
        time.sleep(1)
    query.stop()
    rows = latest(spark, out)
    assert {k: r["status"] for k, r in rows.items()} == {"old": "pending", "used": "failed", "soon": "pending", "done": "complete", "idle": "pending"}
    assert rows["soon"]["by_timer"] and rows["soon"]["claimed_by"] is None and rows["used"]["completed_at"] is not None
    reaped = keyed.reaps(spark.read.parquet(out).drop("n")).collect()
    assert sorted(r["job_id"] for r in reaped) == ["old", "soon", "used"] and {r["kind"] for r in reaped} == {"reaped"}


def test_a_timers_change_fences_late_writers_before_and_after_it_is_read_back(spark, tmp_path):
    log, out, cp = str(tmp_path / "log"), str(tmp_path / "out"), str(tmp_path / "cp")
    start = created(spark, ("a", "running", 1, "2026-01-01 00:00:00", "w"), ("b", "running", 1, "2026-01-01 00:00:00", "w"))
    start.coalesce(1).write.parquet(log)
    run = lambda: keyed.run_states(keyed.event_stream(spark, log), to(out), cp).awaitTermination()
    run()
    late = jobs.complete(jobs.fold(start), F.current_timestamp() + F.expr("INTERVAL 1 DAY"), F.lit("{}"))
    for k, job in enumerate("ab"):  # the first comes with the timer's event, the second after it
        late.filter(F.col("job_id") == job).coalesce(1).write.mode("append").parquet(log)
        run()
        rows = latest(spark, out)
        assert {j: (r["version"], r["status"]) for j, r in rows.items()} == {"a": (1, "pending"), "b": (1, "pending")}
    assert spark.read.parquet(out).filter("by_timer").count() == 2


def test_no_python_runs_for_a_job(spark):
    events = spark.readStream.schema(jobs.EVENT_SCHEMA + ", created_at timestamp").parquet(str("/root/testdata/sf0.001/orders.parquet"))
    plan = keyed.job_states(events)._jdf.queryExecution().analyzed().toString()
    assert "Aggregate" in plan and "Python" not in plan
