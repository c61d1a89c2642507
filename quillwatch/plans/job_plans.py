"""Queries over scan jobs and telemetry, with SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import settings
from ..operators import jobs, telemetry
from ..sources import derived
from ..sources.storage import shared_folder
from ..streaming import keyed
from ..streaming.jobs import JobLog, batch_name, run_batch

#: Where the jobs' creation times are cut into two batches.
_HALF = "TIMESTAMP '1995-06-01 00:00:00'"
WORKERS = ("w-a", "w-b", "w-c")


def now() -> Column:
    return F.expr(derived.NOW)


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.jobs(spark, sf_dir)


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.fold(jobs.created(_jobs(spark, sf_dir)))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def queue_claim_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest pending job goes to one worker."""
    out = jobs.claim(_state(spark, sf_dir), ["w-a"], now())
    return out.select("job_id", "version", "status", "claimed_by", "claim_count", "started_at")


def queue_claim_workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three workers with four places each, one of which is taken; no job goes to two."""
    out = jobs.claim(_state(spark, sf_dir), list(WORKERS), now(), per_worker=4, running={"w-b": 1})
    return out.select("job_id", "claimed_by", "claim_count")


def queue_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    running = _state(spark, sf_dir).filter("status = 'running'")
    return jobs.complete(running, now(), F.to_json(F.struct(F.lit(3).alias("score")))).select("job_id", "version", "status", "claimed_by", "result", "error", "completed_at")


def queue_fail(spark: SparkSession, sf_dir: str) -> DataFrame:
    running = _state(spark, sf_dir).filter("status = 'running'")
    return jobs.fail(running, now(), F.repeat(F.lit("x"), 3000)).select("job_id", "status", "claimed_by", F.length("error").alias("error_chars"))


def queue_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    running = _state(spark, sf_dir).filter("status = 'running'")
    return jobs.release(running, now(), F.lit(None).cast("string")).select("job_id", "status", "claimed_by", "claim_count", "started_at")


def queue_retry_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    running = _state(spark, sf_dir).filter("status = 'running'")
    out = jobs.settle_errors(running, now(), F.lit("timeout"))
    return out.select("job_id", "status", "claimed_by", "claim_count", "error", "completed_at")


def queue_reap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.reap(_state(spark, sf_dir), now()).select("job_id", "version", "status", "claimed_by", "started_at")


def queue_reap_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.reap(_state(spark, sf_dir), now()).agg(F.count("*").alias("reaped"))


def queue_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State after a log of creations, reaps, and workers that complete what was reaped from them: these are fenced."""
    first = jobs.created(_jobs(spark, sf_dir))
    reaped = jobs.reap(jobs.fold(first), now())
    late = jobs.complete(jobs.fold(first).join(reaped.select("job_id"), "job_id", "left_semi"), now() + F.expr("INTERVAL 1 SECOND"), F.lit("{}"))
    log = late.union(first).union(reaped)
    return jobs.fold(log).groupBy("status", "version").agg(F.count("*").alias("jobs"), F.sum("claim_count").alias("claims"))


def queue_fenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late writers: two events of one version, of which the later is fenced."""
    first = jobs.created(_jobs(spark, sf_dir))
    reaped = jobs.reap(jobs.fold(first), now())
    late = jobs.complete(jobs.fold(first).join(reaped.select("job_id"), "job_id", "left_semi"), now() + F.expr("INTERVAL 1 SECOND"), F.lit("{}"))
    return jobs.fenced(first.union(reaped).union(late)).groupBy("kind", "fenced").agg(F.count("*").alias("events"))


def queue_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs after two batches of inserts through the log, of which the first is repeated, as after a failure."""
    log, every = JobLog(spark, f"{shared_folder(spark)}/queue-{uuid.uuid4().hex}"), _jobs(spark, sf_dir)
    batches = [every.filter(F.col("created_at") < F.expr(_HALF)), every.filter(F.col("created_at") >= F.expr(_HALF))]
    for k in (0, 0, 1):
        run_batch(batches[k], log, batch_name(k), list(WORKERS), now(), concurrency=2 + 2 * k)
    return log.state().select("job_id", "version", "status", "claimed_by", "claim_count")


def queue_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs as keyed state of a stream, by the clock of today: every running job is long stuck, and its timer reaps it."""
    folder = f"{shared_folder(spark)}/keyed-{uuid.uuid4().hex}"
    jobs.created(_jobs(spark, sf_dir)).write.parquet(f"{folder}/log")
    stream = keyed.event_stream(spark, f"{folder}/log")
    keyed.run_states(stream, lambda changes, n: changes.write.mode("overwrite").parquet(f"{folder}/changes/n={n}"), f"{folder}/checkpoint").awaitTermination()
    out = spark.read.parquet(f"{folder}/changes").groupBy("job_id").agg(F.max_by(F.struct("version", "status", "claimed_by", "claim_count", "by_timer"), "version").alias("s"))
    return out.select("job_id", "s.*")


def queue_wake_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserts that wake a worker."""
    return _jobs(spark, sf_dir).filter(F.col("status") == jobs.PENDING).select("id")


def worker_gauge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs in flight by worker."""
    return _state(spark, sf_dir).filter("status = 'running'").groupBy(jobs.worker_of(F.col("claimed_by")).alias("worker")).agg(F.count("*").alias("active"))


def health_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.health(_state(spark, sf_dir), "w1", "disabled", "1", now() - F.expr("INTERVAL 5 SECOND"), now(), shutting_down=True)


def event_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = telemetry.short(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.length(short).alias("n_chars"), F.md5(short).alias("text_md5"))


def event_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other event has an address longer than a line may hold."""
    url = F.concat(F.lit("https://a.example.org/"), F.when(F.col("event_id") % 2 == 0, F.repeat(F.lit("p/"), 400)).otherwise(""))
    line = telemetry.event_json("scan_started", F.col("ts"), jobId=F.col("event_id").cast("string"), url=url, provider=F.lit("disabled"), workerId=F.concat(F.lit("w"), F.col("user_id").cast("string")))
    return _events(spark, sf_dir).select("event_id", line.alias("line"))


def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("events"), F.min("event_id").alias("first_id"))


def scan_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Milliseconds between start and now of running jobs."""
    return _state(spark, sf_dir).filter("status = 'running'").select("job_id", (F.unix_millis(now()) - F.unix_millis("started_at")).alias("duration_ms"))


def error_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.length(jobs.cap_error(F.col("text"))).alias("n_chars"))


def log_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = F.array(*map(F.lit, ("debug", "info", "warn", "error", "loud")))
    rows = _events(spark, sf_dir).select("event_id", levels[(F.col("event_id") % 5).cast("int")].alias("level"), levels[(F.col("user_id") % 5).cast("int")].alias("threshold"), "event_type", "ts")
    message = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("[own] "), F.col("event_type"))).otherwise(F.col("event_type"))
    return rows.filter(telemetry.passes(F.col("level"), F.col("threshold"))).select("event_id", telemetry.log_line(F.col("ts"), F.col("level"), message).alias("line"))


def interval_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", settings.interval_text(F.col("event_id") * 250).alias("interval"))


def worker_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    token = F.substring(F.sha2(F.col("o_orderkey").cast("string"), 256), 1, 6)
    prefix = F.when(F.col("o_orderkey") % 2 == 0, F.lit("bot"))
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return rows.select("o_orderkey", settings.worker_id(F.when(F.col("o_orderkey") % 3 != 0, F.lit("host")), F.col("o_custkey"), token, prefix).alias("worker_id"))


#: Settings by event_id % 8: what a variable holds.
_NUMBERS = ("", "0", "12abc", " 700", "-5", "abc", "45000", "999999")


def _settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.array(*map(F.lit, _NUMBERS))[(F.col("event_id") % 8).cast("int")]
    return _events(spark, sf_dir).select("event_id", value.alias("value"), *[F.when(F.floor(F.col("event_id") / d) % 3 == 0, F.lit("key")).when(F.floor(F.col("event_id") / d) % 3 == 1, F.lit("  ")).alias(n) for n, d in (("gemini_key", 8), ("deepseek_key", 24), ("ollama_host", 72))])


def provider_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _settings(spark, sf_dir)
    return rows.select("event_id", settings.reviewer(gemini_key=F.col("gemini_key"), deepseek_key=F.col("deepseek_key"), ollama_host=F.col("ollama_host")).alias("provider"))


def timeout_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _settings(spark, sf_dir)
    name = settings.reviewer(gemini_key=F.col("gemini_key"), deepseek_key=F.col("deepseek_key"), ollama_host=F.col("ollama_host"))
    return rows.select("event_id", settings.outer_timeout_ms(name, F.col("value")).alias("outer_ms"), settings.inner_timeout_ms(name, F.col("value")).alias("inner_ms"), settings.number_setting(F.col("value"), 30_000, 5_000).alias("period_ms"))


def slash_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses without the slashes that they end in."""
    rows = _events(spark, sf_dir).select("event_id", F.concat(F.lit("http://h:1/"), F.col("user_id").cast("string"), F.repeat(F.lit("/"), (F.col("event_id") % 4).cast("int"))).alias("url"))
    return rows.select("event_id", settings.strip_slashes(F.col("url")).alias("url"))


def counts_or_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a counter gives as text, as a number."""
    return _settings(spark, sf_dir).select("event_id", settings.count_or_zero(F.col("value")).alias("n"))


def scans_enabled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kill switch: only the word false turns scans off."""
    words = F.array(F.lit("false"), F.lit("true"), F.lit("FALSE"), F.lit(""), F.lit(None).cast("string"))
    return _events(spark, sf_dir).select("event_id", settings.enabled(words[(F.col("event_id") % 5).cast("int")]).alias("enabled"))


def drained_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shutdown's drained count by worker: jobs in flight when it began less those left when its grace period ended."""
    before = _state(spark, sf_dir).filter("status = 'running'")
    done = jobs.complete(before.filter("pmod(cast(job_id as long), 3) = 0"), now(), F.lit("{}"))
    after = jobs.fold(jobs.created(_jobs(spark, sf_dir)).union(done)).filter("status = 'running'").groupBy(jobs.worker_of(F.col("claimed_by")).alias("worker")).agg(F.count("*").alias("left"))
    began = before.groupBy(jobs.worker_of(F.col("claimed_by")).alias("worker")).agg(F.count("*").alias("in_flight"))
    return began.join(after, "worker", "left").select("worker", "in_flight", (F.col("in_flight") - F.coalesce("left", F.lit(0))).alias("drained"))


QUERIES = {
    f.__name__: f
    for f in (
        slash_strip, counts_or_zero, scans_enabled, drained_jobs, queue_claim_oldest, queue_claim_workers, queue_complete, queue_fail, queue_release, queue_retry_decision, queue_reap, queue_reap_count, queue_fold, queue_fenced, queue_replay, queue_keyed, queue_wake_up, worker_gauge, health_status,
        event_truncate, event_json, event_counts, scan_durations, error_cap, log_filter, interval_text, worker_ids, provider_choice, timeout_rules,
    )
}

_J = f"WITH jobs AS ({derived.JOBS_SQL}), running AS (SELECT * FROM jobs WHERE status = 'running'), stuck AS (SELECT *, claim_count < 3 AS again FROM running WHERE started_at < {derived.NOW} - INTERVAL 180 SECOND)"
_N = derived.NOW
_PROVIDER = "CASE WHEN g = 'key' THEN 'gemini-2.5-flash' WHEN d = 'key' THEN 'deepseek-v3' WHEN o = 'key' THEN 'ollama-gemma-3-4b' ELSE 'disabled' END"
_SET = "(SELECT event_id, event_id % 8 AS v, CASE WHEN event_id // 8 % 3 = 0 THEN 'key' END AS g, CASE WHEN event_id // 24 % 3 = 0 THEN 'key' END AS d, CASE WHEN event_id // 72 % 3 = 0 THEN 'key' END AS o FROM events)"
_ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ')"
ORACLES = {
    "slash_strip": "SELECT event_id, concat('http://h:1/', user_id) AS url FROM events",
    "counts_or_zero": "SELECT event_id, [0, 0, 0, 700, -5, 0, 45000, 999999][event_id % 8 + 1]::DOUBLE AS n FROM events",
    "scans_enabled": "SELECT event_id, event_id % 5 <> 0 AS enabled FROM events",
    "drained_jobs": f"{_J} SELECT coalesce(claimed_by, 'unknown') AS worker, count(*) AS in_flight, count(*) FILTER (WHERE id::BIGINT % 3 = 0) AS drained FROM running GROUP BY 1",
    "queue_claim_oldest": f"{_J} SELECT id AS job_id, 1::BIGINT AS version, 'running' AS status, 'w-a' AS claimed_by, claim_count + 1 AS claim_count, {_N} AS started_at FROM jobs WHERE status = 'pending' ORDER BY created_at, id LIMIT 1",
    "queue_claim_workers": f"{_J}, places AS (SELECT * FROM (VALUES (1, 'w-a'), (2, 'w-b'), (3, 'w-c'), (4, 'w-a'), (5, 'w-b'), (6, 'w-c'), (7, 'w-a'), (8, 'w-b'), (9, 'w-c'), (10, 'w-a'), (11, 'w-c')) p(k, w)) SELECT j.id AS job_id, p.w AS claimed_by, j.claim_count + 1 AS claim_count FROM (SELECT *, row_number() OVER (ORDER BY created_at, id) AS k FROM jobs WHERE status = 'pending') j JOIN places p ON p.k = j.k",
    "queue_complete": f"{_J} SELECT id AS job_id, 1::BIGINT AS version, 'complete' AS status, claimed_by, '{{\"score\":3}}' AS result, NULL::VARCHAR AS error, {_N} AS completed_at FROM running",
    "queue_fail": f"{_J} SELECT id AS job_id, 'failed' AS status, claimed_by, 2000 AS error_chars FROM running",
    "queue_release": f"{_J} SELECT id AS job_id, 'pending' AS status, NULL::VARCHAR AS claimed_by, claim_count, NULL::TIMESTAMP AS started_at FROM running",
    "queue_retry_decision": f"{_J} SELECT id AS job_id, CASE WHEN claim_count < 3 THEN 'pending' ELSE 'failed' END AS status, CASE WHEN claim_count >= 3 THEN claimed_by END AS claimed_by, claim_count, 'timeout' AS error, CASE WHEN claim_count >= 3 THEN {_N} END AS completed_at FROM running",
    "queue_reap": f"{_J} SELECT id AS job_id, 1::BIGINT AS version, CASE WHEN again THEN 'pending' ELSE 'failed' END AS status, CASE WHEN NOT again THEN claimed_by END AS claimed_by, CASE WHEN NOT again THEN started_at END AS started_at FROM stuck",
    "queue_reap_count": f"{_J} SELECT count(*) AS reaped FROM stuck",
    "queue_fold": f"{_J} SELECT status, version, count(*) AS jobs, sum(claim_count)::BIGINT AS claims FROM (SELECT CASE WHEN s.again THEN 'pending' WHEN NOT s.again THEN 'failed' ELSE j.status END AS status, CASE WHEN s.id IS NULL THEN 0 ELSE 1 END::BIGINT AS version, j.claim_count FROM jobs j LEFT JOIN stuck s ON s.id = j.id) GROUP BY status, version",
    "queue_fenced": f"{_J} SELECT 'created' AS kind, false AS fenced, count(*) AS events FROM jobs UNION ALL SELECT 'reaped', false, count(*) FROM stuck HAVING count(*) > 0 UNION ALL SELECT 'completed', true, count(*) FROM stuck HAVING count(*) > 0",
    "queue_replay": f"""{_J}, batches AS (SELECT j.*, j.created_at >= {_HALF} AS later, s.id IS NOT NULL AS reaped, coalesce(s.again, false) AS again FROM jobs j LEFT JOIN stuck s ON s.id = j.id),
      reset AS (SELECT id, later, created_at, reaped::INT AS version, CASE WHEN again THEN 'pending' WHEN reaped THEN 'failed' ELSE status END AS status, CASE WHEN NOT again THEN claimed_by END AS claimed_by, claim_count FROM batches),
      first AS (SELECT id, row_number() OVER (ORDER BY created_at, id) AS k, ['w-a', 'w-b', 'w-c'] AS w FROM reset WHERE NOT later AND status = 'pending' QUALIFY k <= 6),
      second AS (SELECT r.id, row_number() OVER (ORDER BY r.created_at, r.id) AS place, ['w-a', 'w-b', 'w-c'] AS w FROM reset r LEFT JOIN first f ON f.id = r.id WHERE r.status = 'pending' AND f.id IS NULL QUALIFY place <= 6),
      taken AS (SELECT * FROM first UNION ALL SELECT * FROM second)
      SELECT r.id AS job_id, (r.version + (t.id IS NOT NULL)::INT)::BIGINT AS version, CASE WHEN t.id IS NOT NULL THEN 'running' ELSE r.status END AS status, coalesce(t.w[(t.k - 1) % 3 + 1], r.claimed_by) AS claimed_by, r.claim_count + (t.id IS NOT NULL)::INT AS claim_count
      FROM reset r LEFT JOIN taken t ON t.id = r.id""",
    "queue_keyed": f"{_J} SELECT id AS job_id, (status = 'running')::BIGINT AS version, CASE WHEN status <> 'running' THEN status WHEN claim_count < 3 THEN 'pending' ELSE 'failed' END AS status, CASE WHEN status <> 'running' OR claim_count >= 3 THEN claimed_by END AS claimed_by, claim_count, status = 'running' AS by_timer FROM jobs",
    "queue_wake_up": f"{_J} SELECT id FROM jobs WHERE status = 'pending'",
    "worker_gauge": f"{_J} SELECT coalesce(claimed_by, 'unknown') AS worker, count(*) AS active FROM running GROUP BY 1",
    "health_status": f"{_J} SELECT 'shutting_down' AS status, 'disabled' AS provider, 'w1' AS \"workerId\", count(*) AS \"activeJobs\", 5000::BIGINT AS \"uptimeMs\", '1' AS version, true AS \"shuttingDown\", 503 AS code FROM running WHERE claimed_by = 'w1'",
    "event_truncate": "SELECT doc_id, length(s)::INT AS n_chars, md5(s) AS text_md5 FROM (SELECT doc_id, CASE WHEN length(text) > 500 THEN concat(substring(text, 1, 500), '…') ELSE text END AS s FROM documents)",
    "event_json": f"SELECT event_id, concat('{{\"event\":\"scan_started\",\"ts\":\"', {_ISO}, '\",\"jobId\":\"', event_id, '\",\"url\":\"', CASE WHEN event_id % 2 = 0 THEN concat(substring(concat('https://a.example.org/', repeat('p/', 400)), 1, 500), '…') ELSE 'https://a.example.org/' END, '\",\"provider\":\"disabled\",\"workerId\":\"w', user_id, '\"}}') AS line FROM events",
    "event_counts": "SELECT event_type, count(*) AS events, min(event_id) AS first_id FROM events GROUP BY 1",
    "scan_durations": f"{_J} SELECT id AS job_id, (epoch_ms({_N}) - epoch_ms(started_at))::BIGINT AS duration_ms FROM running",
    "error_cap": "SELECT doc_id, least(length(text), 2000)::INT AS n_chars FROM documents",
    "log_filter": f"SELECT event_id, concat('[', {_ISO}, '] ', rpad(upper(level), 5, ' '), CASE WHEN event_id % 2 = 0 THEN ' [own] ' ELSE ' [quillwatch] ' END, event_type) AS line FROM (SELECT *, ['debug', 'info', 'warn', 'error'][event_id % 5 + 1] AS level FROM events) WHERE event_id % 5 < 4 AND user_id % 5 < 4 AND event_id % 5 >= user_id % 5",
    "interval_text": "SELECT event_id, concat(floor(event_id * 250 / 1000.0 + 0.5)::BIGINT, ' seconds') AS interval FROM events",
    "worker_ids": "SELECT o_orderkey, concat(CASE WHEN o_orderkey % 2 = 0 THEN 'bot-' ELSE '' END, CASE WHEN o_orderkey % 3 <> 0 THEN 'host' ELSE 'unknown-host' END, ':', o_custkey, ':', substring(sha256(o_orderkey::VARCHAR), 1, 6)) AS worker_id FROM orders",
    "provider_choice": f"SELECT event_id, {_PROVIDER} AS provider FROM {_SET}",
    "timeout_rules": f"""SELECT event_id, CASE WHEN p = 'ollama-gemma-3-4b' THEN greatest(30000, base) ELSE base END::BIGINT AS outer_ms,
        CASE WHEN v = 0 THEN CASE WHEN p = 'ollama-gemma-3-4b' THEN 30000 END WHEN p = 'ollama-gemma-3-4b' THEN greatest(30000, inn) ELSE inn END::BIGINT AS inner_ms, period::BIGINT AS period_ms
      FROM (SELECT event_id, v, {_PROVIDER} AS p, [15000, 15000, 12, 700, 15000, 15000, 45000, 999999][v + 1] AS base, [NULL, 15000, 1000, 1000, 1000, 15000, 45000, 999999][v + 1] AS inn, [30000, 30000, 5000, 5000, 5000, 30000, 45000, 999999][v + 1] AS period FROM {_SET})""",
}
