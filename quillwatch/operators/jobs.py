"""The scan-job life cycle as an append-only event log: claim, complete, fail, release, reap.

Parquet tables know no update, so each transition is a row (job_id, version, kind, at, worker, error, result), and a
job's state is the fold of its rows: the row with the greatest version says everything that can change. Versions rise
by one, so two writers of one version meet in it: the first to write holds, and the later one is fenced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_CLAIMS = 3
ERROR_CAP = 2_000
STUCK_AFTER_S = 180
PENDING, RUNNING, COMPLETE, FAILED = "pending", "running", "complete", "failed"
#: A job that is one of these stays so.
FINISHED = (COMPLETE, FAILED)

STATE = ("status", "claimed_by", "claim_count", "started_at", "completed_at", "error", "result")
EVENT_SCHEMA = "job_id string, version long, kind string, at timestamp, status string, claimed_by string, claim_count int, started_at timestamp, completed_at timestamp, error string, result string"


def cap_error(error: Column, limit: int = ERROR_CAP) -> Column:
    return F.substring(error, 1, limit)


def created(jobs: DataFrame) -> DataFrame:
    """The first event of each job: (id, created_at, and the state's columns where jobs has them)."""
    empty = {"status": F.lit(PENDING), "claim_count": F.lit(0)}
    state = [(F.col(c) if c in jobs.columns else empty.get(c, F.lit(None))).cast(t).alias(c) for c, t in (("status", "string"), ("claimed_by", "string"), ("claim_count", "int"), ("started_at", "timestamp"), ("completed_at", "timestamp"), ("error", "string"), ("result", "string"))]
    return jobs.select(F.col("id").alias("job_id"), F.lit(0).cast("long").alias("version"), F.lit("created").alias("kind"), F.col("created_at").alias("at"), *state)


def _first_and_last(events: DataFrame) -> DataFrame:
    """(job_id, first, last): each job's first event, and of the greatest version the event that isn't fenced.

    The order is total: of one version the earliest event counts, and of equal times the greatest by the other columns.
    """
    rest = ("kind", "at", *STATE)
    first, last = F.struct("version", "at", "kind", *STATE), F.struct("version", (-F.unix_micros(F.col("at").cast("timestamp"))).alias("before"), *rest)
    return events.groupBy("job_id").agg(F.min(first).alias("first"), F.max(last).alias("last"))


def fold(events: DataFrame) -> DataFrame:
    """The state of each job: (job_id, version, created_at, STATE). One shuffle on job_id, partial aggregates.

    Fenced events don't count, whatever the order of the log.
    """
    out = _first_and_last(events)
    return out.select("job_id", "last.version", F.col("first.at").alias("created_at"), *[f"last.{c}" for c in STATE])


def compacted(events: DataFrame) -> DataFrame:
    """The events that the fold of a log rests on: two rows a job at most, with the same fold."""
    names = ("version", "kind", "at", *STATE)
    ends = _first_and_last(events).select("job_id", *[F.struct(*[f"{end}.{c}" for c in names]).alias(end) for end in ("first", "last")])
    return ends.select("job_id", F.explode(F.array_distinct(F.array("first", "last"))).alias("e")).select("job_id", "e.*")


def unfinished(events: DataFrame) -> DataFrame:
    """fold, for jobs that aren't finished and whose creation is among the events: others come late to finished jobs."""
    out = _first_and_last(events).filter((F.col("first.version") == 0) & ~F.col("last.status").isin(*FINISHED))
    return out.select("job_id", "last.version", F.col("first.at").alias("created_at"), *[f"last.{c}" for c in STATE])


def compacted_by_end(events: DataFrame) -> DataFrame:
    """compacted, with finished for the rows of finished jobs; events of jobs whose creation isn't there are left out."""
    names = ("version", "kind", "at", *STATE)
    known = _first_and_last(events).filter("first.version = 0")
    ends = known.select("job_id", *[F.struct(*[f"{end}.{c}" for c in names]).alias(end) for end in ("first", "last")])
    each = ends.select("job_id", F.col("last.status").isin(*FINISHED).alias("finished"), F.explode(F.array_distinct(F.array("first", "last"))).alias("e"))
    return each.select("job_id", "e.*", "finished")


def _event(jobs: DataFrame, kind: str | Column, at: Column, keep: tuple[str, ...] = (), **changes: Column) -> DataFrame:
    """The next event of each of jobs (as fold returns them): what doesn't change is carried on, and keep's columns beside it."""
    state = [changes[c].cast(jobs.schema[c].dataType).alias(c) if c in changes else F.col(c) for c in STATE]
    return jobs.select("job_id", (F.col("version") + 1).alias("version"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), at.alias("at"), *state, *keep)


def claim(jobs: DataFrame, workers: list[str], now: Column, per_worker: int = 1, running: dict[str, int] | None = None) -> DataFrame:
    """Claims of the oldest pending jobs, up to per_worker in all for each worker, none twice.

    limit() keeps as many rows as there are free places (a top-k, nothing is sorted in full); places go round.
    """
    free = [w for k in range(per_worker) for w in workers if k < per_worker - (running or {}).get(w, 0)]
    oldest = jobs.filter(F.col("status") == PENDING).orderBy("created_at", "job_id").limit(len(free))
    if not free:
        return _event(oldest, "claimed", now)
    place = F.row_number().over(Window.orderBy("created_at", "job_id"))  # over at most len(free) rows
    taken = oldest.withColumn("_w", F.element_at(F.array(*map(F.lit, free)), place))
    return _event(taken, "claimed", now, status=F.lit(RUNNING), claimed_by=F.col("_w"), claim_count=F.col("claim_count") + 1, started_at=now, error=F.lit(None))


def complete(jobs: DataFrame, now: Column, result: Column) -> DataFrame:
    return _event(jobs, "completed", now, status=F.lit(COMPLETE), result=result, error=F.lit(None), completed_at=now)


def fail(jobs: DataFrame, now: Column, error: Column) -> DataFrame:
    return _event(jobs, "failed", now, status=F.lit(FAILED), error=cap_error(error), completed_at=now)


def release(jobs: DataFrame, now: Column, error: Column) -> DataFrame:
    """Back to pending; how often it was claimed stays."""
    return _event(jobs, "released", now, status=F.lit(PENDING), claimed_by=F.lit(None), started_at=F.lit(None), error=cap_error(error))


def will_retry(claim_count: Column, max_claims: int = MAX_CLAIMS) -> Column:
    """Every error may be retried until the claims are used up."""
    return claim_count < max_claims


def settle_errors(jobs: DataFrame, now: Column, error: Column) -> DataFrame:
    """Jobs whose scan raised: released, or failed on the last claim."""
    again = will_retry(F.col("claim_count"))
    return _event(jobs, "errored", now, status=F.when(again, PENDING).otherwise(FAILED), claimed_by=F.when(~again, F.col("claimed_by")), started_at=F.when(~again, F.col("started_at")), error=cap_error(error), completed_at=F.when(again, F.col("completed_at")).otherwise(now))


def settle(jobs: DataFrame, now: Column, result: Column, error: Column) -> DataFrame:
    """Jobs whose scan ended: complete without an error, otherwise as settle_errors."""
    fine, again = error.isNull(), error.isNotNull() & will_retry(F.col("claim_count"))
    return _event(
        jobs, F.when(fine, F.lit("completed")).otherwise("errored"), now, status=F.when(fine, COMPLETE).when(again, PENDING).otherwise(FAILED), result=F.when(fine, result).otherwise(F.col("result")),
        claimed_by=F.when(~again, F.col("claimed_by")), started_at=F.when(~again, F.col("started_at")), error=cap_error(error), completed_at=F.when(again, F.col("completed_at")).otherwise(now),
    )


def is_stuck(now: Column, after_s: int = STUCK_AFTER_S) -> Column:
    """Whether a job runs and started strictly earlier than so many seconds ago; never null."""
    return F.coalesce((F.col("status") == RUNNING) & (F.col("started_at") < now - F.make_dt_interval(secs=F.lit(after_s))), F.lit(False))


def stuck(jobs: DataFrame, now: Column, after_s: int = STUCK_AFTER_S) -> DataFrame:
    return jobs.filter(is_stuck(now, after_s))


def reap(jobs: DataFrame, now: Column, after_s: int = STUCK_AFTER_S, keep: tuple[str, ...] = ()) -> DataFrame:
    """Stuck jobs go back to pending, or fail when their claims are used up."""
    again = will_retry(F.col("claim_count"))
    return _event(stuck(jobs, now, after_s), "reaped", now, keep, status=F.when(again, PENDING).otherwise(FAILED), claimed_by=F.when(~again, F.col("claimed_by")), started_at=F.when(~again, F.col("started_at")), completed_at=F.when(again, F.col("completed_at")).otherwise(now))


def fenced(events: DataFrame) -> DataFrame:
    """Events of a worker that no longer holds the job: its version isn't the one after the last (a late writer)."""
    order = Window.partitionBy("job_id").orderBy("version", "at", *[F.desc(c) for c in ("kind", *STATE)])
    return events.withColumn("fenced", F.coalesce(F.col("version") <= F.lag("version").over(order), F.lit(False)))


def worker_of(claimed_by: Column, *fallbacks: Column) -> Column:
    """Who works on a job: the first name that isn't missing."""
    return F.coalesce(claimed_by, *fallbacks, F.lit("unknown"))
