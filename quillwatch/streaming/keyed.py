"""Jobs as keyed state of a stream: each job's state is held by its key, and a timer reaps it when it is stuck.

The stream reads job events in any order. A job's state is what jobs.fold makes of the same events: a streaming aggregate
keeps each job's first time and the event that counts in the stream's state store, so no log is read again and no row
goes through Python. A running job has a timer at its start plus the timeout; when the clock passes it and the job still
runs, the state moves on as jobs.reap says and the transition is put out, with or without new input: a tick each second
makes batches come.

Timers are a table beside the aggregate, of jobs that run; each batch reads that of the batch before and writes its own, in
turns between two folders, so a repeated batch finds what it found. What a timer did is an event like others and comes back
to the aggregate by a folder that the stream reads too. Until it is there the job stays among the timers, so that later
writers are fenced at once. State, timers and that folder are in the stream's checkpoint and are there after a restart.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import jobs

#: What comes out whenever a job's state changes: the state, and whether the timer did it.
STATE_SCHEMA = f"{jobs.EVENT_SCHEMA}, created_at timestamp, by_timer boolean"
_EVENT = [field.split()[0] for field in jobs.EVENT_SCHEMA.split(", ")][1:]
_STORE, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SEEN_SCHEMA = f"{jobs.EVENT_SCHEMA}, created_at timestamp"


def _counted() -> Column:
    """An event as jobs.fold orders them: the greatest counts."""
    return F.struct("version", (-F.unix_micros("at")).alias("before"), "kind", "at", *jobs.STATE)


def job_states(events: DataFrame) -> DataFrame:
    """(job_id, first, last, reaped) of the jobs that a batch has events of: the first event's version and time, the event
    that counts, and the last one that a timer made. events: EVENT_SCHEMA and created_at, null but for timers' events."""
    own = F.when(F.col("created_at").isNotNull(), F.struct("version", "at", "created_at"))
    return events.groupBy("job_id").agg(F.min(F.struct("version", "at")).alias("first"), F.max(_counted()).alias("last"), F.max(own).alias("reaped"))


def _step(each: Callable[[DataFrame, int], None], folder: str, after_s: int) -> Callable[[DataFrame, int], None]:
    """A batch: the states that it changed meet the timers, and what is due is reaped."""
    def step(states: DataFrame, number: int) -> None:
        spark, now = states.sparkSession, F.timestamp_millis(F.lit(int(1000 * time.time())))
        kind = {f.name: f.dataType.simpleString() for f in states.schema}
        schema = f"_id {kind['job_id']}, _first {kind['first']}, _last {kind['last']}, waits long"
        timers = spark.read.schema(schema).parquet(f"{folder}/running-{(number - 1) % 2}") if number else spark.createDataFrame([], schema)
        both = states.withColumn("changed", F.lit(True)).join(timers, F.col("job_id").eqNullSafe(F.col("_id")), "full_outer")
        both = both.select(F.coalesce("job_id", "_id").alias("job_id"), F.least("first", "_first").alias("first"), F.greatest("last", "_last").alias("last"), F.coalesce("changed", F.lit(False)).alias("changed"), "reaped", "waits")
        # what a timer put out isn't put out again when it comes back
        known = (F.col("reaped.version") == F.col("last.version")) & (F.col("reaped.at") == F.col("last.at")) & (F.col("reaped.created_at") == F.col("first.at")) & (F.col("last.kind") == "reaped")
        back = F.coalesce(F.col("reaped.version") >= F.col("waits"), F.lit(False))
        now_there = both.select("job_id", *[f"last.{c}" for c in _EVENT], F.col("first.at").alias("created_at"), "first", (F.col("changed") & ~F.coalesce(known, F.lit(False))).alias("shown"), F.when(~back, F.col("waits")).alias("waits"))
        now_there.write.mode("overwrite").parquet(f"{folder}/states")  # what follows reads this, so the aggregate runs once
        now_there = spark.read.schema(now_there.schema).parquet(f"{folder}/states")
        reaped = jobs.reap(now_there.withColumn("was", F.struct(*_EVENT)), now, after_s, keep=("created_at", "first", "shown", "was"))
        row = lambda of, by_timer: F.struct(*[F.col(of + c).alias(c) for c in _EVENT], "created_at", F.lit(by_timer).alias("by_timer"))
        # both changes of a job that is due when it comes, in their order
        timed = reaped.select("job_id", F.inline(F.when(F.col("shown"), F.array(row("was.", False), row("", True))).otherwise(F.array(row("", True)))))
        waiting = now_there.filter(~jobs.is_stuck(now, after_s))
        each(waiting.filter("shown").select("job_id", *_EVENT, "created_at", F.lit(False).alias("by_timer")).union(timed), number)
        if not reaped.isEmpty():
            reaped.drop("first", "shown", "was").write.mode("overwrite").parquet(f"{folder}/reaped/batch-{number}")
        left = waiting.filter((F.col("status") == jobs.RUNNING) | F.col("waits").isNotNull())
        timer = lambda df, waits: df.select(F.col("job_id").alias("_id"), F.col("first").alias("_first"), _counted().alias("_last"), waits.alias("waits"))
        timer(left, F.col("waits")).union(timer(reaped, F.col("version"))).write.mode("overwrite").parquet(f"{folder}/running-{number % 2}")

    return step


def run_states(events: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, after_s: int = jobs.STUCK_AFTER_S, period_s: float | None = None) -> StreamingQuery:
    """Gives each batch's changes to each(changes, number), rows STATE_SCHEMA; without a period until all events are read.
    An event that changes nothing repeats its job's state."""
    spark, folder = events.sparkSession, f"{checkpoint.rstrip('/')}/timers"
    spark.createDataFrame([], _SEEN_SCHEMA).write.mode("ignore").parquet(f"{folder}/reaped/none")
    seen = spark.readStream.schema(_SEEN_SCHEMA).parquet(f"{folder}/reaped/*")
    ticks = spark.readStream.format("rate").option("numPartitions", 1).load()
    ticks = ticks.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in seen.schema], (F.col("value") < 0).alias("real"))
    logged = events.select("job_id", *_EVENT, F.lit(None).cast("timestamp").alias("created_at"), F.lit(True).alias("real"))
    every = logged.union(seen.withColumn("real", F.lit(True))).union(ticks).filter("real").drop("real")
    trigger = {"availableNow": True} if period_s is None else {"processingTime": f"{period_s} seconds"}
    old = spark.conf.get(_STORE)
    try:
        spark.conf.set(_STORE, _ROCKS)  # states don't have to fit into memory
        return job_states(every).writeStream.foreachBatch(_step(each, folder, after_s)).outputMode("update").option("checkpointLocation", checkpoint).trigger(**trigger).start()
    finally:
        spark.conf.set(_STORE, old)


def reaps(changes: DataFrame) -> DataFrame:
    """The events that timers made, for a log."""
    return changes.filter("by_timer").select("job_id", *_EVENT)


def event_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(jobs.EVENT_SCHEMA).option("maxFilesPerTrigger", max_files).parquet(path)
