"""Streams: job inserts that wake workers, the log of transitions, the reaper's timer, draining, and telemetry windows."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import jobs, runs


def pending_inserts(spark: SparkSession, path: str, schema: str, max_files: int = 100) -> DataFrame:
    """The stream of job rows that are inserted as pending, from a folder of Parquet files."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)
    return stream.filter(F.col("status") == jobs.PENDING)


class Transaction:
    """What one commit will hold: steps of job events, and telemetry lines. Nothing of it is seen before the commit."""

    def __init__(self, log: JobLog, at: Snapshot, folder: str):
        self.log, self.at, self.folder, self.steps = log, at, folder, []

    def write(self, events: DataFrame, step: str) -> None:
        events.write.parquet(f"{self.folder}/step={step}")
        self.steps.append(f"{self.folder}/step={step}")

    def emit(self, lines: DataFrame, step: str, column: str = "line") -> None:
        """Telemetry that belongs to this commit; JobLog.publish gives it to a sink once it is committed."""
        lines.select(F.col(column).alias("value")).write.text(f"{self.folder}/_lines/{step}")

    def open_jobs(self) -> DataFrame:
        """The state of jobs that aren't finished, as of the commit before and with what was written here."""
        return self.log._open(self.at, self.steps)

    def unknown(self, created: DataFrame) -> DataFrame:
        """Of events of creation those whose job the log doesn't have, finished jobs included."""
        return created.join(self.log._read(self.at, ("open", "finished")).select("job_id"), "job_id", "left_anti").dropDuplicates(["job_id"])


@dataclass(frozen=True)
class Snapshot:
    """A place in the log: the newest snapshot's folder, the commits after it by number, and the names of all of these."""

    folder: str | None
    number: int
    commits: dict[int, str]
    names: frozenset[str]


class JobLog:
    """The event log in a folder, as numbered commits.

    A commit is a folder that is written aside and then renamed to the next number, which one writer only can do; so all
    of its steps are seen at once or not at all. Its name makes it idempotent: a name that the log has is not committed
    again. A transaction reads the state of the commit before its own and is computed anew if another writer came first;
    an append takes the next free number. Compaction folds all commits into a snapshot that remembers their names, with
    open and finished jobs apart: what a batch does reads open jobs and later commits only, and finished jobs are passed
    on without being folded again. Names older than the newest snapshot's commits are forgotten.

    The file system's rename must be atomic, as on HDFS and local disks. A reader whose files a compaction removed
    meanwhile has to read again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _path(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _delete(self, name: str) -> None:
        self._fs().delete(self._path(name), True)

    def _rename(self, source: str, target: str) -> bool:
        """Whether source now is target; False if a target is there already."""
        fs_api = self.spark._jvm.org.apache.hadoop.fs
        context = fs_api.FileContext.getFileContext(self._fs().getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark._sc._gateway.new_array(fs_api.Options.Rename, 0)
        try:
            context.rename(self._path(source), self._path(target), none)
            return True
        except Exception:
            if self._fs().exists(self._path(target)):
                return False
            raise

    def _put(self, name: str, value: dict) -> None:
        out = self._fs().create(self._path(name), True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()

    def _get(self, name: str) -> dict:
        read = self._fs().open(self._path(name))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(read)).decode())
        finally:
            read.close()

    def _now(self) -> Snapshot:
        fs, root = self._fs(), self._path()
        found = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        infos = {n: self._get(f"{n}/_commit.json") for n in found if n.startswith("snapshot=")}
        newest = max(infos, key=lambda n: infos[n]["number"], default=None)
        number, names = (infos[newest]["number"], set(infos[newest]["names"])) if newest else (-1, set())
        commits = {int(n.partition("=")[2]): n for n in found if n.startswith("commit=")}
        later = {k: n for k, n in sorted(commits.items()) if k > number}
        return Snapshot(newest, number, later, frozenset(names | {self._get(f"{n}/_commit.json")["name"] for n in later.values()}))

    def _read(self, at: Snapshot, kinds: tuple[str, ...], more: list[str] = []) -> DataFrame:
        fs = self._fs()
        folders = [f"{at.folder}/{k}" for k in kinds if at.folder and fs.exists(self._path(f"{at.folder}/{k}"))]
        for commit in at.commits.values():
            folders += [f"{commit}/{s.getPath().getName()}" for s in fs.listStatus(self._path(commit)) if s.getPath().getName().startswith("step=")]
        paths = [f"{self.path}/{f}" for f in folders] + more
        read = self.spark.read.schema(jobs.EVENT_SCHEMA)
        parts = [read.parquet(p) for p in paths]  # one by one, so that no folder's name becomes a column
        return reduce(DataFrame.union, parts) if parts else self.spark.createDataFrame([], jobs.EVENT_SCHEMA)

    def _open(self, at: Snapshot, more: list[str] = []) -> DataFrame:
        """Jobs that aren't finished. An event of a job whose creation isn't here comes late to a finished one."""
        return jobs.unfinished(self._read(at, ("open",), more))

    def events(self) -> DataFrame:
        return self._read(self._now(), ("open", "finished"))

    def state(self) -> DataFrame:
        return jobs.fold(self.events())

    def open_jobs(self) -> DataFrame:
        return self._open(self._now())

    def committed(self, name: str) -> bool:
        return name in self._now().names

    def _commit(self, name: str, at: Snapshot, folder: str, blind: bool) -> bool:
        """Gives a folder the next number. Whether that was done; if not blind, the log must be as it was at that place."""
        self._put(f"{folder}/_commit.json", {"name": name})
        while True:
            number = max([at.number, *at.commits]) + 1
            target = f"commit={batch_name(number)}"
            if self._rename(folder, target):
                now = self._now()
                if now.number < number:
                    return True
                folder = f"late-{uuid.uuid4().hex}"  # a compaction freed this number meanwhile
                self._rename(target, folder)
            if not blind:
                return False
            at = self._now()
            if name in at.names:
                return False

    def transact(self, name: str, build: Callable[[Transaction], None], blind: bool = False) -> bool:
        """Commits what build writes, unless name is committed already; whether this call did it.

        blind: what build writes holds whatever others commit meanwhile, since events of an old version are fenced.
        """
        while True:
            at = self._now()
            if name in at.names:
                return False
            folder = f"staged-{uuid.uuid4().hex}"
            try:
                build(Transaction(self, at, f"{self.path}/{folder}"))
                if self._commit(name, at, folder, blind):
                    return True
            finally:
                self._delete(folder)

    def append(self, events: DataFrame, step: str) -> None:
        """One step as a commit of its own, seen whatever its name is; nothing if that name is committed already."""
        self.transact(step, lambda t: t.write(events, step), blind=True)

    def publish(self, sink: str) -> None:
        """Copies the telemetry of all commits to a folder of JSON lines, each commit's once, however often it is called."""
        at, fs = self._now(), self._fs()
        for commit in at.commits.values():
            lines = f"{commit}/_lines"
            if fs.exists(self._path(lines)):
                text = reduce(DataFrame.union, [self.spark.read.text(f"{self.path}/{lines}/{s.getPath().getName()}") for s in fs.listStatus(self._path(lines))])
                text.write.mode("overwrite").text(f"{sink.rstrip('/')}/{commit}")

    def compact(self, batch: str) -> None:
        """Folds all commits into a snapshot of this name, unless there is one; older folders go."""
        at = self._now()
        if at.folder == f"snapshot={batch}":
            return
        folder = f"staged-{uuid.uuid4().hex}"
        folded = jobs.compacted_by_end(self._read(at, ("open",))).persist()
        folded.filter("NOT finished").drop("finished").write.parquet(f"{self.path}/{folder}/open")
        finished = folded.filter("finished").drop("finished")
        if at.folder and self._fs().exists(self._path(f"{at.folder}/finished")):
            finished = finished.union(self.spark.read.schema(jobs.EVENT_SCHEMA).parquet(f"{self.path}/{at.folder}/finished"))
        finished.write.parquet(f"{self.path}/{folder}/finished")
        folded.unpersist()
        names = [self._get(f"{n}/_commit.json")["name"] for n in at.commits.values()]
        self._put(f"{folder}/_commit.json", {"number": max(at.commits, default=at.number), "names": names})
        self._rename(folder, f"snapshot={batch}")
        self._delete(folder)  # if another made this snapshot
        for name in [at.folder, *at.commits.values()]:
            if name:
                self._delete(name)


def batch_name(number: int) -> str:
    """Names of batches sort as their numbers do."""
    return f"{number:012d}"


def with_ticks(inserts: DataFrame) -> DataFrame:
    """inserts, and a row of nulls each second, so that batches come while nothing is inserted."""
    ticks = inserts.sparkSession.readStream.format("rate").load()
    return inserts.union(ticks.select(*[F.when(F.col("value") < 0, F.lit("")).cast(f.dataType).alias(f.name) for f in inserts.schema]))


def run_queue(
    inserts: DataFrame, log: JobLog, workers: list[str], now: Callable[[int], Column], checkpoint: str, concurrency: int = 3, after_s: int = jobs.STUCK_AFTER_S,
    period_s: float | None = None, enabled: bool = True, compact_every: int = 100, claiming: Callable[[], bool] = lambda: True,
    scan: Callable[[DataFrame], DataFrame] | None = None, provider: str = "disabled", sink: str | None = None,
) -> StreamingQuery | None:
    """Folds inserts into the log; every batch first reaps what is stuck, then lets workers claim what is pending.

    An insert is only a hint to look: claims are made from the log's state, so a lost or repeated one does no harm. With
    a period a batch comes so often, whether or not anything is inserted, so stuck jobs are reaped by the clock; without
    one the query ends when all inserts are read. Every so many batches the log is compacted. Nothing runs unless
    enabled, and nothing is claimed once claiming() is false.

    With scan, which gives runs.OUTCOME of the jobs that these workers hold, each batch also runs them to their end, and
    claims and runs again until nothing is left to claim. Telemetry goes to the sink, if any. A batch that is repeated
    after a failure finds what it had committed and goes on from there.
    """
    if not enabled:
        return None

    def step(batch: DataFrame, number: int) -> None:
        run_batch(batch, log, batch_name(number), workers, now(number), concurrency, after_s, claiming, scan, provider)
        if sink is not None:
            log.publish(sink)
        if compact_every and number % compact_every == compact_every - 1:
            log.compact(batch_name(number))

    stream = with_ticks(inserts) if period_s is not None else inserts
    trigger = {"availableNow": True} if period_s is None else {"processingTime": f"{period_s} seconds"}
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def run_batch(
    inserts: DataFrame, log: JobLog, name: str, workers: list[str], at: Column, concurrency: int = 3, after_s: int = jobs.STUCK_AFTER_S, claiming: Callable[[], bool] = lambda: True,
    scan: Callable[[DataFrame], DataFrame] | None = None, provider: str = "disabled",
) -> None:
    """One batch of run_queue: a commit of what is created, reaped and claimed, and with scan a commit of each run."""
    held = (F.col("status") == jobs.RUNNING) & F.col("claimed_by").isin(workers)

    def take(t: Transaction) -> None:
        t.write(t.unknown(jobs.created(inserts.filter("id is not null"))), "1-created")
        state = t.open_jobs().persist()
        reaped = jobs.reap(state, at, after_s)
        t.write(reaped, "2-reaped")
        t.emit(runs.reaped_line(reaped, at), "2-reaped")
        state.unpersist()
        claim(t)

    def claim(t: Transaction) -> None:
        if claiming():
            state = t.open_jobs().persist()
            busy = {r["claimed_by"]: r["n"] for r in state.filter(held).groupBy("claimed_by").agg(F.count("*").alias("n")).collect()}
            t.write(jobs.claim(state, workers, at, concurrency, busy), "3-claimed")
            state.unpersist()

    def run(t: Transaction) -> None:
        mine = t.open_jobs().filter(held).persist()
        ended = runs.ended(mine, scan(mine)).persist()
        t.write(runs.transitions(ended, at), "4-run")
        t.emit(runs.lines(ended, at, provider), "4-run")
        ended.unpersist()
        mine.unpersist()

    log.transact(f"{name}-take", take)
    for k in count() if scan is not None else ():
        if log.open_jobs().filter(held).isEmpty():
            break
        log.transact(f"{name}-run-{k}", run, blind=True)
        log.transact(f"{name}-claim-{k}", claim)


@dataclass
class Shutdown:
    """What a shutdown did, in order."""

    steps: list[str] = field(default_factory=list)
    outcome: str = "done"
    in_flight: int = 0
    drained: int = 0
    duration_ms: int = 0


def shut_down(in_flight: Callable[[], int], stop_claiming: Callable[[], None], query: StreamingQuery | None = None, close_health: Callable[[], None] = lambda: None, grace_s: float = 120.0, every_s: float = 0.5, log: Callable[[str], None] = lambda line: None) -> Shutdown:
    """Closes the health endpoint, stops claiming, waits for jobs in flight up to the grace period, then stops the stream.

    Never raises: a step that fails is logged and the next one follows. Jobs still in flight are left to the reaper.
    """
    began, out = time.monotonic(), Shutdown()

    def attempt(name: str, act: Callable[[], object]) -> object:
        try:
            value = act()
            out.steps.append(name)
            return value
        except Exception as e:
            log(f"shutdown: {name} failed: {type(e).__name__}")
            out.steps.append(f"{name} failed")
            return None

    out.in_flight = attempt("jobs counted", in_flight) or 0
    attempt("health closed", close_health)
    attempt("claiming stopped", stop_claiming)
    left = out.in_flight
    while left and time.monotonic() - began < grace_s:
        time.sleep(min(every_s, grace_s))
        try:
            left = in_flight()
        except Exception as e:
            log(f"shutdown: counting failed: {type(e).__name__}")
    out.outcome = "timeout" if left else "done"
    out.steps.append(f"drain {out.outcome}")
    if query is not None:
        attempt("stream stopped", query.stop)
    out.drained, out.duration_ms = out.in_flight - left, int(1000 * (time.monotonic() - began))
    return out


def event_counts(events: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events by kind and time window of a stream (ts, event_type); rows later than late are left out (an extension)."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n")
