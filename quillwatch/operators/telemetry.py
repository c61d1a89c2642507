"""Events as JSON lines, log lines, and status, without any page or policy content."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.settings import iso_instant
from ..functions.text import shorten

STRING_CAP = 500
# Log levels by rank.
LEVELS = {"debug": 0, "info": 1, "warn": 2, "error": 3}
#: What each event says besides its name and time.
PAYLOADS = {
    "scan_started": ("jobId", "url", "provider", "workerId"),
    "scan_completed": ("jobId", "durationMs", "score", "overallStatus", "aiProvider", "aiLatencyMs"),
    "scan_failed": ("jobId", "durationMs", "error", "claimCount", "willRetry"),
    "scan_reaped": ("reapedCount",),
    "worker_boot": ("workerId", "provider", "concurrency", "version"),
    "worker_shutdown": ("workerId", "inFlightJobsDrained", "durationMs"),
}
#: Those of them that are text, and those that aren't.
TEXTS = {"jobId", "url", "provider", "workerId", "overallStatus", "aiProvider", "error", "version"}
OTHERS = {"durationMs", "score", "aiLatencyMs", "claimCount", "willRetry", "reapedCount", "concurrency", "inFlightJobsDrained"}


def event_json(name: str, at: Column, **payload: Column) -> Column:
    """One event as JSON: event, ts, then the payload; long strings are shortened, a payload's own event or ts counts.

    Payloads of the names that events have are made into JSON at once. Of others it is known when the plan is made only
    whether they are strings, where the branch of other types is folded away; their line is made of one JSON text a field.
    """
    if payload.keys() <= TEXTS | OTHERS:
        cut = [short(v.cast("string")).alias(k) if k in TEXTS else v.alias(k) for k, v in payload.items()]
        return F.to_json(F.struct(F.lit(name).alias("event"), iso_instant(at).alias("ts"), *cut), {"ignoreNullFields": "false"})

    def value(column: Column) -> Column:
        text = lambda v: F.to_json(F.struct(v.alias("v")), {"ignoreNullFields": "false"})
        inner = F.when(F.typeof(column) == "string", text(short(column.cast("string")))).otherwise(text(column))
        return F.regexp_extract(inner, "(?s)^.{5}(.*).$", 1)

    fields = {"event": F.lit(name), "ts": iso_instant(at)} | payload
    parts = [F.concat(F.lit(f"{json.dumps(k)}:"), value(v)) for k, v in fields.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def short(text: Column, limit: int = STRING_CAP) -> Column:
    return shorten(text, limit)


def write_events(lines: DataFrame, path: str, column: str = "line", epoch: int | None = None) -> None:
    """Appends JSON lines, one file a task; those of an epoch once, however often it is written."""
    values = lines.select(F.col(column).alias("value"))
    if epoch is None:
        values.write.mode("append").text(path)
    else:
        values.write.mode("overwrite").text(f"{path.rstrip('/')}/epoch={epoch:012d}")


def event_sink(lines: DataFrame, path: str, checkpoint: str, column: str = "line", period_s: float | None = None) -> StreamingQuery:
    """A stream's lines as JSON lines by epoch: a batch that is repeated after a failure replaces its own files, which a
    committer moves in only when all of its tasks are done. Without a period until all is read."""
    trigger = {"availableNow": True} if period_s is None else {"processingTime": f"{period_s} seconds"}
    return lines.writeStream.foreachBatch(lambda batch, epoch: write_events(batch, path, column, epoch)).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def log_line(at: Column, level: Column, message: Column, tag: str = "[quillwatch]") -> Column:
    """[time] LEVEL message; a message that begins with a bracket has its own tag."""
    body = F.when(message.startswith("["), message).otherwise(F.concat(F.lit(tag + " "), message))
    return F.concat(F.lit("["), iso_instant(at), F.lit("] "), F.rpad(F.upper(level), 5, " "), F.lit(" "), body)


def passes(level: Column, threshold: Column | str) -> Column:
    """Whether a level is loud enough; with an unknown level or threshold nothing is."""
    rank = F.create_map(*[F.lit(x) for p in LEVELS.items() for x in p])
    threshold = F.lit(threshold) if isinstance(threshold, str) else threshold
    return F.coalesce(rank[level] >= rank[threshold], F.lit(False))


def health(jobs: DataFrame, worker: str, provider: str, version: str, started_at: Column, now: Column, shutting_down: bool = False) -> DataFrame:
    """One row as a health endpoint would answer, with its HTTP code."""
    active = jobs.filter((F.col("status") == "running") & (F.col("claimed_by") == worker)).agg(F.count("*").alias("activeJobs"))
    return active.select(
        F.lit("shutting_down" if shutting_down else "ok").alias("status"), F.lit(provider).alias("provider"), F.lit(worker).alias("workerId"), "activeJobs",
        (F.unix_millis(now) - F.unix_millis(started_at)).alias("uptimeMs"), F.lit(version).alias("version"), F.lit(shutting_down).alias("shuttingDown"), F.lit(503 if shutting_down else 200).alias("code"),
    )


class HealthServer:
    """Answers GET /healthz with the worker's state as JSON, 503 once it shuts down, and everything else with 404.

    state() gives provider, workerId, activeJobs, version and shuttingDown. Runs on the driver.
    """

    def __init__(self, state: Callable[[], dict], port: int = 8080, host: str = ""):
        began = time.monotonic()

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                code, kind, body = 404, "text/plain", b"not found"
                if self.path == "/healthz":
                    now = state()
                    down = bool(now["shuttingDown"])
                    answer = {"status": "shutting_down" if down else "ok", "provider": now["provider"], "workerId": now["workerId"], "activeJobs": now["activeJobs"], "uptimeMs": int(1000 * (time.monotonic() - began)), "version": now["version"], "shuttingDown": down}
                    code, kind, body = 503 if down else 200, "application/json", json.dumps(answer).encode()
                self.send_response(code)
                self.send_header("content-type", kind)
                self.send_header("content-length", str(len(body)))
                self.end_headers()
                self.wfile.write(body)

            def do_POST(self):
                self.send_error(404)

            do_PUT = do_DELETE = do_HEAD = do_PATCH = do_POST

            def log_message(self, *_):
                pass

        self.server = ThreadingHTTPServer((host, port), Handler)
        self.port = self.server.server_address[1]
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def close(self) -> None:
        self.server.shutdown()
        self.server.server_close()
