"""Reviewers' verdicts: parsing, validation, fallback, and running a pluggable reviewer over Arrow batches."""

from __future__ import annotations

import json
import math
import queue
import re
import threading
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.settings import DEFAULT_TIMEOUT_MS, DISABLED, LOCAL_REVIEWER, LOCAL_TIMEOUT_MS

# What a verdict may say.
FORM_RISKS = ("none", "low", "medium", "high")
DATA_RISKS = ("low", "medium", "high", "unknown")
SCORES = (0, 5)
#: Reviews that one partition asks for at once.
PARALLEL = 4
UNKNOWN = "unknown"

CLASS_TYPE = T.StructType().add("likely_vendor", T.StringType()).add("phi_risk", T.StringType()).add("reasoning", T.StringType())
CLASSES_TYPE = T.MapType(T.StringType(), CLASS_TYPE)
VERDICT_TYPE = (
    T.StructType().add("score", T.IntegerType()).add("missing", T.ArrayType(T.StringType())).add("form_risk", T.StringType()).add("form_reasoning", T.StringType())
    .add("classifications", CLASSES_TYPE).add("error", T.StringType())
)


class VerdictError(ValueError):
    """Carries a fixed code only: never a part of a reply."""


def strip_fence(text: str) -> str:
    """The content of a reply that is fenced as code; other replies as they are, trimmed."""
    text = text.strip()
    if text.startswith("```"):
        text = re.sub(r"\A```(?:json)?\s*", "", text, flags=re.I)
        text = re.sub(r"\s*```\Z", "", text)
    return text.strip()


def fence_free(text: Column) -> Column:
    """strip_fence on a column."""
    space = " \t\n\r\f\x0b"
    plain = F.btrim(text, F.lit(space))
    inner = F.regexp_replace(F.regexp_replace(plain, "^(?i)```(?:json)?\\s*", ""), "\\s*```$", "")
    return F.when(plain.startswith("```"), F.btrim(inner, F.lit(space))).otherwise(plain)


def _not_json(_: str):
    raise ValueError


def _as_text(value) -> str | None:
    """How the value reads as text: a list of one text reads like the text."""
    while isinstance(value, list) and len(value) == 1:
        value = value[0]
    return value if isinstance(value, str) else None


def parse_reply(raw: str | None) -> dict:
    """A reply's verdict as VERDICT_TYPE; raises VerdictError with a fixed code."""
    if not isinstance(raw, str) or not raw:
        raise VerdictError("empty")
    try:
        reply = json.loads(strip_fence(raw), parse_constant=_not_json)
    except (ValueError, RecursionError):
        raise VerdictError("not json") from None
    if not isinstance(reply, (dict, list)):
        raise VerdictError("not an object")
    fields = reply if isinstance(reply, dict) else {}
    score = fields.get("privacyPolicyScore")
    number = isinstance(score, (int, float)) and not isinstance(score, bool) and math.isfinite(score) and float(score).is_integer()
    if not number or not SCORES[0] <= score <= SCORES[1]:
        raise VerdictError("bad score")
    risk = _as_text(fields.get("phiFormRiskLevel"))
    if risk not in FORM_RISKS:
        raise VerdictError("bad form risk")
    text = lambda value, other: value if isinstance(value, str) else other
    missing = fields.get("privacyPolicyMissing")
    classes = fields.get("unknownTrackerClassifications")
    if isinstance(classes, list):
        classes = {str(k): v for k, v in enumerate(classes)}
    found = {}
    for domain, value in (classes.items() if isinstance(classes, dict) else ()):
        if isinstance(value, (dict, list)):
            value = value if isinstance(value, dict) else {}
            data_risk = value.get("phiRisk")
            found[domain] = {
                "likely_vendor": text(value.get("likelyVendor"), UNKNOWN),
                "phi_risk": data_risk if isinstance(data_risk, str) and data_risk in DATA_RISKS else UNKNOWN,
                "reasoning": text(value.get("reasoning"), ""),
            }
    return {
        "score": int(score),
        "missing": [m for m in missing if isinstance(m, str)] if isinstance(missing, list) else [],
        "form_risk": risk,
        "form_reasoning": text(fields.get("phiFormReasoning"), ""),
        "classifications": found,
        "error": None,
    }


def stub() -> dict:
    """The verdict where there is no reviewer or it failed."""
    return {"score": 0, "missing": [], "form_risk": "none", "form_reasoning": "", "classifications": {}, "error": None}


def _safe(raw) -> dict:
    try:
        return parse_reply(raw)
    except VerdictError as e:
        return {"score": None, "missing": None, "form_risk": None, "form_reasoning": None, "classifications": None, "error": str(e)}


@F.pandas_udf(VERDICT_TYPE)
def parse_verdict(raw: pd.Series) -> pd.DataFrame:
    """Invalid replies give nulls and an error code."""
    return pd.DataFrame([_safe(r) for r in raw], columns=["score", "missing", "form_risk", "form_reasoning", "classifications", "error"])


def with_fallback(parsed: Column, provider: Column, latency_ms: Column) -> Column:
    """The parsed verdict with who gave it, or the stub, which nobody gave."""
    ok = parsed["error"].isNull() & parsed["score"].isNotNull()
    return F.struct(
        F.when(ok, parsed["score"]).otherwise(0).alias("score"),
        F.when(ok, parsed["missing"]).otherwise(F.array().cast("array<string>")).alias("missing"),
        F.when(ok, parsed["form_risk"]).otherwise("none").alias("form_risk"),
        F.when(ok, parsed["form_reasoning"]).otherwise("").alias("form_reasoning"),
        F.when(ok, parsed["classifications"]).otherwise(F.create_map().cast(CLASSES_TYPE)).alias("classifications"),
        F.when(ok, provider).otherwise(DISABLED).alias("provider"),
        F.when(ok, latency_ms).otherwise(0).cast("long").alias("latency_ms"),
    )


class Reviewer(Protocol):
    """Takes a prompt payload as JSON and returns a reply's text; may raise anything."""

    name: str

    def classify(self, payload: str) -> str: ...


def outer_timeout(name: str, given_ms: int | None = None) -> int:
    """Milliseconds that a review may take in all; a local reviewer has more time."""
    base = given_ms if given_ms is not None and given_ms > 0 else DEFAULT_TIMEOUT_MS
    return max(LOCAL_TIMEOUT_MS, base) if name == LOCAL_REVIEWER else base


class _Call:
    """One review: its reply or what it raised, once done is set."""

    def __init__(self, payload: str):
        self.payload, self.done, self.abandoned = payload, threading.Event(), False
        self.reply, self.error, self.took_ms = None, None, 0


class ReviewPool:
    """Asks a reviewer for several rows at once, on so many threads at most, whatever hangs.

    A call that takes longer than the timeout is abandoned: its thread is taken until the call returns, and what it returns
    is thrown away. A row that finds no free thread waits for one as long as a call may take, and then counts as timed out.
    """

    def __init__(self, reviewer: Reviewer, size: int):
        self.reviewer, self.size = reviewer, size
        self.waiting: queue.Queue[_Call] = queue.Queue()
        self.threads: list[threading.Thread] = []

    def _work(self) -> None:
        while True:
            call = self.waiting.get()
            if call.abandoned:
                continue
            began = time.monotonic()
            try:
                call.reply = self.reviewer.classify(call.payload)
            except BaseException as e:
                call.error = e
            call.took_ms = int(1000 * (time.monotonic() - began))
            call.done.set()

    def ask(self, payloads: list[str], timeout_ms: int) -> Iterator[_Call]:
        """A finished call for each payload, in their order; no more than the pool's size are asked at once."""
        while len(self.threads) < min(self.size, len(payloads)):
            self.threads.append(threading.Thread(target=self._work, daemon=True))
            self.threads[-1].start()
        for first in range(0, len(payloads), self.size):
            window = [_Call(p) for p in payloads[first : first + self.size]]
            began = time.monotonic()
            for call in window:
                self.waiting.put(call)
            for call in window:
                if not call.done.wait(max(0.0, began + timeout_ms / 1000 - time.monotonic())):
                    call.abandoned, late = True, _Call(call.payload)
                    late.error, late.took_ms = TimeoutError("review"), timeout_ms
                    call = late
                yield call


def run_reviews(inputs: DataFrame, make_reviewer: Callable[[], Reviewer] | None, payload: str = "payload", timeout_ms: int | None = None, parallel: int = PARALLEL) -> DataFrame:
    """inputs with verdict: one reviewer a partition, asked for so many rows at once; no row ever fails or takes longer than
    the outer timeout. Without a reviewer no Python runs."""
    if make_reviewer is None:
        nothing = F.lit(None).cast(VERDICT_TYPE)
        return inputs.withColumn("verdict", with_fallback(nothing, F.lit(DISABLED), F.lit(0)))
    names = inputs.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reviewer = make_reviewer()
        pool = ReviewPool(reviewer, parallel)
        for rows in batches:
            parsed, took = [], []
            for call in pool.ask(list(rows[payload]), outer_timeout(reviewer.name, timeout_ms)):
                try:
                    if call.error is not None:
                        raise call.error
                    parsed.append(parse_reply(call.reply))
                except VerdictError as e:
                    parsed.append(_safe(None) | {"error": str(e)})
                except BaseException:  # whatever a reviewer raises, the row gets the stub
                    parsed.append(_safe(None) | {"error": "reviewer failed"})
                took.append(call.took_ms)
            yield rows[names].assign(_parsed=parsed, _by=reviewer.name, _took=took)

    schema = inputs.select("*", F.lit(None).cast(VERDICT_TYPE).alias("_parsed"), F.lit("").alias("_by"), F.lit(0).cast("long").alias("_took")).schema
    out = inputs.mapInPandas(run, schema)
    return out.withColumn("verdict", with_fallback(F.col("_parsed"), F.col("_by"), F.col("_took"))).drop("_parsed", "_by", "_took")


def classification_rows(verdicts: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, domain, likely_vendor, phi_risk, reasoning): a row for each classified domain."""
    return verdicts.select(key, F.explode("verdict.classifications").alias("domain", "c")).select(key, "domain", "c.*")


def classify_hosts(hosts: DataFrame, verdicts: DataFrame, key: str = "page_id") -> DataFrame:
    """Unknown hosts with what the verdict says of each; those it leaves out are unknown (an audit the verdict itself doesn't make)."""
    found = classification_rows(verdicts, key).withColumnRenamed("domain", "host")
    return hosts.join(found, [key, "host"], "left").withColumn("classified", F.col("phi_risk").isNotNull()).withColumn("phi_risk", F.coalesce("phi_risk", F.lit(UNKNOWN)))
