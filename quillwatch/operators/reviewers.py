"""Reviewers over HTTP for `verdicts.run_reviews`: two hosted ones and a local one, and live policy fetching.

Each takes a post (or get) function, so tests and closed networks put a fake in its place. Anything unexpected raises;
the caller turns that into the stub verdict. Nothing here logs a payload or a reply.
"""

from __future__ import annotations

import json
import re
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.settings import DEFAULT_TIMEOUT_MS, LEAST_TIMEOUT_MS, LOCAL_TIMEOUT_MS
from .verdicts import DATA_RISKS, FORM_RISKS, SCORES, Reviewer

TEMPERATURE = 0.2
FETCH_TIMEOUT_S = 10
USER_AGENT = "quillwatch/1.0"

PROMPT = f"""You review how a website handles health data. The user message is JSON: policy text, trackers found, hosts that no rule explains, and a summary of the contact form.
Answer with one JSON object and nothing else:
privacyPolicyScore: whole number from {SCORES[0]} to {SCORES[1]}. {SCORES[0]}: there is no policy text. 1: a policy that says nothing about health privacy law. 2: names that law, but not what others or trackers get of health data. 3: says how health data and some sharing are handled, but neither agreements with partners nor patients' rights. 4: law, sharing and rights are covered, but agreements, breach notice or retention is missing. {SCORES[1]}: all of it, and what trackers may and may not see;
privacyPolicyMissing: list of short phrases for what the policy lacks;
phiFormRiskLevel: one of {', '.join(FORM_RISKS)}. high: clinical fields together with identity, sent to a foreign or unencrypted target. medium: such fields sent to the site itself over https, or contact fields on a page with foreign trackers. low: contact or appointment fields only, sent to the site itself over https. none: no form, or nothing near health data;
phiFormReasoning: one sentence;
unknownTrackerClassifications: an object with each unknown host as a key and likelyVendor, phiRisk ({', '.join(DATA_RISKS)}) and reasoning as its value; empty without hosts.
Without policy text the score is 0 and the list holds "no privacy policy detected"."""

# The names and values of a reply, as a schema that is sent with the request where a model takes one.
REPLY_SCHEMA = {
    "type": "object",
    "properties": {
        "privacyPolicyScore": {"type": "integer", "minimum": SCORES[0], "maximum": SCORES[1]},
        "privacyPolicyMissing": {"type": "array", "items": {"type": "string"}},
        "phiFormRiskLevel": {"type": "string", "enum": list(FORM_RISKS)},
        "phiFormReasoning": {"type": "string"},
        "unknownTrackerClassifications": {
            "type": "object",
            "additionalProperties": {
                "type": "object",
                "properties": {"likelyVendor": {"type": "string"}, "phiRisk": {"type": "string", "enum": list(DATA_RISKS)}, "reasoning": {"type": "string"}},
                "required": ["likelyVendor", "phiRisk", "reasoning"],
            },
        },
    },
}
REPLY_SCHEMA["required"] = list(REPLY_SCHEMA["properties"])

Post = Callable[[str, dict, dict, float], dict]


def post_json(url: str, headers: dict, body: dict, timeout_s: float) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"content-type": "application/json", **headers})
    with urllib.request.urlopen(request, timeout=timeout_s) as answer:
        return json.load(answer)


def _messages(payload: str) -> list[dict]:
    return [{"role": "system", "content": PROMPT}, {"role": "user", "content": payload}]


class Gemini:
    name = "gemini-2.5-flash"

    def __init__(self, key: str, timeout_ms: int = DEFAULT_TIMEOUT_MS, post: Post = post_json):
        self.key, self.timeout_s, self.post = key, timeout_ms / 1000, post

    def classify(self, payload: str) -> str:
        body = {
            "systemInstruction": {"parts": [{"text": PROMPT}]},
            "contents": [{"role": "user", "parts": [{"text": payload}]}],
            "generationConfig": {"temperature": TEMPERATURE, "responseMimeType": "application/json", "responseSchema": REPLY_SCHEMA},
        }
        url = f"https://generativelanguage.googleapis.com/v1beta/models/{self.name}:generateContent"
        return self.post(url, {"x-goog-api-key": self.key}, body, self.timeout_s)["candidates"][0]["content"]["parts"][0]["text"]


class DeepSeek:
    name = "deepseek-v3"

    def __init__(self, key: str, timeout_ms: int = DEFAULT_TIMEOUT_MS, post: Post = post_json):
        self.key, self.timeout_s, self.post = key, timeout_ms / 1000, post

    def classify(self, payload: str) -> str:
        body = {"model": "deepseek-chat", "temperature": TEMPERATURE, "response_format": {"type": "json_object"}, "messages": _messages(payload)}
        return self.post("https://api.deepseek.com/chat/completions", {"authorization": f"Bearer {self.key}"}, body, self.timeout_s)["choices"][0]["message"]["content"]


class Ollama:
    name = "ollama-gemma-3-4b"

    def __init__(self, host: str, model: str = "gemma3:4b", timeout_ms: int = LOCAL_TIMEOUT_MS, post: Post = post_json):
        self.host, self.model, self.timeout_s, self.post = host.rstrip("/"), model, max(timeout_ms, LOCAL_TIMEOUT_MS) / 1000, post

    def classify(self, payload: str) -> str:
        body = {"model": self.model, "stream": False, "format": "json", "options": {"temperature": TEMPERATURE}, "messages": _messages(payload)}
        return self.post(f"{self.host}/api/chat", {}, body, self.timeout_s)["message"]["content"]


def from_settings(settings: dict[str, str], post: Post = post_json) -> Callable[[], Reviewer] | None:
    """What makes the first reviewer that is set up, or None. settings: gemini_key, deepseek_key, ollama_host, ollama_model, timeout_ms."""
    value = lambda k: (settings.get(k) or "").strip()
    number = re.match(r"[+-]?[0-9]+", value("timeout_ms"))  # as settings.inner_timeout_ms reads it
    given = (int(number[0]) if number else 0) or DEFAULT_TIMEOUT_MS
    timeout = {"timeout_ms": max(LEAST_TIMEOUT_MS, given)} if settings.get("timeout_ms") else {}
    if value("gemini_key"):
        return lambda: Gemini(value("gemini_key"), post=post, **timeout)
    if value("deepseek_key"):
        return lambda: DeepSeek(value("deepseek_key"), post=post, **timeout)
    if value("ollama_host"):
        model = {"model": value("ollama_model")} if value("ollama_model") else {}
        return lambda: Ollama(value("ollama_host"), post=post, **model, **timeout)
    return None


def get_text(url: str) -> str | None:
    """A document's markup; None unless it is answered well."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"user-agent": USER_AGENT}), timeout=FETCH_TIMEOUT_S) as answer:
            return answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace") if 200 <= answer.status < 300 else None
    except (OSError, ValueError):
        return None


def fetch_documents(urls: DataFrame, url: str = "url", get: Callable[[str], str | None] = get_text) -> DataFrame:
    """(url, ok, body) for each distinct URL, fetched by the executors: the table that `html.fetch_policies` joins."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            bodies = [get(u) for u in rows["url"]]
            yield pd.DataFrame({"url": rows["url"], "ok": [b is not None for b in bodies], "body": bodies})

    wanted = urls.select(F.col(url).alias("url")).filter("url is not null").distinct()
    return wanted.mapInPandas(run, "url string, ok boolean, body string")
