"""Reviewers with a fake transport, and fetching with a fake getter."""

import pytest
from pyspark.sql import functions as F

from quillwatch.operators import html, reviewers, verdicts

GOOD = '{"privacyPolicyScore": 2, "phiFormRiskLevel": "low"}'
REPLIES = {
    "gemini_key": {"candidates": [{"content": {"parts": [{"text": GOOD}]}}]},
    "deepseek_key": {"choices": [{"message": {"content": GOOD}}]},
    "ollama_host": {"message": {"content": GOOD}},
}


@pytest.mark.parametrize(("setting", "name"), [("gemini_key", "gemini-2.5-flash"), ("deepseek_key", "deepseek-v3"), ("ollama_host", "ollama-gemma-3-4b")])
def test_each_reviewer(setting, name):
    sent = []
    make = reviewers.from_settings({setting: " http://h/ ", "timeout_ms": "500"}, lambda *a: sent.append(a) or REPLIES[setting])
    reviewer = make()
    assert reviewer.name == name and verdicts.parse_reply(reviewer.classify("{}"))["score"] == 2
    url, _, body, timeout = sent[0]
    assert "0.2" in str(body) and "//api/chat" not in url and timeout == (30 if setting == "ollama_host" else 1)


def test_settings_read_numbers_as_the_columns_do():
    timeout = lambda text: reviewers.from_settings({"gemini_key": "k", "timeout_ms": text})().timeout_s
    assert [timeout(t) for t in ("", "12abc", " 700", "45000", "-5", "abc", "0")] == [15, 1, 1, 45, 1, 15, 15]


def test_the_reply_schema_is_sent():
    sent = []
    reviewers.from_settings({"gemini_key": "k"}, lambda *a: sent.append(a) or REPLIES["gemini_key"])().classify("{}")
    schema = sent[0][2]["generationConfig"]["responseSchema"]
    assert schema["required"] == list(schema["properties"]) and schema["properties"]["phiFormRiskLevel"]["enum"] == list(verdicts.FORM_RISKS)


def test_precedence():
    assert reviewers.from_settings({"gemini_key": " "}) is None
    assert reviewers.from_settings({"ollama_host": "h", "deepseek_key": "k"})().name == "deepseek-v3"


def test_a_reply_of_another_shape_gives_the_stub(spark):
    make = reviewers.from_settings({"gemini_key": "k"}, lambda *a: {"error": "quota"})
    inputs = spark.createDataFrame([(1, "{}")], "page_id long, payload string")
    assert tuple(verdicts.run_reviews(inputs, make).select("verdict.score", "verdict.provider").first()) == (0, "disabled")


def test_fetching(spark):
    wanted = spark.createDataFrame([("https://h.org/p",), ("https://h.org/p",), ("https://h.org/gone",), (None,)], "url string")
    store = reviewers.fetch_documents(wanted, get=lambda u: "<body>Hi</body>" if u.endswith("p") else None)
    assert {(r["url"], r["ok"]) for r in store.collect()} == {("https://h.org/p", True), ("https://h.org/gone", False)}
    pages = spark.createDataFrame([(1, "https://h.org/", "p")], "page_id long, url string, policy_href string")
    assert html.fetch_policies(pages, store).select(F.col("policy_text")).first()[0] == "Hi"


def test_hanging_reviews_leave_no_more_threads_than_the_pool_has():
    import threading
    import time

    from quillwatch.operators import verdicts

    release = threading.Event()

    class Hangs:
        name = "hangs"

        def classify(self, payload):
            if payload.startswith("hang"):
                release.wait(60)
            return payload

    before = threading.active_count()
    pool = verdicts.ReviewPool(Hangs(), 4)
    calls = list(pool.ask([f"hang {k}" for k in range(1_000)], 5))
    assert len(calls) == 1_000 and all(isinstance(c.error, TimeoutError) for c in calls) and threading.active_count() - before <= 4
    release.set()
    time.sleep(0.2)
    calls = list(pool.ask([f"p{k}" for k in range(50)], 2_000))
    assert [c.reply for c in calls] == [f"p{k}" for k in range(50)] and threading.active_count() - before <= 4


def test_reviews_run_at_once_and_keep_their_order(spark):
    import time

    from quillwatch.operators import verdicts

    class Slow:
        name = "slow"

        def classify(self, payload):
            time.sleep(0.3 if int(payload) % 3 else 0.05)
            if int(payload) == 7:
                raise ValueError("no")
            return '{"privacyPolicyScore": %d, "phiFormRiskLevel": "low"}' % (int(payload) % 6)

    inputs = spark.createDataFrame([(k, str(k)) for k in range(40)], "page_id long, payload string").coalesce(1)
    rows = verdicts.run_reviews(inputs, Slow, timeout_ms=5_000, parallel=10).collect()
    assert [(r["page_id"], r["verdict"]["score"], r["verdict"]["provider"]) for r in rows] == [(k, k % 6, "slow") if k != 7 else (7, 0, "disabled") for k in range(40)]


def test_a_repeated_epoch_leaves_one_copy(spark, tmp_path):
    from quillwatch.operators import telemetry

    lines = spark.createDataFrame([("a",), ("b",)], "line string")
    for epoch in (0, 0, 1):
        telemetry.write_events(lines, str(tmp_path / "sink"), epoch=epoch)
    assert spark.read.option("recursiveFileLookup", True).text(str(tmp_path / "sink")).count() == 4
    lines.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("line string").parquet(str(tmp_path / "in"))
    for _ in range(2):
        telemetry.event_sink(stream(), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r["value"] for r in spark.read.option("recursiveFileLookup", True).text(str(tmp_path / "out")).collect()) == ["a", "b"]
