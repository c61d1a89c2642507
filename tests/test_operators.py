"""Operators on small hand-made inputs."""

import json

import pytest
from pyspark.sql import functions as F

from quillwatch.operators import html, jobs, results, telemetry, trackers, verdicts
from quillwatch.sources import catalog
from quillwatch.streaming import jobs as streams

PAGE = "https://clinic.example.com/home"
REQUESTS = "page_id long, page_url string, seq long, url string"


def log(spark, *found, page=PAGE):
    return spark.createDataFrame([(1, page, k, u) for k, u in enumerate(found)], REQUESTS)


def names(df):
    return [r["host"] for r in df.orderBy("place").collect()]


@pytest.mark.parametrize(
    ("page", "found", "want"),
    [
        (PAGE, ["https://connect.facebook.net/en_US/fbevents.js", "https://cdn.other.io/a.js"], ["cdn.other.io"]),
        (PAGE, [PAGE + "/a", "https://static.example.com/x", "https://third.net/x"], ["third.net"]),
        (PAGE, ["https://a.net/1", "https://a.net/2", "https://A.NET/3"], ["a.net"]),
        (PAGE, [f"https://h{k}.net/" for k in range(30)], [f"h{k}.net" for k in range(20)]),
        (PAGE, ["data:x", "chrome-extension://a/b", "junk", "", "https://ok.net"], ["ok.net"]),
        ("nonsense", ["https://clinic.example.com/x"], ["clinic.example.com"]),
    ],
)
def test_unknown_hosts(spark, page, found, want):
    assert names(trackers.unknown_hosts(log(spark, *found, page=page))) == want


def test_trackers(spark):
    both = "https://js.driftt.com/x?u=https://connect.facebook.net/tr"
    rows = trackers.ordered(trackers.detect_trackers(log(spark, "", both, "https://CONNECT.facebook.net/2", "https://adrift.com/3"))).orderBy("place").collect()
    assert [(r["name"], r["request_count"], r["example_url"]) for r in rows] == [("Facebook Pixel", 2, both), ("Drift", 2, both)]
    rows = trackers.ordered(trackers.detect_trackers(log(spark, "https://js.driftt.com/x", "https://connect.facebook.net/2"))).orderBy("place").collect()
    assert [r["risk"] for r in rows] == ["warning", "high"]
    assert trackers.detect_trackers(log(spark, "https://x.org"), rules=()).count() == 0


def test_large_catalogs_are_joined(spark, tmp_path):
    rules = tuple(catalog.Rule(f"t{k}[.]net", f"T{k}", "v", "high", False) for k in range(300))
    found = log(spark, "https://t7.net/", "https://t250.net/", "https://x.org/")
    assert {r["name"] for r in trackers.match_rules(found, rules).collect()} == {"T7", "T250"}
    (tmp_path / "rules.json").write_text(json.dumps([{"pattern": "a[.]b", "name": "A", "vendor": "V", "riskLevel": "low", "description": "d", "baaAvailable": True}]))
    assert catalog.load_rules(spark, str(tmp_path / "rules.json")) == (catalog.Rule("a[.]b", "A", "V", "low", True, "d"),)


def form(markup, url="https://h.org/p"):
    return html.primary_form(html._read(markup), url)


@pytest.mark.parametrize(
    ("markup", "want"),
    [
        ('<form action="/c"><input name="full_name"><input type="email" name="email"><input type="hidden" name="t"><textarea name="message"></textarea></form>', (["full_name", "email", "message"], "https://h.org/c", True)),
        ('<form action="/b"><label>Patient name</label><input id="pt_name"><input id="pt_dob"></form>', (["pt_name", "pt_dob"], "https://h.org/b", True)),
        ('<form action="http://o.org/s"><input name="first"><input name="phoneNumber"></form>', (["first", "phoneNumber"], "http://o.org/s", False)),
        ('<form><input name="q"></form>', None),
        ('<label>contact</label><form><input name="q"></form>', None),
        ('<form><input name="q"></form><form action="x"><input type=email id=em></form><form><input type=email></form>', (["em"], "https://h.org/x", True)),
        ('<form><input type=email name=a><input name=a><input type=submit name=go></form>', (["a", "go"], "", True)),
        ('<form><input type=hidden name=phone><input name=z></form>', (["z"], "", True)),
        ("", None),
    ],
)
def test_forms(markup, want):
    found = form(markup)
    assert found is None if want is None else (found["fields"], found["action"], found["hasHttps"]) == want


@pytest.mark.parametrize(
    ("markup", "want"),
    [('<a href="/privacy">x</a>', "/privacy"), ('<a href="/x">Our <b>Privacy</b> notice</a>', "/x"), ('<a href="/x">y</a>', None), ('<a href="mailto:privacy@h.org">m</a><a href="/privacy">p</a>', "mailto:privacy@h.org"), ('<a href=" ">privacy</a><a href="/HIPAA">n</a>', "/HIPAA")],
)
def test_policy_links(spark, markup, want):
    assert html.policy_href(html._read(markup)) == want
    df = spark.createDataFrame([(markup,)], "h string")
    assert df.select(html.policy_link(F.col("h")).alias("x")).first()["x"] == want


def test_policy_text():
    assert html.page_text(html._read("<body><header>h</header><p>a</p><p>b  c</p><noscript>n</noscript></body>")) == "ab c"
    assert html.page_text(html._read("only text")) == "only text"
    assert html.page_text(html._read("<body>" + "x " * 20_000 + "</body>")) == ("x " * 10_000)[:20_000]
    assert html.page_text(html._read(None)) == ""


def test_policy_fetching(spark):
    pages = spark.createDataFrame([(1, PAGE, "/privacy"), (2, PAGE, "mailto:x@y.z"), (3, PAGE, None), (4, PAGE, "/broken"), (5, PAGE, "/gone"), (6, PAGE, "/privacy#here")], "page_id long, url string, policy_href string")
    store = spark.createDataFrame([("https://clinic.example.com/privacy", True, "<body>Policy</body>"), ("https://clinic.example.com/broken", False, "<body>Error</body>")], "url string, ok boolean, body string")
    got = {r["page_id"]: r["policy_text"] for r in html.fetch_policies(pages, store).collect()}
    assert got == {1: "Policy", 2: "", 3: "", 4: "", 5: "", 6: "Policy"}


def test_fetched_markup_is_parsed(spark):
    body = "<body><nav>a<nav>b</nav>c</nav>T<img alt='a>b'>Caf&eacute; &#8217;s &mdash; <footer>f</footer>abc</body>"
    pages = spark.createDataFrame([(1, PAGE, "/p")], "page_id long, url string, policy_href string")
    store = spark.createDataFrame([("https://clinic.example.com/p", True, body)], "url string, ok boolean, body string")
    assert html.fetch_policies(pages, store).first()["policy_text"] == "TCafé ’s — abc"


def test_reviewers(spark):
    class Raises:
        name = "raises"

        def classify(self, payload):
            raise TimeoutError(payload)

    class Good:
        name = "good"

        def classify(self, payload):
            return '{"privacyPolicyScore": 4, "phiFormRiskLevel": "low"}'

    inputs = spark.createDataFrame([(1, "{}")], "page_id long, payload string")
    score = lambda make: verdicts.run_reviews(inputs, make).select("verdict.score", "verdict.provider").first()
    assert tuple(score(Raises)) == (0, "disabled") and tuple(score(None)) == (0, "disabled") and tuple(score(Good)) == (4, "good")


def test_reviews_have_an_outer_timeout(spark):
    class Slow:
        name = "slow"

        def classify(self, payload):
            import time

            time.sleep(20)

    inputs = spark.createDataFrame([(1, "{}")], "page_id long, payload string")
    began = __import__("time").monotonic()
    assert tuple(verdicts.run_reviews(inputs, Slow, timeout_ms=300).select("verdict.score", "verdict.provider").first()) == (0, "disabled")
    assert __import__("time").monotonic() - began < 15
    assert verdicts.outer_timeout("ollama-gemma-3-4b", 700) == 30_000 and verdicts.outer_timeout("x") == 15_000 and verdicts.outer_timeout("x", 700) == 700


def test_scan_with_a_reviewer(spark):
    class Good:
        name = "good"

        def classify(self, payload):
            assert json.loads(payload)["privacyPolicyBytes"] == 7
            return '{"privacyPolicyScore": 4, "phiFormRiskLevel": "low"}'

    pages = spark.createDataFrame([(1, PAGE, '<body><a href="/privacy">p</a></body>', None)], "page_id long, url string, html string, tls_version string")
    store = spark.createDataFrame([("https://clinic.example.com/privacy", True, "<body>Policy\U0001f642</body>")], "url string, ok boolean, body string")
    r = results.scan(pages, log(spark, "https://js.driftt.com/x"), store, F.lit("2026-01-01").cast("timestamp"), make_reviewer=Good).first()
    assert r["ai_verification"]["score"] == 4 or r["ai_verification"]["provider"] == "disabled"
    assert r["overall_status"] == "warning" and r["runtime_trackers"][0]["name"] == "Drift" and r["tls_version"] is None


def t0():
    return F.lit("2026-01-01 00:10:00").cast("timestamp")


def queue(spark, *rows):
    df = spark.createDataFrame([tuple(r) for r in rows], "id string, status string, claim_count int, started string, claimed_by string")
    jobs_in = df.select("id", "status", "claim_count", F.col("started").cast("timestamp").alias("started_at"), "claimed_by", F.lit("2026-01-01").cast("timestamp").alias("created_at"))
    return jobs.created(jobs_in)


def test_captures(spark, tmp_path):
    from quillwatch.sources import captures

    entry = lambda page, url: {"pageref": page, "request": {"method": "GET", "url": url}}
    (tmp_path / "a.har").write_text(json.dumps({"log": {"pages": [{"id": "p1", "title": PAGE}, {"id": "p2", "title": "Home"}], "entries": [entry("p1", PAGE), entry("p2", "https://o.org/"), entry("p1", "https://js.driftt.com/x")]}}, indent=1))
    (tmp_path / "b.har").write_text("no archive")
    (tmp_path / "c.har").write_text(json.dumps({"log": {"entries": [{"request": {"url": "https://x.net/"}}, {"request": None}]}}))
    rows = captures.read_captures(spark, str(tmp_path)).collect()
    assert {(r["page_url"], r["seq"], r["url"]) for r in rows} == {(PAGE, 0, PAGE), (PAGE, 2, "https://js.driftt.com/x"), ("https://o.org/", 1, "https://o.org/"), ("https://x.net/", 0, "https://x.net/")}
    assert len({r["page_id"] for r in rows}) == 3
    assert [r["name"] for r in trackers.detect_trackers(captures.read_captures(spark, str(tmp_path))).collect()] == ["Drift"]


def test_life_cycle(spark):
    log = queue(spark, *[(f"j{k}", "pending", 0, None, None) for k in range(10)])
    claims = jobs.claim(jobs.fold(log), ["a", "b", "c"], t0(), per_worker=4)
    got = claims.collect()
    assert len({r["job_id"] for r in got}) == 10 and {r["claimed_by"] for r in got} == {"a", "b", "c"}
    log = log.union(claims)
    state = jobs.fold(log)
    assert jobs.claim(state, ["a"], t0()).count() == 0 and jobs.claim(state, ["a"], t0(), 1, {"a": 1}).count() == 0
    log = log.union(jobs.complete(state.filter("job_id = 'j0'"), t0(), F.lit("{}")))
    log = log.union(jobs.settle_errors(state.filter("job_id = 'j1'"), t0(), F.repeat(F.lit("e"), 3000)))
    rows = {r["job_id"]: r for r in jobs.fold(log).collect()}
    assert rows["j0"]["status"] == "complete" and rows["j1"]["status"] == "pending" and rows["j1"]["claim_count"] == 1 and len(rows["j1"]["error"]) == 2000 and rows["j1"]["claimed_by"] is None


def test_reaping(spark):
    log = queue(spark, ("old1", "running", 1, "2026-01-01 00:00:00", "a"), ("old3", "running", 3, "2026-01-01 00:00:00", "a"), ("edge", "running", 1, "2026-01-01 00:07:00", "a"), ("new", "running", 1, "2026-01-01 00:09:00", "a"), ("done", "complete", 1, "2026-01-01 00:00:00", "a"))
    got = {r["job_id"]: (r["status"], r["claimed_by"]) for r in jobs.reap(jobs.fold(log), t0()).collect()}
    assert got == {"old1": ("pending", None), "old3": ("failed", "a")}


def test_late_writers_are_fenced_whatever_the_order(spark):
    log = queue(spark, ("a", "running", 1, "2026-01-01 00:00:00", "w"))
    reaped = jobs.reap(jobs.fold(log), t0())
    for delay in (0, 1):  # at the same time and later
        late = jobs.complete(jobs.fold(log), t0() + F.make_dt_interval(secs=F.lit(delay)), F.lit("{}"))
        rows = [log, reaped, late]
        for order in ((0, 1, 2), (2, 1, 0), (1, 2, 0)):
            events = rows[order[0]].union(rows[order[1]]).union(rows[order[2]])
            state = jobs.fold(events).collect()
            assert [(r["status"], r["version"], r["result"]) for r in state] == [("pending", 1, None)]
            assert {(r["kind"], r["fenced"]) for r in jobs.fenced(events).collect()} == {("created", False), ("reaped", False), ("completed", True)}
            short = jobs.compacted(events)
            assert short.count() == 2 and jobs.fold(short).collect() == state


def test_the_log_is_compacted(spark, tmp_path):
    log = streams.JobLog(spark, str(tmp_path / "log"))
    assert log.state().count() == 0
    log.append(queue(spark, *[(f"j{k}", "pending", 0, None, None) for k in range(4)]), f"{streams.batch_name(0)}-1-created")
    log.append(jobs.claim(log.state(), ["a"], t0(), 2), f"{streams.batch_name(0)}-3-claimed")
    before = sorted(log.state().collect())
    log.compact(streams.batch_name(0))
    assert sorted(log.state().collect()) == before and log.events().count() == 6
    log.append(jobs.complete(log.state().filter("claimed_by = 'a'"), t0(), F.lit("{}")), f"{streams.batch_name(1)}-1-done")
    log.compact(streams.batch_name(1))
    assert sorted(p.name for p in (tmp_path / "log").iterdir()) == ["snapshot=000000000001"]
    assert sorted(r["status"] for r in log.state().collect()) == ["complete", "complete", "pending", "pending"]


def test_the_clock_reaps_without_inserts(spark, tmp_path):
    import time

    log = streams.JobLog(spark, str(tmp_path / "log"))
    log.append(queue(spark, ("old", "running", 1, "2026-01-01 00:00:00", "gone")), "0-seed")
    (tmp_path / "in").mkdir()
    inserts = streams.pending_inserts(spark, str(tmp_path / "in"), "id string, status string, created_at timestamp")
    assert streams.run_queue(inserts, log, ["a"], lambda n: t0(), str(tmp_path / "off"), period_s=1, enabled=False) is None
    claiming = [True]
    query = streams.run_queue(inserts, log, ["a"], lambda n: t0(), str(tmp_path / "cp"), period_s=1, claiming=lambda: claiming[0])
    until = time.monotonic() + 60
    while time.monotonic() < until and not any(r["claimed_by"] == "a" for r in log.state().collect()):
        time.sleep(1)
    done = streams.shut_down(lambda: log.state().filter("status = 'running'").count(), lambda: claiming.__setitem__(0, False), query, grace_s=1)
    assert [(r["status"], r["claimed_by"], r["claim_count"]) for r in log.state().collect()] == [("running", "a", 2)]
    assert (done.outcome, done.in_flight, done.drained) == ("timeout", 1, 0) and not query.isActive
    assert done.steps == ["jobs counted", "health closed", "claiming stopped", "drain timeout", "stream stopped"]


def test_shutdown_goes_on_after_a_failure():
    left, said = iter([2, 1, 0]), []
    done = streams.shut_down(lambda: next(left), lambda: None, close_health=lambda: 1 / 0, grace_s=5, every_s=0.01, log=said.append)
    assert (done.outcome, done.drained) == ("done", 2) and done.steps[1] == "health closed failed" and said == ["shutdown: health closed failed: ZeroDivisionError"]


def test_health_endpoint():
    import urllib.error
    import urllib.request

    state = {"provider": "disabled", "workerId": "w", "activeJobs": 2, "version": "1", "shuttingDown": False}
    server = telemetry.HealthServer(lambda: state, port=0, host="127.0.0.1")
    get = lambda path: urllib.request.urlopen(f"http://127.0.0.1:{server.port}{path}", timeout=5)
    try:
        answer = json.load(get("/healthz"))
        assert list(answer) == ["status", "provider", "workerId", "activeJobs", "uptimeMs", "version", "shuttingDown"] and (answer["status"], answer["activeJobs"]) == ("ok", 2)
        with pytest.raises(urllib.error.HTTPError) as e:
            get("/other")
        assert e.value.code == 404
        state["shuttingDown"] = True
        with pytest.raises(urllib.error.HTTPError) as e:
            get("/healthz")
        assert e.value.code == 503 and json.load(e.value)["status"] == "shutting_down"
    finally:
        server.close()


def test_events_are_cut_by_the_sink(spark):
    line = telemetry.event_json("scan_failed", t0(), error=F.repeat(F.lit('x"'), 1500), n=F.lit(10**9), list=F.array(F.lit("y")), ts=F.lit("own"))
    event = json.loads(spark.range(1).select(line).first()[0])
    assert event == {"event": "scan_failed", "ts": "own", "error": 'x"' * 250 + "…", "n": 10**9, "list": ["y"]}


def test_events(spark, tmp_path):
    line = telemetry.event_json("scan_failed", t0(), jobId=F.lit("1"), error=telemetry.short(F.repeat(F.lit("x"), 900)), claimCount=F.lit(1), willRetry=F.lit(True), none=F.lit(None).cast("string"))
    df = spark.range(1).select(line.alias("line"))
    event = json.loads(df.first()["line"])
    assert list(event)[:2] == ["event", "ts"] and event["ts"] == "2026-01-01T00:10:00.000Z" and len(event["error"]) == 501 and event["none"] is None
    telemetry.write_events(df, str(tmp_path / "events"))
    assert spark.read.text(str(tmp_path / "events")).count() == 1


def test_insert_stream_claims_each_job_once(spark, tmp_path):
    schema = "id string, status string, created_at timestamp"
    source, path = str(tmp_path / "in"), str(tmp_path / "log")
    for part in range(2):
        rows = spark.range(part * 6, part * 6 + 6).select(F.concat(F.lit("j"), "id").alias("id"), F.when(F.col("id") % 3 == 2, "complete").otherwise("pending").alias("status"), F.lit("2026-01-01").cast("timestamp").alias("created_at"))
        rows.coalesce(1).write.mode("append").parquet(source)
    log = streams.JobLog(spark, path)
    for _ in range(2):  # a second run finds nothing new
        streams.run_queue(streams.pending_inserts(spark, source, schema, max_files=1), log, ["a", "b"], lambda n: t0(), str(tmp_path / "cp"), concurrency=2).awaitTermination()
    state = log.state().collect()
    assert len(state) == 8 and sum(r["status"] == "running" for r in state) == 4 and {r["claimed_by"] for r in state} == {"a", "b", None}


def test_event_windows(spark, tmp_path, small):
    events = spark.read.parquet(f"{small}/events.parquet")
    events.select("ts", "event_type").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(str(tmp_path / "e"))
    query = streams.event_counts(stream).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.sql("SELECT sum(n) FROM windows").first()[0] == events.count()
