"""Archives as a table and as a stream."""

import json

from quillwatch.operators import trackers
from quillwatch.sources import captures


def archive(path, *entries, pages=()):
    path.write_text(json.dumps({"log": {"pages": [{"id": i, "title": t} for i, t in pages], "entries": [{"pageref": ref, "request": {"url": u}} for ref, u in entries]}}))


def rows(df):
    return sorted((r["page_id"], r["page_url"], r["seq"], r["url"]) for r in df.collect())


def test_a_stream_gives_the_rows_of_the_table_also_after_a_restart(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()

    def read():
        stream = captures.stream_captures(spark, str(source), max_files=1)
        write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{tmp_path}/out/n={n}")
        stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        return rows(spark.read.parquet(f"{tmp_path}/out"))

    archive(source / "a.har", ("p", "https://a.org/"), ("q", "https://js.driftt.com/x"), (None, "https://b.org/"), ("p", None), ("p", "https://c.org/"), pages=(("p", "https://title.org/"), ("q", "no address")))
    archive(source / "b.har", (None, None), (None, "https://d.org/1"), (None, "https://d.org/2"))
    (source / "c.har").write_text("no archive")
    first = read()
    assert first == rows(captures.read_captures(spark, str(source))) and len(first) == 6
    assert {(u, s) for _, u, s, _ in first} == {("https://title.org/", 0), ("https://js.driftt.com/x", 1), ("https://b.org/", 2), ("https://title.org/", 4), ("https://d.org/1", 1), ("https://d.org/1", 2)}
    archive(source / "d.har", ("x", "https://e.org/"))
    again = read()
    assert again == rows(captures.read_captures(spark, str(source))) and len(again) == 7
    assert [r["name"] for r in trackers.detect_trackers(captures.read_captures(spark, str(source))).collect()] == ["Drift"]
