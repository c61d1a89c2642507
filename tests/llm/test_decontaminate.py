"""Benchmark decontamination against plain Python."""

import hashlib
import re

from quillwatch.llm import decontaminate, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    out = {}
    for i, text in docs:
        w, hit, found = words(text), set(), []
        at = {}
        for k in range(len(w)):
            at.setdefault(w[k], []).append(k)
        for item, t in items:
            v = words(t)
            n = min(13, len(v))
            own = {k + j for s in range(len(v) - n + 1 if n else 0) for k in at.get(v[s], []) if w[k : k + n] == v[s : s + n] for j in range(n)}
            hit |= own
            found += [str(item)] if own else []
        out[i] = (len(w), len(hit), len(found), ",".join(sorted(found)), bool(hit) and 20 * len(hit) >= len(w))
    return out


def got(df):
    return {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], ",".join(r["items"]), r["contaminated"]) for r in df.collect()}


def test_query_on_whole_tables(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    want = brute(docs, items)
    assert sum(v[4] for v in want.values()) > 5
    rows = queries.op6_decontamination(spark, sf).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in rows} == {k: (*v[:3], hashlib.sha256(v[3].encode()).hexdigest(), v[4]) for k, v in want.items()}


def test_odd_rows_in_one_slice_and_in_many(spark):
    long = " ".join(f"w{k}" for k in range(40))
    docs = [(1, None), (2, ""), (3, "!!! --"), (4, "x " * 3 + long + " y" * 9), (5, "Short ITEM!"), (6, "short item, short\nitem"), (7, "z " * 400 + "short item"), (8, long.upper()), (9, "été été"), (10, "w5 w6 w7")]
    items = [(1, long), (2, "short item"), (3, None), (4, "..."), (5, "été"), (10, "été"), (None, "zz"), (7, long)]
    docs_df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, items string")
    items_df = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert got(decontaminate.find_contamination(docs_df, items_df)) == want
    assert got(decontaminate.find_contamination(docs_df, items_df, slice_words=20, chunk_words=7)) == want
    assert [r["doc_id"] for r in decontaminate.drop_contaminated(docs_df, items_df).orderBy("doc_id").collect()] == [i for i, v in want.items() if not v[4]]


def test_benchmarks_of_several_slices_and_long_texts(spark):
    import random

    rng = random.Random(7)
    word = lambda: f"v{rng.randint(0, 400)}"
    items = [(k, " ".join(word() for _ in range(rng.choice([3, 20, 200])))) for k in range(30)] + [(99, " ".join(f"u{k}" for k in range(3000)))]
    docs = [(k, " ".join([*(word() for _ in range(50)), *items[k % 31][1].split()[:30], *(word() for _ in range(50))])) for k in range(60)]
    docs += [(100, " ".join(f"u{k}" for k in range(1000, 1200))), (101, "q " * 300_000 + items[1][1])]
    want = brute(docs, items)
    assert sum(v[1] > 0 for v in want.values()) > 40
    docs_df, items_df = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert got(decontaminate.find_contamination(docs_df, items_df, slice_words=1500, chunk_words=400)) == want
    assert got(decontaminate.find_contamination(docs_df, items_df)) == want


def test_any_column_names(spark):
    docs = spark.createDataFrame([(1, "a b c", 5, 6, "k"), (2, "short item", 7, 8, "l")], "doc_id long, text string, _hits int, _words int, contaminated string")
    items = spark.createDataFrame([(1, "short item")], "item_id long, text string")
    assert decontaminate.drop_contaminated(docs, items).collect() == docs.filter("doc_id = 1").collect()
    assert [(r["_hits"], r["_words"], r["n_hit"]) for r in decontaminate.find_contamination(docs, items).orderBy("doc_id").collect()] == [(5, 6, 0), (7, 8, 2)]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert got(decontaminate.find_contamination(docs, none)) == {1: (2, 0, 0, "", False)}
    assert decontaminate.find_contamination(docs.limit(0), none).count() == 0
