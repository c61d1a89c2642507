"""Importance resampling against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from quillwatch.llm import queries, resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, longest=1, buckets=10_000, min_words=20, percent=10, seed=2024):
    """(n_features, weight, score, rank) of each of docs (id, text), by position."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    own = [features(t, longest) for _, t in docs]
    s, t = Counter(bucket(f) for _, fs in own for f in fs), Counter(bucket(f) for x in target for f in features(x, longest)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    out = []
    for (i, _), (_, fs) in zip(docs, own):
        weight = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((k for k, (n, _) in enumerate(own) if n >= min_words), key=lambda k: (-out[k][2], docs[k][0] is None, docs[k][0] or 0))
    for rank, k in enumerate(able[: percent * len(able) // 100], 1):
        out[k][3] = rank
    return [tuple(x) for x in out]


def run(spark, docs, target, **options):
    df = spark.createDataFrame([(k, *d) for k, d in enumerate(docs)], "k long, doc_id long, text string").repartition(6)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    how = {c: options.pop(c) for c in ("longest", "buckets") if c in options}
    out = resampling.draw(resampling.weigh(df, aim, **how), **options)
    return [tuple(r)[1:] for r in out.select("k", "n_features", "weight", "score", "rank").orderBy("k").collect()]


def test_query_on_whole_tables(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op13_resampling(spark, sf).collect()}
    want = brute(docs, target)
    assert [got[i] for i, _ in docs] == want and sum(w[3] is not None for w in want) > 50


@pytest.fixture(scope="module")
def cases():
    long = "Alpha beta GAMMA delta. " * 8
    docs = [(1, None), (2, ""), (3, "... \n"), (4, long), (5, long), (6, long.lower()), (7, "word " * 19), (8, "word " * 20), (None, long), (9, "Été été ÉTÉ " * 10), (10, "q " * 100_000), (11, "z9 " * 25), (11, "z9 " * 25), (11, long)]
    return docs + [(100 + k, f"alpha w{k % 7} " * 15) for k in range(60)], [long, None, "", "beta", "Beta!"]


@pytest.mark.parametrize("options", [{}, {"percent": 50, "min_words": 1, "longest": 3, "buckets": 97}, {"percent": 100, "min_words": 0, "seed": 7}, {"percent": 0}, {"longest": 2}])
def test_odd_rows(spark, cases, options):
    docs, target = cases
    got, want = run(spark, docs, target, **options), brute(docs, target, **options)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    alike = lambda rows: sorted((docs[k][0] or 0, r) for k, r in enumerate(rows) if r[3] is not None)  # noqa: E731  equal rows may change places
    assert alike(got) == alike(want)


def test_ranks_are_whole_over_many_partitions(spark):
    docs = [(k, f"w{k % 3} " * 20) for k in range(3_000)]
    assert run(spark, docs, ["w1"], percent=70) == brute(docs, ["w1"], percent=70)


def test_empty_tables_targets_and_names(spark):
    df = spark.createDataFrame([(k, f"a b{k} " * 15, "x", k, "y") for k in range(20)], "`doc.id` long, `te.xt` string, rank string, weight int, key string")
    aim = spark.createDataFrame([], "text string")
    out = resampling.resample(df, aim, "doc.id", "te.xt", percent=25)
    assert out.columns == df.columns and out.count() == 5 and out.exceptAll(df).count() == 0
    weighed = resampling.weigh(df, aim, "te.xt")
    assert weighed.columns == ["doc.id", "te.xt", "rank", "key", "n_words", "n_features", "weight"]
    assert resampling.draw(weighed.limit(0), "doc.id").count() == 0
    assert resampling.weigh(df.limit(0), aim, "te.xt").count() == 0
