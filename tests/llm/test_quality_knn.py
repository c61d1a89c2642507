"""The neighbour vote: held-out accuracy, exactness of the blocked products, and odd rows."""

import zlib

import numpy as np

from quillwatch.llm import quality_knn, queries


def test_held_out_accuracy_on_whole_tables(spark, sf):
    rows = {r["doc_id"]: r for r in queries.op3_quality(spark, sf).collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
    held = [i for i in labels if rows[i]["held_out"]]
    assert np.mean([rows[i]["predicted"] == labels[i] for i in held]) > 0.95


def test_held_out_labels_change_nothing(spark, small):
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    from pyspark.sql import functions as F

    flipped = labels.withColumn("quality", F.when(quality_knn.is_held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r["doc_id"]: r["score"] for r in quality_knn.score_quality(docs, x).collect()} for x in (labels, flipped))
    assert a == b


def test_vote_against_all_cosines():
    rng = np.random.default_rng(4)
    counts = rng.poisson(0.05, (60, quality_knn.TERMS)).astype(np.float32)
    idf = np.ones(quality_knn.TERMS, np.float32)
    space = rng.standard_normal((quality_knn.TERMS, 8)).astype(np.float32)
    unit = lambda v: v / np.linalg.norm(v)
    latent = [unit(unit(np.sqrt(c)) @ space) for c in counts]
    labels = rng.integers(0, 2, 40).astype(np.float32)
    model = quality_knn.Model(idf, space, np.array(latent[:40], np.float32), labels, 0.5)
    got = quality_knn.vote(model, counts[40:], 5)
    for g, v in zip(got, latent[40:]):
        near = sorted(((float(v @ latent[i]), labels[i]) for i in range(40)), reverse=True)[:5]
        w = [max(c, 0) ** 8 for c, _ in near]
        assert abs(g - (sum(a * y for a, (_, y) in zip(w, near)) + 1e-3 * 0.5) / (sum(w) + 1e-3)) < 1e-3


def test_odd_rows_and_missing_labels(spark):
    docs = spark.createDataFrame([(1, "good words here", "x"), (1, "good words here", "x"), (2, None, "x"), (3, "", "x"), (None, "%% $$ ##", "x"), (5, "w " * 50_000, "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (3, 7), (99, 1), (None, 1)], "doc_id long, quality int")
    for some in (labels, labels.limit(0)):
        rows = quality_knn.score_quality(docs, some).collect()
        assert len(rows) == 6 and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["score"] == 0.5 for r in rows)
    assert quality_knn.score_quality(docs.limit(0), labels).count() == 0


def test_the_sample_is_bounded_and_repeatable(spark):
    labels = spark.range(1000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    a, b = (quality_knn.labelled_sample(x, "doc_id", "quality", 100).collect() for x in (labels, labels.repartition(7)))
    assert len(a) == 100 and a == b


def plain_counts(text):
    """Counts of each term by a plain loop over the words."""
    import re
    from collections import Counter

    import xxhash

    words = (text or "").encode().split()
    counts = Counter()
    ids = []
    for w in words:
        shape = re.sub(rb"(.)\1+", rb"\1", bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in w), flags=re.S)[:8]
        counts[4 + xxhash.xxh3_64_intdigest(shape) % 1024] += 1
        ids.append(1028 + xxhash.xxh3_64_intdigest(w.lower().strip(b".,;:!?()\"'")) % (4096 - 1028))
        counts[ids[-1]] += 1
    counts[0] = 4 * sum(a == b for a, b in zip(ids, ids[1:]))
    triples = list(zip(ids, ids[1:], ids[2:]))
    counts[1] = 2 * (len(triples) - len(set(triples)))
    lines = [x for x in (text or "").encode().split(b"\n") if x.strip()]
    counts[2] = 8 * (len(lines) - len(set(lines)))
    return np.array([counts[k] for k in range(4096)], dtype=float)


def test_query_against_all_cosines(spark, small):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    counts = {i: plain_counts(t) for i, t in docs.items()}
    seen = sum(c > 0 for c in counts.values())
    idf = np.log((1 + len(docs)) / (1 + seen)) + 0.1
    idf[:4] = 2.0
    unit = lambda v: v / n if (n := np.linalg.norm(v)) > 0 else v
    weighted = {i: unit(np.sqrt(c) * idf) for i, c in counts.items()}
    learnt = [i for i in labels if i in docs and zlib.crc32(str(i).encode()) % 4 != 2]
    space = np.linalg.svd(np.stack([weighted[i] for i in learnt]), full_matrices=False)[2][: quality_knn.RANK].T
    latent = {i: unit(w @ space) for i, w in weighted.items()}
    prior = np.mean([labels[i] for i in learnt])
    for r in queries.op3_quality(spark, small).collect():
        near = sorted(((latent[r["doc_id"]] @ latent[i], labels[i]) for i in learnt), reverse=True)[: quality_knn.NEIGHBOURS]
        weights = [max(c, 0) ** 8 for c, _ in near]
        want = (sum(w * y for w, (_, y) in zip(weights, near)) + 1e-3 * prior) / (sum(weights) + 1e-3) if sum(weights) > 0 else prior
        assert abs(r["score"] - want) < 0.05, (r, want)
        assert r["predicted"] == (want >= 0.7) or abs(want - 0.7) < 0.05
