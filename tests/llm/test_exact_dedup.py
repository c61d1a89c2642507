"""Exact deduplication against plain Python, and quotient filters against counting."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillwatch.llm import exact_dedup, queries
from quillwatch.llm.exact_dedup import QuotientFilter


def brute(rows):
    """rows: (id, text), in any order; (keep_id, size, kept, sha) of each."""
    plain = [re.sub("[\x20\x09-\x0d]+", " ", t or "") for _, t in rows]
    ids = defaultdict(list)
    for (i, _), t in zip(rows, plain):
        ids[t].append(i)
    out = []
    for (i, _), t in zip(rows, plain):
        least = min((x for x in ids[t] if x is not None), default=None)
        out.append((least, len(ids[t]), i == least, hashlib.sha256(t.encode()).hexdigest()))
    return out


def check(spark, rows, **options):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k long, doc_id long, text string").repartition(7)
    out = exact_dedup.mark_duplicates(df, **options)
    assert out.columns == ["k", "doc_id", "text", *exact_dedup.OUTPUTS]
    got = {r["k"]: tuple(r[c] for c in exact_dedup.OUTPUTS) for r in out.collect()}
    assert [got[k] for k in range(len(rows))] == brute(rows)


ODD = [(1, None), (2, ""), (3, " "), (4, "\t\n  "), (5, "a b"), (6, "a\n\nb"), (7, "a  b"), (8, " a b"), (9, "a b"), (9, "a b"), (None, "a b"), (None, "n"), (None, "n"), (None, "alone"), (10, "alone again"), (11, "x" * 300_000), (12, "x" * 300_000), (13, "x" * 299_999 + "y"), (14, "A b"), (15, "é b")]


@pytest.mark.parametrize("options", [{}, {"rows_a_block": 3}, {"broadcast_fingerprints": 0}])
def test_odd_rows_in_any_way(spark, options):
    check(spark, ODD, **options)


def test_many_copies_of_few_texts(spark):
    rng = random.Random(2)
    check(spark, [(k, rng.choice(["hot text", "hot  text", f"t {rng.randint(0, 300)}"])) for k in rng.sample(range(9_000), 4_000)], rows_a_block=100)


def test_equal_fingerprints_of_different_texts_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda c: exact_dedup.F.lit(7).cast("long"))
    check(spark, ODD)


def test_query_on_whole_tables(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op12_exact_dedup(spark, sf).collect()}
    assert [got[i] for i, _ in rows] == brute(rows) and any(not g[2] for g in got.values())


def test_filters_hold_and_merge_what_they_count():
    rng = np.random.default_rng(4)
    for block_bits in (0, 1, 5, 20):
        parts, total = [], Counter()
        for size in (1, 2, 3, 100, 5_000):
            every = rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            every = np.concatenate([every, every[: size // 2], np.full(size // 3, every[0]), np.array([0, 2**64 - 1], np.uint64)])
            if block_bits:
                every = every >> np.uint64(block_bits) | np.uint64(1) << np.uint64(64 - block_bits)
            parts.append(QuotientFilter.of(every))
            total.update(every.tolist())
        again = [QuotientFilter.unpack(1 if block_bits else 0, block_bits, p.pack(block_bits)) for p in parts]
        for p, q in zip(parts, again):
            assert (p.fingerprints == q.fingerprints).all() and (p.counts == q.counts).all()
        whole = QuotientFilter.merged(again)
        assert dict(zip(whole.fingerprints.tolist(), whole.counts.tolist())) == total and (np.diff(whole.fingerprints.astype(object)) > 0).all()


def test_a_task_writes_several_filters_when_it_is_full(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(exact_dedup, "TASK_ROWS", 4)
    batches = [pa.RecordBatch.from_arrays([pa.array([1, 1, -5]), ], names=["f"])] * 3
    out = list(exact_dedup._build(1)(iter(batches)))
    assert [b.column(0).to_pylist() for b in out] == [[0, 1], [0, 1]]
    merged = exact_dedup._merge(1)(pa.Table.from_batches(out).filter(pa.compute.equal(pa.Table.from_batches(out)["block"], 1)))
    assert merged.to_pylist() == [{"fingerprint": -5, "n": 3}]


def test_rows_that_stay_names_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b", "p", 5), (2, "a  b", "q", 6), (3, None, "r", 7)], "`doc.id` long, text string, kept string, `c0` int")
    assert sorted(exact_dedup.drop_duplicates(df, "doc.id").collect()) == sorted(df.filter("`doc.id` <> 2").collect())
    marked = exact_dedup.mark_duplicates(df, "doc.id")
    assert marked.columns == ["doc.id", "text", "c0", *exact_dedup.OUTPUTS]
    assert exact_dedup.mark_duplicates(df.limit(0), "doc.id").count() == 0
