"""Repeated byte strings against plain Python."""

import hashlib
import random
from collections import Counter

import pytest

from quillwatch.llm import queries, repeats
from quillwatch.llm.suffixes import SuffixOrder, intervals


def brute(rows, length=400):
    """rows: (id, text) -> list of (id, n_bytes, n_removed, n_spans, kept)"""
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + length] for _, b in data for k in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone, runs, end = 0, 0, -1
        keep = bytearray()
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                if k > end:
                    runs += 1
                    keep += b[max(end, 0) : k]
                gone += k + length - max(end, k)
                end = k + length
        keep += b[max(end, 0) :]
        out.append((i, len(b), gone, runs, bytes(keep)))
    return out


def got(df, **options):
    return sorted((tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans")) + (bytes(r["kept"]),) for r in repeats.remove_repeats(df, **options).collect()), key=str)


def test_query_on_whole_tables(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows)
    assert sum(w[2] > 0 for w in want) > 100
    have = queries.op5_repeats(spark, sf).collect()
    assert {tuple(r) for r in have} == {(*w[:4], hashlib.sha256(w[4]).hexdigest(), w[2] > 0) for w in want}


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    shared = [word(n) for n in (30, 39, 40, 41, 90, 200)]
    rows = [(k, word(rng.randint(0, 60)) + rng.choice(shared) + word(rng.randint(0, 60)) + rng.choice(shared)) for k in range(150)]
    rows += [(500, "a" * 300), (501, "ab" * 100), (502, "a" * 41), (503, None), (504, ""), (None, shared[5]), (None, shared[5]), (505, shared[4]), (505, shared[4]), (505, shared[5] + "x"), (506, "q" + word(3000))]
    rows += [(600 + k, f"{k:03d}" + shared[5] + f"{k:03d}") for k in range(40)]
    return rows


@pytest.mark.parametrize("options", [{}, {"hot_segments": 2}], ids=["arrays", "hot keys"])
def test_odd_texts(spark, odd, options):
    df = spark.createDataFrame([(*r, "x") for r in odd], "doc_id long, text string, kept string")
    assert got(df, length=40, gram=12, piece=1000, **options) == sorted(brute(odd, 40), key=str)


def test_empty_table(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def naive(strings, least):
    found = set()
    subs = {s[a:b] for s in strings for a in range(len(s)) for b in range(a + least, len(s) + 1)}
    for x in subs:
        at = [(i, a) for i, s in enumerate(strings) for a in range(len(s)) if s.startswith(x, a)]
        left = {(i, "start") if a == 0 else strings[i][a - 1] for i, a in at}
        right = {(i, "end") if a + len(x) == len(strings[i]) else strings[i][a + len(x)] for i, a in at}
        if len(at) > 1 and len(left) > 1 and len(right) > 1:
            found.add((len(x), tuple(sorted(at))))
    return found


def test_maximal_repeats_with_all_occurrences():
    rng = random.Random(2)
    for _ in range(60):
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 14))) for _ in range(rng.randint(1, 5))]
        order = SuffixOrder(strings, [len(s) for s in strings])
        have = [(n, tuple(sorted(zip(o.tolist(), a.tolist())))) for n, o, a in order.maximal_repeats(2)]
        assert len(have) == len(set(have)) and set(have) == naive(strings, 2)


def test_copies_of_a_string_are_occurrences():
    rng = random.Random(3)
    for _ in range(60):
        strings = list({bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 4))})
        copies = [rng.randint(1, 3) for _ in strings]
        order = SuffixOrder(strings, [len(s) for s in strings], copies)
        have = sorted((n, sorted(zip(o.tolist(), a.tolist()))) for n, o, a in order.maximal_repeats(2))
        every = [k for k, c in enumerate(copies) for _ in range(c)]
        want = {(n, tuple(sorted({(every[i], a) for i, a in at}))) for n, at in naive([strings[k] for k in every], 2)}
        assert [(n, tuple(at)) for n, at in have] == sorted(want)


def test_a_long_text_repeats_itself_and_others(spark):
    rng = random.Random(12)
    long = "".join(rng.choice("abcdefgh ") for _ in range(700_000))
    rows = [(1, long), (2, "x" + long[300_000:301_000] + "y"), (3, long[:500] + long[600_000:600_399]), (4, None)]
    want = brute(rows)
    assert [w[3] for w in want] == [2, 1, 1, 0]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == want


def test_intervals_come_inner_first():
    assert list(intervals([0, 3, 5, 3, 1, 4], 2)) == [(5, 1, 2), (3, 0, 3), (4, 4, 5)]
