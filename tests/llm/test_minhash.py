"""Near-duplicate components against all pairs in plain Python."""

import random
import re

import numpy as np
import pytest

from quillwatch.llm import minhash, queries
from quillwatch.llm.storage import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows, percent=85):
    """rows: (id, text), distinct ids. -> id: (set size, component, kept)"""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    tested = set()
    for group in holders.values():
        for a in group:
            for b in group:
                if a < b and (a, b) not in tested:
                    tested.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                        x, y = find(a), find(b)
                        parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def got(df):
    return {r["doc_id"]: tuple(r)[1:] for r in df.collect()}


def test_query_on_whole_tables(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows)
    assert sum(not v[2] for v in want.values()) > 50
    assert got(queries.op1_minhash(spark, sf)) == want


@pytest.fixture(scope="module")
def chains():
    """Groups in which only neighbours are alike, a hub whose copies differ from each other, and short texts."""
    rng, rows = random.Random(3), []
    base = [f"b{k}" for k in range(200)]
    for k in range(40):  # a chain: each differs from the last in a few words
        rows.append(" ".join(base))
        at = (k * 5) % 200
        base = [*base[:at], f"c{k}", *base[at + 1 :]]
    hub = [f"h{k}" for k in range(120)]
    for k in range(60):
        copy = list(hub)
        for at in rng.sample(range(120), rng.randint(1, 2)):
            copy[at] = f"x{k}"
        rows.append(" ".join(copy))
    rows += [" ".join(hub), " ".join(hub).upper(), "one two three", "One  two\nthree", "one two four", "a", "A", "", " \n", None]
    for n in range(5, 14):
        rows += [" ".join(f"s{j}" for j in range(n)), " ".join(f"s{j}" for j in range(n + 1))]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_chains_hubs_and_short_texts(spark, chains):
    df = spark.createDataFrame([(*r, "x") for r in chains], "doc_id long, text string, kept string")
    want = brute(chains)
    assert len({v[1] for v in want.values()}) < len(want) - 60
    assert got(minhash.near_duplicates(df)) == want
    kept = minhash.drop_near_duplicates(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i, v in want.items() if v[2]}


def test_null_and_repeated_ids_and_empty_table(spark):
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    df = spark.createDataFrame([(None, a), (None, a), (3, a), (5, a), (5, b), (7, b), (7, b), (9, "x")], "doc_id long, text string")
    rows = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in minhash.near_duplicates(df).collect())
    assert rows == [(0, 0, True), (0, 0, True), (3, 3, True), (5, 3, False), (5, 3, False), (7, 3, False), (7, 3, False), (9, 9, True)]
    near = [(20, a + " x")] * 40 + [(21, a + " y")] * 40
    out = minhash.near_duplicates(df.union(spark.createDataFrame(near, df.schema))).filter("doc_id >= 20").groupBy("doc_id", "component_id", "kept").count().collect()
    assert sorted(map(tuple, out)) == [(20, 3, False, 40), (21, 3, False, 40)]
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_densified_signatures_agree_as_often_as_sets_do():
    rng = np.random.default_rng(1)
    for size in (1, 2, 7, 40, 500):
        rates = []
        for _ in range(200):
            a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
            b = np.unique(np.append(a[: max(1, int(0.9 * size))], rng.integers(0, 2**64, size - max(1, int(0.9 * size)), dtype=np.uint64)))
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            rates.append((minhash.signature(a) == minhash.signature(b)).mean() - true)
        assert abs(np.mean(rates)) < 0.03


def test_components(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 90), (100, 95), (300, 300)]
    out = {r["id"]: r["root"] for r in minhash.components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark)).collect()}
    assert out == {k: 0 for k in range(61)} | {90: 90, 95: 90, 100: 90}


def _linked(a, b):
    both = len(np.intersect1d(a, b))
    return 100 * both >= 85 * (len(a) + len(b) - both)


def test_redealt_buckets_lose_no_link(spark):
    """Any two linked sets that the centre doesn't connect meet in a bucket."""
    rng, groups, rows = np.random.default_rng(8), [], []
    for g in range(300):
        base = rng.choice(2**60, 60, replace=False).astype(np.uint64)
        pool = rng.choice(2**60, 12, replace=False).astype(np.uint64)
        sets = []
        for _ in range(14):
            keep = base[rng.random(60) > rng.choice([0.02, 0.08, 0.15])][: rng.integers(40, 61)]
            sets.append(np.unique(np.concatenate([keep, pool[rng.random(12) < rng.choice([0.1, 0.4, 0.8])]])))
        groups.append(sets)
        for i in range(1, 14):
            both, more = minhash.held_against(sets[0], sets[i])
            rows.append((g * 14, g * 14 + i, len(sets[0]), len(sets[i]), g * 14, g * 14 if _linked(sets[0], sets[i]) else g * 14 + i, True, False, min(map(len, sets)), _linked(sets[0], sets[i]), both, more.view(np.int64).tolist()))
    schema = "u long, v long, n_u long, n long, own_u long, own long, main boolean, also boolean, low long, linked boolean, both long, more array<long>"
    buckets = {}
    for r in minhash.redeal(spark.createDataFrame(rows, schema), Scratch(spark), 85)[0].collect():
        buckets.setdefault(r["bucket"], set()).add(r["id"])
    met = {(a, b) for members in buckets.values() for a in members for b in members}
    seen = 0
    for g, sets in enumerate(groups):
        for i in range(1, 14):
            for j in range(1, i):
                if _linked(sets[i], sets[j]) and not (_linked(sets[0], sets[i]) and _linked(sets[0], sets[j])):
                    seen += 1
                    assert (g * 14 + i, g * 14 + j) in met, (g, i, j)
    assert seen > 500


def near_copies(n, words=150, seed=5):
    """Copies of one text with 1 to 4 of its words changed, many of which are linked to few others."""
    rng, base = random.Random(seed), [f"g{k}" for k in range(words)]
    rows = []
    for i in range(n):
        copy = list(base)
        for at in rng.sample(range(words), rng.randint(1, 4)):
            copy[at] = f"y{i}_{at}"
        rows.append((i, " ".join(copy)))
    return rows


def test_large_buckets_are_dealt_anew(spark, chains, monkeypatch):
    monkeypatch.setattr(minhash, "MORE", 2)
    rng, rows = random.Random(9), [t for _, t in chains]
    hub = [f"g{k}" for k in range(100)]
    for k in range(60):
        copy = list(hub)
        for at in rng.sample(range(100), rng.randint(1, 6)):
            copy[at] = f"y{rng.randint(0, 3)}"
        rows.append(" ".join(copy))
    rows = list(enumerate(rows))
    assert got(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_pairs_are_bounded_by_members_not_their_square(spark, monkeypatch):
    made, plain = [], minhash.confirm
    monkeypatch.setattr(minhash, "confirm", lambda pairs, *rest: (made.append(pairs.count()), plain(pairs, *rest))[1])
    rows = near_copies(200)
    assert got(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
    made.clear()
    minhash.near_duplicates(spark.createDataFrame(near_copies(1600), "doc_id long, text string"))
    assert sum(made) < 2 * minhash.MOST_CENTRES * 1600 < 1600 * 1599 / 6, made


def test_very_long_texts(spark):
    rng = random.Random(4)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(120_000)]
    other = [w if rng.random() > 0.01 else "new" for w in words]
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words[:60_000])), (4, "w " * 200_000), (5, "w " * 300_000)]
    assert got(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
