"""Token groups and links against the libraries on whole texts."""

import hashlib
import json
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quillwatch.llm import alignment, queries

A_PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "   a   ", "\n", "a\nb\n", "\t \t", "▁", "a▁b c", "é ü ß 漢字 🙂🙂", "a\x00b", "x" * 5_000, "<s> </s> <unk> <|endoftext|>", "it's we'll  don't", "a;\r\nb;\r c", "\r\n\r\n x",
    "a b   c d", "a\x1c\x1f b", "​z﻿ q", "a\n\n\n b\n\n  c", "!!!\n???", "foo　bar 　baz", "tab\tsep\t\tx", "İıŞ ǅ ʼn ﬁ Ⅷ ²³ ¼", "\x0b \x0c\x0bq", "a\x85 b c", "é ä", "word " * 3_000,
]


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    with open(A_PATH, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
    a_bytes = {k: bytes(letters[c] for c in t) for t, k in vocabulary.items()}
    b = sentencepiece.SentencePieceProcessor(model_file=queries.model_path())
    b_bytes = {k: bytes([int(b.id_to_piece(k)[1:-1], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in range(b.get_piece_size())}
    return a, a_bytes, b, b_bytes


def brute(texts, tokenizers):
    a, a_bytes, b, b_bytes = tokenizers
    groups, sizes = [], []
    for text in texts:
        ids = [a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)] if text else [[], []]
        whole = [b"".join(t[k] for k in x) for t, x in zip((a_bytes, b_bytes), ids)]
        if not text or any(w != (" " + text).encode() for w in whole):
            ids = [[], []]
        ends = []
        for t, x in zip((a_bytes, b_bytes), ids):
            at, own = 0, {}
            for k in x:
                at += len(t[k])
                own[at] = k
            ends.append(own)
        both = sorted(set(ends[0]) & set(ends[1]))
        own, begin = [], 0
        for end in both:
            own.append(tuple([k for at, k in side.items() if begin < at <= end] for side in ends))
            begin = end
        groups.append(own)
        sizes.append([len(x) for x in ids])
    counts = Counter((x[-1], y[-1]) for own in groups for x, y in own)
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(most.get(y, 0), n)
    out = []
    for own, (n_a, n_b) in zip(groups, sizes):
        links = [(x[-1], y[-1]) for x, y in own]
        shown = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in own)
        out.append((n_a, n_b, len(own), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), shown))
    return out, counts, most


def rows_of(found):
    return [tuple(r)[1:] for r in found.documents.select("k", *alignment.OUTPUTS, "groups").orderBy("k").collect()]


def run(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string").repartition(5)
    return alignment.align(df, A_PATH, queries.model_path(), **options)


def test_query_on_whole_tables(spark, small, tokenizers):
    docs = spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()
    want, _, _ = brute([d["text"] for d in docs], tokenizers)
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    got = queries.op11_alignment(spark, small).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in got] == [d["doc_id"] for d in docs]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest() if s else ""
    assert [tuple(r[n] for n in names) for r in got] == [(*w[:6], sha(w[6])) for w in want]


def test_odd_and_random_texts(spark, tokenizers):
    rng = random.Random(9)
    alphabet = "  ab'st▁\n\n\t\r.;é漢\x00🙂THE the  \x0b\x1c12ß"
    texts = ODD + ["".join(rng.choice(alphabet.replace("▁", "")) for _ in range(rng.randint(0, 30))) for _ in range(1500)] + ["".join(rng.choice(alphabet) for _ in range(12)) for _ in range(100)]
    want, counts, most = brute(texts, tokenizers)
    found = run(spark, texts)
    for got, expected, text in zip(rows_of(found), want, texts):
        assert got == expected, repr(text[:80] if text else text)
    assert {(r["a"], r["b"]): (r["count"], r["best"]) for r in found.pairs.collect()} == {p: (n, n == most[p[1]]) for p, n in counts.items()}
    assert found.groups.agg({"n": "sum"}).first()[0] == sum(w[2] for w in want)


def test_rare_groups_by_a_shuffle_and_tables_that_are_full(spark, small, tokenizers, monkeypatch):
    texts = [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").limit(60).collect()] + ["the same text " * 40] * 30
    want, _, _ = brute(texts, tokenizers)
    assert rows_of(run(spark, texts, broadcast_groups=50)) == want
    assert rows_of(run(spark, texts, broadcast_groups=0)) == want


def test_a_full_table_starts_anew(tokenizers, monkeypatch):
    monkeypatch.setattr(alignment, "TABLE_ENTRIES", 4)
    table = alignment.GroupTable(A_PATH, queries.model_path(), 0)
    texts = ["a b c a", "c d e f g h", "a", "", "x  y"]
    want, _, _ = brute(texts, tokenizers)
    met = Counter()
    for text, w in zip(texts, want):
        if table.full():
            met.update(dict(zip(*table.met()[1:])))
            table.renew()
        counts, groups, _ = table.block([text, "▁"])
        assert (*(c[0] for c in counts), groups[0]) == (*w[:3], w[6]) and groups[1] == "" and counts[0][1] == 0
    met.update(dict(zip(*table.met()[1:])))
    assert met == Counter(g for w in want if w[6] for g in w[6].split(";"))


def test_keys_that_clash_are_made_anew(spark, tokenizers, monkeypatch):
    seeds, plain = [], alignment._encode

    def clashing(rows, text, a, b, seed):
        seeds.append(seed)
        out = plain(rows, text, a, b, seed)
        if seed:
            return out
        return out.withColumn("dictionary", alignment.F.transform("dictionary", lambda d: d.withField("key", d["key"] % 3)))

    monkeypatch.setattr(alignment, "_encode", clashing)
    texts = ["one two three", "two three four", None]
    assert rows_of(run(spark, texts)) == brute(texts, tokenizers)[0] and seeds == [0, 1]


def test_the_fast_library_is_used_only_where_it_is_the_same(tokenizers):
    pair = alignment._Pair(A_PATH, queries.model_path())
    assert pair.fast is not None
    rng = random.Random(3)
    words = [" " + "".join(rng.choice("abcdefghijklmnopqrstuvwxyzäöüßéèñABC0123'-_.,;!?") for _ in range(rng.randint(1, 25))) for _ in range(20_000)]
    assert pair.encode_a(words) == [e.ids for e in tokenizers[0].encode_batch(words, add_special_tokens=False)]


def test_clashing_names_and_empty_tables(spark, tokenizers):
    df = spark.createDataFrame([(1, "a b", "x", 5, "y")], "k long, text string, `a.b` string, n_a int, found string")
    out = alignment.align(df, A_PATH, queries.model_path()).documents
    assert out.columns == ["k", "text", "a.b", "found", *alignment.OUTPUTS, "groups"]
    assert out.first()["a.b"] == "x" and out.first()["n_a"] == 2
    none = alignment.align(df.limit(0), A_PATH, queries.model_path())
    assert none.documents.count() == 0 and none.pairs.count() == 0
