"""SentencePiece ids and decoded texts against the library itself."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from quillwatch.llm import pieces, queries

ODD = [None, "", " ", "  ", "a", " a", "a ", "a  b", "   a   ", "\n", "a\nb\n", "\t \t", "▁", "a▁b ▁ c", "é ü ß 漢字 🙂🙂", "a\x00b", "x" * 50_000, "word " * 30_000, "<s> </s> <unk>", "   x"]


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=queries.model_path())


def check(rows, model):
    for r in rows:
        want = model.encode(r["text"] or "")
        assert r["ids"] == want, r["text"][:80]
        assert r["back"] == model.decode(want)


def run(df):
    ids = pieces.encode(df, queries.model_path())
    return pieces.decode(ids, queries.model_path(), text="back").collect()


def test_whole_documents_and_odd_texts(spark, small, model):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    check(run(docs.union(spark.createDataFrame([(None, t) for t in ODD], docs.schema))), model)


def test_random_texts(spark, model):
    rng = random.Random(5)
    alphabet = "  ab▁\n.é漢\x00🙂THE the"
    texts = [("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))),) for _ in range(3000)]
    check(run(spark.createDataFrame(texts, "text string")), model)


def test_a_full_table_starts_anew(model, monkeypatch):
    table, back = pieces.ChunkTable(queries.model_path()), pieces.PieceTexts(queries.model_path())
    monkeypatch.setattr(pieces, "TABLE_ENTRIES", 3)
    for text in ("a b c a", "c d e f g h", "a", "", "x  y"):
        ids, sizes = pieces._encode_block([text, "", "a b"], table)
        assert ids.tolist() == model.encode(text) + model.encode("a b") and sizes.tolist() == [len(model.encode(text)), 0, 2]
        assert back.decode([np.array(model.encode(text), np.int32), np.empty(0, np.int32)]) == [text, ""]


def test_any_ids_decode_as_the_library_decodes_them(spark, model):
    rng = random.Random(6)
    rows = [[rng.randrange(300) if rng.random() < 0.3 else rng.randrange(model.get_piece_size()) for _ in range(rng.randint(0, 12))] for _ in range(2000)]
    rows += [[0], [1, 2], [0, 0, 300], [model.piece_to_id("▁")] * 3]
    df = spark.createDataFrame([(r, k, "x") for k, r in enumerate(rows)] + [(None, -1, "x")], "_ids array<int>, k int, text string")
    for r in pieces.decode(df, queries.model_path(), ids="_ids").collect():
        assert r["text"] == model.decode(r["_ids"] or []), r
    assert pieces.decode(df.limit(0), queries.model_path(), ids="_ids").count() == 0


def test_query_and_empty_table(spark, small, model):
    got = {r["doc_id"]: r for r in queries.op9_pieces(spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for d in docs:
        ids = model.encode(d["text"])
        assert tuple(got[d["doc_id"]])[1:] == (len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids)))
    assert pieces.encode(spark.createDataFrame([], "text string, ids string"), queries.model_path()).count() == 0
