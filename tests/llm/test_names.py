"""Columns of any name, and what operators leave behind."""

from pathlib import Path

import corpus_pipeline
import pytest

from quillwatch.llm import decontaminate, minhash, pieces, quality_rules, queries, sharding
from quillwatch.sources.storage import shared_folder

TEXT = " ".join(f"word{k}" for k in range(80))
ROWS = [(1, TEXT, "x", "a", 1, "en", 5), (2, TEXT + " more", "y", "a", 2, "en", 6), (3, None, None, None, None, None, None), (4, "short item", "z", "b", 4, "de", 7)]
SCHEMA = "doc_id long, text string, `a.b` string, source string, `c``d.e` int, lang string, n_chars long"


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def ids(out):
    return sorted(r["doc_id"] for r in out.collect())


def test_operators_take_dotted_names(spark, df):
    items = spark.createDataFrame([(1, "short item")], "`item.id` long, `te.xt` string")
    kept = minhash.drop_near_duplicates(df)
    assert kept.columns == df.columns and ids(kept) == [1, 3, 4]
    judged = quality_rules.apply_quality_rules(df, carry=("doc_id", "a.b"))
    assert judged.columns[:2] == ["doc_id", "a.b"] and judged.count() == 4
    good = quality_rules.drop_rejected(df)
    assert good.columns == df.columns and ids(good) == [1, 2]
    found = decontaminate.find_contamination(df, items, item_id="item.id", item_text="te.xt")
    assert found.columns[:7] == df.columns and {r["doc_id"]: r["n_hit"] for r in found.collect()} == {1: 0, 2: 0, 3: 0, 4: 2}
    coded = pieces.decode(pieces.encode(df, queries.model_path()), queries.model_path(), text="back")
    assert coded.columns == [*df.columns, "ids", "back"] and all((r["text"] or "") == r["back"] for r in coded.collect())


def test_operators_take_dotted_texts(spark):
    df = spark.createDataFrame([(1, TEXT, "a"), (2, TEXT + " more", "a")], "`doc.id` long, `te.xt` string, `so.urce` string")
    assert minhash.drop_near_duplicates(df, "doc.id", "te.xt").count() == 1
    assert quality_rules.drop_rejected(df, "te.xt", "so.urce").count() == 2 and quality_rules.apply_quality_rules(df, "te.xt", "so.urce", carry=("doc.id",)).count() == 2
    assert quality_rules.count_features(df, "te.xt").columns == [*df.columns, *quality_rules.FEATURES]
    assert decontaminate.drop_contaminated(df, spark.createDataFrame([(1, TEXT)], "item_id long, text string"), "te.xt").count() == 0
    assert pieces.encode(df, queries.model_path(), "te.xt", "i.ds").columns == [*df.columns, "i.ds"]


def test_stages_take_dotted_names(spark, df, sf):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, sf)
        assert out.dtypes == df.dtypes
        out.collect()
    assert corpus_pipeline.STAGES[-1][1](spark, df, sf).count() == 4


def test_a_key_may_be_named_like_an_output(spark):
    keys = [(k, f"s{k}") for k in range(50)]
    plain = sharding.assign_shards(spark.createDataFrame(keys, "k long, t string"), ["k"], ["x", "y", "z"])
    want = {r["k"]: r["shard_name"] for r in plain.collect()}
    for name in ("shard", "slot", "shard_name", "_at", "a.b"):
        out = sharding.assign_shards(spark.createDataFrame(keys, f"`{name}` long, t string"), [name], ["x", "y", "z"])
        assert {r["t"]: r["shard_name"] for r in out.collect()} == {f"s{k}": v for k, v in want.items()}


def test_rows_of_one_item_are_one_item(spark):
    docs = spark.createDataFrame([(1, "short item and late word")], "doc_id long, text string")
    items = spark.createDataFrame([("i1", "short item"), ("i1", "late word"), ("i1", "short item"), (None, "and"), ("i0", "word")], "item_id string, text string")
    for options in ({}, {"slice_words": 2}):
        r = decontaminate.find_contamination(docs, items, **options).first()
        assert (r["n_hit"], r["n_items"], r["items"]) == (5, 3, ["i0", "i1", None])


def test_the_quality_stage_writes_no_texts(spark, sf):
    folder = Path(shared_folder(spark).removeprefix("file://"))
    size = lambda: sum(p.stat().st_size for p in folder.rglob("*.parquet"))
    docs, before = spark.read.parquet(f"{sf}/documents.parquet"), size()
    assert 0 < quality_rules.drop_rejected(docs).count() < docs.count()
    assert size() - before < 100_000
