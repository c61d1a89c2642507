"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is written as Parquet in the
cluster's shared folder and reread as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwatch.llm import decontaminate, line_dedup, minhash, pieces, quality_rules
from quillwatch.llm.names import quoted
from quillwatch.llm.queries import model_path
from quillwatch.llm.storage import Scratch

#: Near-duplicates agree in so many hundredths of their five-word shingles.
PERCENT = 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or their host's verdict reject go.

    Null and empty texts have no words and go; a null source is a source of its own; repeated rows are judged each by
    itself and count each; an empty table stays empty.
    """
    return quality_rules.drop_rejected(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's boilerplate lines go; n_chars follows the text. Every document stays.

    Null texts stay null and count as documents without lines; a text may become empty; repeated rows count each; a
    line at the ratio itself, not above it, stays.
    """
    out = line_dedup.drop_boilerplate(docs)
    n_chars = F.when(F.col("n_lines_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", n_chars).select(*[quoted(c) for c in docs.columns])


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group, by similarities of 0.8 or more, the document with the least id stays.

    Ids go, not rows: all rows of a kept id stay, and all rows with a null id, copies or not. Null and empty texts are
    near nothing.
    """
    return minhash.drop_near_duplicates(docs, percent=PERCENT)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark windows in a twentieth of their words or more go.

    Null and empty texts hold none and stay; repeated rows are judged alike.
    """
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, its decoding, and whether it round-trips. Null texts are read as empty; repeated rows stay."""
    ids = pieces.encode(docs, model_path())
    out = pieces.decode(ids, model_path(), text="decoded")
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"), (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("round_trips"))


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("near-dedup", near_dup_stage),
    ("decontamination", decontamination_stage),
    ("pieces", pieces_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over the documents table."""
    docs, scratch, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark), None
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
        if last is not None:
            scratch.drop(last)
        last = docs
    return docs


#: Near-duplicate components and SentencePiece ids are beyond SQL; tests/llm holds run() against plain Python.
ORACLE_SQL = None
