"""The thin queries over whole tables, and SQL that gives the same rows where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontaminate, exact_dedup, licenses, line_dedup, minhash, pieces, quality_knn, quality_rules, repeats, resampling, sharding, url_filters
from .oracles import ORACLES  # noqa: F401  the driver reads them here


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's near-duplicate component."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's slot and shard among 256 shards."""
    shards = [f"shard-{k:04d}" for k in range(256)]
    return sharding.assign_shards(_table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], shards).select("doc_id", "slot", "shard", "shard_name")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score, learnt from three of four folds of the labels."""
    return quality_knn.score_quality(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.apply_quality_rules(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", *quality_rules.FEATURES, "base_failed", "kept")


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes that belong to a repeated 400-byte string."""
    out = repeats.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), (F.col("n_removed") > 0).alias("changed"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words that lie inside a window of a benchmark item, and the items."""
    out = decontaminate.find_contamination(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path and verdict."""
    out = url_filters.judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url"))
    return out.select("page_id", "host", "path", "rule", "verdict", "template", "purity")


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's license sentences and licenses."""
    out = licenses.scan_licenses(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "license_sentences", "licenses", "license", "permissive")


def model_path() -> str:
    """Where the tokenizer's file lies on every machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's SentencePiece ids and their decoding, as digests."""
    ids = pieces.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), model_path()).drop("text")
    ids = ids.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"))
    out = pieces.decode(ids, model_path(), keep=("doc_id", "n_tokens", "ids_sha256"))
    return out.select("doc_id", "n_tokens", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of boilerplate lines, and its text without them as a digest."""
    out = line_dedup.drop_boilerplate(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "n_lines_dropped", F.length("text").cast("long").alias("n_chars_kept"), F.md5(F.col("text").cast("binary")).alias("kept_md5"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's groups and links between the tokens of two tokenizers."""
    import public_tokenizers

    out = alignment.align(_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), model_path(), digest=True)
    return out.documents.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's group of equal texts."""
    out = exact_dedup.mark_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards the benchmark's distribution, its score, and its rank if it is drawn."""
    weighed = resampling.weigh(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return resampling.draw(weighed.drop("text")).select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {f.__name__: f for f in (op1_minhash, op2_sharding, op3_quality, op4_quality_rules, op5_repeats, op6_decontamination, op7_url_filters, op8_license_scans, op9_pieces, op10_line_dedup, op11_alignment, op12_exact_dedup, op13_resampling)}
