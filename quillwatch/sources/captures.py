"""Captured request logs: folders of HTTP archive (HAR) files, as any browser exports them.

Spark's own JSON reader takes them from any store, one file a row, so a capture is read where it lies. Files that are
no archive give no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The parts of the archive format that are read.
HAR_SCHEMA = "log struct<pages:array<struct<id:string,title:string>>,entries:array<struct<pageref:string,request:struct<url:string,method:string>>>>"


def requests_of(archives: DataFrame, file: str = "file") -> DataFrame:
    """Rows (page_id, page_url, seq, url) of archives (file, log): a page's requests in order of capture.

    A page goes by its file and reference; its address is its title where that is one, else its first request's.
    """
    named = archives.select(file, F.coalesce("log.pages", F.array().cast("array<struct<id:string,title:string>>")).alias("pages"), F.transform("log.entries", lambda e: F.struct(F.coalesce(e["pageref"], F.lit("")).alias("ref"), e["request"]["url"].alias("url"))).alias("entries"))
    asked = F.filter("entries", lambda e: e["url"].isNotNull())
    # each page's first request, once an archive, so that rows need no grouping and streams no state
    firsts = F.map_from_entries(F.transform(F.array_distinct(F.transform(asked, lambda e: e["ref"])), lambda ref: F.struct(ref, F.get(F.filter(asked, lambda e: e["ref"] == ref), F.lit(0))["url"])))
    entry = named.withColumn("firsts", firsts).select(file, "pages", "firsts", F.posexplode("entries").alias("seq", "entry")).filter("entry.url is not null")
    title = F.get(F.filter("pages", lambda p: p["id"] == F.col("entry.ref")), F.lit(0))["title"]
    address = F.when(title.rlike("(?i)^https?://"), title).otherwise(F.element_at("firsts", F.col("entry.ref")))
    return entry.select(F.xxhash64(file, F.col("entry.ref")).alias("page_id"), address.alias("page_url"), F.col("seq").cast("long").alias("seq"), F.col("entry.url").alias("url"))


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """requests_of all archives in a folder."""
    archives = spark.read.schema(HAR_SCHEMA).option("multiLine", True).json(path)
    return requests_of(archives.select(F.input_file_name().alias("file"), "log").filter("log is not null"))


def stream_captures(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """The same rows as a stream of the archives that come into a folder; its checkpoint knows which were read."""
    archives = spark.readStream.schema(HAR_SCHEMA).option("multiLine", True).option("maxFilesPerTrigger", max_files).json(path)
    return requests_of(archives.select(F.input_file_name().alias("file"), "log").filter("log is not null"))
