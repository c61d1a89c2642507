"""Scratch tables in the folder that the cluster shares (``spark.checkpoint.dir``)."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..sources.storage import shared_folder


#: Rows (tens to hundreds of bytes each) that one task reads where that saves shuffles.
FEW_ROWS = 20_000


class Scratch:
    """Tables written once and reread: lineage ends there, and a lost executor costs no recomputation."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(self.drop)

    def keep(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._scratch_path = path
        return kept

    def settle(self, df: DataFrame, few: int = FEW_ROWS) -> tuple[DataFrame, int]:
        """keep(df) and its number of rows; a table of few rows is read in one partition, and so isn't shuffled again."""
        kept = self.keep(df)
        n = kept.count()
        out = kept.coalesce(1) if n <= few else kept
        out._scratch_path = kept._scratch_path
        return out, n

    def drop(self, table: DataFrame | None = None) -> None:
        """Deletes one table, or the whole folder; the tables that a result still reads stay until the session ends."""
        path = self.root if table is None else table._scratch_path
        try:
            jvm = self.spark._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # at exit the session may be gone; the cluster's own cleaning then applies
            if table is not None:
                raise
