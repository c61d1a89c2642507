"""Tables written once in the folder that the cluster shares, and reread."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where none is set and one machine does all, as in tests, a local folder is made."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quillwatch-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


_written: dict[tuple[str, str, str], str] = {}


def once(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """build()'s rows, written as Parquet on first use in a session for each input folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _written:
        path = f"{shared_folder(spark)}/derived-{uuid.uuid4().hex}-{name}"
        build().write.parquet(path)
        _written[key] = path
    return spark.read.parquet(_written[key])
