"""Sharding by a permutation-filled lookup table.

Every shard walks the slots of a prime-sized table in a preference order of its own and, in turn, claims the
next slot that is still free. A key's hash gives a slot and the slot a shard, so placement takes constant time,
loads differ by a few slots, and adding or removing a shard moves few keys.

Cases: a null key hashes like every other null key and gets one shard; repeated and tied keys share a shard; an
empty table gives an empty table. Input columns named like the outputs are replaced by them, also where they are keys.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .names import fresh, quoted

TABLE_SIZE = 65_537
#: Tables up to so many slots (16 bytes a row) are broadcast; larger ones are joined by a shuffle.
BROADCAST_SLOTS = 2_000_003


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(shards: list[str], size: int = TABLE_SIZE, weights: list[int] | None = None) -> np.ndarray:
    """Index of the owning shard for each slot. A shard of weight w claims w slots in each turn."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names")
    if not _is_prime(size) or size < len(shards):
        raise ValueError(f"the table size must be a prime of {len(shards)} or more")
    weights = weights or [1] * len(shards)
    if len(weights) != len(shards) or min(weights) < 0 or max(weights) < 1:
        raise ValueError("each shard needs a weight of 0 or more, and one of them 1 or more")
    start = [xxhash.xxh64_intdigest(s, seed=1) % size for s in shards]
    step = [xxhash.xxh64_intdigest(s, seed=2) % (size - 1) + 1 for s in shards]
    owner, asked, free = [-1] * size, [0] * len(shards), size
    while free:
        for i, weight in enumerate(weights):
            for _ in range(min(weight, free)):
                while owner[slot := (start[i] + asked[i] * step[i]) % size] >= 0:
                    asked[i] += 1
                owner[slot] = i
                free -= 1
    return np.array(owner, dtype=np.int32)


def lookup_frame(spark: SparkSession, shards: list[str], size: int = TABLE_SIZE, weights: list[int] | None = None) -> DataFrame:
    """The table as rows (slot, shard, shard_name)."""
    owner = fill_table(shards, size, weights).tolist()
    return spark.createDataFrame([(k, i, shards[i]) for k, i in enumerate(owner)], "slot long, shard int, shard_name string")


def slot_of(keys: list[Column], size: int = TABLE_SIZE) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(size)).cast("long")


def assign_shards(df: DataFrame, keys: list[str], shards: list[str], size: int = TABLE_SIZE, weights: list[int] | None = None) -> DataFrame:
    """df with slot, shard and shard_name: one broadcast join with a table of fixed size, no shuffle."""
    table = lookup_frame(df.sparkSession, shards, size, weights)
    at = fresh([*df.columns, "slot"], "_at")[0]
    placed = df.withColumn(at, slot_of([F.col(quoted(k)) for k in keys], size)).drop("slot", "shard", "shard_name").withColumnRenamed(at, "slot")
    return placed.join(F.broadcast(table) if size <= BROADCAST_SLOTS else table, "slot", "left")


def write_shards(df: DataFrame, keys: list[str], shards: list[str], path: str, files_per_shard: int = 1, **options) -> None:
    """Writes a folder for each shard, in so many files. Rows are dealt to files by the hash of all they hold, so that one
    key's rows, of which there may be many, are spread too; a retry deals alike."""
    placed = assign_shards(df, keys, shards, **options)
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(files_per_shard))
    placed.repartition(len(shards) * files_per_shard, "shard", salt).write.partitionBy("shard").parquet(path)
