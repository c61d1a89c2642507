"""Exact deduplication through counting quotient filters.

Every text, each run of white space in it turned into one space, has a 64-bit fingerprint. Each task builds counting
quotient filters of its fingerprints: the leading bits choose a block, the next ones (the quotient) a home slot, and the
rest (the remainder) is stored there in sorted runs, with a counter where it came more than once. Filters of a block
merge without loss, since their remainders are sorted, into the block's filter over all tasks; fingerprints that it
counts twice or more go on to a comparison of whole texts. All others are alone and travel no further.

A block has about ``ROWS_A_BLOCK`` fingerprints, however large the corpus; a text with many copies is one slot of each
task's filter and one row of each task's partial groups.

Cases: a null text counts as empty; empty texts are equal to each other; texts of white space only are one space, which
is not empty; very long texts are compared whole; rows repeated with one id count each, and all of them are kept where
that id is the least; null ids come after all others and the rows of a group without ids are all kept; an empty table
gives an empty table; input columns named like the outputs are replaced, others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import numbered, renamed
from .storage import Scratch
from .workers import tidied

#: Fingerprints in a block of all filters together, as near as a power of two comes.
ROWS_A_BLOCK = 100_000
#: Fingerprints that a task holds before it writes its filters and starts anew.
TASK_ROWS = 1_000_000
#: Up to so many repeated fingerprints (8 bytes each, some 50 in a hash table) are broadcast; more are joined by a shuffle.
BROADCAST_FINGERPRINTS = 500_000
OUTPUTS = ("keep_id", "group_size", "kept", "text_sha256")
#: White space that changes when a run becomes one space: anything but a single space.
_RUN = "[\\x09-\\x0D][\\x20\\x09-\\x0D]*|\\x20[\\x20\\x09-\\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _RUN, " ")


class QuotientFilter:
    """Distinct fingerprints of one block with their counts, in slots sorted by (quotient, remainder).

    occupied says which quotients have a run, run_ends where runs end, remainders are cut to whole bytes, and counters
    belong to the slots that came more than once.
    """

    def __init__(self, fingerprints: np.ndarray, counts: np.ndarray):
        """fingerprints: ascending and distinct (uint64)."""
        self.fingerprints, self.counts = fingerprints, counts

    @classmethod
    def of(cls, fingerprints: np.ndarray) -> QuotientFilter:
        return cls(*np.unique(fingerprints, return_counts=True))

    @classmethod
    def merged(cls, filters: list[QuotientFilter]) -> QuotientFilter:
        """One filter that counts what all of them count: sorted runs are merged, counters of equal slots added."""
        every, counts = np.concatenate([f.fingerprints for f in filters]), np.concatenate([f.counts for f in filters])
        order = np.argsort(every, kind="stable")
        every, counts = every[order], counts[order]
        first = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.empty(0, np.int64)
        return cls(every[first], np.add.reduceat(counts, first) if len(every) else counts)

    def pack(self, block_bits: int) -> bytes:
        """The filter's slots as bytes. Its fingerprints agree in their first block_bits bits, which aren't stored."""
        n = len(self.fingerprints)
        quotient_bits = min(max(1, (n - 1).bit_length()), 64 - block_bits)
        rest = 64 - block_bits - quotient_bits
        inside = (self.fingerprints << np.uint64(block_bits)) >> np.uint64(block_bits) if block_bits else self.fingerprints
        quotients = (inside >> np.uint64(rest)).astype(np.int64)
        occupied = np.zeros(1 << quotient_bits, bool)
        occupied[quotients] = True
        run_ends = np.append(quotients[1:] != quotients[:-1], True)
        width = -(-rest // 8)
        remainders = (inside & np.uint64((1 << rest) - 1)).astype("<u8").view(np.uint8).reshape(n, 8)[:, :width]
        often = np.flatnonzero(self.counts > 1)
        head = np.array([n, quotient_bits, len(often)], "<i8")
        return b"".join(x.tobytes() for x in (head, np.packbits(occupied), np.packbits(run_ends), remainders, often.astype("<i8"), self.counts[often].astype("<i8")))

    @classmethod
    def unpack(cls, block: int, block_bits: int, data: bytes) -> QuotientFilter:
        n, quotient_bits, n_often = np.frombuffer(data, "<i8", 3).tolist()
        rest = 64 - block_bits - quotient_bits
        at = 24

        def take(size: int) -> np.ndarray:
            nonlocal at
            at += size
            return np.frombuffer(data, np.uint8, size, at - size)

        occupied = np.flatnonzero(np.unpackbits(take(-(-(1 << quotient_bits) // 8)), count=1 << quotient_bits))
        run_ends = np.unpackbits(take(-(-n // 8)), count=n)
        run = np.cumsum(run_ends) - run_ends
        width = -(-rest // 8)
        remainders = np.zeros((n, 8), np.uint8)
        remainders[:, :width] = take(n * width).reshape(n, width)
        out = occupied[run].astype(np.uint64) << np.uint64(rest) | remainders.view("<u8").ravel().astype(np.uint64)
        if block_bits:
            out |= np.uint64(block) << np.uint64(64 - block_bits)
        counts = np.ones(n, np.int64)
        often = take(8 * n_often).view("<i8")
        counts[often] = take(8 * n_often).view("<i8")
        return cls(out, counts)


def _build(block_bits: int):
    """Fingerprints to (block, filter): one row for each block that this task has something of."""
    def filters(parts: list[np.ndarray]) -> pa.RecordBatch:
        whole = QuotientFilter.of(np.concatenate(parts))
        blocks = (whole.fingerprints >> np.uint64(64 - block_bits)).astype(np.int64) if block_bits else np.zeros(len(whole.fingerprints), np.int64)
        first = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1]))
        ends = np.append(first[1:], len(blocks))
        packed = [QuotientFilter(whole.fingerprints[a:b], whole.counts[a:b]).pack(block_bits) for a, b in zip(first, ends)]
        return pa.RecordBatch.from_arrays([pa.array(blocks[first]), pa.array(packed, pa.binary())], names=["block", "filter"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            parts.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            size += len(batch)
            if size >= TASK_ROWS:
                yield filters(parts)
                parts, size = [], 0
        if size:
            yield filters(parts)

    return run


def _merge(block_bits: int):
    """A block's filters to the fingerprints that it counts twice or more."""
    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        whole = QuotientFilter.merged([QuotientFilter.unpack(block, block_bits, f) for f in table.column("filter").to_pylist()])
        often = whole.counts > 1
        return pa.table({"fingerprint": whole.fingerprints[often].view(np.int64), "n": whole.counts[often]})

    return run


def repeated_fingerprints(fingerprints: DataFrame, rows_a_block: int = ROWS_A_BLOCK) -> DataFrame:
    """(fingerprint, n) of those in a one-column DataFrame of longs that come twice or more."""
    n = fingerprints.count()
    block_bits = max(0, (n // rows_a_block).bit_length())
    built = fingerprints.mapInArrow(tidied(_build(block_bits)), "block long, filter binary")
    return built.groupBy("block").applyInArrow(_merge(block_bits), "fingerprint long, n long")


def mark_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", rows_a_block: int = ROWS_A_BLOCK, broadcast_fingerprints: int = BROADCAST_FINGERPRINTS) -> DataFrame:
    """df with keep_id (the least id of equal texts), group_size, kept and text_sha256 (of the normalised text)."""
    scratch = Scratch(df.sparkSession)
    names = df.columns
    own_id, own_text = (f"c{names.index(c)}" for c in (id, text))
    plain = normalised(F.col(own_text))
    rows = numbered(df)
    often = scratch.keep(repeated_fingerprints(rows.select(F.xxhash64(plain).alias("fingerprint")), rows_a_block)).select("fingerprint")
    few = F.broadcast(often) if often.count() <= broadcast_fingerprints else often
    copies = rows.select(F.col(own_id).alias("id"), plain.alias("plain")).withColumn("fingerprint", F.xxhash64("plain")).join(few, "fingerprint", "left_semi")
    groups = copies.groupBy("plain").agg(F.min("id").alias("least"), F.count("*").alias("n")).filter("n > 1")
    groups = groups.select(F.sha2("plain", 256).alias("sha"), "least", "n", F.lit(True).alias("grouped"))
    out = rows.withColumn("text_sha256", F.sha2(plain, 256)).join(groups.withColumnRenamed("sha", "text_sha256"), "text_sha256", "left")
    out = out.withColumn("keep_id", F.when(F.col("grouped"), F.col("least")).otherwise(F.col(own_id))).withColumn("group_size", F.coalesce("n", F.lit(1)).cast("long"))
    return renamed(out.withColumn("kept", F.col("keep_id").eqNullSafe(F.col(own_id))), names, *OUTPUTS)


def drop_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of df that stay, with df's columns, also those named like mark_duplicates' outputs."""
    names = df.columns
    marked = mark_duplicates(numbered(df), f"c{names.index(id)}", f"c{names.index(text)}", **options)
    return renamed(marked.filter("kept"), names)
