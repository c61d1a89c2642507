"""Removal of long byte strings that stand anywhere else too, by suffix arrays over candidate segments.

Every window of ``LENGTH`` bytes has one anchor: the least hash among its ``GRAM``-byte strings (the first of equal
ones). Equal windows have equal anchors at equal places, so windows can only repeat where an anchor's hash does. The
windows of one anchor form a segment of text. Digests of segments only prune: an anchor seen once has no repeat, and of
equal segments one goes on, with their number.

The segments of repeated anchors go into suffix arrays, whole anchors by key, in blocks of about ``BLOCK_BYTES``. The
maximal repeats of ``LENGTH`` bytes or more that the interval tree gives there, with all their occurrences, are what is
removed: an occurrence in a segment is one at all places where that segment stands. They are gathered per document.

An anchor with more than ``HOT_SEGMENTS`` different segments would make an unbounded block. Of its segments' windows
those whose 128-bit digest repeats go into the suffix arrays one by one instead, which spreads one anchor over all tasks
and finds the same windows.

Rows are told apart by a 128-bit hash of id and text; rows that agree in both repeat each other in full and share their
spans.

Cases: a null text is empty; texts below LENGTH bytes have no window; repeated rows repeat each other; null ids and
clashing columns don't matter; an empty table gives an empty table; long texts are cut into pieces whose windows
don't overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import Scratch
from .suffixes import MAX_STRINGS, SuffixOrder
from .workers import tidied

LENGTH = 400
GRAM = 128
#: Bytes whose windows are hashed at once, and the windows of one piece of a long text.
PIECE = 1 << 18
BLOCK_BYTES = 1_000_000
HOT_SEGMENTS = 4096

_ODD = np.uint64(0x9E3779B97F4A7C15)
_UNODD = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOW = np.uint64(21)  # bits of a place in a buffer
_BYTE = np.array([xxhash.xxh3_64_intdigest(bytes([b])) for b in range(256)], dtype=np.uint64)


class Anchors:
    """Finds anchors in a buffer of at most size bytes."""

    def __init__(self, size: int, length: int, gram: int):
        self.length, self.gram = length, gram
        self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, _ODD, np.uint64)]))
        self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, _UNODD, np.uint64)]))

    def find(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every window's start, its anchor's place; for every place, the hash of its gram."""
        n, k = len(data), self.gram
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[data] * self.up[:n])])
        h = (sums[k:] - sums[:-k]) * self.down[: n - k + 1]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        least = (h >> _LOW << _LOW) | np.arange(len(h), dtype=np.uint64)
        width, reach = self.length - k + 1, 1
        while reach * 2 <= width:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if reach < width:
            least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
        return (least & ((np.uint64(1) << _LOW) - np.uint64(1))).astype(np.int64), h


def _keyed(df: DataFrame, key: str, text: str, *more: Column) -> DataFrame:
    """(r1, r2, data, more): who a row is, and its text as bytes."""
    data = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    return df.select(F.xxhash64(key, text).alias("r1"), F.xxhash64(F.lit("row"), F.col(text), F.col(key)).alias("r2"), data.alias("data"), *more)


def _pieces(values: list[bytes], length: int, piece: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (row, offset, bytes) of about piece bytes together; pieces of a text share length - 1 bytes."""
    out, size = [], 0
    for row, value in enumerate(values):
        for at in range(0, max(0, len(value) - length + 1), piece):
            part = value[at : at + piece + length - 1] if len(value) > piece else value
            out.append((row, at, part))
            size += len(part)
            if size >= piece:
                yield out
                out, size = [], 0
            if part is value:
                break
    if out:
        yield out


def segments(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, piece: int = PIECE) -> DataFrame:
    """(key, digest, r1, r2, lo, n): the n windows from byte lo on have the anchor of that key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Anchors(3 * piece + 8 * length, length, gram)
        for batch in batches:
            values = batch.column(2).to_pylist()
            for part in _pieces(values, length, piece):
                buffer = b"".join(p[2] for p in part)
                sizes = np.array([len(p[2]) for p in part], dtype=np.int64)
                begins = np.cumsum(sizes) - sizes
                anchor, h = finder.find(np.frombuffer(buffer, np.uint8))
                own = np.zeros(len(anchor) + 1, dtype=np.int8)  # 1 where a window lies in one piece
                own[begins] += 1
                np.add.at(own, np.minimum(begins + sizes - length + 1, len(anchor)), -1)
                inside = np.cumsum(own)[:-1] > 0
                new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1])])
                new[begins[begins < len(new)]] = True
                lo = np.flatnonzero(new)
                n = np.diff(np.append(lo, len(anchor)))
                lo, n = lo[inside[lo]], n[inside[lo]]
                view, digest = memoryview(buffer), xxhash.xxh3_64_intdigest
                digests = np.array([digest(view[a : a + m + length - 1]) for a, m in zip(lo.tolist(), n.tolist())], dtype=np.uint64)
                which = np.searchsorted(begins, lo, side="right") - 1
                row = np.array([p[0] for p in part])[which]
                at = lo - begins[which] + np.array([p[1] for p in part])[which]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[anchor[lo]].view(np.int64)), pa.array(digests.view(np.int64)), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(at), pa.array(n.astype(np.int32))],
                    names=["key", "digest", "r1", "r2", "lo", "n"],
                )

    return rows.mapInArrow(tidied(run), "key long, digest long, r1 long, r2 long, lo long, n int")


def _cut(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(key, digest, n, k, segments, data) for each wanted (key, digest, k, segments, r1, r2, lo, n): its text."""
    lists = wanted.groupBy("r1", "r2").agg(F.collect_list(F.struct("key", "digest", "lo", "n", "k", "segments")).alias("wanted"))
    # rows that agree in id and text have the same text: each segment is cut from one of them
    joined = rows.join(lists, ["r1", "r2"]).dropDuplicates(["r1", "r2"]).select("data", F.explode("wanted").alias("w"))
    return joined.select("w.key", "w.digest", "w.n", "w.k", "w.segments", F.expr(f"substring(data, cast(w.lo + 1 as int), w.n + {length - 1})").alias("data"))


def _scan(strings: DataFrame, length: int, hot_segments: int) -> DataFrame:
    """(key, digest, a, b): the parts of each string (key, digest, n, k, data) that occurrences of maximal repeats cover,
    from suffix arrays over whole keys. n: windows; k: places where the string stands."""
    def spans(block: list[tuple]) -> pa.RecordBatch:
        sizes = [s[2] for s in block]
        depth, out = SuffixOrder([s[4] for s in block], sizes, [s[3] for s in block]).longest(length), []
        for (key, digest, *_), d in zip(block, np.split(depth, np.cumsum(sizes)[:-1])):
            starts = np.flatnonzero(d)
            if len(starts):
                ends = np.maximum.accumulate(starts + d[starts])
                cut_at = np.flatnonzero(starts[1:] > ends[:-1]) + 1
                out += [(key, digest, a, b) for a, b in zip(starts[np.append(0, cut_at)].tolist(), ends[np.append(cut_at - 1, len(ends) - 1)].tolist())]
        columns = list(zip(*out)) if out else [[], [], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["key", "digest", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, last = [], 0, None
        for batch in batches:
            for s in zip(*(c.to_pylist() for c in batch.columns)):
                if s[0] != last and (size >= BLOCK_BYTES or len(block) >= MAX_STRINGS - hot_segments):
                    yield spans(block)
                    block, size = [], 0
                last = s[0]
                block.append(s)
                size += len(s[4])
        if block:
            yield spans(block)

    return strings.select("key", "digest", "n", "k", "data").repartition("key").sortWithinPartitions("key").mapInArrow(tidied(run), "key long, digest long, a long, b long")


def _scan_windows(cut: DataFrame, length: int, hot_segments: int, scratch: Scratch) -> DataFrame:
    """The same as _scan, for keys with any number of segments: their repeated windows are the strings."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, digest, n, k, data in zip(*(c.to_pylist() for c in batch.columns)):
                view = memoryview(data)
                found = [xxhash.xxh3_128_digest(view[a : a + length]) for a in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([key] * n, pa.int64()), pa.array([digest] * n, pa.int64()), pa.array([k] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(found, pa.binary())], names=["key", "digest", "k", "a", "window"])

    windows = scratch.keep(cut.select("key", "digest", "n", "k", "data").mapInArrow(tidied(run), "key long, digest long, k long, a long, window binary"))
    again = scratch.keep(windows.groupBy("window").agg(F.sum("k").alias("k"), F.min(F.struct("key", "digest", "a")).alias("at")).filter("k > 1"))
    # strings need whole numbers for names: two 64-bit hashes of the 128-bit digest
    name = (F.xxhash64("window").alias("key"), F.xxhash64(F.lit("window"), "window").alias("digest"))
    strings = again.select(*name, "k", F.col("at.key").alias("of_key"), F.col("at.digest").alias("of_digest"), "at.a")
    texts = cut.select(F.col("key").alias("of_key"), F.col("digest").alias("of_digest"), "data")
    strings = strings.join(texts, ["of_key", "of_digest"]).select("key", "digest", F.lit(1).alias("n"), "k", F.expr(f"substring(data, cast(a + 1 as int), {length})").alias("data"))
    found = _scan(strings, length, hot_segments).select("key", "digest").distinct()
    marked = windows.withColumnsRenamed({"key": "of_key", "digest": "of_digest"}).select("of_key", "of_digest", "a", *name)
    return marked.join(found, ["key", "digest"]).select(F.col("of_key").alias("key"), F.col("of_digest").alias("digest"), "a", (F.col("a") + length).alias("b"))


def repeated_spans(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, hot_segments: int = HOT_SEGMENTS, piece: int = PIECE) -> DataFrame:
    """(r1, r2, spans): for each row with repeats, by _keyed's key, its repeated byte ranges [a, b), unmerged."""
    if not 0 < hot_segments <= MAX_STRINGS // 2:
        raise ValueError(f"hot_segments must be between 1 and {MAX_STRINGS // 2}")
    scratch = Scratch(df.sparkSession)
    rows = _keyed(df, key, text)
    every = scratch.keep(segments(rows, length, gram, piece))
    # what a hot key is joined with is written first, so that the join alone deals it and can be split
    counts = scratch.keep(every.groupBy("key").agg(F.count("*").alias("k")).filter("k > 1").select("key"))
    again = scratch.keep(every.join(counts, "key"))
    for table in (every, counts):
        scratch.drop(table)
    each = again.groupBy("key", "digest").agg(F.count("*").alias("k"), *[F.first(c).alias(c) for c in ("r1", "r2", "lo", "n")])
    each = scratch.keep(each)
    per_key = scratch.keep(each.groupBy("key").agg(F.count("*").alias("segments")))
    cut = scratch.keep(_cut(rows, each.join(per_key, "key"), length))
    for table in (each, per_key):
        scratch.drop(table)
    found, hot = _scan(cut.filter(F.col("segments") <= hot_segments), length, hot_segments), cut.filter(F.col("segments") > hot_segments)
    if not hot.isEmpty():
        found = found.union(_scan_windows(hot, length, hot_segments, scratch))
    ranges = scratch.keep(found.groupBy("key", "digest").agg(F.collect_set(F.struct("a", "b")).alias("spans")))
    scratch.drop(cut)
    parts = again.join(ranges, ["key", "digest"]).select("r1", "r2", "lo", F.explode("spans").alias("s"))
    placed = parts.select("r1", "r2", F.struct((F.col("lo") + F.col("s.a")).alias("a"), (F.col("lo") + F.col("s.b")).alias("b")).alias("span"))
    return placed.groupBy("r1", "r2").agg(F.collect_set("span").alias("spans"))


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, hot_segments: int = HOT_SEGMENTS, piece: int = PIECE) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, removed: array of [a, b), kept: the remaining bytes), a row for each of df's."""
    spans = repeated_spans(df, key, text, length, gram, hot_segments, piece)
    joined = _keyed(df, key, text, F.col(key).alias("id")).join(spans, ["r1", "r2"], "left").select("id", "data", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, kept = [], [], []
            for value, found in zip(batch.column(1), batch.column(2)):
                text, runs = value.as_py(), []
                for s in sorted((s["a"], s["b"]) for s in found.as_py() or ()):
                    if runs and s[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], s[1])
                    else:
                        runs.append([*s])
                edges = [0, *(x for r in runs for x in r), len(text)]
                sizes.append(len(text))
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])) if runs else text)
                removed.append([{"a": a, "b": b} for a, b in runs])
            counts = [sum(r["b"] - r["a"] for r in x) for x in removed]
            kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([len(x) for x in removed], pa.int64()), pa.array(removed, kind), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_bytes", "n_removed", "n_spans", "removed", "kept"])

    kind = joined.schema["id"].dataType.simpleString()
    out = joined.mapInArrow(tidied(run), f"id {kind}, n_bytes long, n_removed long, n_spans long, removed array<struct<a:long,b:long>>, kept binary")
    return out.withColumnRenamed("id", key)
