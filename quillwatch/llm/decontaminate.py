"""Benchmark decontamination by n-gram lookup.

Windows of the benchmark's normalised words form a hash set that is broadcast; each document's word windows are
looked up in it, hits are verified word by word, and the hit words give spans to remove or documents to reject.

The set's size is bounded as built: items are cut into chunks of ``CHUNK_WORDS`` that overlap by a window less a word,
and chunks are dealt by hash into slices of about ``SLICE_WORDS``; each slice is broadcast in a pass of its own. A slice
takes some 50 MB in a worker. Between passes the documents are written with what was found so far.

Cases: null and empty texts have no words and no hits; items without words are never found; items shorter than a
window are one window as a whole; items of equal texts and repeated rows each count, rows of one item id are one item;
null item ids count as an item each but name nothing; an empty benchmark hits nothing and an empty table gives an empty
table; very long texts and items are read whole; input columns named like the outputs are replaced, others may have any
name. Words are runs of
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import numbered, quoted, renamed
from .storage import Scratch
from .workers import tidied

WINDOW = 13
#: A document with at least this share of hit words is contaminated.
MIN_PERCENT = 5
#: Words of benchmark items that are broadcast at once, and in one chunk of an item.
SLICE_WORDS, CHUNK_WORDS = 300_000, 5_000
#: Words of documents that are looked up at once.
BLOCK_WORDS = 200_000

#: Lower-cases A-Z and turns every byte outside words into a space; the bytes of other characters stay.
NORMAL = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))

_ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


def window_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(len(ids) - size + 1, dtype=np.uint64)
    for k in range(size):
        out = out * _ODD + ids[k : len(ids) - size + 1 + k]
    return out


class Windows:
    """The distinct windows of one size, by hash: of window k, hashes[k] is the hash, flat[place[k]:] are the words, and
    items[start[k]:start[k + 1]] the items."""

    def __init__(self, size: int, flat: np.ndarray, at: np.ndarray, item: np.ndarray):
        """at: where windows begin in flat; item: the item of each."""
        hashes = np.zeros(len(at), dtype=np.uint64)
        for k in range(size):
            hashes = hashes * _ODD + flat[at + k]
        order = np.lexsort((item, hashes))
        at, item, hashes = at[order], item[order], hashes[order]
        new = np.append(True, hashes[1:] != hashes[:-1])
        for k in range(size):
            new[1:] |= flat[at[1:] + k] != flat[at[:-1] + k]
        keep = new | np.append(True, item[1:] != item[:-1])
        self.size, self.flat = size, flat
        self.hashes, self.place, self.items = hashes[new], at[new], item[keep]
        self.start = np.append(np.flatnonzero(new[keep]), keep.sum())

    def find(self, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, window) for all of these places at which one of the windows stands."""
        hashes = np.zeros(len(at), dtype=np.uint64)
        for k in range(self.size):
            hashes = hashes * _ODD + words[at + k]
        low = np.searchsorted(self.hashes, hashes)
        found = np.flatnonzero(self.hashes[np.minimum(low, len(self.hashes) - 1)] == hashes)
        at, low = at[found], low[found]
        many = np.searchsorted(self.hashes, hashes[found], side="right") - low
        at, window = np.repeat(at, many), np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
        same = np.ones(len(at), dtype=bool)
        for k in range(self.size):
            same &= words[at + k] == self.flat[self.place[window] + k]
        return at[same], window[same]


class WindowSet:
    """The windows of one slice, by size. items: (number of the item, its id, words of a chunk)."""

    def __init__(self, items: list[tuple], window: int):
        self.numbers: dict[bytes, int] = {}
        self.names = dict({number: name for number, name, _ in items})
        own: dict[int, list] = {}
        flat, end = [], 0
        for number, _, words in items:
            ids = np.array([self.numbers.setdefault(w.encode(), len(self.numbers) + 1) for w in words], dtype=np.uint32)
            size = min(window, len(ids))
            if size:
                starts = np.arange(len(ids) - size + 1) + end
                own.setdefault(size, []).append((starts, np.full(len(starts), number, dtype=np.int64)))
                flat.append(ids)
                end += len(ids)
        words = np.concatenate([*flat, np.empty(0, np.uint32)])
        self.sizes = [Windows(size, words, *map(np.concatenate, zip(*parts))) for size, parts in own.items()]


def _find(words: np.ndarray, starts: np.ndarray, windows: WindowSet, hit: np.ndarray, found: list[set]) -> None:
    """Marks hit words and adds item numbers to each document's set. words: numbers, 0 for words of no item."""
    known = np.concatenate([[0], np.cumsum(words > 0)])
    ends = np.append(starts[1:], len(words))
    for table in windows.sizes:
        size = table.size
        if len(words) < size:
            continue
        at = np.flatnonzero(known[size:] - known[:-size] == size)
        at = at[at + size <= ends[np.searchsorted(starts, at, side="right") - 1]]
        if not len(at):
            continue
        at, window = table.find(words, at)
        for k in range(size):
            hit[at + k] = True
        doc = np.searchsorted(starts, at, side="right") - 1
        for d, w in np.unique(np.stack([doc, window], axis=1), axis=0).tolist():
            found[d].update(table.items[table.start[w] : table.start[w + 1]].tolist())


def _pass(df: DataFrame, text: str, inner: list[str], items: list[tuple], window: int) -> DataFrame:
    """df with what this slice adds to its inner columns: number of words, positions of hit words, items (number, id)."""
    windows = df.sparkSession.sparkContext.broadcast(WindowSet(items, window))
    names = df.columns
    at, at_words, at_hits, at_items = (names.index(c) for c in (text, *inner))
    kind = pa.list_(pa.struct([("number", pa.int64()), ("id", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = windows.value.numbers.get
        for batch in batches:
            texts = batch.column(at).cast(pa.binary())
            first = 0
            while first < len(batch):
                ids, sizes, total, end = [], [], 0, first
                while end < len(batch) and total < BLOCK_WORDS:
                    value = texts[end].as_py()
                    words = words_of(value) if value else []
                    ids.append(np.fromiter(map(get, words, [0] * len(words)), np.uint32, len(words)))
                    sizes.append(len(words))
                    total, end = total + len(words), end + 1
                flat, stops = np.concatenate(ids), np.cumsum(sizes)
                hit, found = np.zeros(total, dtype=bool), [set() for _ in sizes]
                nonempty = np.flatnonzero(sizes)
                if total and windows.value.sizes:
                    _find(flat, (stops - sizes)[nonempty], windows.value, hit, [found[k] for k in nonempty])
                part = batch.slice(first, end - first)
                old_hits, old_items = part.column(at_hits).to_pylist(), part.column(at_items).to_pylist()
                hits = [np.union1d(old, np.flatnonzero(hit[s - n : s])).astype(np.int32) if n else np.empty(0, np.int32) for old, s, n in zip(old_hits, stops, sizes)]
                columns = list(part.columns)
                columns[at_words] = pa.array(sizes, pa.int64())
                columns[at_hits] = pa.array(hits, pa.list_(pa.int32()))
                every = [{x["number"]: x["id"] for x in old} | {k: windows.value.names[k] for k in new} for old, new in zip(old_items, found)]
                columns[at_items] = pa.array([[{"number": k, "id": v} for k, v in x.items()] for x in every], kind)
                yield pa.RecordBatch.from_arrays(columns, names=names)
                first = end

    return df.mapInArrow(tidied(run), df.schema)


def _words(text: Column) -> Column:
    """words_of on a column."""
    plain = F.regexp_replace(F.translate(text, ascii_uppercase, ascii_lowercase), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", " ")
    return F.filter(F.split(plain, " ", -1), lambda w: w != "")


def _chunks(benchmark: DataFrame, item_id: str, item_text: str, window: int, chunk_words: int) -> DataFrame:
    """(number, id, begin, words): each item's chunks. Every window lies in one of them."""
    items = benchmark.select(F.monotonically_increasing_id().alias("number"), F.col(quoted(item_id)).cast("string").alias("id"), _words(F.col(quoted(item_text))).alias("w")).filter("size(w) > 0")
    begins = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)), F.lit(chunk_words))
    return items.select("number", "id", "w", F.explode(begins).alias("begin")).select("number", "id", "begin", F.slice("w", F.col("begin") + 1, F.lit(chunk_words + window - 1)).alias("words"))


def find_contamination(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, slice_words: int = SLICE_WORDS, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """df with n_words, hit_words (ascending positions), items (ids as sorted strings), n_hit, n_items, contaminated."""
    scratch = Scratch(df.sparkSession)
    chunks = scratch.keep(_chunks(benchmark, item_id, item_text, window, chunk_words))  # so that numbers stay as they are
    total = chunks.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    n_slices = max(1, -(-total // slice_words))
    outputs = ("n_words", "hit_words", "items", "n_hit", "n_items", "contaminated")
    rows = numbered(df)
    own = f"c{df.columns.index(text)}"
    inner = ["_words", "_hits", "_items"]
    kinds = ("long", "array<int>", "array<struct<number:long,id:string>>")
    state = rows.select("*", *[(F.lit(0) if kind == "long" else F.array()).cast(kind).alias(c) for c, kind in zip(inner, kinds)])
    last = None
    for k in range(n_slices):
        items = chunks.filter(F.pmod(F.xxhash64("number", "begin"), F.lit(n_slices)) == k).select("number", "id", "words").collect()
        state = _pass(state, own, inner, [tuple(r) for r in items], window)
        if k + 1 < n_slices:  # so that one slice at a time is held
            state = scratch.keep(state)
            if last is not None:
                scratch.drop(last)
            last = state
    scratch.drop(chunks)
    found = F.transform("_items", lambda x: x["id"])
    ids = F.concat(F.sort_array(F.array_distinct(F.filter(found, lambda x: x.isNotNull()))), F.filter(found, lambda x: x.isNull()))
    out = state.withColumns({"n_words": F.col("_words"), "hit_words": F.col("_hits"), "items": ids})
    out = out.withColumn("n_hit", F.size("hit_words").cast("long")).withColumn("n_items", F.size("items").cast("long"))
    out = out.withColumn("contaminated", (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= MIN_PERCENT * F.col("n_words")))
    return renamed(out, df.columns, *outputs)


def drop_contaminated(df: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents of df that aren't contaminated, with df's columns, also those named like find_contamination's outputs."""
    marked = find_contamination(numbered(df), benchmark, f"c{df.columns.index(text)}", **options)
    return renamed(marked.filter(~F.col("contaminated")), df.columns)
