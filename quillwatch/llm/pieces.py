"""SentencePiece encoding and decoding through a distinct-chunk table.

In a model none of whose pieces has a whitespace marker after another character, no merge crosses the place before
a run of markers. So a text is cut there, each distinct marked word is segmented once by the library, and the ids
are joined back by position. A task's table of distinct words is emptied when it is full and freed when the task
ends, so its memory is bounded and no row is shuffled. Ids are decoded by a table of the pieces' own texts; a row
whose ids need more than these (unknown and control ids, bytes that are no text) is left to the library.

Cases: a null text is read as empty; an empty text has no ids and decodes to an empty text; runs of spaces, texts
without spaces and very long texts give the library's own ids; repeated rows and null keys pass through; an empty
table gives an empty table; input columns named like the outputs are replaced, others may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .names import numbered
from .workers import tidied

MARK = "▁"
#: Distinct words that a task's table holds before it starts anew, and characters in them.
TABLE_ENTRIES, TABLE_CHARS = 300_000, 20_000_000
#: Characters of texts whose ids are put together at once.
BLOCK_CHARS = 1_000_000


@lru_cache(maxsize=2)
def _model(path: str):
    """One a worker. Refuses models for which cutting before markers would not be exact."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as layout

    spec = layout.ModelProto()
    with open(path, "rb") as f:
        spec.ParseFromString(f.read())
    norm = spec.normalizer_spec
    if norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or not norm.escape_whitespaces or spec.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("the chunk table needs an identity normaliser, a dummy prefix and kept spaces")
    if any(re.search(f"[^{MARK}]{MARK}", p.piece) for p in spec.pieces if p.type == 1) or any(p.type == 4 for p in spec.pieces):
        raise ValueError("a piece of this model crosses a whitespace marker")
    return sentencepiece.SentencePieceProcessor(model_file=path)


def _chunks(text: str) -> list[str]:
    """The marked words of a text, each without the first of its markers (the first word's is the dummy prefix)."""
    text = text.replace(MARK, " ")
    words = text.split(" ")
    if "" in words:
        words = [w[1:] for w in re.findall(" +[^ ]*", " " + text)]
    return words


class ChunkTable(dict):
    """word -> row; row k's ids are flat[start[k]:start[k + 1]]."""

    def __init__(self, path: str):
        super().__init__()
        self.model = _model(path)
        self.renew()

    def renew(self) -> None:
        self.clear()
        self.flat, self.start, self.used, self.chars = np.empty(1 << 12, np.int32), np.zeros(1 << 12, np.int64), 0, 0
        self._add([""], [[self.model.piece_to_id(MARK)]])  # the library gives nothing for nothing: here it is a marker alone

    def _add(self, words: list[str], ids: list[list[int]]) -> None:
        n, ends = len(self), self.used + np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
        while n + len(words) + 1 > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
        while ends[-1] > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.start[n + 1 : n + 1 + len(words)] = ends
        self.flat[self.used : ends[-1]] = np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1]) - self.used)
        self.update(zip(words, range(n, n + len(words))))
        self.used = int(ends[-1])
        self.chars += sum(map(len, words))

    def learn(self, words: list[str]) -> None:
        """Segments those of the words that it doesn't know, in one call; the library adds each one's first marker."""
        if len(self) >= TABLE_ENTRIES or self.chars >= TABLE_CHARS:
            self.renew()
        new = list(set(words).difference(self))
        if new:
            self._add(new, self.model.encode(new, num_threads=1))

    def gather(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these words one after the other, and each word's number of ids."""
        rows = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        first, size = self.start[rows], self.start[rows + 1] - self.start[rows]
        before = np.cumsum(size) - size
        return self.flat[np.arange(size.sum()) + np.repeat(first - before, size)], size


def _encode_block(texts: list[str], table: ChunkTable) -> tuple[np.ndarray, np.ndarray]:
    """All ids, and the number of ids of each text."""
    words, ends = [], []
    for text in texts:
        words += _chunks(text) if text else []
        ends.append(len(words))
    table.learn(words)
    ids, size = table.gather(words)
    ends = np.concatenate([[0], np.cumsum(size)])[ends]
    return ids, np.diff(np.concatenate([[0], ends]))


def _blocks(texts: list, weigh) -> Iterator[list]:
    block, size = [], 0
    for t in texts:
        block.append(t)
        size += weigh(t)
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def encode(df: DataFrame, model_path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with the ids (array<int>) of each text, as the library encodes it without begin and end ids."""
    rest = df.drop(ids)
    rows, at = numbered(rest), rest.columns.index(text)
    schema = rows.select("*", F.array().cast("array<int>").alias("ids")).schema
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(model_path)
        for batch in batches:
            done = 0
            for block in _blocks([t or "" for t in batch.column(at).to_pylist()], len):
                flat, sizes = _encode_block(block, table)
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                part = batch.slice(done, len(block))
                done += len(block)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32()))], names=[*names, "ids"])

    return rows.mapInArrow(tidied(run), schema).toDF(*rest.columns, ids)


class PieceTexts:
    """The bytes that each id stands for: id k's are flat[start[k]:start[k + 1]]. plain: whether that is all there is to it."""

    def __init__(self, path: str):
        self.model = m = _model(path)
        every = range(m.get_piece_size())
        texts = [bytes([int(m.id_to_piece(k)[1:-1], 16)]) if m.is_byte(k) else m.id_to_piece(k).replace(MARK, " ").encode() for k in every]
        self.plain = np.array([not (m.is_control(k) or m.is_unknown(k) or m.is_unused(k)) for k in every])
        self.opens = np.array([m.id_to_piece(k).startswith(MARK) for k in every])
        self.flat = np.frombuffer(b"".join(texts), np.uint8)
        self.start = np.concatenate([[0], np.cumsum([len(t) for t in texts])])

    def decode(self, rows: list[np.ndarray]) -> list[str]:
        """What the library decodes from each row's ids."""
        ids = np.concatenate([*rows, np.empty(0, np.int32)]).astype(np.int64)
        plain = (ids >= 0) & (ids < len(self.plain))
        ids = np.where(plain, ids, 0)
        plain &= self.plain[ids]
        first, size = self.start[ids], self.start[ids + 1] - self.start[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        data = self.flat[np.arange(ends[-1]) + np.repeat(first - ends[:-1], size)].tobytes()
        stops = np.concatenate([[0], np.cumsum([len(r) for r in rows], dtype=np.int64)])
        at, odd = ends[stops].tolist(), np.concatenate([[0], np.cumsum(~plain)])[stops].tolist()
        out = []
        for k, row in enumerate(rows):
            try:
                if odd[k + 1] > odd[k]:
                    raise ValueError("ids that stand for more than their bytes")
                opens = len(row) and self.opens[row[0]]  # the dummy prefix, which is no space of the text
                out.append(data[at[k] + bool(opens) : at[k + 1]].decode())
            except ValueError:  # bytes that are no text raise one too
                out.append(self.model.decode(row.tolist(), num_threads=1))
        return out


@lru_cache(maxsize=2)
def _piece_texts(path: str) -> PieceTexts:
    """One a worker, of the vocabulary's size."""
    return PieceTexts(path)


def decode(df: DataFrame, model_path: str, ids: str = "ids", text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """df (or its columns of keep) with the text that the library decodes from each row's ids; null ids are read as none."""
    kept = [c for c in (keep if keep is not None else df.columns) if c != text]
    rows, names = numbered(df), [f"c{df.columns.index(c)}" for c in kept]
    source = rows.select(*names, F.col(f"c{df.columns.index(ids)}").alias("ids"))
    schema = rows.select(*names, F.lit("").alias("text")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _piece_texts(model_path)
        for batch in batches:
            done = 0
            for block in _blocks(batch.column(len(names)), lambda v: len(v) if v.is_valid else 0):
                out = table.decode([v.values.to_numpy(zero_copy_only=False) if v.is_valid else np.empty(0, np.int32) for v in block])
                part = batch.slice(done, len(block))
                done += len(block)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(out, pa.string())], names=[*names, "text"])

    return source.mapInArrow(tidied(run), schema).toDF(*kept, text)
