"""Alignment of two tokenizers through a dictionary of token groups.

Tokenizer A is a byte-level BPE (a ``tokenizers`` file) that reads a space and the text, B a SentencePiece model that
reads the text and adds that space. Their tokens cover the same bytes; the places where tokens of both end cut them into
groups, and the A token and the B token that end there together are linked. An id pair's count is the number of links in
the corpus that hold it.

No group crosses the place where white space begins after a word, so a text is cut there and each distinct chunk is
encoded, checked and cut into groups once in a worker's table, which is emptied when full. A document is then its distinct
groups with their frequencies. Each task also writes the groups that it met, with their number; summed, they are the
corpus' dictionary of distinct groups, where a group's link is made once and multiplied by its frequency into pair
counts. What a group gives goes back to documents by the group's key: the most frequent groups by a broadcast of bounded
size, the others, which are rare by definition and so have no hot key, by a shuffle.

Keys are 64-bit hashes; a key that two groups share is seen in the dictionary, and all is done again with another seed.

Cases: null and empty texts, and texts that B doesn't give back byte by byte (with U+2581 in them), have no tokens: zeros
and an empty string; special tokens' strings are plain text; very long texts and texts without spaces are encoded whole;
repeated rows and null ids count each; of equal counts of a B id all are the best; an empty table gives an empty table;
input columns named like the outputs are replaced, others may have any name.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .names import numbered, renamed
from .pieces import MARK, _blocks, _model
from .storage import Scratch
from .workers import tidied

#: Distinct chunks that a worker's table holds before it starts anew, and characters in them.
TABLE_ENTRIES, TABLE_CHARS = 400_000, 12_000_000
#: Groups in one row of the dictionary that a task writes.
GROUPS_A_ROW = 2_000
#: The most frequent groups that are broadcast, of three numbers each.
BROADCAST_GROUPS = 1_000_000
OUTPUTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")

# Characters that are white space to the patterns of byte-level tokenizers.
_CUT = " \\n\\t"  # no piece of several characters has these but for leading markers, which _Pair checks
_ODD_SPACE = "\\x0b\\x0c\\r\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: White space and the word after it; words that odd white space parts stay together.
_CHUNK = re.compile(f"[{_CUT}{_ODD_SPACE}]*[^{_CUT}{_ODD_SPACE}]+(?:[{_ODD_SPACE}][{_CUT}{_ODD_SPACE}]*[^{_CUT}{_ODD_SPACE}]*)*|[{_CUT}{_ODD_SPACE}]+")
#: Characters whose classes are the same in all versions of Unicode that libraries use, in words that aren't too long.
_PLAIN = re.compile("[\x00-ɏЀ-џ‐-‧‰-⁞ぁ-ゖァ-ヺ一-龥가-힣]{1,200}")


def _byte_alphabet() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, from U+0100 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class _Pair:
    """Both tokenizers: ids and the bytes that they stand for."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        with open(a_path, encoding="utf-8") as f:
            layout = json.load(f)
        before = layout["pre_tokenizer"]
        if layout["normalizer"] or layout["model"]["type"] != "BPE" or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"]:
            raise ValueError("the chunk table needs a plain byte-level BPE that cuts before white space")
        alphabet, vocabulary = _byte_alphabet(), layout["model"]["vocab"]
        self.a_bytes = [b""] * (1 + max(vocabulary.values()))
        for token, k in vocabulary.items():
            self.a_bytes[k] = bytes(alphabet[c] for c in token)
        self.fast = self._ranked(layout["model"]["merges"], vocabulary)
        self.b = _model(b_path)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        if any(len(p) > 1 and re.search("[\n\t]", p) for p in pieces):
            raise ValueError("a piece of this model crosses a line's end or a tab")
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(k) else p.replace(MARK, " ").encode() for k, p in enumerate(pieces)]
        self.b_mark = self.b.piece_to_id(MARK)

    def _ranked(self, merges: list, vocabulary: dict[str, int]):
        """The same BPE in a library that merges by ids, or None where that might differ: ids must rise with the merges, and
        each token's own bytes must merge to it, so that at no time two other tokens can stand where it is made."""
        made = [vocabulary["".join(m if isinstance(m, (list, tuple)) else m.split(" "))] for m in merges]
        alone = all(len(t := self.a.model.tokenize(token)) == 1 and t[0].id == k for token, k in vocabulary.items())
        if made != sorted(set(made)) or not alone:
            return None
        import tiktoken

        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: how byte-level tokenizers cut
        return tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks={b: k for k, b in enumerate(self.a_bytes) if b}, special_tokens={})

    def encode_a(self, chunks: list[str]) -> list[list[int]]:
        fast = self.fast
        out = [fast.encode_ordinary(c) if fast is not None and _PLAIN.fullmatch(c) else None for c in chunks]
        slow = [k for k, ids in enumerate(out) if ids is None]
        for k, e in zip(slow, self.a.encode_batch([chunks[k] for k in slow], add_special_tokens=False)):
            out[k] = e.ids
        return out

    def encode_b(self, chunks: list[str]) -> list[list[int]]:
        """The library adds a space: instead of the chunk's own first one, or too many, and gives nothing for nothing."""
        out = self.b.encode([c[1:] if c[0] == " " else c for c in chunks], num_threads=1)
        for k, c in enumerate(chunks):
            if c == " ":
                out[k] = [self.b_mark]
            elif c[0] != " ":
                if out[k][0] != self.b_mark:
                    raise ValueError("a piece of this model joins a marker to other white space")
                out[k] = out[k][1:]
        return out


class GroupTable(dict):
    """chunk -> row. Row k's groups are flat[start[k]:start[k + 1]], numbers of groups that are interned beside it."""

    def __init__(self, a_path: str, b_path: str, seed: int):
        super().__init__()
        import xxhash

        self.pair, self.hash = _Pair(a_path, b_path), lambda group: xxhash.xxh64_intdigest(group, seed)
        self.lengths = [np.array([len(b) for b in x], np.int64) for x in (self.pair.a_bytes, self.pair.b_bytes)]
        self.renew()

    def renew(self) -> None:
        self.clear()
        self.chars, self.texts, self.groups = 0, [], {}
        self.flat, self.start = np.empty(0, np.int32), np.zeros(1, np.int64)
        self.n_a = self.n_b = np.empty(0, np.int32)
        self.bad = np.empty(0, bool)
        self.keys, self.frequency = np.empty(0, np.int64), np.empty(0, np.int64)

    def full(self) -> bool:
        return len(self) >= TABLE_ENTRIES or self.chars >= TABLE_CHARS

    def learn(self, words: list[str]) -> None:
        new = list(set(words).difference(self))
        if not new:
            return
        pair = self.pair
        ids = [pair.encode_a(new), pair.encode_b(new)]
        raw = [c.encode() for c in new]
        bad = np.array([b"".join(map(pair.a_bytes.__getitem__, a)) != r or b"".join(map(pair.b_bytes.__getitem__, b)) != r for a, b, r in zip(*ids, raw)])
        ids = [[[] if x else i for i, x in zip(side, bad)] for side in ids]
        sizes = [np.fromiter(map(len, side), np.int64, len(new)) for side in ids]
        flat = [np.fromiter(chain.from_iterable(side), np.int64, int(n.sum())) for side, n in zip(ids, sizes)]
        ends = [np.cumsum(length[x]) for length, x in zip(self.lengths, flat)]  # in all good chunks one after the other
        cuts, at_a, at_b = np.intersect1d(*ends, assume_unique=True, return_indices=True)
        chunk_ends = np.cumsum(np.where(bad, 0, np.fromiter(map(len, raw), np.int64, len(raw))))
        n_groups = np.diff(np.concatenate([[0], np.searchsorted(cuts, chunk_ends, side="right")]))
        texts = [list(map(str, x.tolist())) for x in flat]
        stops = [(at + 1).tolist() for at in (at_a, at_b)]
        begins = [[0, *s[:-1]] for s in stops]
        named = [f"{texts[0][i] if j - i == 1 else ','.join(texts[0][i:j])}|{texts[1][p] if q - p == 1 else ','.join(texts[1][p:q])}" for i, j, p, q in zip(begins[0], stops[0], begins[1], stops[1])]
        known = len(self.groups)
        numbers = [self.groups.setdefault(g, len(self.groups)) for g in named]
        fresh = list(islice(self.groups, known, None))
        self.keys = np.concatenate([self.keys, np.fromiter(map(self.hash, fresh), np.uint64, len(fresh)).view(np.int64)])
        self.frequency = np.concatenate([self.frequency, np.zeros(len(fresh), np.int64)])
        last = np.cumsum(n_groups)
        first = last - n_groups
        self.texts += [";".join(named[i:j]) for i, j in zip(first.tolist(), last.tolist())]
        self.start = np.concatenate([self.start, self.start[-1] + last])
        self.flat = np.concatenate([self.flat, np.array(numbers, np.int32)])
        self.n_a, self.n_b = (np.concatenate([old, n.astype(np.int32)]) for old, n in zip((self.n_a, self.n_b), sizes))
        self.bad = np.concatenate([self.bad, bad])
        self.update(zip(new, range(len(self), len(self) + len(new))))
        self.chars += sum(map(len, new))

    def block(self, texts: list[str]) -> tuple[list[np.ndarray], list[str], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(n_a, n_b, n_groups), the groups' text, and (offsets, numbers, frequencies) of distinct groups of each text."""
        words, sizes = [], []
        for text in texts:
            own = _CHUNK.findall(f" {text}") if text else []
            words += own
            sizes.append(len(own))
        self.learn(words)
        rows = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        doc = np.repeat(np.arange(len(texts)), sizes)
        bad = np.bincount(doc, self.bad[rows], len(texts)) > 0 if len(rows) else np.zeros(len(texts), bool)
        rows, doc = rows[~bad[doc]], doc[~bad[doc]]
        sizes = np.bincount(doc, minlength=len(texts))
        first, many = self.start[rows], self.start[rows + 1] - self.start[rows]
        numbers = self.flat[np.arange(many.sum()) + np.repeat(first - np.cumsum(many) + many, many)].astype(np.int64)
        self.frequency += np.bincount(numbers, minlength=len(self.frequency))
        counts = [np.bincount(doc, w, len(texts)).astype(np.int64) for w in (self.n_a[rows], self.n_b[rows], many)]
        found, n = np.unique(np.repeat(doc, many) * max(1, len(self.groups)) + numbers, return_counts=True)
        in_doc, numbers = np.divmod(found, max(1, len(self.groups)))
        offsets = np.concatenate([[0], np.cumsum(np.bincount(in_doc, minlength=len(texts)))])
        stops = np.cumsum(sizes).tolist()
        every = list(map(self.texts.__getitem__, rows.tolist()))
        joined = [";".join(every[b - a : b]) for a, b in zip(sizes.tolist(), stops)]
        return counts, joined, (offsets, numbers, n)

    def met(self) -> tuple[np.ndarray, list[str], np.ndarray]:
        """(keys, groups, frequencies) of what was met since this was last asked."""
        at = np.flatnonzero(self.frequency)
        names = list(self.groups)
        out = self.keys[at], [names[k] for k in at.tolist()], self.frequency[at].copy()
        self.frequency[:] = 0
        return out


@lru_cache(maxsize=1)
def _table(a_path: str, b_path: str, seed: int) -> GroupTable:
    """One a worker, whose chunks the next task finds."""
    return GroupTable(a_path, b_path, seed)


def _encode(rows: DataFrame, text: str, a_path: str, b_path: str, seed: int) -> DataFrame:
    """rows with row (a number of its own), n_a, n_b, n_groups, groups and found (key, n); and rows with dictionary alone."""
    names = rows.columns
    at = names.index(text)
    more = "row long, n_a long, n_b long, n_groups long, groups string, found array<struct<key:long,n:int>>, dictionary array<struct<key:long,group:string,n:long>>"
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema] + T._parse_datatype_string(more).fields)
    every = schema.names
    kind = pa.list_(pa.struct([("key", pa.int64()), ("group", pa.string()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, types, row = _table(a_path, b_path, seed), None, TaskContext.get().partitionId() << 33
        table.met()  # of a task that ended early

        def dictionary() -> Iterator[pa.RecordBatch]:
            keys, groups, n = table.met()
            starts = list(range(0, len(keys), GROUPS_A_ROW))
            if starts:
                items = pa.StructArray.from_arrays([pa.array(keys), pa.array(groups, pa.string()), pa.array(n)], names=["key", "group", "n"])
                lists = pa.ListArray.from_arrays(pa.array([*starts, len(keys)], pa.int32()), items)
                yield pa.RecordBatch.from_arrays([*(pa.nulls(len(starts), t) for t in types), lists.cast(kind)], names=every)

        for batch in batches:
            done = 0
            for block in _blocks([t or "" for t in batch.column(at).to_pylist()], len):
                if table.full():
                    if types is not None:
                        yield from dictionary()
                    table.renew()
                counts, groups, (offsets, numbers, n) = table.block(block)
                items = pa.StructArray.from_arrays([pa.array(table.keys[numbers]), pa.array(n.astype(np.int32))], names=["key", "n"])
                found = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), items)
                part = batch.slice(done, len(block))
                own = [*part.columns, pa.array(np.arange(row, row + len(block))), *map(pa.array, counts), pa.array(groups, pa.string()), found]
                done, row, types = done + len(block), row + len(block), [c.type for c in own]
                yield pa.RecordBatch.from_arrays([*own, pa.nulls(len(block), kind)], names=every)
        if types is not None:
            yield from dictionary()

    return rows.mapInArrow(tidied(run), schema)


@dataclass
class Alignment:
    """documents: the input with OUTPUTS and groups. pairs: (a, b, count, best). groups: (key, group, a, b, n), distinct."""

    documents: DataFrame
    pairs: DataFrame
    groups: DataFrame


def align(df: DataFrame, a_path: str, b_path: str, text: str = "text", digest: bool = False, broadcast_groups: int = BROADCAST_GROUPS) -> Alignment:
    """Each text's tokens, groups (`a1,a2|b1;a3|b2,b3`, or with digest their SHA-256 as groups_sha256), links, how many of
    these have the highest count of their B id, and their counts' sum."""
    scratch = Scratch(df.sparkSession)
    names, said = df.columns, "groups_sha256" if digest else "groups"
    rows = numbered(df)
    shown = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)) if digest else F.col("groups")
    kept = [c for c, n in zip(rows.columns, names) if n.lower() not in (*OUTPUTS, said)]
    seed = 0
    while True:
        encoded = _encode(rows, f"c{names.index(text)}", a_path, b_path, seed)
        encoded = scratch.keep(encoded.select(*kept, "row", "n_a", "n_b", "n_groups", shown.alias(said), "found", "dictionary"))
        met = encoded.filter("dictionary IS NOT NULL").select(F.explode("dictionary").alias("d")).select("d.*")
        parts = F.split("group", "[|]")
        last = [F.element_at(F.split(parts[k], ","), -1).cast("int").alias(c) for k, c in enumerate("ab")]
        groups = met.groupBy("key").agg(F.min("group").alias("group"), F.max("group").alias("other"), F.sum("n").alias("n"))
        groups = scratch.keep(groups.select("key", "group", *last, "n", (F.col("group") != F.col("other")).alias("clash")))
        if groups.filter("clash").isEmpty():
            break
        scratch.drop(encoded)
        scratch.drop(groups)
        seed += 1
    counted = groups.groupBy("a", "b").agg(F.sum("n").alias("count"))
    best = counted.groupBy("b").agg(F.max("count").alias("most"))
    pairs = scratch.keep(counted.join(best, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best")))
    gives = scratch.keep(groups.join(pairs, ["a", "b"]).select("key", "n", F.col("best").cast("long").alias("best"), "count"))
    level = F.floor(F.log2("n")).cast("int")
    head, taken = 64, 0  # the least power of two from which on groups are broadcast
    for r in gives.groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect():  # 64 rows at most
        if taken + r["n"] > broadcast_groups:
            break
        head, taken = r["level"], taken + r["n"]
    else:
        head = 0
    documents = encoded.filter("dictionary IS NULL")
    found = documents.select("row", F.explode("found").alias("f")).select("row", "f.key", F.col("f.n").alias("times"))
    frequent = F.broadcast(gives.filter(level >= head).select("key", "best", "count"))
    joined = found.join(frequent, "key")
    if head:
        rare = found.join(frequent.select("key"), "key", "left_anti").join(gives.filter(level < head).select("key", "best", "count"), "key")
        joined = joined.unionByName(rare)
    sums = joined.groupBy("row").agg(F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    out = documents.drop("found", "dictionary").join(sums, "row", "left")
    out = out.withColumn("n_links", F.col("n_groups")).withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_best", "count_sum")})
    return Alignment(renamed(out, names, *OUTPUTS, said), pairs, groups.drop("clash"))
