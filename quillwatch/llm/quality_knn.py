"""Quality classifier: neighbours of latent-semantic vectors vote.

A text becomes counts of hashed terms: its words, the shapes of its words (runs of capitals, small letters, digits
and each other character) and marks for words, word triples and lines that stand there again. Terms are weighted by
inverse document frequency over all documents, and a truncated singular value decomposition of a bounded sample of
labelled rows gives a latent space. The labelled vectors are broadcast; every document's exact cosines with all of
them come from blocked matrix products, and the nearest ones' labels are averaged with their similarities as weights.

Bounds: the sample has at most ``MAX_LABELLED`` rows (those whose hashed ids are least, so it doesn't depend on the
order of rows), so vectors and model take MAX_LABELLED * RANK + TERMS * RANK floats whatever the input's size. The
document frequencies are TERMS sums over every document.

Cases: null and empty texts have no term and get the sample's mean label; labels other than 0 and 1 and labels
without a document are left out; an id labelled twice gets the mean; with no label at all the score is 0.5; repeated
rows and null ids pass through; very long texts count whole; an empty table gives an empty table; columns named like
the outputs are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workers import tidied

TERMS = 4096
RANK = 64
MAX_LABELLED = 4000
NEIGHBOURS = 25
THRESHOLD = 0.7
#: Documents whose terms are held as a matrix at once.
BLOCK = 256
WORD_TABLE = 500_000

#: The first terms are marks; shapes follow, then words.
MARKS, SHAPES = 4, 1024
_CLASS = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256))
_RUNS = re.compile(rb"(.)\1+", re.S)


class WordTerms(dict):
    """word -> shape's term and word's term in one number."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_TABLE:
            self.clear()
        shape = _RUNS.sub(rb"\1", word.translate(_CLASS))[:8]
        low = word.lower().strip(b".,;:!?()\"'")
        value = self[word] = (MARKS + xxhash.xxh3_64_intdigest(shape) % SHAPES) << 32 | (MARKS + SHAPES + xxhash.xxh3_64_intdigest(low) % (TERMS - MARKS - SHAPES))
        return value


def count_terms(text: bytes | None, table: WordTerms) -> np.ndarray:
    """Counts of each term (float32); all 0 for a text without words."""
    words = text.split() if text else []
    out = np.zeros(TERMS, np.float32)
    if not words:
        return out
    both = np.fromiter(map(table.__getitem__, words), np.int64, len(words))
    word = both & 0xFFFFFFFF
    out += np.bincount(both >> 32, minlength=TERMS)
    out += np.bincount(word, minlength=TERMS)
    # how much of the text stands there again, as if each mark were so many words
    out[0] = 4 * np.count_nonzero(word[1:] == word[:-1])
    if len(word) > 2:
        triples = (word[:-2] * 4099 + word[1:-1]) * 4099 + word[2:]
        out[1] = 2 * (len(triples) - len(np.unique(triples)))
    lines = [x for x in text.split(b"\n") if x.strip()]
    out[2] = 8 * (len(lines) - len(set(lines)))
    return out


class Model(NamedTuple):
    idf: np.ndarray  # TERMS
    space: np.ndarray  # TERMS x rank
    vectors: np.ndarray  # labelled rows x rank, of length 1
    labels: np.ndarray
    prior: float


def _weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of roots of term shares, by idf, of length 1."""
    out = np.sqrt(counts) * idf
    return _unit(out)


def _unit(rows: np.ndarray) -> np.ndarray:
    size = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)


def document_frequencies(df: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """In how many of all documents each term is, and their number. TERMS sums come to the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen, n = WordTerms(), np.zeros(TERMS, np.int64), 0
        for batch in batches:
            for value in batch.column(0).cast(pa.binary()):
                seen += count_terms(value.as_py(), table) > 0
                n += 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, TERMS), pa.int32()), pa.array(np.append(n, seen), pa.int64())], names=["term", "n"])

    sums = df.select(text).mapInArrow(tidied(run), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(TERMS + 1, np.int64)
    for r in sums:
        out[r["term"]] = r["n"]
    return out[:TERMS], int(out[TERMS])


def labelled_sample(labels: DataFrame, key: str, label: str, limit: int) -> DataFrame:
    """(key, y): at most limit labelled ids, those of the least hashes."""
    valid = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.avg(label).alias("y"))
    return valid.orderBy(F.xxhash64(key), key).limit(limit)


def _decompose(rows: np.ndarray, rank: int) -> np.ndarray:
    """Right singular vectors of the largest singular values, by a seeded random range finder."""
    rng = np.random.default_rng(17)
    rank = min(rank, *rows.shape)
    basis = rows @ rng.standard_normal((rows.shape[1], min(rank + 16, rows.shape[1])), dtype=np.float32)
    for _ in range(4):
        basis, _ = np.linalg.qr(rows @ (rows.T @ np.linalg.qr(basis)[0]))
    return np.linalg.svd(basis.T @ rows, full_matrices=False)[2][:rank].T.astype(np.float32)


def fit(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_labelled: int = MAX_LABELLED, rank: int = RANK) -> Model:
    seen, total = document_frequencies(df, text)
    idf = np.log((1 + total) / (1 + seen)).astype(np.float32) + np.float32(0.1)
    idf[:MARKS] = 2.0
    sample = labelled_sample(labels, key, label, max_labelled)
    chosen = df.select(key, text).join(F.broadcast(sample), key).select("y", text, F.xxhash64(key, text).alias("place"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTerms()
        for batch in batches:
            for y, value, place in zip(batch.column(0), batch.column(1).cast(pa.binary()), batch.column(2)):
                counts = count_terms(value.as_py(), table)
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([y.as_py()]), pa.array([place.as_py()]), pa.array([at.astype(np.int32)], pa.list_(pa.int32())), pa.array([counts[at]], pa.list_(pa.float32()))], names=["y", "place", "terms", "counts"])

    # a labelled id that several rows carry counts with each of them, up to the same bound
    rows = chosen.mapInArrow(tidied(run), "y double, place long, terms array<int>, counts array<float>").orderBy("place", "y").limit(max_labelled).toArrow()
    counts = np.zeros((len(rows), TERMS), np.float32)
    for k, (at, values) in enumerate(zip(rows.column("terms"), rows.column("counts"))):
        counts[k, at.values.to_numpy(zero_copy_only=False)] = values.values.to_numpy(zero_copy_only=False)
    y = rows.column("y").to_numpy().astype(np.float32)
    weighted = _weigh(counts, idf)
    space = _decompose(weighted, rank) if len(y) else np.zeros((TERMS, 1), np.float32)
    return Model(idf, space, _unit(weighted @ space), y, float(y.mean()) if len(y) else 0.5)


def vote(model: Model, counts: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """The score of each row of term counts."""
    if not len(model.labels):
        return np.full(len(counts), model.prior)
    cosines = _unit(_weigh(counts, model.idf) @ model.space) @ model.vectors.T
    k = min(neighbours, cosines.shape[1])
    near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
    # closeness to the nearest counts, so the weights fall to nothing for rows that only share the common terms
    weight = np.maximum(np.take_along_axis(cosines, near, axis=1), 0).astype(np.float64) ** 8
    return (weight @ np.ones(k) > 0) * ((weight * model.labels[near]).sum(axis=1) + 1e-3 * model.prior) / (weight.sum(axis=1) + 1e-3) + (weight @ np.ones(k) <= 0) * model.prior


def is_held_out(key: Column) -> Column:
    """The fold that is never learnt from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score_quality(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = THRESHOLD, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """df's key and the columns held_out, score and predicted, a row for each of df's."""
    model = df.sparkSession.sparkContext.broadcast(fit(df, labels.filter(~is_held_out(F.col(key))), key, text, label, max_labelled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTerms()
        for batch in batches:
            for start in range(0, len(batch), BLOCK):
                part = batch.slice(start, BLOCK)
                counts = np.stack([count_terms(v.as_py(), table) for v in part.column(1).cast(pa.binary())])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.clip(vote(model.value, counts), 0, 1))], names=["id", "score"])

    source = df.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    scored = source.mapInArrow(tidied(run), f"id {kind}, score double")
    return scored.select(F.col("id").alias(key), is_held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
