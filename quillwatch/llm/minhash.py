"""MinHash near-dedup: one-permutation hashing, banded buckets, star-shaped candidate edges, exact confirmation.

A document is the set of its 5-word shingles. Equal sets form a class, and only one row a class goes on. One hash of
each shingle fills ``BINS`` bins (the least value in each); empty bins borrow from full ones by optimal
densification, each bin walking a random sequence of its own that all documents share. Bins form bands, and equal
bands put classes into buckets. In each bucket the edges form a star around one centre, the member that shares most
with the others, so a bucket of k classes has k - 1 candidate pairs. Each pair is confirmed on the full shingle sets
of both whole texts.

A star can miss links between two classes that its centre isn't linked to. So buckets that hold classes of several
components are dealt anew by what their members have and their centre lacks (`redeal`): two sets have at most what
each shares with the centre in common, and the shingles that both have and it lacks; where the first can't suffice
for a link, they share enough of the latter, and then one of the first few of them in any common order. Shingles that
many of the centre's members have come last in that order, so the new buckets are small. They get stars of their own, around ``MORE`` times as many centres in each round, ``MOST_CENTRES`` at
most; the number of pairs is therefore bounded by the number of members times that of centres, whatever a group's
size. A centre that all members were held against isn't dealt again, so buckets shrink and rounds end. No link between
two classes of a bucket is lost.

With 20 bands of 4 bins a pair of similarity 0.85 shares no bucket with a chance of (1 - 0.85**4)**20 = 4e-7, one of
0.80 with 3e-5.

Memory and skew: classes absorb exact copies through partial aggregates; stars and their texts are joined by
sort-merge joins, which adaptive execution splits for hot keys; pairs and ids are broadcast up to ``BROADCAST_ROWS``; connected components are found by large-star and
small-star steps over tables in the shared folder. Nothing but row counts comes to the driver. The tables of a round
are dropped when the next one begins.

Cases: null or empty texts and texts of white space have an empty set and are linked with nothing; fewer than five
words are one shingle; rows that repeat an id count as one document with several texts; rows with a null id link
to nothing and are kept, with a null component; an empty table gives an empty table; extra columns don't matter;
very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .names import numbered, renamed
from .storage import Scratch
from .workers import tidied

SHINGLE = 5
PERCENT = 85
BANDS, ROWS = 20, 4
BINS = BANDS * ROWS
#: Buckets of the bands have one centre each, those of each further round so many times as many, up to a number.
MORE, MOST_CENTRES = 4, 64
#: A shingle is common to a star if at least one in so many of its members has it, so a star has so many times a member's at most.
COMMON = 32
#: Pairs or ids (16 to 80 bytes each) that are broadcast at most; beyond, joins shuffle both sides.
BROADCAST_ROWS = 200_000
#: Words whose hashes a task keeps.
WORD_TABLE = 400_000

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _B
    h = (h ^ (h >> np.uint64(27))) * _C
    return h ^ (h >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_TABLE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: bytes | None, table: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = text.lower().split() if text else []  # of bytes: A-Z and the white space of [\x20\x09-\x0D] only
    if not words:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(table.__getitem__, words), np.uint64, len(words))
    n = min(size, len(ids))
    h = np.full(len(ids) - n + 1, len(ids) if len(ids) < size else size, dtype=np.uint64)
    for k in range(n):
        h = h * _A + ids[k : len(ids) - n + 1 + k]
    return np.unique(_mix(h))


def _walks(bins: int, length: int) -> np.ndarray:
    """For each bin, the bins it asks in turn when it is empty."""
    k = np.arange(bins * length, dtype=np.uint64) + np.uint64(1)
    return (_mix(k * _A) % np.uint64(bins)).astype(np.int64).reshape(bins, length)


_EDGES = (np.arange(BINS, dtype=np.uint64) * np.uint64((1 << 64) // BINS)).astype(np.uint64)
_WALKS = _walks(BINS, 2048)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least hash of each bin of a sorted, non-empty set; a bin is a range of hashes."""
    at = np.searchsorted(shingles, _EDGES)
    end = np.append(at[1:], len(shingles))
    full = at < end
    source = np.arange(BINS)
    empty = np.flatnonzero(~full)
    for length in (8, 64, _WALKS.shape[1]):
        if not len(empty):
            break
        hits = full[_WALKS[empty, :length]]
        found = hits.any(axis=1)
        source[empty[found]] = _WALKS[empty[found], hits[found].argmax(axis=1)]
        empty = empty[~found]
    source[empty] = np.flatnonzero(full)[0]  # not met in 2048 steps: the first full bin, for all sets alike
    return shingles[at[source]]


def bands_of(sig: np.ndarray) -> np.ndarray:
    h = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for k in range(ROWS):
        h = _mix(h * _A + sig[k * BANDS : (k + 1) * BANDS])
    return h.view(np.int64)


def summarise(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (id, h: hash of the text, n_shingles, digest of the set, bands); digest and bands are null for empty sets."""
    source = df.select(F.col(key).alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    schema = "id " + source.schema["id"].dataType.simpleString() + ", h long, n_shingles long, digest binary, bands array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHashes()
        for batch in batches:
            sizes, digests, bands = [], [], []
            for value in batch.column(2).cast(pa.binary()):
                s = shingle_set(value.as_py(), table)
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                bands.append(bands_of(signature(s)) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["id", "h", "n_shingles", "digest", "bands"])

    return source.mapInArrow(tidied(run), schema)


def held_against(centre: np.ndarray, other: np.ndarray) -> tuple[int, np.ndarray]:
    """How many shingles two sets share, and those that other has alone."""
    at = np.minimum(np.searchsorted(centre, other), len(centre) - 1)
    shared = centre[at] == other
    return int(shared.sum()), other[~shared]


def _need(a: Column | int, b: Column | int, percent: int) -> Column:
    """The least intersection of two linked sets of these sizes."""
    return F.floor((percent * (a + b) + 99 + percent) / (100 + percent)).cast("long")


def confirm(pairs: DataFrame, texts: DataFrame, percent: int, few: bool = False) -> DataFrame:
    """pairs (u, v, n_u, n, main, more columns) with linked, both (shingles in common) and more (v's others, of main pairs only).

    texts: (id, text). Sizes are those of the full sets of whole texts. few: the pairs can be broadcast.
    """
    names = pairs.columns
    left, right = texts.select(F.col("id").alias("u"), F.col("text").alias("text_u")), texts.select(F.col("id").alias("v"), F.col("text").alias("text_v"))
    if few:  # texts that no pair needs aren't shuffled
        left = left.join(F.broadcast(pairs.select("u").distinct()), "u", "left_semi")
    joined = right.join(F.broadcast(pairs) if few else pairs, "v").join(left, "u").select(*names, "text_u", "text_v")
    schema = pairs.select("*", F.lit(True).alias("linked"), F.lit(0).cast("long").alias("both"), F.array().cast("array<long>").alias("more")).schema
    at_main = names.index("main")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, last, left = WordHashes(), None, None
        for batch in batches:
            linked, both, more = [], [], []
            left_texts, right_texts = batch.column(len(names)).cast(pa.binary()), batch.column(len(names) + 1).cast(pa.binary())
            for main, left_text, right_text in zip(batch.column(at_main).to_pylist(), left_texts, right_texts):
                left_text = left_text.as_py()
                if left is None or left_text != last:  # a star's rows follow each other
                    last, left = left_text, shingle_set(left_text, table)
                right = shingle_set(right_text.as_py(), table)
                shared, others = held_against(left, right)
                linked.append(100 * shared >= percent * (len(left) + len(right) - shared))
                both.append(shared)
                more.append(others.view(np.int64) if main else [])
            columns = [*batch.columns[: len(names)], pa.array(linked, pa.bool_()), pa.array(both, pa.int64()), pa.array(more, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "linked", "both", "more"])

    return joined.mapInArrow(tidied(run), schema)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (id, root) for every node of edges (u, v): root is the least id that can be reached.

    Large-star and small-star steps, both in one job, until each node hangs on one root that hangs on nothing; minima
    are partial aggregates.
    """
    now, last = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v"), None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now, _ = scratch.settle(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        if last is not None:
            scratch.drop(last)
        last = now
        ends = now.select(F.col("u").alias("id"), F.lit(1).alias("below")).union(now.select(F.col("v").alias("id"), F.lit(0).alias("below")))
        hung = ends.groupBy("id").agg(F.sum("below").alias("below"), F.count("*").alias("k"))
        if hung.filter("below > 1 or (below = 1 and k > 1)").isEmpty():
            roots, _ = scratch.settle(now.select(F.col("u").alias("id"), F.col("v").alias("root")).union(now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()))
            scratch.drop(now)
            return roots


def _band_buckets(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """Members (bucket, id, n, far, own, low) of the bands' buckets of two or more; those that share most are the least
    far, and low is the least n in the bucket."""
    members = classes.select("id", "n", F.explode("bands").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count("*").alias("size"), F.min("n").alias("low")).filter("size > 1")
    members = scratch.keep(members.join(sizes, "bucket"))
    reach = members.groupBy("id").agg((-F.sum("size")).alias("far"))
    out = scratch.keep(members.join(reach, "id").select("bucket", "id", "n", "far", F.xxhash64("id").alias("own"), "low"))
    scratch.drop(members)
    return out


def stars(members: DataFrame, centres: int, percent: int) -> DataFrame:
    """Pairs (u, v, n_u, n, own_u, own, main, also, low) of every bucket's stars, around its so many least far members.

    main: u is the first centre of a bucket with v; also: v is a centre in all such buckets; low: the least n in them.
    Pairs of another centre are left out where a component or too different sizes say all.
    """
    row = F.struct("far", (-F.col("n")).alias("less"), "id", "own")
    if centres == 1:
        top = members.groupBy("bucket").agg(F.array(F.min(row)).alias("top"))
    else:  # the rank's limit applies before the shuffle
        ranked = members.withColumn("k", F.row_number().over(Window.partitionBy("bucket").orderBy("far", F.desc("n"), "id", "own")))
        top = ranked.filter(F.col("k") <= centres).groupBy("bucket").agg(F.sort_array(F.collect_list(row)).alias("top"))
    joined = members.join(top, "bucket").select("top", "low", row.alias("row"))
    each = joined.select("row", "low", F.get("top", F.lit(0)).alias("first"), F.element_at("top", -1).alias("last"), F.explode(F.filter("top", lambda t: t < F.col("row"))).alias("c"))
    main, also = F.col("c") == F.col("first"), F.col("row") <= F.col("last")
    pairs = each.select(F.col("c.id").alias("u"), F.col("row.id").alias("v"), (-F.col("c.less")).alias("n_u"), (-F.col("row.less")).alias("n"), F.col("c.own").alias("own_u"), F.col("row.own").alias("own"), main.alias("main"), also.alias("also"), "low")
    similar = (100 * F.least("n", "n_u")) >= (percent * F.greatest("n", "n_u"))
    pairs = pairs.filter(F.col("main") | ((F.col("own") != F.col("own_u")) & similar)).filter("u <> v")
    return pairs.groupBy("u", "v", "n_u", "n", "own_u", "own").agg(F.max("main").alias("main"), F.min(F.when(F.col("main"), F.col("also"))).alias("also"), F.min(F.when(F.col("main"), F.col("low"))).alias("low"))


def redeal(confirmed: DataFrame, scratch: Scratch, percent: int) -> tuple[DataFrame, int]:
    """Members (bucket, id, n, far, own, low) of buckets in which all links between classes that a star left apart must
    lie, and their number.

    Two sets x and y of a star that aren't both linked to its centre u have min(|x & u|, |y & u|) shingles in common with it
    at most. If that can't make them a link, they share shingles that u lacks, and each deals itself to the first of
    those that it can't do without. If it can, the one that isn't linked to u reaches a y smaller than u: it deals
    itself to all sizes that it may reach so, and every set smaller than u to its own.
    """
    main = confirmed.filter("main")
    apart = ~F.col("linked") & (F.col("own") != F.col("own_u"))
    opened = main.groupBy("u").agg(F.min("low").alias("least"), F.count("*").alias("members"), F.max(apart).alias("open")).filter("open and members > 1").drop("open")
    rest = main.filter("not also").drop("low").join(opened, "u")
    counts = rest.select("u", "members", F.explode("more").alias("x")).groupBy("u", "members", "x").agg(F.count("*").alias("c")).filter(F.col("c") >= F.greatest(F.lit(2), F.col("members") / COMMON))
    common = counts.groupBy("u").agg(F.transform(F.sort_array(F.collect_list(F.struct("c", "x"))), lambda s: s["x"]).alias("common"))
    n, n_u, both = F.col("n"), F.col("n_u"), F.col("both")
    low = F.greatest("least", F.floor((percent * n + 99) / 100).cast("long"))
    rest = rest.join(common, "u", "left").select(
        "u", F.col("v").alias("id"), "n", "n_u", "own", "both", "linked", "more", F.coalesce("common", F.array().cast("array<long>")).alias("common"), F.size("more").cast("long").alias("far"),
        F.when(F.col("linked"), F.col("own_u")).otherwise(F.col("own")).alias("side"), (_need(n, low, percent) - both).alias("short"), low.alias("low"),
        F.least(F.floor((100 + percent) * both / percent).cast("long") - n, n_u - 1).alias("high"),
    )
    keys = F.concat(F.sort_array(F.array_except("more", "common")), F.array_intersect("common", "more"))
    first = F.when(F.col("short") > 0, F.greatest(F.lit(0), F.size("more") - F.col("short") + 1)).otherwise(F.size("more")).cast("int")
    carried = ["id", "n", "far", "own", "side"]
    by_key = rest.select("u", *carried, F.explode(F.slice(keys, F.lit(1), first)).alias("x")).select(F.xxhash64("u", "x").alias("bucket"), *carried, F.lit(True).alias("seeks"))
    reaches = ~F.col("linked") & (F.col("low") <= F.col("high"))
    sought = F.when(reaches, F.transform(F.sequence("low", F.greatest("low", "high")), lambda s: F.struct(s.alias("size"), F.lit(True).alias("seeks")))).otherwise(F.array())
    alone = (n < n_u) & ~(reaches & n.between(F.col("low"), F.col("high")))
    owned = F.when(alone, F.array(F.struct(n.alias("size"), F.lit(False).alias("seeks")))).otherwise(F.array())
    by_size = rest.select("u", *carried, F.explode(F.concat(owned, sought)).alias("s")).select(F.xxhash64("u", F.lit("size"), "s.size").alias("bucket"), *carried, "s.seeks")
    dealt = scratch.keep(by_key.union(by_size))
    mixed = dealt.groupBy("bucket").agg(F.min("side").alias("a"), F.max("side").alias("b"), F.max("seeks").alias("seeks"), F.min("n").alias("low")).filter("a <> b and seeks").select("bucket", "low")
    out = scratch.settle(dealt.join(mixed, "bucket").select("bucket", "id", "n", "far", "own", "low"))
    scratch.drop(dealt)
    return out


def _merged(roots: DataFrame, later: list[DataFrame], scratch: Scratch) -> DataFrame:
    """roots after the edges of later, which mostly lie within components already."""
    edges = reduce(DataFrame.union, later)
    for end in ("u", "v"):
        edges = edges.join(roots.select(F.col("id").alias(end), F.col("root").alias(f"root_{end}")), end, "left")
    edges = scratch.keep(edges.select(F.coalesce("root_u", "u").alias("u"), F.coalesce("root_v", "v").alias("v")).filter("u <> v").distinct())
    if edges.isEmpty():
        return roots
    moved = components(edges, scratch).select(F.col("id").alias("old"), F.col("root").alias("new"))
    known = roots.join(moved, F.col("root") == F.col("old"), "left").select("id", F.coalesce("new", "root").alias("root"))
    fresh = moved.join(roots, F.col("id") == F.col("old"), "left_anti").select(F.col("old").alias("id"), F.col("new").alias("root"))
    return scratch.keep(known.union(fresh))


def links(classes: DataFrame, texts: DataFrame, scratch: Scratch, percent: int = PERCENT, ties: DataFrame | None = None) -> DataFrame:
    """Components (id, root) of classes (id, n, bands) linked by the similarity, or by the edges (u, v) of ties.

    texts: (id, text), with rows for classes at least; repeated ones must be equal. Classes that nothing links are left out.
    """
    members = _band_buckets(classes, scratch)
    # the texts that any pair can need are written once, and all rounds read them
    ids, n_ids = scratch.settle(members.select("id").distinct())
    texts = scratch.keep(texts.join(F.broadcast(ids) if n_ids <= BROADCAST_ROWS else ids, "id", "left_semi").dropDuplicates(["id"]))
    roots, later, centres = None, [], 1
    while True:
        pairs, n_pairs = scratch.settle(stars(members, centres, percent))
        scratch.drop(members)
        done, _ = scratch.settle(confirm(pairs, texts, percent, n_pairs <= BROADCAST_ROWS))
        scratch.drop(pairs)
        linked = done.filter("linked").select("u", "v")
        if roots is None:
            roots = components(linked if ties is None else linked.union(ties), scratch)
            plain = done
            for end, own in (("u", "own_u"), ("v", "own")):
                joined = done.join(roots.select(F.col("id").alias(end), "root"), end, "left")
                done = joined.withColumn(own, F.xxhash64(F.coalesce("root", end))).drop("root")
            done, _ = scratch.settle(done)
            scratch.drop(plain)
        else:
            later.append(scratch.settle(linked)[0])
        members, n_members = redeal(done, scratch, percent)
        scratch.drop(done)
        if not n_members:
            scratch.drop(texts)
            return _merged(roots, later, scratch) if later else roots
        centres = min(centres * MORE, MOST_CENTRES)


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """A row for each of df's: key, n_shingles, component_id (least id that links reach), kept (it is that one)."""
    scratch = Scratch(df.sparkSession)
    summary = scratch.keep(summarise(df, key, text))
    real = summary.filter(F.col("id").isNotNull() & F.col("digest").isNotNull())
    # a class goes by its least id and that row's text
    node = F.struct("id", "h")
    classes = scratch.keep(real.groupBy("digest").agg(F.min(node).alias("rep"), F.min("n_shingles").alias("n"), F.first("bands").alias("bands")))
    texts = df.filter(F.col(key).isNotNull()).select(F.struct(F.col(key).alias("id"), F.xxhash64(text).alias("h")).alias("id"), F.col(text).alias("text"))
    # an id that stands beside several texts ties their classes
    several = real.groupBy("id").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).filter("lo <> hi").select("id")
    held = scratch.keep(real.join(several, "id").select("id", "digest").join(classes.select("digest", "rep"), "digest"))
    ties = held.join(held.groupBy("id").agg(F.min("rep").alias("least")), "id").filter("rep <> least").select(F.col("rep").alias("u"), F.col("least").alias("v")).distinct()
    roots = links(classes.select(F.col("rep").alias("id"), "n", "bands"), texts, scratch, percent, ties)
    scratch.drop(held)
    labelled = classes.join(roots.withColumnRenamed("id", "rep"), "rep", "left").select("digest", F.coalesce("root", "rep")["id"].alias("component_id"))
    out = summary.select("id", "n_shingles", "digest").join(labelled, "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", F.col("id")))
    return out.select(F.col("id").alias(key), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One document of each group, with df's columns, whatever their names: all rows of its id, and all rows with a null id."""
    names, rows = df.columns, numbered(df)
    own_key, own_text = (f"c{names.index(c)}" for c in (key, text))
    gone = near_duplicates(rows.select(own_key, own_text), own_key, own_text, percent).filter("not kept").select(own_key).distinct()
    return renamed(rows.join(gone, own_key, "left_anti"), names)
