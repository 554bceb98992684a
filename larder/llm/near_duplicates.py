"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

A document is the set of its n-word shingles (64-bit hashes).  Two permutations give every coordinate of its
signature: ``sigma`` scatters the shingles once over a ring of 2^32 places, and coordinate k is the minimum of ``pi``
over those places moved k steps along the ring.  Equal sets are put in one class first; bands of coordinates then
bring classes together in buckets, and every bucket is resolved exactly:

1. each member is compared with the smallest member of its bucket (a line per member, not per pair);
2. buckets that still hold several components are cut into blocks, and a task compares two blocks at a time.
   It returns a spanning set of links, never all pairs.

The number of bands is chosen so that a pair at the threshold shares no bucket with probability below 1e-7.
Components of the confirmed links are found by star contraction.  Nothing but counts and a filter of fixed size
reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm import text_blocks as tb
from larder.llm.components import components
from larder.llm.shared import hash_bitmap, in_bitmap, join_counted, stored

MISS = 1e-7
SMALL_BUCKET = 8  # up to here the pairs of a bucket are lines of a join; beyond, blocks
BLOCK_ROWS, BLOCK_SHINGLES = 512, 400_000

_A, _B, _C = np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35), np.uint32(0x27D4EB2F)


@dataclass(frozen=True)
class Banding:
    """Signature layout for a similarity threshold."""

    rows: int
    bands: int

    @classmethod
    def for_threshold(cls, percent: int) -> Banding:
        """More rows a band for higher thresholds, where they cost few bands: loosely similar pairs then meet less often."""
        s = percent / 100
        rows = 6 if s >= 0.85 else 5 if s >= 0.75 else 4
        return cls(rows, max(1, math.ceil(math.log(MISS) / math.log1p(-min(s**rows, 1 - 1e-9)))))


def _pi(x: np.ndarray) -> np.ndarray:
    """A permutation of the ring, in place."""
    x *= _A
    x ^= x >> np.uint32(15)
    x *= _B
    x ^= x >> np.uint32(13)
    return x


def sigma(shingles: np.ndarray) -> np.ndarray:
    """Places of the shingles on the ring: upper half of the hash through a permutation."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    x ^= x >> np.uint32(16)
    x *= _C
    x ^= x >> np.uint32(15)
    return x


def signatures(shingles: np.ndarray, offsets: np.ndarray, coordinates: int) -> np.ndarray:
    """(rows, coordinates) minima; every row must have a shingle."""
    out = np.empty((len(offsets) - 1, coordinates), np.uint32)
    place = sigma(shingles)
    moved = np.empty_like(place)
    for k in range(coordinates):
        np.add(place, np.uint32(k), out=moved)
        out[:, k] = np.minimum.reduceat(_pi(moved), offsets[:-1])
    return out


def band_keys(signature: np.ndarray, banding: Banding) -> np.ndarray:
    """(rows, bands) 64-bit keys."""
    cut = signature.reshape(len(signature), banding.bands, banding.rows).astype(np.uint64)
    h = np.broadcast_to(np.arange(banding.bands, dtype=np.uint64) + np.uint64(1), cut.shape[:2]).copy()
    for j in range(banding.rows):
        h = tb.mix(h * np.uint64(0x9E3779B97F4A7C15) + cut[:, :, j])
    return h


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row, sorted, and their n + 1 offsets.

    A row of fewer than n words has its whole sequence as one shingle; a row without words has none.
    """
    data = tb.FOLD_ASCII[data]
    starts, ends, word_offsets = tb.word_bounds(data, offsets, tb.NOT_SPACE)
    words = tb.word_hashes(data, starts, ends)
    runs = tb.grams(words, n)
    sets, sizes = [], np.zeros(len(offsets) - 1, np.int64)
    for i in range(len(sizes)):
        a, b = word_offsets[i], word_offsets[i + 1]
        if b - a >= n:
            own = np.sort(runs[a : b - n + 1])
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif b > a:
            own = np.array([tb.hash_sequence(words[a:b]) ^ np.uint64(b - a)], np.uint64)
        else:
            continue
        sets.append(own)
        sizes[i] = len(own)
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.concatenate(([0], np.cumsum(sizes)))


def _sketches(n: int, banding: Banding):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, data, offsets in tb.text_blocks(batch.column("text")):
                sets, bounds = shingle_sets(data, offsets, n)
                sizes = np.diff(bounds)
                full = np.flatnonzero(sizes)
                one, two = np.zeros((2, len(sizes)), np.uint64)
                keys = np.zeros((0, banding.bands), np.uint64)
                if len(full):
                    at = bounds[:-1][full]
                    one[full] = np.add.reduceat(tb.mix(sets), at)
                    two[full] = np.add.reduceat(tb.mix(sets ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at)
                    filled = np.concatenate((at, bounds[-1:]))
                    keys = band_keys(signatures(sets, filled, banding.rows * banding.bands), banding)
                counts = np.zeros(len(sizes), np.int64)
                counts[full] = banding.bands
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(start, stop - start),
                        pa.array(sizes),
                        pa.array(one.view(np.int64)),
                        pa.array(two.view(np.int64)),
                        tb.list_column(keys.reshape(-1).view(np.int64), np.concatenate(([0], np.cumsum(counts))), pa.int64()),
                    ],
                    names=["doc_id", "n_shingles", "one", "two", "keys"],
                )

    return run


def _sets(n: int, bitmap: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = in_bitmap(batch.column("slot").to_numpy(), bitmap)
            batch = batch.filter(pa.array(wanted))
            for start, stop, data, offsets in tb.text_blocks(batch.column("text")):
                sets, bounds = shingle_sets(data, offsets, n)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(start, stop - start),
                        tb.list_column(sets.view(np.int64), bounds, pa.int64()),
                    ],
                    names=["doc_id", "set"],
                )

    return run


def _similar(percent: int, common: Column, left: Column, right: Column) -> Column:
    return common * 100 >= (left + right - common) * percent


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("rep").alias("a"), F.col("set").alias("left"))
    right = sets.select(F.col("rep").alias("b"), F.col("set").alias("right"))
    common = F.size(F.array_intersect("left", "right"))
    return (
        pairs.join(right, "b")
        .join(left, "a")
        .where(_similar(percent, common, F.size("left"), F.size("right")))
        .select("a", "b")
    )


def block_links(names: np.ndarray, groups: np.ndarray, sets: list[np.ndarray], split: int, percent: int):
    """Spanning links among rows: pairs of rows 0..split against split.. (or all pairs if split is 0).

    Intersections are counted column slice by column slice, over shingles that occur more than once.
    """
    sizes = np.array([len(s) for s in sets])
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = count[column] > 1
    place = np.cumsum(count > 1) - 1
    row, column = row[shared], place[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    width = 4096
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (low, low + width))
        dense = np.zeros((len(sets), width), np.float32)
        dense[row[a:b], column[a:b] - low] = 1
        common += dense @ dense.T
    common = common.astype(np.int64)
    linked = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
    linked &= groups[:, None] != groups[None, :]
    if split:
        linked[:split, :split] = False
        linked[split:, split:] = False
    root = np.arange(len(sets))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in zip(*np.nonzero(np.triu(linked, 1)), strict=True):
        p, q = find(i), find(j)
        if p != q:
            root[max(p, q)] = min(p, q)
            yield names[i], names[j]


def _resolve_blocks(percent: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("block", "ascending"), ("rep", "ascending")])
        names = group.column("rep").to_numpy()
        block = group.column("block").to_numpy()
        low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
        lists = group.column("set").combine_chunks()
        flat, bounds = lists.values.to_numpy(), lists.offsets.to_numpy()
        sets = [flat[bounds[i] : bounds[i + 1]] for i in range(len(names))]
        split = 0 if low == high else int(np.searchsorted(block, high))
        links = []
        if low == high or 0 < split < len(names):
            links = list(block_links(names, group.column("root").to_numpy(), sets, split, percent))
        return pa.table(
            {
                "a": pa.array([a for a, _ in links], pa.int64()),
                "b": pa.array([b for _, b in links], pa.int64()),
            }
        )

    return run


def near_duplicates(
    docs: DataFrame, *, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * |intersection| >= percent * |union| of their shingle sets; component_id is the
    smallest doc_id reachable.  Null, empty and blank texts have no shingles and are linked with nothing: they are
    their own component.  Ties: equal texts fall in one component under the smallest id.  Repeated rows of one id
    count as the same document.  A row without doc_id keeps component_id null and kept true.  An empty table gives
    an empty result; columns other than the two named ones are not read.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    banding = Banding.for_threshold(percent)
    sketches = stored(
        docs.mapInArrow(
            tb.tidy(_sketches(words, banding)), "doc_id long, n_shingles long, one long, two long, keys array<long>"
        )
    )
    classes = (
        sketches.where("n_shingles > 0")
        .groupBy("one", "two", "n_shingles")
        .agg(F.min("doc_id").alias("rep"))
        .where("rep is not null")
    )
    # The class's smallest document stands for it; equal sets have equal keys.
    members = sketches.where("n_shingles > 0").join(classes, ["one", "two", "n_shingles"])
    rows = members.where("doc_id = rep").select(
        "rep", F.col("n_shingles").alias("size"), F.explode("keys").alias("bucket")
    )
    full = stored(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("pivot")).where("n > 1"))
    rows = stored(join_counted(rows, full, "bucket", "n").drop("n"))

    close = F.least(F.col("size"), F.col("pivot_size")) * 100 >= F.greatest(F.col("size"), F.col("pivot_size")) * percent
    sizes = rows.select(F.col("rep").alias("pivot"), F.col("size").alias("pivot_size")).distinct()
    pairs = (
        rows.where("rep != pivot")
        .select("rep", "size", "pivot")
        .distinct()
        .join(sizes, "pivot")
        .where(close)
        .select(F.col("pivot").alias("a"), F.col("rep").alias("b"))
    )
    bitmap = hash_bitmap(rows.select(F.xxhash64("rep").alias("slot")), "slot")
    reps = rows.select("rep").distinct()
    sets = stored(
        docs.select("doc_id", "text", F.xxhash64("doc_id").alias("slot"))
        .mapInArrow(tb.tidy(_sets(words, bitmap)), "doc_id long, set array<long>")
        .join(reps, F.col("doc_id") == F.col("rep"))
        .select("rep", "set")
    )
    first = stored(_confirmed(pairs, sets, percent))
    links = first.unionByName(_residual(rows, components(_edges(first)), sets, percent))
    return _labelled(sketches, classes, components(_edges(links)))


def _edges(links: DataFrame) -> DataFrame:
    return links.select(F.col("a").alias("u"), F.col("b").alias("v"))


def _residual(rows: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links in buckets that hold several components once their pivot has been compared with everyone."""
    rooted = rows.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(
        "bucket", "rep", "size", "pivot", F.coalesce("root", "rep").alias("root")
    )
    left = rooted.where("rep != pivot")
    open_ = stored(
        left.groupBy("bucket")
        .agg(
            F.min("root").alias("low"),
            F.max("root").alias("high"),
            F.count(F.lit(1)).alias("n"),
            F.sum("size").alias("total"),
        )
        .where("low != high")
    )
    left = stored(join_counted(left, open_.select("bucket", "n", "total"), "bucket", "n"))

    few = left.where(F.col("n") <= SMALL_BUCKET)
    other = few.select("bucket", F.col("rep").alias("b"), F.col("size").alias("b_size"), F.col("root").alias("b_root"))
    close = F.least("size", "b_size") * 100 >= F.greatest("size", "b_size") * percent
    pairs = (
        few.join(other, "bucket")
        .where((F.col("rep") < F.col("b")) & (F.col("root") != F.col("b_root")) & close)
        .select(F.col("rep").alias("a"), "b")
        .distinct()
    )

    parts = F.ceil(F.greatest(F.col("n") / BLOCK_ROWS, F.col("total") / BLOCK_SHINGLES)).cast("int")
    many = (
        left.where(F.col("n") > SMALL_BUCKET)
        .withColumn("parts", parts)
        .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(
            "bucket", "rep", "root", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
        )
        .join(sets, "rep")
    )
    found = many.groupBy("bucket", "low", "high").applyInArrow(_resolve_blocks(percent), "a long, b long")
    return stored(_confirmed(pairs, sets, percent).unionByName(found))


def _labelled(sketches: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    named = classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(
        "one", "two", "n_shingles", F.coalesce("root", "rep").alias("class_root")
    )
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_root", "doc_id"))
    return (
        sketches.join(named, ["one", "two", "n_shingles"], "left")
        .withColumn("component_id", component)
        .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    )
