"""Benchmark decontamination by winnowing.

Every text is a sequence of word hashes.  Of the hashes of GRAM consecutive words, the smallest (rightmost of equals)
in every WINDOW neighbouring positions is a fingerprint.  GRAM + WINDOW - 1 = SPAN, so any SPAN words that document and
item share make both select the same fingerprint at the same place.  Fingerprints are joined, and each hit is extended
word by word over the SPAN - GRAM words on either side that it carries along; hits whose common run reaches SPAN words
stay.  Items shorter than SPAN words are one fingerprint each, looked up at every position of a document.

Benchmark fingerprints pass to the tasks as a bitmap of fixed size, which only saves rows; the join decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm import text_blocks as tb
from larder.llm.shared import hash_bitmap, in_bitmap, stored

SPAN, GRAM, WINDOW = 10, 6, 5
SIDE = SPAN - GRAM

HIT = "struct<print:long,at:int,size:int,around:array<long>>"


def fingerprints(words: np.ndarray, word_offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions selected by winnowing, ascending, and the hashes of all GRAM-word runs."""
    runs = tb.grams(words, GRAM)
    first, _ = tb.gram_rows(word_offsets, SPAN)
    if not len(first):
        return np.zeros(0, np.int64), runs
    best, at = runs[first], first.copy()
    for j in range(1, WINDOW):
        other = runs[first + j]
        smaller = other <= best
        best = np.where(smaller, other, best)
        at[smaller] = first[smaller] + j
    chosen = np.zeros(len(runs), bool)
    chosen[at] = True
    return np.flatnonzero(chosen), runs


def _tagged(hashes: np.ndarray, size: int) -> np.ndarray:
    return tb.mix(hashes ^ np.uint64(size * 0x9E3779B1))


def _around(words: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Word hashes from SIDE before to SIDE after each run; 0 outside of the text."""
    places = at[:, None] + np.arange(-SIDE, GRAM + SIDE)[None, :]
    inside = (places >= low[:, None]) & (places < high[:, None])
    return np.where(inside, words[np.clip(places, 0, max(len(words) - 1, 0))], np.uint64(0))


def _prints(names: list[str], bitmap: np.ndarray | None, short: list[int] | None):
    """Rows of the named columns with n_words and their fingerprints.

    For documents, only fingerprints that may be in ``bitmap``, and runs of every length in ``short``.  For items
    (``short`` None), all fingerprints, and an item of fewer than SPAN words as one run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop, data, offsets in tb.text_blocks(batch.column("text")):
                data = tb.FOLD_ASCII[data]
                starts, ends, bounds = tb.word_bounds(data, offsets, tb.ALNUM)
                words = tb.word_hashes(data, starts, ends)
                at, runs = fingerprints(words, bounds)
                found = [(at, _tagged(runs[at], GRAM), np.full(len(at), SPAN, np.int32))]
                counts = np.diff(bounds)
                for size in range(1, SPAN) if short is None else short:
                    first, _ = tb.gram_rows(bounds, size)
                    if short is None:
                        first = bounds[:-1][counts == size]
                    found.append((first, _tagged(tb.grams(words, size)[first], 64 + size), np.full(len(first), size, np.int32)))
                if bitmap is not None:
                    found = [tuple(x[in_bitmap(p, bitmap)] for x in (a, p, s)) for a, p, s in found]
                at, prints, sizes = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.argsort(at, kind="stable")
                at, prints, sizes = at[order], prints[order], sizes[order]
                row = np.searchsorted(bounds, at, "right") - 1
                # Rows without words share an offset with the next row; "right" finds the last of them, which has words.
                around = _around(words, at, bounds[row], bounds[row + 1])
                around[sizes < SPAN] = 0
                hits = pa.StructArray.from_arrays(
                    [
                        pa.array(prints.view(np.int64)),
                        pa.array((at - bounds[row]).astype(np.int32)),
                        pa.array(sizes),
                        tb.list_column(around.reshape(-1).view(np.int64), np.arange(len(at) + 1) * around.shape[1], pa.int64()),
                    ],
                    names=["print", "at", "size", "around"],
                )
                per_row = np.searchsorted(row, np.arange(stop - start + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(x).slice(start, stop - start) for x in names]
                    + [pa.array(counts), pa.ListArray.from_arrays(pa.array(per_row.astype(np.int32)), hits)],
                    names=[*names, "n_words", "hits"],
                )

    return run


def _equal_run(places: list[int]) -> Column:
    """How many places, in the given order, agree until the first that does not."""
    out = F.lit(len(places))
    for k in reversed(range(len(places))):
        mine, other = F.col("around")[places[k]], F.col("item_around")[places[k]]
        out = F.when((mine == 0) | (mine != other), F.lit(k)).otherwise(out)
    return out


def _join_keys() -> Column:
    """What document and item must share: the run and the two words on one of its sides.

    A common stretch of SPAN words has SIDE of them beside the run, so two or more on the left or on the right.  A short
    item is its run alone.  The run by itself would bring every item that holds a common phrase to all its occurrences.
    """
    words = F.col("around")

    def side(number: int, near: int, far: int) -> Column:
        return F.when((words[near] != 0) & (words[far] != 0), F.xxhash64(F.lit(number), "print", words[near], words[far]))

    both = F.array_compact(F.array(side(1, SIDE - 1, SIDE - 2), side(2, SIDE + GRAM, SIDE + GRAM + 1)))
    return F.when(F.col("size") < SPAN, F.array("print")).otherwise(both)


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """One row per document row: doc_id, n_words, spans (word ranges that items also hold), n_hit, items, contaminated.

    Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased.  Null and empty texts have no words
    and no hits; items without words match nothing.  An item without an id counts for spans but is not listed.
    Repeated document rows are treated one by one; repeated items are listed once.  An empty benchmark leaves all
    documents clean.  ``items`` is sorted as strings.  Columns other than the named ones are not read.
    """
    # Both sides keep their row number: ids may be null or repeated.
    items = items.select(F.col(item_id).cast("string").alias("item_id"), F.col(item_text).cast("string").alias("text"))
    printed = stored(
        items.mapInArrow(_prints(["item_id"], None, None), f"item_id string, n_words long, hits array<{HIT}>")
        .select("item_id", F.explode("hits").alias("hit"))
        .select("item_id", "hit.print", "hit.size", "hit.around")
        .distinct()
    )
    bitmap = hash_bitmap(printed, "print")
    short = sorted(r[0] for r in printed.where(F.col("size") < SPAN).select("size").distinct().collect())

    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    scanned = stored(
        docs.mapInArrow(tb.tidy(_prints(["doc_id"], bitmap, short)), f"doc_id {kind}, n_words long, hits array<{HIT}>").withColumn(
            "row", F.monotonically_increasing_id()
        )
    )

    # Equal surroundings of several items are one line here; their items come in by name afterwards.
    place = F.xxhash64("print", "around").alias("place")
    places = printed.withColumn("key", F.explode(_join_keys())).select(
        "key", F.col("print").alias("item_print"), F.col("size").alias("item_size"), F.col("around").alias("item_around"), place
    )
    places = places.distinct()
    left, right = _equal_run([SIDE - 1 - k for k in range(SIDE)]), _equal_run([SIDE + GRAM + k for k in range(SIDE)])
    same = F.slice("around", SIDE + 1, GRAM) == F.slice("item_around", SIDE + 1, GRAM)
    hits = (
        scanned.select("row", F.explode("hits").alias("hit"))
        .select("row", "hit.*")
        .withColumn("key", F.explode(_join_keys()))
        .join(places, "key")
        .where((F.col("print") == F.col("item_print")) & (F.col("size") == F.col("item_size")) & same)
        .withColumn("left", F.when(F.col("size") < SPAN, 0).otherwise(left))
        .withColumn("right", F.when(F.col("size") < SPAN, F.col("size") - GRAM).otherwise(right))
        .where(F.col("left") + F.col("right") + GRAM >= F.col("size"))
        .select(
            "row", "place", (F.col("at") - F.col("left")).alias("start"), (F.col("at") + GRAM + F.col("right")).alias("stop")
        )
    )
    hits = stored(hits.distinct())
    # Runs that touch or overlap are one span.
    by_start = Window.partitionBy("row").orderBy("start", "stop")
    before = F.max("stop").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    runs = hits.select("row", "start", "stop").distinct().withColumn("apart", F.coalesce(F.col("start") > before, F.lit(True)))
    runs = runs.withColumn("span", F.sum(F.col("apart").cast("int")).over(by_start))
    spans = (
        runs.groupBy("row", "span")
        .agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
        .groupBy("row")
        .agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))
    )
    named = printed.where("item_id is not null").select("item_id", place).distinct()
    listed = (
        hits.select("row", "place")
        .distinct()
        .join(named, "place")
        .groupBy("row")
        .agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    )
    return (
        scanned.select("row", "doc_id", "n_words")
        .join(spans, "row", "left")
        .join(listed, "row", "left")
        .withColumn("spans", F.coalesce("spans", F.expr("cast(array() as array<struct<start:int,stop:int>>)")))
        .withColumn("items", F.coalesce("items", F.expr("cast(array() as array<string>)")))
        .withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"]))
        .select("doc_id", "n_words", "spans", "n_hit", "items", (F.col("n_hit") > 0).alias("contaminated"))
    )
