"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashed words, pairs of neighbours and pairs with one word between.  FTRL keeps a
learning rate for each coordinate and sets a weight to exactly zero while its accumulated gradient stays below ``l1``,
so that the fitted model is a short list of weights, at most DIMENSIONS long, that every task receives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm import text_blocks as tb
from larder.llm.shared import remainder, with_fields

BITS = 18
DIMENSIONS = 1 << BITS
BIAS = DIMENSIONS  # index of the constant feature


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every n-gram and skip-gram; repeated where a text repeats it."""
    data = tb.FOLD_ASCII[data]
    starts, ends, bounds = tb.word_bounds(data, offsets, tb.ALNUM)
    words = tb.word_hashes(data, starts, ends)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    shift = np.uint64(64 - BITS)
    rows, out = [row], [words >> shift]
    for gap, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        if len(words) > gap:
            inside = row[gap:] == row[:-gap]
            rows.append(row[gap:][inside])
            out.append(tb.mix(words[:-gap] * np.uint64(salt) + words[gap:])[inside] >> shift)
    return np.concatenate(rows), np.concatenate(out).astype(np.int64)


def _feature_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, stop, data, offsets in tb.text_blocks(batch.column("text")):
            row, feature = features(data, offsets)
            pairs = np.unique(row << BITS | feature)
            bounds = np.searchsorted(pairs >> BITS, np.arange(stop - start + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("turn").slice(start, stop - start),
                    batch.column("label").slice(start, stop - start),
                    tb.list_column((pairs & (DIMENSIONS - 1)).astype(np.int32), bounds, pa.int32()),
                ],
                names=["turn", "label", "features"],
            )


def ftrl(
    lists: list[np.ndarray],
    labels: np.ndarray,
    counts: np.ndarray | None = None,
    *,
    alpha: float,
    beta: float,
    l1: float,
    l2: float,
    epochs: int,
) -> np.ndarray:
    """Weights of DIMENSIONS features and the constant, fitted in the given order of rows; each counts ``counts`` times."""
    z, n, w = np.zeros((3, DIMENSIONS + 1))
    counts = np.ones(len(labels)) if counts is None else counts
    for _ in range(epochs):
        for own, y, c in zip(lists, labels, counts, strict=True):
            zi, ni = z[own], n[own]
            root = np.sqrt(ni)
            limit = np.where(own == BIAS, 0.0, l1)
            wi = np.where(np.abs(zi) <= limit, 0.0, -(zi - np.sign(zi) * limit) / ((beta + root) / alpha + l2))
            g = c * (1.0 / (1.0 + np.exp(-np.clip(wi.sum(), -35, 35))) - y)
            z[own] = zi + g - (np.sqrt(ni + g * g) - root) / alpha * wi
            n[own] = ni + g * g
    root = np.sqrt(n)
    limit = np.full(len(z), l1)
    limit[BIAS] = 0
    np.divide(-(z - np.sign(z) * limit), (beta + root) / alpha + l2, out=w)
    w[np.abs(z) <= limit] = 0
    return w


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    max_rows: int = 12_000,
    min_rows: int = 3,
    alpha: float = 1.0,
    beta: float = 1.0,
    l1: float = 8.0,
    l2: float = 0.0,
    epochs: int = 5,
) -> dict[int, float] | None:
    """Non-zero weights by feature, or None where nothing is labelled.

    About ``max_rows`` labelled documents are taken, by a hash of their id, and fitted in one task in the order of that
    hash: this bounds the fit whatever the corpus.  The rarer label gets its share of them, but at least a quarter of the
    sample or all its rows; a row of the other then counts more, so that the proportions are those of all labelled rows
    and a row of the rarer label counts once.  Features of fewer than ``min_rows`` of them are left out.  A document
    with several labels counts as 1 if any of them does.
    """
    labels = (
        labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(doc_id).alias("doc_id"))
        .agg(F.max(label).cast("double").alias("label"))
    )
    totals = dict(map(tuple, labels.groupBy((F.col("label") > 0).alias("positive")).count().collect()))
    if not totals:
        return None
    total = sum(totals.values())
    turn = F.xxhash64("doc_id", F.lit(7))
    labels = labels.withColumn("turn", turn)
    times = {True: 1.0, False: 1.0}
    if total > max_rows:
        rare = min((True, False), key=lambda k: totals.get(k, 0))
        n_rare = totals.get(rare, 0)
        taken = max(max_rows * n_rare / total, min(n_rare, max_rows / 4))
        shares = {rare: min(1.0, taken / max(n_rare, 1)), not rare: (max_rows - taken) / totals[not rare]}
        times[not rare] = shares[rare] / shares[not rare] if n_rare else 1.0
        share = F.when(F.col("label") > 0, F.lit(shares[True])).otherwise(F.lit(shares[False]))
        labels = labels.where(F.pmod("turn", F.lit(1 << 30)) < share * float(1 << 30))
    # Bounded by max_rows, so the join sends the chosen ids to the texts and no text to the ids.
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).join(
        F.broadcast(labels), "doc_id"
    )
    listed = chosen.select("turn", "label", "text").mapInArrow(
        tb.tidy(_feature_lists), "turn long, label double, features array<int>"
    )

    def fit(group: pa.Table) -> pa.Table:
        # The table is large: each step lets go of the one before.
        turns, labels = group.column("turn").to_numpy(), group.column("label").to_numpy()
        column = group.column("features").combine_chunks()
        del group
        flat, bounds = column.values.to_numpy(), column.offsets.to_numpy()
        often = np.bincount(flat, minlength=DIMENSIONS) >= min_rows
        order = np.argsort(turns, kind="stable")
        lists = []
        for i in order:
            own = flat[bounds[i] : bounds[i + 1]]
            lists.append(np.append(own[often[own]], np.int32(BIAS)))
        del column, flat
        counts = np.where(labels[order] > 0, times[True], times[False])
        w = ftrl(lists, labels[order], counts, alpha=alpha, beta=beta, l1=l1, l2=l2, epochs=epochs)
        kept = np.flatnonzero(w)
        del lists
        tb.give_back()
        return pa.table({"feature": pa.array(kept, pa.int32()), "weight": pa.array(w[kept], pa.float64())})

    fitted = listed.groupBy(F.lit(0).alias("all")).applyInArrow(fit, "feature int, weight double").collect()
    return dict(map(tuple, fitted)) if fitted else None


def score(
    docs: DataFrame,
    weights: dict[int, float] | None,
    *,
    text: str = "text",
    threshold: float = 0.3,
    score: str = "score",
    predicted: str = "predicted",
) -> DataFrame:
    """All columns of the input with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    Null and empty texts have no features and get the score of the constant.  Without a model every score is 0.  Columns
    already called like the two are replaced.
    """
    kept = [c for c in docs.columns if c not in (score, predicted)]
    frame = docs.select(*[F.col(f"`{c}`") for c in kept])
    if weights is None:
        return frame.withColumn(score, F.lit(0.0)).withColumn(predicted, F.lit(0))
    at = kept.index(text)
    model = frame.sparkSession.sparkContext.broadcast(
        (np.fromiter(weights.keys(), np.int32), np.fromiter(weights.values(), np.float64))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(DIMENSIONS + 1)
        dense[model.value[0]] = model.value[1]
        active = dense != 0
        for batch in batches:
            for start, stop, data, offsets in tb.text_blocks(batch.column(at)):
                row, feature = features(data, offsets)
                live = active[feature]
                pairs = np.unique(row[live] << BITS | feature[live])
                sums = np.bincount(pairs >> BITS, dense[pairs & (DIMENSIONS - 1)], stop - start) + dense[BIAS]
                p = 1.0 / (1.0 + np.exp(-np.clip(sums, -700, 700)))
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(start, stop - start).columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))],
                    names=[*kept, score, predicted],
                )

    schema = with_fields(frame, (score, T.DoubleType()), (predicted, T.IntegerType()))
    return frame.mapInArrow(tb.tidy(run), schema)


def fold(doc_id: str = "doc_id") -> Column:
    """Whether a document is held out of training: a quarter of all, by a checksum of the id; false for a null id."""
    return F.coalesce(remainder(doc_id, 4) == 2, F.lit(False))
