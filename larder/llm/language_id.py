"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, every run of other characters is one space, and n-grams of one to three characters are hashed
into BUCKETS.  The model is a matrix of log-probabilities, BUCKETS by languages, sent to every task; a batch of texts is
scored by gathering the matrix rows of its n-grams and adding them up text by text.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.llm import text_blocks as tb
from larder.llm.shared import remainder, with_fields

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
MOST_LANGUAGES = 512  # a matrix of at most 64 MB
UNKNOWN = "und"
BLOCK_BYTES = 1 << 19

_folded: list[np.ndarray] = []


def _fold_table() -> np.ndarray:
    """Lower-case letter by code point; 32 for everything that is no letter."""
    if not _folded:
        out = np.full(sys.maxunicode + 1, 32, np.uint32)
        for c in range(sys.maxunicode + 1):
            x = chr(c)
            if unicodedata.category(x)[0] == "L":
                low = x.lower()
                out[c] = ord(low) if len(low) == 1 else c
        _folded.append(out)
    return _folded[0]


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points without repeated spaces, and the n + 1 offsets of the rows."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    bounds = heads[offsets]
    points = _fold_table()[points]
    space = points == 32
    keep = np.ones(len(points), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[bounds[:-1][bounds[:-1] < len(points)]] = True
    kept = np.concatenate(([0], np.cumsum(keep)))
    return points[keep], kept[bounds]


def ngrams(points: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: buckets, and the n + 1 offsets of the rows among them."""
    x = points.astype(np.uint64)
    for n in ORDERS:
        places, offsets = tb.gram_rows(bounds, n)
        if not len(places):
            yield np.zeros(0, np.int64), offsets
            continue
        h = np.full(len(x) - n + 1, n, np.uint64)
        for j in range(n):
            h *= np.uint64(0x1000193)
            h ^= x[j : len(x) - n + 1 + j]
        h *= np.uint64(0x9E3779B97F4A7C15)
        yield (h[places] >> np.uint64(64 - 15)).astype(np.int64), offsets


@dataclass
class Model:
    """languages[k] has log prior prior[k] and log-probabilities matrix[:, k]."""

    languages: list[str]
    prior: np.ndarray
    matrix: np.ndarray


def train(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    per_language: int = 2000,
    smoothing: float = 0.5,
) -> Model | None:
    """Fit on rows with a text and a language, about ``per_language`` of each by a hash of the id; None without any.

    This bounds the fit whatever the corpus; the taken texts count whole.  The priors are the shares of the languages among
    all rows that have a text and a language.  More than MOST_LANGUAGES values of ``lang``
    are an error, because the matrix would no longer be small.
    """
    rows = docs.select(
        F.xxhash64(doc_id).alias("place"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")
    ).where("text is not null and lang is not null")
    totals = rows.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if not totals:
        return None
    if len(totals) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    totals = dict(sorted(map(tuple, totals)))
    names = list(totals)
    share = F.create_map(*[F.lit(v) for k, n in totals.items() for v in (k, float(per_language) / n)])
    place = F.pmod("place", F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(place < share[F.col("lang")])
    number = F.create_map(*[F.lit(v) for k, name in enumerate(names) for v in (name, k)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            language = batch.column("number").to_numpy()
            for start, stop, data, offsets in tb.text_blocks(batch.column("text"), BLOCK_BYTES):
                points, bounds = characters(data, offsets)
                own = language[start:stop]
                for bucket, edges in ngrams(points, bounds):
                    tagged = np.repeat(own, np.diff(edges))
                    for k in np.unique(own):
                        counts.setdefault(int(k), np.zeros(BUCKETS, np.int64))
                        counts[int(k)] += np.bincount(bucket[tagged == k], minlength=BUCKETS)
        for k, held in counts.items():
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(held[at])],
                names=["number", "bucket", "n"],
            )

    counted = (
        sample.select(number[F.col("lang")].cast("int").alias("number"), "text")
        .mapInArrow(tb.tidy(count), "number int, bucket int, n long")
        .groupBy("number", "bucket")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    matrix = np.full((BUCKETS, len(names)), smoothing)
    at = counted.column("bucket").to_numpy(), counted.column("number").to_numpy()
    matrix[at] += counted.column("n").to_numpy()
    seen = np.array([totals[x] for x in names], float)
    return Model(names, np.log(seen / seen.sum()), np.log(matrix / matrix.sum(axis=0)).astype(np.float32))


def predict(
    docs: DataFrame, model: Model | None, *, text: str = "text", predicted: str = "lang_pred", score: str = "score"
) -> DataFrame:
    """All columns of the input with the most probable language and its posterior probability.

    A null text, or one without a letter, is ``und`` with score 0; so is every text without a model.  Equal scores go
    to the language that sorts first.  Columns already called like the two are replaced.
    """
    kept = [c for c in docs.columns if c not in (predicted, score)]
    frame = docs.select(*[F.col(f"`{c}`") for c in kept])
    if model is None:
        return frame.withColumn(predicted, F.lit(UNKNOWN)).withColumn(score, F.lit(0.0))
    at = kept.index(text)
    sent = frame.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*sent.value.languages, UNKNOWN], object)
        prior, matrix = sent.value.prior, sent.value.matrix
        for batch in batches:
            for start, stop, data, offsets in tb.text_blocks(batch.column(at), BLOCK_BYTES):
                points, bounds = characters(data, offsets)
                sums = np.tile(prior, (stop - start, 1))
                for bucket, edges in ngrams(points, bounds):
                    full = np.flatnonzero(np.diff(edges))
                    if len(full):
                        sums[full] += np.add.reduceat(matrix[bucket], edges[:-1][full], axis=0, dtype=np.float64)
                best = sums.argmax(axis=1)
                p = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
                letters = np.concatenate(([0], np.cumsum(points != 32)))[bounds]
                none = np.diff(letters) == 0
                best[none], p[none] = len(names) - 1, 0.0
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(start, stop - start).columns, pa.array(names[best], pa.string()), pa.array(p)],
                    names=[*kept, predicted, score],
                )

    schema = with_fields(frame, (predicted, T.StringType()), (score, T.DoubleType()))
    return frame.mapInArrow(tb.tidy(run), schema)


def fold(doc_id: str = "doc_id") -> Column:
    """Whether a document is held out of training: a fifth of all, by a checksum of the id; false for a null id."""
    return F.coalesce(remainder(doc_id, 5) == 0, F.lit(False))
