"""Exact top-k by integer inner product with Fagin's threshold algorithm.

Queries meet the candidates block against block, so every task holds two blocks of bounded size.  In a candidate block
every dimension is a list of the vectors in sorted order.  A query reads its lists from the end that suits the sign of
its component, step by step; every vector that turns up is scored in full, and reading stops once the sum of the last
values read, which bounds all vectors not seen yet, is below the k-th best score, or once no vector is unseen.  The best of
all blocks are merged.

Every candidate block meets every query block, so rows are copied n / QUERIES_PER_BLOCK and n / CANDIDATES_PER_BLOCK times:
blocks are as large as a task can hold, candidates in smaller ones only where fewer than a block for each core would be left.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CANDIDATES_PER_BLOCK = 65_536
LEAST_CANDIDATES = 4_096
QUERIES_PER_BLOCK = 16_384


def quantised(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component, as long."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def whole(vector: Column) -> Column:
    """Whether a vector has only finite components."""
    return F.coalesce(
        F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False)
    )


class Lists:
    """A block of candidates with a sorted list for each dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.rising = np.argsort(self.vectors, axis=0, kind="stable").astype(np.int32)
        self.falling = self.rising[::-1]

    def best(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best vectors, best first, ties to the smaller id; the query's own id is left out."""
        n = len(self.ids)
        used = np.flatnonzero(query)
        seen = np.zeros(n, bool)
        kept, scores = np.zeros(0, np.int64), np.zeros(0, self.vectors.dtype)
        depth, step = 0, max(1, n // max(64, 2 * len(used)))
        up, unseen, every = query[used] > 0, n, None
        while unseen:
            stop = min(n, depth + step)
            fresh = np.zeros(n, bool)
            if len(used):
                lists = np.where(up, self.falling[depth:stop, used], self.rising[depth:stop, used])
                fresh[lists.ravel()] = True
                bound = (query[used] * self.vectors[lists[-1], used]).sum()
            else:
                # Without a component the query has no list, and every score is 0.
                fresh[:], bound = True, 0
            fresh &= ~seen
            seen |= fresh
            unseen = n - int(np.count_nonzero(seen))
            at = np.flatnonzero(fresh)
            at = at[self.ids[at] != query_id]
            # Where most of the block has turned up, one pass over it is cheaper than picking rows out again and again.
            if every is None and 3 * unseen < 2 * n:
                every = self.vectors @ query
            values = self.vectors[at] @ query if every is None else every[at]
            if len(kept) == k:
                good = values >= scores[-1]
                at, values = at[good], values[good]
            kept, scores = np.concatenate((kept, at)), np.concatenate((scores, values))
            if len(kept) > 4 * k:
                cut = np.partition(scores, len(scores) - k)[len(scores) - k]
                kept, scores = kept[scores >= cut], scores[scores >= cut]
            # Places follow the ids, so equal scores go to the smaller id.
            order = np.lexsort((kept, -scores))[:k]
            kept, scores = kept[order], scores[order]
            # A vector that ties with the k-th could still have a smaller id: only a smaller bound ends the search.
            if len(kept) == k and bound < scores[-1]:
                break
            depth, step = stop, step * 2
        return self.ids[kept], scores


def _matrix(column: pa.ChunkedArray, width: int, dtype: type) -> np.ndarray:
    lists = column.combine_chunks()
    sizes = lists.value_lengths().to_numpy()
    out = np.zeros((len(sizes), width), dtype)
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, place] = lists.flatten().to_numpy()
    return out


def _number_type(queries: pa.Table, candidates: pa.Table, width: int) -> type:
    """The cheapest number type in which all inner products of the two blocks are exact."""

    def largest(t: pa.Table) -> int:
        flat = t.column("vector").combine_chunks().flatten().to_numpy()
        return max(abs(int(flat.max())), abs(int(flat.min()))) if len(flat) else 0

    bound = largest(queries) * largest(candidates) * max(width, 1)
    return np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64


def _search(k: int):
    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(candidates) and len(queries):
            width = 0
            for t in (candidates, queries):
                width = max(width, int(t.column("vector").combine_chunks().value_lengths().to_numpy().max()))
            kind = _number_type(queries, candidates, width)
            lists = Lists(candidates.column("vec_id").to_numpy(), _matrix(candidates.column("vector"), width, kind))
            vectors = _matrix(queries.column("vector"), width, kind)
            for name, query in zip(queries.column("vec_id").to_numpy(), vectors, strict=True):
                ids, scores = lists.best(name, query, k)
                out.append((np.full(len(ids), name, np.int64), ids, scores.astype(np.int64)))
        cols = [np.concatenate(c) if out else np.zeros(0, np.int64) for c in (zip(*out, strict=True) if out else ((), (), ()))]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), cols, strict=True)})

    return run


def top_k(
    queries: DataFrame, candidates: DataFrame, *, k: int = 20, vec_id: str = "vec_id", vector: str = "vector"
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best candidates of each query, ties to the smaller vec_id.

    Both inputs have a long ``vec_id`` and an array<long> ``vector``; shorter vectors count as padded with zeros.  Null
    ids and null vectors take no part.  A query never finds its own id.  A query given twice is answered once; a
    candidate row given twice is two candidates.  Fewer than k candidates give fewer rows; an empty side gives none.
    """
    def plain(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<long>").alias("vector"))
        return rows.where("vec_id is not null and vector is not null and not array_contains(transform(vector, x -> x is null), true)")

    queries, candidates = plain(queries).dropDuplicates(["vec_id"]), plain(candidates)
    rows, cores = candidates.count(), candidates.sparkSession.sparkContext.defaultParallelism
    per_block = min(CANDIDATES_PER_BLOCK, max(LEAST_CANDIDATES, math.ceil(rows / cores)))
    c_blocks = max(1, math.ceil(rows / per_block))
    q_blocks = max(1, math.ceil(queries.count() / QUERIES_PER_BLOCK))
    # Rows are dealt by a hash of id and vector, so that repeated ids do not pile up in one block.
    left = candidates.withColumn("c", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(c_blocks)).cast("int")).withColumn(
        "q", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))
    )
    right = queries.withColumn("q", F.pmod(F.xxhash64("vec_id"), F.lit(q_blocks)).cast("int")).withColumn(
        "c", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1)))
    )
    found = (
        left.groupBy("c", "q")
        .cogroup(right.groupBy("c", "q"))
        .applyInArrow(_search(k), "query_id long, vec_id long, score long")
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
