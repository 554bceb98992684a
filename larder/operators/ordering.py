"""Numbering and running totals over a whole table without a single-task window.

A window without PARTITION BY moves every row into one task.  Here rows are range-partitioned on the sort
key instead, each partition is totalled, the (few) partition totals are accumulated, and every row gets its
partition's offset.  The range-partitioned rows are checkpointed because the split points come from a
sample: recomputing them could move rows between partitions after their totals were taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.session import checkpointed

PART, SEQ = "__part", "__seq"


def _sorted_parts(df: DataFrame, order: list[Column | str]) -> DataFrame:
    ranged = df.orderBy(*order)
    return checkpointed(
        ranged.withColumn(PART, F.spark_partition_id()).withColumn(SEQ, F.monotonically_increasing_id())
    )


def number_rows(df: DataFrame, order: list[Column | str], name: str, start: int = 0) -> DataFrame:
    """Global row number in the given order, counting from ``start``."""
    parts = _sorted_parts(df, order)
    # One row per partition from here on, so this window sees at most as many rows as there are partitions.
    offsets = parts.groupBy(PART).agg(F.count(F.lit(1)).alias("__n"), F.min(SEQ).alias("__first"))
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select(
        PART, "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset")
    )
    return (
        parts.join(F.broadcast(offsets), PART)
        .withColumn(name, (F.col(SEQ) - F.col("__first") + F.col("__offset") + start).cast("long"))
        .drop(PART, SEQ, "__first", "__offset")
    )


def exact_median(df: DataFrame, column: str) -> float | None:
    """Median over the whole table: the middle value, or the mean of the two middle values.

    Equal values are counted first, so the sort handles distinct values only; the partition that holds the
    middle is found from partition totals, and only that partition's values are accumulated.
    """
    counted = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(
        F.count(F.lit(1)).alias("n")
    )
    parts = _sorted_parts(counted, ["v"])
    totals = parts.groupBy(PART).agg(F.sum("n").alias("n")).orderBy(PART).collect()
    rows = sum(t["n"] for t in totals)
    if not rows:
        return None
    wanted = {(rows + 1) // 2, rows // 2 + 1}
    picked: list[float] = []
    before = 0
    for total in totals:
        inside = [k - before for k in sorted(wanted) if before < k <= before + total["n"]]
        if inside:
            running = F.sum("n").over(Window.partitionBy(PART).orderBy("v"))
            reached = parts.where(F.col(PART) == total[PART]).withColumn("upto", running)
            firsts = reached.agg(*[F.min(F.when(F.col("upto") >= k, F.col("v"))) for k in inside]).first()
            picked += [float(v) for v in firsts]
        before += total["n"]
    return sum(picked) / len(picked)
