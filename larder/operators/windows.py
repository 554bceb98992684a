"""Row-ordered computations within a series.

Features of daily series run as plain windows: after the tidy job a series has one row per day, so a window
partition is never longer than the calendar.  Raw uploads give no such promise, and one product may own a
third of all rows; ``with_lookback`` therefore cuts every group into blocks that carry just the rows their
frames look back on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from larder.operators.ordering import PART, SEQ, _sorted_parts

BLOCK_ROWS = 100_000


def series_window(keys: list[str], order: list[Column | str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def with_lookback(
    df: DataFrame,
    keys: list[str],
    order: list[Column | str],
    lookback: int,
    columns: Callable[[WindowSpec], dict[str, Column]],
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add window columns whose frames reach at most ``lookback`` rows back, whatever the group sizes.

    Rows are range-partitioned on (keys, order) and numbered within their group, each run of ``block_rows``
    becomes a block, and the last ``lookback`` rows of a block are lent to the next one.  Every row is computed
    exactly once, from exactly its own frame, and in the same way for groups of every size.

    ``order`` should tell the rows of a group apart.  Rows that tie in it follow one another by their other
    columns, so that the result does not depend on the shuffle.
    """
    if not order:
        raise ValueError("rows of a series need an order")
    block_rows = max(block_rows, lookback + 1)
    ties = [f.name for f in df.schema.fields if f.name not in keys and f.dataType.typeName() not in ("map", "variant")]
    parts = _sorted_parts(df, [*keys, *order, *ties])
    runs = parts.groupBy(*keys, PART).agg(F.count(F.lit(1)).alias("__n"), F.min(SEQ).alias("__first"))
    # Rows here: one per group and partition it touches.
    before = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("__offset", F.coalesce(F.sum("__n").over(before), F.lit(0))).alias("r")
    on = [F.col(f"p.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, PART]]
    position = F.col("p." + SEQ) - F.col("r.__first") + F.col("r.__offset")
    numbered = parts.alias("p").join(runs, on).select("p.*", position.alias("__pos")).drop(PART, SEQ)

    block = F.floor(F.col("__pos") / block_rows)
    lent = F.col("__pos") % block_rows >= block_rows - lookback
    own = F.struct(block.alias("__block"), F.lit(True).alias("__own"))
    next_one = F.struct((block + 1).alias("__block"), F.lit(False).alias("__own"))
    blocks = numbered.select("*", F.inline(F.when(lent, F.array(own, next_one)).otherwise(F.array(own))))
    inside = Window.partitionBy(*keys, "__block").orderBy("__pos")
    return blocks.withColumns(columns(inside)).where("__own").drop("__pos", "__block", "__own")


def rolling_mean_min1(
    df: DataFrame, keys: list[str], order: list[Column | str], value: str, name: str, rows: int = 7,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Mean of this row and up to ``rows - 1`` before it."""
    return with_lookback(
        df, keys, order, rows - 1,
        lambda w: {name: F.avg(value).over(w.rowsBetween(-(rows - 1), 0))},
        block_rows,
    )


def lag_columns(w: WindowSpec, value: str, lags: list[int], prefix: str) -> dict[str, Column]:
    return {f"{prefix}_lag_{k}": F.lag(value, k).over(w) for k in lags}


def add_past_means(df: DataFrame, w: WindowSpec, value: str, lengths: list[int], prefix: str) -> DataFrame:
    """Mean of the previous ``n`` rows, NULL until there are n known values, for each length.

    From running totals: a frame's sum is the difference of two of them, so the cost per row does not grow
    with the frame length.
    """
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({"__sum": F.sum(value).over(upto), "__cnt": F.count(value).over(upto)})

    def before(column: str, rows: int) -> Column:
        return F.coalesce(F.lag(column, rows).over(w), F.lit(0))

    means = {}
    for n in lengths:
        known = before("__cnt", 1) - before("__cnt", n + 1)
        means[f"{prefix}_rmean_{n}"] = F.when(known == n, (before("__sum", 1) - before("__sum", n + 1)) / n)
    return df.withColumns(means).drop("__sum", "__cnt")


def full_mean(w: WindowSpec, value: str, rows: int) -> Column:
    """Mean of this and the previous ``rows - 1`` rows, NULL until the frame is full."""
    frame = w.rowsBetween(-(rows - 1), 0)
    return F.when(F.count(value).over(frame) == rows, F.avg(value).over(frame))


def pct_change(w: WindowSpec, value: str) -> Column:
    """Relative change to the row before; 0 for the first row."""
    previous = F.lag(value, 1).over(w)
    return F.coalesce(F.try_divide(F.col(value), previous) - 1, F.lit(0.0))


def fill_forward_back(w: WindowSpec, value: str) -> Column:
    """Last known value, else the next known one, within the series."""
    back = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    # Only rows before the first known value are still open, and for those the next known value is the
    # series' first one.  A whole-series frame is computed once; one reaching ahead from each row is not.
    ahead = F.first(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return F.coalesce(back, ahead)


def series_diff(w: WindowSpec, value: str) -> Column:
    return F.col(value) - F.lag(value, 1).over(w)


def dedupe_keep_last(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the last in the given order.

    The filter on row_number lets Spark keep one candidate per key in every map task before the shuffle, so
    a key with very many copies costs one row per task.
    """
    last = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return df.withColumn("__rn", F.row_number().over(last)).where("__rn = 1").drop("__rn")


def last_row_per_series(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return dedupe_keep_last(df, keys, [F.col(order)])


def last_rows(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The last ``n`` rows of each group with their distance from the end (1 = last)."""
    w = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return df.withColumn("from_end", F.row_number().over(w)).where(F.col("from_end") <= n)
