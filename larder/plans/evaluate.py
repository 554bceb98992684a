"""Forecast accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.operators import joins, windows
from larder.plans.features import SERIES


def rmsse_denominator(panel: DataFrame, keys: list[str] = SERIES, value: str = "sales") -> DataFrame:
    """Root mean squared day-to-day change per series; NULL with fewer than two values or no change."""
    known = panel.where(F.col(value).isNotNull())
    w = Window.partitionBy(*keys).orderBy("date")  # one row per day
    steps = known.withColumn("__diff", windows.series_diff(w, value))
    mean = F.avg(F.col("__diff") * F.col("__diff"))
    return steps.groupBy(*keys).agg(F.when(mean > 0, F.sqrt(mean)).alias("denominator"))


def validation_weights(panel: DataFrame, start: Column, keys: list[str] = SERIES) -> DataFrame:
    """Share of each series in mean revenue over the validation days; equal shares if there is no revenue."""
    means = (
        panel.where(F.col("date") >= start)
        .groupBy(*keys)
        .agg(F.coalesce(F.avg(F.col("sales") * F.col("sell_price")), F.lit(0.0)).alias("__revenue"))
    )
    totals = means.agg(
        F.struct(F.sum("__revenue").alias("revenue"), F.count(F.lit(1)).alias("series")).alias("t")
    ).scalar()
    share = F.col("__revenue") / F.nullif(totals["revenue"], F.lit(0.0))
    return means.withColumn("weight", F.coalesce(share, 1 / totals["series"])).drop("__revenue")


def series_rmsse(predictions: DataFrame, panel: DataFrame, start: Column, keys: list[str] = SERIES) -> DataFrame:
    """Error over the validation days relative to the day-to-day change before them."""
    gap = F.col("y_pred") - F.col("y_true")
    errors = predictions.groupBy(*keys).agg(F.avg(gap * gap).alias("__mse"))
    scale = rmsse_denominator(panel.where(F.col("date") < start), keys)
    return errors.join(scale, keys, "left").select(
        *keys, F.try_divide(F.sqrt("__mse"), F.col("denominator")).alias("rmsse")
    )


def wrmsse_bottom(predictions: DataFrame, panel: DataFrame, start: Column, keys: list[str] = SERIES) -> DataFrame:
    """Weighted error over all series; one row."""
    weights = validation_weights(panel, start, keys)
    aligned = joins.align_series(weights, series_rmsse(predictions, panel, start, keys), keys, "rmsse")
    return aligned.agg(F.sum("contribution").alias("wrmsse"))
