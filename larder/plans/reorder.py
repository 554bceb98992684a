"""The reorder plan: how many units of each product to order now."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions import stock

PLAN_COLUMNS = [
    "sku", "product_name", "on_hand", "stockroom_units", "shelf_units", "avg_daily_sales", "lead_time_days",
    "safety_stock", "days_of_cover", "reorder_qty", "reorder_flag",
]
TINY = 0.0001


def reorder_plan(df: DataFrame) -> DataFrame:
    """One narrow projection.  Absent cover is on_hand / daily sales with zeros read as 0.0001."""
    if "safety_stock" not in df.columns:
        df = df.withColumn("safety_stock", F.lit(stock.DEFAULT_SAFETY_STOCK))
    if "days_of_cover" not in df.columns:
        top, bottom = (
            F.when(F.col(c) == 0, F.lit(TINY)).otherwise(F.col(c)) for c in ("on_hand", "avg_daily_sales")
        )
        df = df.withColumn("days_of_cover", top / bottom)
    quantity = stock.reorder_quantity(
        F.col("lead_time_days"), F.col("safety_stock"), F.col("days_of_cover"), F.col("avg_daily_sales")
    )
    df = df.withColumn("reorder_qty", quantity).withColumn("reorder_flag", F.col("reorder_qty") > 0)
    return df.select(*PLAN_COLUMNS)
