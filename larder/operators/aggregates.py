"""Totals and summaries.  Every grouped total is a partial aggregate before its shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def inventory_kpis(df: DataFrame) -> DataFrame:
    mean = F.avg("avg_daily_sales")
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("sku").alias("unique_sku"),
        F.floor(F.sum("on_hand")).alias("total_on_hand"),
        F.bround(F.coalesce(mean, F.lit(0.0)), 3).alias("avg_daily_sales_mean"),
        F.bround(F.coalesce(mean, F.lit(0.0)), 2).alias("avg_daily_sales_mean_2"),
    )


def dashboard_stats(df: DataFrame, low_stock: float = 50) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total_skus"),
        F.sum("on_hand").alias("total_on_hand"),
        F.round(F.avg("avg_daily_sales"), 2).alias("avg_daily_sales"),
        F.count_if(F.col("on_hand") < low_stock).alias("low_stock_items"),
    )


def daily_item_sales(sales: DataFrame) -> DataFrame:
    return sales.groupBy("item_id", "date").agg(F.sum("sale").alias("sales"))


def total_sales_by_item(sales: DataFrame) -> DataFrame:
    return sales.groupBy("item_id").agg(F.sum("sale").alias("sales"))


def sales_revenue(sales: DataFrame, item_dim: DataFrame) -> DataFrame:
    """Units x price per item; units are totalled per item before the join."""
    units = sales.groupBy("item_id").agg(F.sum("sale").alias("units"))
    return units.join(item_dim.select("item_id", "price"), "item_id").select(
        "item_id", "units", (F.col("units") * F.col("price")).alias("revenue")
    )


def low_stock_items(inv: DataFrame, item_dim: DataFrame, below: float) -> DataFrame:
    return (
        inv.where(F.col("unit") < below)
        .join(item_dim.select("item_id", "description"), "item_id")
        .orderBy("unit", "item_id")
    )


def sales_last_month(sales: DataFrame, days: int = 30) -> DataFrame:
    """Units per day over the last ``days`` days of data."""
    cutoff = sales.select(F.date_sub(F.max("date"), days)).scalar()
    return sales.where(F.col("date") > cutoff).groupBy("date").agg(F.sum("sale").alias("sales"))


def sales_by_category(sales: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """Units per category: from an item-to-category table, else the part of the item id before the "_"."""
    totals = sales.groupBy("item_id").agg(F.sum("sale").alias("sale"))
    if categories is None:
        keyed = totals.withColumn("category", F.substring_index("item_id", "_", 1))
    else:
        keyed = totals.join(categories.select("item_id", "category"), "item_id")
    return keyed.groupBy("category").agg(F.sum("sale").alias("sales"))


def revenue_by_category(sales: DataFrame, item_dim: DataFrame, categories: DataFrame | None = None) -> DataFrame:
    """Units and units x price per category; units are totalled per item before any join."""
    per_item = sales_revenue(sales, item_dim)
    if categories is None:
        keyed = per_item.withColumn("category", F.substring_index("item_id", "_", 1))
    else:
        keyed = per_item.join(categories.select("item_id", "category"), "item_id")
    return keyed.groupBy("category").agg(F.sum("units").alias("units"), F.sum("revenue").alias("revenue"))


def period_compare(sales: DataFrame, days: int) -> DataFrame:
    """Units of the last ``days`` days against the same number of days before them."""
    last = sales.select(F.max("date")).scalar()
    recent = F.col("date") > F.date_sub(last, days)
    earlier = (F.col("date") <= F.date_sub(last, days)) & (F.col("date") > F.date_sub(last, 2 * days))
    sums = sales.agg(
        F.coalesce(F.sum(F.when(recent, F.col("sale"))), F.lit(0.0)).alias("current_units"),
        F.coalesce(F.sum(F.when(earlier, F.col("sale"))), F.lit(0.0)).alias("previous_units"),
    )
    return sums.withColumns(
        {
            "difference": F.col("current_units") - F.col("previous_units"),
            "ratio": F.try_divide("current_units", "previous_units"),
        }
    )


def inventory_turnover(sales: DataFrame, inv: DataFrame) -> DataFrame:
    sold = sales.groupBy("item_id").agg(F.sum("sale").alias("sold"))
    return sold.join(inv, "item_id").select(
        "item_id", "sold", "unit", F.try_divide("sold", "unit").alias("turnover")
    )


def inventory_by_category(df: DataFrame) -> DataFrame:
    return df.groupBy("category").agg(
        F.sum("on_hand").alias("on_hand"), F.count(F.lit(1)).alias("items")
    )


def sales_stock_relation(df: DataFrame) -> DataFrame:
    """How daily sales and stock move together: correlation over all products."""
    return df.agg(
        F.count(F.lit(1)).alias("products"), F.corr("avg_daily_sales", "on_hand").alias("correlation")
    )


def store_rollup(long_sales: DataFrame, value: str = "sold_qty") -> DataFrame:
    """Units per item and day over all stores."""
    return long_sales.groupBy("item_id", "d").agg(F.sum(value).alias("sales"))


def max_sale_by_item(sales: DataFrame) -> DataFrame:
    return sales.groupBy("item_id").agg(F.max("sale").alias("sale"))


def derive_inv(sales: DataFrame) -> DataFrame:
    """Stock table from sales: twice the largest sale of the item."""
    return sales.groupBy("item_id").agg((F.max("sale") * 2).alias("unit"))


def mean_price_by_item(prices: DataFrame) -> DataFrame:
    return prices.groupBy("item_id").agg(F.avg("sell_price").alias("sell_price"))


def null_counts(df: DataFrame) -> DataFrame:
    """NULLs per column in one pass."""
    counted = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    return counted.unpivot([], [f"`{c}`" for c in df.columns], "column_name", "nulls")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    counts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def forecast_summary(forecast: DataFrame, next_days: int = 7) -> DataFrame:
    """Per item: size, span, mean and total of the forecast, mean of the next days, and its direction."""
    w = Window.partitionBy("item_id").orderBy("ds")  # at most one row per forecast day
    ranked = forecast.withColumn("__rn", F.row_number().over(w))
    out = ranked.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("periods"),
        F.min("ds").alias("forecast_start"),
        F.max("ds").alias("forecast_end"),
        F.avg("yhat").alias("avg_daily_demand"),
        F.sum("yhat").alias("total_demand"),
        F.avg(F.when(F.col("__rn") <= next_days, F.col("yhat"))).alias("next_days_mean"),
        F.min_by("yhat", "ds").alias("__first"),
        F.max_by("yhat", "ds").alias("__last"),
    )
    trend = (
        F.when(F.col("__last") > F.col("__first"), "increasing")
        .when(F.col("__last") < F.col("__first"), "decreasing")
        .otherwise("stable")
    )
    enough = F.col("periods") >= next_days
    return out.withColumns(
        {
            "next_days_mean": F.when(enough, F.col("next_days_mean")),
            "trend": F.when(F.col("periods") >= 2, trend),
        }
    ).drop("__first", "__last")


def priority_counts(ranked: DataFrame) -> DataFrame:
    """Items per band, and the revenue at risk in the HIGH band."""
    at_risk = F.when(F.col("priority") == "HIGH", F.col("expected_revenue")).otherwise(F.lit(0.0))
    return ranked.groupBy("priority").agg(
        F.count(F.lit(1)).alias("items"), F.sum(at_risk).alias("revenue_at_risk")
    )


def plan_panel_kpis(df: DataFrame) -> DataFrame:
    """Reorder panel: items at or below their reorder point, HIGH items, units suggested."""
    return df.agg(
        F.count_if(F.col("current_inventory") <= F.col("reorder_point")).alias("needing_reorder"),
        F.count_if(F.col("priority") == "HIGH").alias("high_priority"),
        F.sum("suggested_units").alias("total_suggested"),
    )


def value_counts_topk(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The most frequent non-NULL values; ties go to the smaller value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).count()
    return counts.orderBy(F.desc("count"), "value").limit(k)


def clean_stats(df: DataFrame, raw_numeric_valid: dict[str, Column] | None = None, shelf_low: float = 3) -> DataFrame:
    """Counts and ranges of a cleaned inventory, with how many raw cells per column were not numbers."""
    coerced = {
        f"coerced_{c}": F.count_if(~valid) for c, valid in (raw_numeric_valid or {}).items()
    }
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("shelf_units") < shelf_low).alias("low_shelf"),
        F.count_if(F.col("avg_daily_sales") <= 0).alias("zero_avg_sales"),
        *[m(c).alias(f"{m.__name__}_{c}") for c in ("on_hand", "avg_daily_sales", "days_of_cover") for m in (F.min, F.max)],
        *[v.alias(k) for k, v in coerced.items()],
    )


def chat_stats(messages: DataFrame) -> DataFrame:
    return messages.groupBy("role").agg(F.count(F.lit(1)).alias("messages"))


def pie_share(slices: DataFrame, value: str) -> DataFrame:
    """Each slice's share of the total; the total is a scalar subquery, not a window over all rows."""
    total = slices.select(F.sum(value)).scalar()
    return slices.withColumn("share", F.try_divide(F.col(value), total))


def histogram_bins(df: DataFrame, column: str, bins: int | None = None) -> DataFrame:
    """Equal-width counts over ``bins`` bins, by default max(1, min(20, rows // 2)); the last includes its right edge.

    When all values are equal the range is widened by half a unit on both sides.
    """
    present = df.where(F.col(column).isNotNull())
    usual = F.greatest(F.lit(1), F.least(F.lit(20), F.floor(F.count(F.lit(1)) / 2)))
    shape = present.agg(
        F.struct(
            F.min(column).cast("double").alias("lo"),
            F.max(column).cast("double").alias("hi"),
            (usual if bins is None else F.lit(bins)).cast("int").alias("bins"),
        ).alias("s")
    ).scalar()
    flat = shape["lo"] == shape["hi"]
    lo = F.when(flat, shape["lo"] - 0.5).otherwise(shape["lo"])
    hi = F.when(flat, shape["hi"] + 0.5).otherwise(shape["hi"])
    width = (hi - lo) / shape["bins"]
    bin_no = F.least(F.floor((F.col(column).cast("double") - lo) / width), shape["bins"] - 1).cast("int")
    counts = present.groupBy(bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    all_bins = df.sparkSession.range(1).select(F.explode(F.sequence(F.lit(0), shape["bins"] - 1)).alias("bin"))
    return all_bins.join(counts, "bin", "left").select(
        "bin",
        (lo + F.col("bin") * width).alias("left_edge"),
        (lo + (F.col("bin") + 1) * width).alias("right_edge"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def rmse(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    gap = F.col(predicted) - F.col(truth)
    return df.agg(F.sqrt(F.avg(gap * gap)).alias("rmse"), F.avg(F.abs(gap)).alias("mean_abs_error"))
