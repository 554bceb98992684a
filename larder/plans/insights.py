"""From a forecast to coverage, reorder point, money, urgency and risk, for all items at once.

Input is any (item_id, ds, yhat) frame with one row per item and day, one row per item with its days as arrays
(``forecast_series``), or one without days (``forecast_fits``), which get their days after the joins.  The analyses go
through an item's days within its row, so what a task holds and sorts are items, not days; rows are gathered into such
series first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.cleaning import once
from larder.operators.joins import join_inventory_forecast
from larder.plans.forecast import days_within, is_fits

CRITICAL_DAYS, LOW_DAYS = 7, 14
SAFETY_FACTOR = 1.25
LOW_MARGIN = 10

STOCK_COLUMNS = ["current_inventory", "description", "price", "lead_time", "holding_cost"]


def is_series(forecast: DataFrame) -> bool:
    return forecast.schema["yhat"].dataType.typeName() == "array"


def as_series(forecast: DataFrame) -> DataFrame:
    """One row per item with its days in order: item_id, ds, yhat; fits stay without days, if they have a first one."""
    if is_fits(forecast):
        return forecast.where(F.col("__n").isNotNull())
    if is_series(forecast):
        return forecast.select("item_id", "ds", "yhat").where(F.size("yhat") > 0)
    days = forecast.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("ds", "yhat"))).alias("__days"))
    return days.select("item_id", F.col("__days.ds").alias("ds"), F.col("__days.yhat").alias("yhat"))


def added(total: Column, value: Column) -> Column:
    """The sum that ignores NULLs and is NULL without a value."""
    return F.coalesce(total + value, total, value)


def cumulative_demand(forecast: DataFrame, key: str = "item_id") -> DataFrame:
    """Rows with the item's demand up to their day.

    A series adds its days up within its row, where every day copies the totals before it; this is for horizons, and
    years of days are better given as rows.
    """
    if is_fits(forecast):
        forecast = days_within(forecast)
    if is_series(forecast):
        none = F.array().cast("array<double>")
        totals = F.aggregate("yhat", none, lambda upto, y: F.concat(upto, F.array(added(F.try_element_at(upto, F.lit(-1)), y))))
        others = [c for c in forecast.columns if c not in ("ds", "yhat")]
        return forecast.withColumn("cum_demand", totals).select(*others, F.inline(F.arrays_zip("ds", "yhat", "cum_demand")))
    w = Window.partitionBy(key).orderBy("ds")
    return forecast.withColumn("cum_demand", F.sum("yhat").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def inventory_projection(df: DataFrame) -> DataFrame:
    """Stock left after each day's cumulative demand, never below 0."""
    return df.withColumn(
        "inventory", F.greatest(F.col("current_inventory") - F.col("cum_demand"), F.lit(0.0))
    )


def item_sums(forecast: DataFrame, inv: DataFrame, item_dim: DataFrame) -> DataFrame:
    """One row per item with every sum the analyses need, from one pass over its days within its row.

    ``inv`` and ``item_dim`` have one row per item.
    """
    items = join_inventory_forecast(as_series(forecast), inv, item_dim)
    if is_fits(items):
        items = days_within(items)
    number, date = F.lit(None).cast("double"), items.schema["ds"].dataType.elementType
    start = F.struct(
        number.alias("total"), number.alias("first_k"), F.lit(0.0).alias("inventory"), F.lit(0).cast("long").alias("known"),
        F.lit(None).cast(date).alias("until"),
    )

    def day(days: Column, sums: Column, i: Column) -> Column:
        ds, yhat = F.get(days["ds"], i), F.get(days["yhat"], i)
        total = added(sums["total"], yhat)
        left = F.greatest(F.col("current_inventory") - total, F.lit(0.0))
        return F.struct(
            total.alias("total"),
            added(sums["first_k"], F.when(i < F.col("lead_time"), yhat).otherwise(0.0)).alias("first_k"),
            (sums["inventory"] + left).alias("inventory"),
            (sums["known"] + F.when(yhat.isNull(), 0).otherwise(1)).alias("known"),
            F.least(sums["until"], F.when(total >= F.col("current_inventory"), ds)).alias("until"),
        )

    def sums_of(days: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.size(days["yhat"]) - 1), start, lambda sums, i: day(days, sums, i))

    # Bound once: a filter on the sums is moved below the days, which would then be worked out anew for every day.
    summed = items.withColumn("__sums", once(F.struct("ds", "yhat"), sums_of))
    days = F.size("yhat").cast("long")
    return summed.select(
        "item_id",
        *STOCK_COLUMNS,
        days.alias("forecast_days"),
        F.array_min("ds").alias("__first_ds"),
        F.col("__sums.until").alias("cover_until"),
        F.col("__sums.total").alias("__total"),
        F.col("__sums.first_k").alias("__first_k"),
        (F.col("__sums.inventory") / days).alias("__avg_inventory"),
        F.try_divide(F.col("__sums.total"), F.col("__sums.known")).alias("avg_daily_demand"),
    )


def first_k_demand() -> Column:
    """Demand over the lead time; the mean day times the lead time if the forecast is shorter."""
    short = F.col("forecast_days") < F.col("lead_time")
    return F.when(short, F.col("__total") / F.col("forecast_days") * F.col("lead_time")).otherwise(F.col("__first_k"))


def whole(c: Column) -> Column:
    return F.bround(c, 0).cast("long")


def coverage_columns() -> dict[str, Column]:
    until = F.col("cover_until")
    days = F.date_diff(until, F.col("__first_ds"))
    never = until.isNull()
    return {
        "coverage_days_number": days.cast("int"),
        "coverage_days": F.when(never, F.concat(F.lit(">"), F.col("forecast_days").cast("string"))).otherwise(
            days.cast("string")
        ),
        "coverage_status": F.when(never, "sufficient")
        .when(days <= CRITICAL_DAYS, "critical")
        .when(days <= LOW_DAYS, "low")
        .otherwise("adequate"),
        "remaining_inventory": F.when(never, F.col("current_inventory") - F.col("__total")).otherwise(0.0),
    }


def reorder_point_columns(factor: float = SAFETY_FACTOR) -> dict[str, Column]:
    demand = first_k_demand()
    return {
        "lead_time_demand": whole(demand),
        "reorder_point": whole(demand * factor),
        "reorder_safety_stock": whole(demand * (factor - 1)),
    }


def financial_columns() -> dict[str, Column]:
    sales = F.least(F.col("current_inventory").cast("double"), F.col("__total"))
    revenue = sales * F.col("price")
    holding = F.col("__avg_inventory") * F.col("holding_cost") * F.col("forecast_days")
    profit = revenue - holding
    margin = F.when(revenue > 0, profit / F.nullif(revenue, F.lit(0.0)) * 100).otherwise(0.0)
    return {
        "expected_revenue": F.bround(revenue, 2),
        "expected_sales": whole(sales),
        "total_demand": whole(F.col("__total")),
        "avg_inventory": F.bround(F.col("__avg_inventory"), 1),
        "holding_cost_total": F.bround(holding, 2),
        "gross_profit": F.bround(profit, 2),
        "profit_margin": F.bround(margin, 1),
    }


def coverage(forecast: DataFrame, inv: DataFrame, item_dim: DataFrame) -> DataFrame:
    sums = item_sums(forecast, inv, item_dim).withColumns(coverage_columns())
    return sums.select("item_id", "cover_until", "coverage_days", "coverage_status", "remaining_inventory")


def reorder_point(
    forecast: DataFrame, inv: DataFrame, item_dim: DataFrame, factor: float = SAFETY_FACTOR
) -> DataFrame:
    sums = item_sums(forecast, inv, item_dim).withColumns(reorder_point_columns(factor))
    return sums.select("item_id", "lead_time_demand", "reorder_point", "reorder_safety_stock")


def financials(forecast: DataFrame, inv: DataFrame, item_dim: DataFrame) -> DataFrame:
    columns = financial_columns()
    return item_sums(forecast, inv, item_dim).withColumns(columns).select("item_id", *columns)


def inventory_insights(forecast: DataFrame, inv: DataFrame, item_dim: DataFrame) -> DataFrame:
    """Coverage, reorder point and money per item, with what to do about it in order of weight."""
    out = item_sums(forecast, inv, item_dim).withColumns(
        {**coverage_columns(), **reorder_point_columns(), **financial_columns()}
    )
    out = out.withColumn("below_reorder_point", F.col("current_inventory") <= F.col("reorder_point"))
    advice = F.array(
        F.when(F.col("coverage_status") == "critical", F.lit("reorder immediately"))
        .when(F.col("coverage_status") == "low", F.lit("reorder soon")),
        F.when(F.col("below_reorder_point"), F.lit("stock at or below reorder point")),
        F.when(F.col("profit_margin") < LOW_MARGIN, F.lit("adjust stock to improve margin")),
    )
    return out.withColumn("recommendations", F.array_compact(advice)).drop(
        "__first_ds", "__total", "__first_k", "__avg_inventory"
    )


def reorder_priority(insights: DataFrame) -> DataFrame:
    """Urgency score and band of every item, most urgent first is ``urgency_sort``."""
    status, margin = F.col("coverage_status"), F.col("profit_margin")
    by_cover = F.when(status == "critical", 100).when(status == "low", 50).otherwise(0)
    by_point = F.when(F.col("below_reorder_point"), 75).otherwise(0)
    by_margin = F.when(margin < LOW_MARGIN, -20).otherwise(0)
    score = (by_cover + by_point + by_margin).cast("int")
    reasons = F.array(
        F.when(by_cover > 0, F.concat(F.upper(status), F.lit(": "), "coverage_days", F.lit(" days coverage"))),
        F.when(
            F.col("below_reorder_point"),
            F.concat(
                F.lit("Below ROP: "), F.col("current_inventory").cast("string"),
                F.lit(" <= "), F.col("reorder_point").cast("string"),
            ),
        ),
        F.when(margin < LOW_MARGIN, F.concat(F.lit("Low margin: "), F.format_string("%.1f", margin), F.lit("%"))),
    )
    return insights.withColumns(
        {
            "urgency_score": score,
            "urgency_reasons": F.array_compact(reasons),
            "priority": F.when(score >= 75, "HIGH").when(score >= 25, "MEDIUM").otherwise("LOW"),
        }
    ).select(
        "item_id", "description", "current_inventory", "coverage_days", "coverage_status", "reorder_point",
        "below_reorder_point", "expected_revenue", "profit_margin", "urgency_score", "priority",
        "urgency_reasons", "recommendations",
    )


def risk_grades(insights: DataFrame) -> DataFrame:
    """Grades per item from its insights; no further pass over the forecast."""
    status, margin, days = F.col("coverage_status"), F.col("profit_margin"), F.col("coverage_days_number")
    demand = F.col("avg_daily_demand")
    # A stock that outlasts the forecast has no day count and counts as low risk.
    stockout = (
        F.when(days <= 3, "Critical").when(days <= 7, "High").when(days <= 14, "Medium").otherwise("Low")
    )
    finance = F.when(margin < 10, "High").when(margin < 20, "Medium").otherwise("Low")
    return insights.select(
        "item_id",
        F.upper(status).alias("status"),
        F.when((status == "critical") | F.col("below_reorder_point"), "HIGH")
        .when(status == "low", "MEDIUM")
        .otherwise("LOW")
        .alias("priority_level"),
        F.when(demand > 500, "High demand item")
        .when(demand > 200, "Moderate demand item")
        .otherwise("Low demand item")
        .alias("demand_level"),
        F.when(margin >= 30, "Excellent").when(margin >= 20, "Good").when(margin >= 10, "Acceptable")
        .otherwise("Poor").alias("roi_status"),
        stockout.alias("stockout_risk"),
        finance.alias("financial_risk"),
        F.when((stockout == "Critical") | (finance == "High"), "HIGH")
        .when(stockout.isin("High", "Medium") | (finance == "Medium"), "MEDIUM")
        .otherwise("LOW")
        .alias("overall_risk"),
        F.col("forecast_days").alias("forecast_period_days"),
    )
