"""Joins.

No side is force-broadcast: Spark broadcasts a side whose size it knows to be below
``spark.sql.autoBroadcastJoinThreshold`` (AQE re-checks with real sizes) and otherwise merges or hashes with
skewed partitions split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def unique_side(df: DataFrame, keys: list[str]) -> DataFrame:
    """The lookup side of a many-to-one join, failing the job if a key occurs twice.

    The check is part of the plan: rows are grouped on the join keys, which is also the layout the join
    needs, so it adds no shuffle to a shuffled join and no separate job.  It stands in a key column, which the
    join reads whatever columns are used afterwards, so the optimizer cannot prune it.  Rows without a key match
    nothing and are not checked.
    """
    others = [c for c in df.columns if c not in keys]
    grouped = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), *[F.first(c).alias(c) for c in others]
    )
    message = F.concat(F.lit("join is not many-to-one, repeated key: "), F.to_json(F.struct(*keys)))
    known = F.lit(True)
    for key in keys:
        known &= F.col(key).isNotNull()
    kind = df.schema[keys[0]].dataType
    guard = F.when((F.col("__n") > 1) & known, F.raise_error(message).cast(kind)).otherwise(F.col(keys[0]))
    return grouped.withColumn(keys[0], guard).select(*df.columns)


def join_calendar(facts: DataFrame, calendar: DataFrame, key: str = "d") -> DataFrame:
    return facts.join(unique_side(calendar, [key]), key, "left")


def join_prices(
    facts: DataFrame, prices: DataFrame, keys: tuple[str, ...] = ("store_id", "item_id", "wm_yr_wk")
) -> DataFrame:
    """Price per store, item and week; skipped when a key column is absent on either side."""
    if not all(k in facts.columns and k in prices.columns for k in keys):
        return facts
    return facts.join(unique_side(prices, list(keys)), list(keys), "left")


def join_sales_dim(sales: DataFrame, item_dim: DataFrame) -> DataFrame:
    """Total units per item with its description and price; sales are totalled before they meet the join."""
    totals = sales.groupBy("item_id").agg(F.sum("sale").alias("total_sales"))
    return totals.join(item_dim.select("item_id", "description", "price"), "item_id")


def build_item_dim(
    descriptions: DataFrame, prices: DataFrame, lead_time: int = 3, holding_cost: float = 0.5
) -> DataFrame:
    """Item descriptions with their mean price and constant lead time and holding cost."""
    mean_price = prices.groupBy("item_id").agg(F.avg("sell_price").alias("price"))
    return descriptions.join(mean_price, "item_id", "left").withColumns(
        {"lead_time": F.lit(lead_time), "holding_cost": F.lit(holding_cost)}
    )


def gap_fill(
    daily: DataFrame, keys: list[str], date: str = "date", value: str = "sale", keep: list[str] | None = None
) -> DataFrame:
    """Every day between a series' first and last date, 0 where nothing was recorded.

    ``daily`` has one row per series and day.  Each row is repeated up to the day before the series' next
    row, so one window does it: no second pass for the spans and no join of the days.  Columns in ``keep``
    are NULL on the added days.
    """
    upcoming = F.lead(date).over(Window.partitionBy(*keys).orderBy(date))
    last = F.coalesce(F.date_sub(upcoming, 1), F.col(date))
    days = daily.withColumn("__last", last).withColumn("__day", F.explode(F.sequence(F.col(date), F.col("__last"))))
    recorded = F.col("__day") == F.col(date)
    others = [F.when(recorded, F.col(c)).alias(c) for c in keep or []]
    return days.select(
        *keys, F.col("__day").alias(date), F.when(recorded, F.col(value)).otherwise(F.lit(0.0)).alias(value), *others
    )


def join_inventory_forecast(forecast: DataFrame, inv: DataFrame, item_dim: DataFrame) -> DataFrame:
    """Forecast rows of items that have both a stock row and an item row.

    An item with two stock or item rows is an error: it would multiply its demand.
    """
    stock = inv.select("item_id", F.floor("unit").cast("long").alias("current_inventory"))
    items = item_dim.select("item_id", "description", "price", "lead_time", "holding_cost")
    return forecast.join(unique_side(stock, ["item_id"]), "item_id").join(unique_side(items, ["item_id"]), "item_id")


def unmatched_items(forecast: DataFrame, inv: DataFrame, item_dim: DataFrame) -> DataFrame:
    """Forecast items that cannot be analysed, with the reason; a missing stock row is reported first."""
    wanted = forecast.select("item_id").distinct()
    no_stock = wanted.join(inv, "item_id", "left_anti").withColumn("error", F.lit("no inventory data"))
    no_item = (
        wanted.join(inv, "item_id", "left_semi")
        .join(item_dim, "item_id", "left_anti")
        .withColumn("error", F.lit("no item details"))
    )
    return no_stock.unionByName(no_item)


def join_future_events(dates: DataFrame, calendar: DataFrame, flags: list[str], events: list[str]) -> DataFrame:
    """Future dates with their calendar flags (0 when unknown) and event names."""
    known = [c for c in flags + events if c in calendar.columns]
    joined = dates.join(calendar.select("date", *known), "date", "left")
    out = {f: F.coalesce(F.col(f).try_cast("int"), F.lit(0)) if f in known else F.lit(0) for f in flags}
    out |= {e: F.coalesce(F.col(e), F.lit("NONE")) if e in known else F.lit("NONE") for e in events}
    return joined.withColumns(out).select("date", *flags, *events)


def join_step_features(skeleton: DataFrame, features: DataFrame, keys: list[str]) -> DataFrame:
    return skeleton.join(features, keys, "left")


def align_series(weights: DataFrame, errors: DataFrame, keys: list[str], error: str) -> DataFrame:
    """One row per weighted series; a series without an error value contributes 0."""
    joined = weights.join(errors, keys, "left")
    return joined.withColumn("contribution", F.coalesce(F.col("weight") * F.col(error), F.lit(0.0)))


def semi_top_items(df: DataFrame, top: DataFrame, key: str = "item_id") -> DataFrame:
    return df.join(top.select(key), key, "left_semi")

