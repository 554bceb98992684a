"""Row-ordered operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators import windows as W
from larder.plans import insights
from larder.plans.features import SERIES, demand_features, price_features
from larder.plans.forecast import forecast_fits
from larder.queries.aggregates import rounded
from larder.queries.registry import query
from larder.sources import marts

SERIES_WINDOW = "WINDOW w AS (PARTITION BY store_id, item_id ORDER BY date)"


def _series(spark, folder, *columns):
    return marts.panel(spark, folder).select("store_id", "item_id", "date", *columns)


@query(
    "rolling_mean_min1",
    f"""
    SELECT item_id, date, sale, round(avg(sale) OVER (PARTITION BY item_id ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS mean7
    FROM item_daily""",
    "item_daily",
)
def _(spark, folder):
    daily = marts.sales(spark, folder).groupBy("item_id", "date").agg(F.sum("sale").alias("sale"))
    return rounded(W.rolling_mean_min1(daily, ["item_id"], ["date"], "sale", "mean7"), 6, "mean7")


@query(
    "rolling_mean_day_key",
    """
    SELECT item_id, store_id, d, sold_qty, round(avg(sold_qty) OVER (PARTITION BY item_id, store_id ORDER BY k ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS mean7
    FROM week_cells""",
    "week_cells",
)
def _(spark, folder):
    from larder.functions.calendar import day_number
    from larder.plans.tidy import long_sales

    long = long_sales(marts.wide_sales(spark, folder), [F.col("load_no")]).select("item_id", "store_id", "d", "sold_qty")
    return rounded(W.rolling_mean_min1(long, ["item_id", "store_id"], [day_number("d")], "sold_qty", "mean7"), 6, "mean7")


@query(
    "lag_features",
    f"""
    SELECT store_id, item_id, date, lag(sales, 1) OVER w AS sales_lag_1, lag(sales, 7) OVER w AS sales_lag_7, lag(sales, 14) OVER w AS sales_lag_14,
           lag(sales, 28) OVER w AS sales_lag_28, lag(sales, 56) OVER w AS sales_lag_56 FROM panel {SERIES_WINDOW}""",
    "panel",
)
def _(spark, folder):
    w = W.series_window(SERIES, ["date"])
    return _series(spark, folder, "sales").withColumns(W.lag_columns(w, "sales", [1, 7, 14, 28, 56], "sales")).drop("sales")


def _past(n: int) -> str:
    frame = f"(PARTITION BY store_id, item_id ORDER BY date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"round(CASE WHEN count(sales) OVER {frame} = {n} THEN avg(sales) OVER {frame} END, 6) AS sales_rmean_{n}"


@query(
    "rolling_past_mean",
    f"SELECT store_id, item_id, date, {', '.join(_past(n) for n in (7, 14, 28, 56))} FROM panel",
    "panel",
)
def _(spark, folder):
    rows = demand_features(_series(spark, folder, "sales"))
    means = [f"sales_rmean_{n}" for n in (7, 14, 28, 56)]
    return rounded(rows.select("store_id", "item_id", "date", *means), 6, *means)


def _full(n: int) -> str:
    frame = f"(PARTITION BY store_id, item_id ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(sell_price) OVER {frame} = {n} THEN avg(sell_price) OVER {frame} END"


@query(
    "price_rolling",
    f"""
    SELECT store_id, item_id, date, round({_full(7)}, 6) AS price_roll7_mean, round({_full(28)}, 6) AS price_roll28_mean,
           round(sell_price - {_full(7)}, 6) AS price_roll7_dev FROM panel""",
    "panel",
)
def _(spark, folder):
    rows = price_features(_series(spark, folder, "sell_price"))
    columns = ["price_roll7_mean", "price_roll28_mean", "price_roll7_dev"]
    return rounded(rows.select("store_id", "item_id", "date", *columns), 6, *columns)


@query(
    "pct_change",
    f"""
    SELECT store_id, item_id, date, round(change, 8) AS price_pct_change, CAST(change < 0 AS INTEGER) AS price_drop_flag FROM (
      SELECT store_id, item_id, date, coalesce(sell_price / nullif(lag(sell_price) OVER w, 0) - 1, 0) AS change FROM panel {SERIES_WINDOW})""",
    "panel",
)
def _(spark, folder):
    rows = price_features(_series(spark, folder, "sell_price"))
    return rounded(rows.select("store_id", "item_id", "date", "price_pct_change", "price_drop_flag"), 8, "price_pct_change")


@query(
    "fill_forward_back",
    """
    SELECT store_id, item_id, date,
           coalesce(last_value(sell_price IGNORE NULLS) OVER (PARTITION BY store_id, item_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                    first_value(sell_price IGNORE NULLS) OVER (PARTITION BY store_id, item_id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS filled
    FROM panel""",
    "panel",
)
def _(spark, folder):
    w = W.series_window(SERIES, ["date"])
    return _series(spark, folder, "sell_price").withColumn("filled", W.fill_forward_back(w, "sell_price")).drop("sell_price")


@query("cumulative_demand", "SELECT item_id, ds, round(cum_demand, 4) AS cum_demand FROM running", "running")
def _(spark, folder):
    forecast = forecast_fits(marts.sales(spark, folder))
    return rounded(insights.cumulative_demand(forecast).select("item_id", "ds", "cum_demand"), 4, "cum_demand")


@query(
    "inventory_projection",
    "SELECT item_id, ds, current_inventory, round(greatest(current_inventory - cum_demand, 0), 4) AS inventory FROM running",
    "running",
)
def _(spark, folder):
    from larder.operators.joins import join_inventory_forecast

    forecast = forecast_fits(marts.sales(spark, folder))
    joined = join_inventory_forecast(forecast, marts.stock(spark, folder), marts.item_dim(spark, folder))
    left = insights.inventory_projection(insights.cumulative_demand(joined))
    return rounded(left.select("item_id", "ds", "current_inventory", "inventory"), 4, "inventory")


@query(
    "dedupe_keep_last",
    """
    SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, l_quantity FROM (
      SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_quantity DESC) AS rn FROM lineitem)
    WHERE rn = 1""",
)
def _(spark, folder):
    order = [F.col(c) for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_quantity")]
    last = W.dedupe_keep_last(marts.table(spark, folder, "lineitem"), ["l_partkey", "l_suppkey"], order)
    return last.select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")


@query(
    "last_row_per_series",
    "SELECT store_id, item_id, max(date) AS date, arg_max(sales, date) AS sales FROM panel GROUP BY 1, 2",
    "panel",
)
def _(spark, folder):
    return W.last_row_per_series(_series(spark, folder, "sales"), SERIES, "date")


@query(
    "first_k_sum",
    "SELECT item_id, lead_time, round(ltd, 4) AS lead_time_demand FROM item_numbers",
    "item_numbers",
)
def _(spark, folder):
    forecast = forecast_fits(marts.sales(spark, folder))
    sums = insights.item_sums(forecast, marts.stock(spark, folder), marts.item_dim(spark, folder))
    return sums.select("item_id", "lead_time", F.round(insights.first_k_demand(), 4).alias("lead_time_demand"))


@query(
    "recent_messages",
    """
    SELECT conv_id, string_agg((CASE role WHEN 'user' THEN 'User' ELSE 'AI' END) || ': ' || substring(content, 1, 100) || '...', chr(10) ORDER BY turn, role, content) AS context,
           count(*) AS messages
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, content DESC) AS rn FROM messages WHERE role IN ('user', 'assistant'))
    WHERE rn <= 6 GROUP BY 1 HAVING count(*) >= 2""",
    "messages",
)
def _(spark, folder):
    from larder.plans.dialogue import recent_messages

    return recent_messages(marts.messages(spark, folder))


@query(
    "series_diff",
    f"SELECT store_id, item_id, date, sales - lag(sales) OVER w AS diff FROM panel {SERIES_WINDOW}",
    "panel",
)
def _(spark, folder):
    w = W.series_window(SERIES, ["date"])
    return _series(spark, folder, "sales").withColumn("diff", W.series_diff(w, "sales")).drop("sales")
