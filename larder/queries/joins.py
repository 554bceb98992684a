"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators import joins
from larder.plans.evaluate import series_rmsse, validation_weights
from larder.plans.features import demand_features
from larder.plans.forecast import forecast_items
from larder.plans.tidy import long_sales
from larder.queries.registry import query
from larder.session import checkpointed
from larder.sources import marts


def _long(spark, folder):
    return long_sales(marts.wide_sales(spark, folder), [F.col("load_no")])


@query(
    "join_calendar",
    """
    SELECT c.item_id, c.store_id, c.d, c.sold_qty, w.date, w.wm_yr_wk, w.event_name_1
    FROM week_cells c LEFT JOIN (SELECT * FROM week_calendar WHERE month <> 2) w ON w.d = c.d""",
    "week_cells week_calendar",
)
def _(spark, folder):
    calendar = marts.calendar(spark, folder, 7).where("month <> 2").select("d", "date", "wm_yr_wk", "event_name_1")
    joined = joins.join_calendar(_long(spark, folder), calendar)
    return joined.select("item_id", "store_id", "d", "sold_qty", "date", "wm_yr_wk", "event_name_1")


@query(
    "join_prices",
    """
    SELECT c.item_id, c.store_id, c.d, c.sold_qty, w.wm_yr_wk, p.sell_price
    FROM week_cells c JOIN week_calendar w ON w.d = c.d
    LEFT JOIN prices p ON p.store_id = c.store_id AND p.item_id = c.item_id AND p.wm_yr_wk = w.wm_yr_wk""",
    "week_cells week_calendar prices",
)
def _(spark, folder):
    calendar = marts.calendar(spark, folder, 7).select("d", "wm_yr_wk")
    joined = joins.join_prices(joins.join_calendar(_long(spark, folder), calendar), marts.prices(spark, folder))
    return joined.select("item_id", "store_id", "d", "sold_qty", "wm_yr_wk", "sell_price")


@query(
    "join_sales_dim",
    """
    SELECT s.item_id, sum(s.sale) AS total_sales, i.description, i.price
    FROM sales s JOIN item_dim i ON i.item_id = s.item_id GROUP BY s.item_id, i.description, i.price""",
    "sales item_dim",
)
def _(spark, folder):
    return joins.join_sales_dim(marts.sales(spark, folder), marts.item_dim(spark, folder))


@query(
    "build_item_dim",
    """
    SELECT i.item_id, i.dept_id AS description, round(p.price, 10) AS price, 3 AS lead_time, CAST(0.5 AS DOUBLE) AS holding_cost
    FROM (SELECT DISTINCT item_id, dept_id FROM lines) i
    LEFT JOIN (SELECT item_id, avg(sell_price) AS price FROM prices GROUP BY 1) p ON p.item_id = i.item_id""",
    "lines prices",
)
def _(spark, folder):
    names = marts.lines(spark, folder).select("item_id", F.col("dept_id").alias("description")).distinct()
    dim = joins.build_item_dim(names, marts.prices(spark, folder))
    return dim.withColumn("price", F.round("price", 10))


@query(
    "gap_fill",
    """
    SELECT g.item_id, g.date, coalesce(d.sale, 0) AS sale
    FROM (SELECT item_id, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM brand_sales GROUP BY item_id) g
    LEFT JOIN brand_sales d ON d.item_id = g.item_id AND d.date = g.date""",
    "brand_sales",
)
def _(spark, folder):
    daily = marts.lines(spark, folder).groupBy("item_id", "date").agg(F.sum("sale").alias("sale"))
    return joins.gap_fill(daily, ["item_id"])


@query(
    "join_inventory_forecast",
    """
    SELECT f.item_id, f.ds, round(f.yhat, 4) AS yhat, CAST(floor(s.unit) AS BIGINT) AS current_inventory,
           i.description, i.price, i.lead_time, i.holding_cost
    FROM forecast f JOIN stock s ON s.item_id = f.item_id JOIN item_dim i ON i.item_id = f.item_id""",
    "forecast stock item_dim",
)
def _(spark, folder):
    forecast = forecast_items(marts.sales(spark, folder)).select("item_id", "ds", F.round("yhat", 4).alias("yhat"))
    return joins.join_inventory_forecast(forecast, marts.stock(spark, folder), marts.item_dim(spark, folder))


@query(
    "unmatched_items",
    """
    SELECT item_id, CASE WHEN CAST(item_id AS BIGINT) % 5 = 0 THEN 'no inventory data' ELSE 'no item details' END AS error
    FROM (SELECT DISTINCT item_id FROM sales) WHERE CAST(item_id AS BIGINT) % 5 = 0 OR CAST(item_id AS BIGINT) % 7 = 0""",
    "sales",
)
def _(spark, folder):
    number = F.col("item_id").cast("long")
    sales = marts.sales(spark, folder)
    inv = marts.inv(spark, folder).where(number % 5 != 0)
    dim = marts.item_dim(spark, folder).where(number % 7 != 0)
    return joins.unmatched_items(sales, inv, dim)


@query(
    "join_future_events",
    """
    SELECT CAST(c.date + 30 AS DATE) AS date, CAST(coalesce(k.snap_ca, 0) AS INTEGER) AS snap_ca, 0 AS snap_xx,
           coalesce(k.event_name_1, 'NONE') AS event_name_1
    FROM calendar c LEFT JOIN calendar k ON k.date = c.date + 30""",
    "calendar",
)
def _(spark, folder):
    calendar = marts.calendar(spark, folder)
    dates = calendar.select(F.date_add("date", 30).alias("date"))
    return joins.join_future_events(dates, calendar, ["snap_ca", "snap_xx"], ["event_name_1"])


@query(
    "join_step_features",
    """
    SELECT s.item_id, s.store_id, s.date, l.lag1 AS sales_lag_1, l.lag28 AS sales_lag_28
    FROM (SELECT store_id, item_id, max(date) AS date FROM panel GROUP BY 1, 2) s
    LEFT JOIN (SELECT store_id, item_id, date, lag(sales, 1) OVER w AS lag1, lag(sales, 28) OVER w AS lag28
               FROM panel WINDOW w AS (PARTITION BY store_id, item_id ORDER BY date)) l
      ON l.store_id = s.store_id AND l.item_id = s.item_id AND l.date = s.date""",
    "panel",
)
def _(spark, folder):
    panel = marts.panel(spark, folder)
    skeleton = panel.groupBy("store_id", "item_id").agg(F.max("date").alias("date"))
    lags = demand_features(panel).select("store_id", "item_id", "date", "sales_lag_1", "sales_lag_28")
    return joins.join_step_features(skeleton, lags, ["store_id", "item_id", "date"])


SPLIT = "(SELECT max(date) - 27 FROM panel)"
WEIGHTS = f"""
    revenue AS (SELECT store_id, item_id, coalesce(avg(sales * sell_price), 0) AS r FROM panel WHERE date >= {SPLIT} GROUP BY 1, 2),
    weights AS (SELECT store_id, item_id, CASE WHEN (SELECT sum(r) FROM revenue) = 0 THEN 1.0 / (SELECT count(*) FROM revenue)
                ELSE r / (SELECT sum(r) FROM revenue) END AS weight FROM revenue),
    naive AS (SELECT store_id, item_id, date, sales AS y_true, lag28 AS y_pred FROM (
                SELECT *, lag(sales, 28) OVER (PARTITION BY store_id, item_id ORDER BY date) AS lag28 FROM panel) WHERE date >= {SPLIT}),
    scale AS (SELECT store_id, item_id, CASE WHEN avg(diff * diff) > 0 THEN sqrt(avg(diff * diff)) END AS denominator FROM (
                SELECT store_id, item_id, sales - lag(sales) OVER (PARTITION BY store_id, item_id ORDER BY date) AS diff
                FROM panel WHERE date < {SPLIT}) GROUP BY 1, 2),
    errors AS (SELECT n.store_id, n.item_id, sqrt(avg((y_pred - y_true) * (y_pred - y_true))) / any_value(s.denominator) AS rmsse
               FROM naive n LEFT JOIN scale s ON s.store_id = n.store_id AND s.item_id = n.item_id GROUP BY 1, 2)"""


def naive_predictions(panel, start):
    """Last month's sales of the same weekday as the prediction; a stand-in model for the metrics."""
    lagged = demand_features(panel).where(F.col("date") >= start)
    return lagged.select("store_id", "item_id", "date", F.col("sales").alias("y_true"), F.col("sales_lag_28").alias("y_pred"))


def split_day(panel):
    return panel.select(F.date_sub(F.max("date"), 27)).scalar()


@query(
    "align_series",
    f""", {WEIGHTS}
    SELECT w.store_id, w.item_id, round(w.weight, 8) AS weight, round(e.rmsse, 6) AS rmsse,
           round(coalesce(w.weight * e.rmsse, 0), 8) AS contribution
    FROM weights w LEFT JOIN errors e ON e.store_id = w.store_id AND e.item_id = w.item_id""",
    "panel",
)
def _(spark, folder):
    panel = checkpointed(marts.panel(spark, folder))
    start = split_day(panel)
    errors = series_rmsse(naive_predictions(panel, start), panel, start)
    aligned = joins.align_series(validation_weights(panel, start), errors, ["store_id", "item_id"], "rmsse")
    return aligned.withColumns(
        {"weight": F.round("weight", 8), "rmsse": F.round("rmsse", 6), "contribution": F.round("contribution", 8)}
    )


@query(
    "semi_top_items",
    """
    SELECT item_id, date, sale FROM sales WHERE item_id IN (
      SELECT item_id FROM (SELECT item_id, sum(sale) AS s FROM sales GROUP BY 1) ORDER BY s DESC, item_id LIMIT 12)""",
    "sales",
)
def _(spark, folder):
    from larder.operators.ranking import top_sellers

    sales = marts.sales(spark, folder)
    return joins.semi_top_items(sales, top_sellers(sales, 12))
