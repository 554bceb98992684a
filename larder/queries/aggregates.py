"""Totals, summaries and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions.cleaning import PLAIN_NUMBER
from larder.operators import aggregates as A
from larder.operators import encode
from larder.operators.headers import alias_headers, wide_to_long
from larder.plans import evaluate
from larder.plans.cleaning import clean_inventory
from larder.plans.features import global_median_fill
from larder.plans.forecast import forecast_items
from larder.plans.training import union_history
from larder.queries.joins import WEIGHTS, naive_predictions, split_day
from larder.queries.registry import query
from larder.session import checkpointed
from larder.sources import marts


def rounded(df, digits, *columns):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(
    "inventory_kpis",
    """
    SELECT count(*) AS rows, count(DISTINCT sku) AS unique_sku, CAST(floor(sum(on_hand)) AS BIGINT) AS total_on_hand,
           round_even(avg(avg_daily_sales), 3) AS avg_daily_sales_mean, round_even(avg(avg_daily_sales), 2) AS avg_daily_sales_mean_2
    FROM inventory""",
    "inventory",
)
def _(spark, folder):
    return A.inventory_kpis(marts.inventory(spark, folder))


@query(
    "dashboard_stats",
    """
    SELECT count(*) AS total_skus, sum(on_hand) AS total_on_hand, round(avg(avg_daily_sales), 2) AS avg_daily_sales,
           count(*) FILTER (on_hand < 50) AS low_stock_items FROM inventory""",
    "inventory",
)
def _(spark, folder):
    return A.dashboard_stats(marts.inventory(spark, folder))


@query("daily_item_sales", "SELECT item_id, date, sale AS sales FROM item_daily", "item_daily")
def _(spark, folder):
    return A.daily_item_sales(marts.sales(spark, folder))


@query("total_sales_by_item", "SELECT item_id, sum(sale) AS sales FROM sales GROUP BY 1", "sales")
def _(spark, folder):
    return A.total_sales_by_item(marts.sales(spark, folder))


@query(
    "sales_revenue",
    """
    SELECT s.item_id, sum(s.sale) AS units, round(sum(s.sale) * any_value(i.price), 2) AS revenue
    FROM sales s JOIN item_dim i ON i.item_id = s.item_id GROUP BY 1""",
    "sales item_dim",
)
def _(spark, folder):
    return rounded(A.sales_revenue(marts.sales(spark, folder), marts.item_dim(spark, folder)), 2, "revenue")


@query(
    "low_stock_items",
    "SELECT i.item_id, v.unit, i.description FROM stock v JOIN item_dim i ON i.item_id = v.item_id WHERE v.unit < 20",
    "stock item_dim",
)
def _(spark, folder):
    return A.low_stock_items(marts.stock(spark, folder), marts.item_dim(spark, folder), 20)


@query(
    "sales_last_month",
    "SELECT date, sum(sale) AS sales FROM sales WHERE date > (SELECT max(date) - 30 FROM sales) GROUP BY 1",
    "sales",
)
def _(spark, folder):
    return A.sales_last_month(marts.sales(spark, folder))


@query("sales_by_category", "SELECT cat_id AS category, sum(sale) AS sales FROM lines GROUP BY 1", "lines")
def _(spark, folder):
    return A.sales_by_category(marts.lines(spark, folder).select("item_id", "sale"))


@query(
    "revenue_by_category",
    """
    SELECT p_type AS category, sum(units) AS units, round(sum(units * price), 2) AS revenue
    FROM (SELECT s.item_id, sum(s.sale) AS units, any_value(i.price) AS price FROM sales s JOIN item_dim i ON i.item_id = s.item_id GROUP BY 1)
    JOIN part ON CAST(p_partkey AS VARCHAR) = CAST(item_id AS VARCHAR) GROUP BY 1""",
    "sales item_dim",
)
def _(spark, folder):
    found = A.revenue_by_category(marts.sales(spark, folder), marts.item_dim(spark, folder), marts.item_categories(spark, folder))
    return rounded(found, 2, "revenue")


@query(
    "sales_by_item_category",
    "SELECT p_type AS category, sum(l_quantity) AS sales FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1",
)
def _(spark, folder):
    return A.sales_by_category(marts.sales(spark, folder), marts.item_categories(spark, folder))


@query(
    "period_compare",
    """
    SELECT current_units, previous_units, current_units - previous_units AS difference, round(current_units / previous_units, 6) AS ratio FROM (
      SELECT sum(sale) FILTER (date > m - 365) AS current_units, sum(sale) FILTER (date <= m - 365 AND date > m - 730) AS previous_units
      FROM sales, (SELECT max(date) AS m FROM sales))""",
    "sales",
)
def _(spark, folder):
    return rounded(A.period_compare(marts.sales(spark, folder), 365), 6, "ratio")


@query(
    "inventory_turnover",
    """
    SELECT s.item_id, sum(s.sale) AS sold, any_value(v.unit) AS unit,
           round(sum(s.sale) / nullif(any_value(v.unit), 0), 6) AS turnover
    FROM sales s JOIN stock v ON v.item_id = s.item_id GROUP BY 1""",
    "sales stock",
)
def _(spark, folder):
    return rounded(A.inventory_turnover(marts.sales(spark, folder), marts.stock(spark, folder)), 6, "turnover")


@query("inventory_by_category", "SELECT category, sum(on_hand) AS on_hand, count(*) AS items FROM inventory GROUP BY 1", "inventory")
def _(spark, folder):
    return A.inventory_by_category(marts.inventory(spark, folder))


@query(
    "sales_stock_relation",
    "SELECT count(*) AS products, round(corr(avg_daily_sales, on_hand), 6) AS correlation FROM inventory",
    "inventory",
)
def _(spark, folder):
    return rounded(A.sales_stock_relation(marts.inventory(spark, folder)), 6, "correlation")


@query(
    "store_rollup",
    """
    SELECT item_id, d, sum(CASE WHEN item_id LIKE '%0' OR item_id LIKE '%5' THEN 2 * sold_qty + 1 ELSE sold_qty END)::BIGINT AS sales
    FROM week_cells GROUP BY 1, 2""",
    "week_cells",
)
def _(spark, folder):
    return A.store_rollup(wide_to_long(marts.wide_sales(spark, folder), ["item_id", "store_id"]))


@query("max_sale_by_item", "SELECT item_id, max(sale) AS sale FROM sales GROUP BY 1", "sales")
def _(spark, folder):
    return A.max_sale_by_item(marts.sales(spark, folder))


@query("derive_inv", "SELECT item_id, unit FROM inv", "inv")
def _(spark, folder):
    return A.derive_inv(marts.sales(spark, folder))


@query("mean_price_by_item", "SELECT item_id, round(avg(sell_price), 10) AS sell_price FROM prices GROUP BY 1", "prices")
def _(spark, folder):
    return rounded(A.mean_price_by_item(marts.prices(spark, folder)), 10, "sell_price")


CALENDAR_COLUMNS = [
    "d", "date", "wm_yr_wk", "wday", "month", "year", "event_name_1", "event_type_1", "event_name_2", "event_type_2",
    "snap_ca", "snap_tx", "snap_wi",
]


@query(
    "null_counts",
    " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS nulls FROM calendar" for c in CALENDAR_COLUMNS),
    "calendar",
)
def _(spark, folder):
    return A.null_counts(marts.calendar(spark, folder).select(*CALENDAR_COLUMNS))


@query(
    "table_counts",
    """
    SELECT 'sales' AS table_name, count(*) AS rows FROM sales UNION ALL SELECT 'inv', count(*) FROM inv
    UNION ALL SELECT 'item_dim', count(*) FROM item_dim""",
    "sales inv item_dim",
)
def _(spark, folder):
    return A.table_counts(
        {"sales": marts.sales(spark, folder), "inv": marts.inv(spark, folder), "item_dim": marts.item_dim(spark, folder)}
    )


SUMMARY = """
    SELECT item_id, count(*) AS periods, min(ds) AS forecast_start, max(ds) AS forecast_end, round(avg(yhat), 4) AS avg_daily_demand,
           round(sum(yhat), 4) AS total_demand, round(avg(yhat) FILTER (rn <= 7), 4) AS next_days_mean,
           CASE WHEN arg_max(yhat, ds) > arg_min(yhat, ds) THEN 'increasing' WHEN arg_max(yhat, ds) < arg_min(yhat, ds) THEN 'decreasing' ELSE 'stable' END AS trend
    FROM (SELECT item_id, ds, round(yhat, 8) AS yhat, row_number() OVER (PARTITION BY item_id ORDER BY ds) AS rn FROM forecast) GROUP BY 1"""


@query("forecast_summary", SUMMARY, "forecast")
def _(spark, folder):
    forecast = forecast_items(marts.sales(spark, folder)).withColumn("yhat", F.round("yhat", 8))
    return rounded(A.forecast_summary(forecast), 4, "avg_daily_demand", "total_demand", "next_days_mean")


@query(
    "global_median_fill",
    """
    SELECT store_id, item_id, date, round(coalesce(p, (SELECT median(p) FROM thinned)), 6) AS sell_price FROM thinned""",
    "thinned",
)
def _(spark, folder):
    prices = marts.panel(spark, folder).select(
        "store_id", "item_id", "date", F.when(F.dayofmonth("date") != 1, F.col("sell_price")).alias("sell_price")
    )
    return rounded(global_median_fill(prices, "sell_price"), 6, "sell_price")


@query(
    "value_counts_topk",
    "SELECT p_name AS value, count(*) AS count FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
)
def _(spark, folder):
    line = marts.table(spark, folder, "lineitem").select(F.col("l_partkey").alias("p_partkey"))
    return A.value_counts_topk(line.join(marts.table(spark, folder, "part"), "p_partkey"), "p_name")


@query(
    "clean_stats",
    """
    SELECT count(*) AS rows, count(*) FILTER (shelf_units < 3) AS low_shelf, count(*) FILTER (avg_daily_sales <= 0) AS zero_avg_sales,
           min(on_hand) AS min_on_hand, max(on_hand) AS max_on_hand, round(min(avg_daily_sales), 6) AS min_avg_daily_sales,
           round(max(avg_daily_sales), 6) AS max_avg_daily_sales, round(min(days_of_cover), 6) AS min_days_of_cover,
           round(max(days_of_cover), 6) AS max_days_of_cover
    FROM clean_inv""",
    "clean_inv",
)
def _(spark, folder):
    stats = A.clean_stats(clean_inventory(marts.inventory(spark, folder)))
    ranges = ["min_avg_daily_sales", "max_avg_daily_sales", "min_days_of_cover", "max_days_of_cover"]
    return rounded(stats, 6, *ranges)


@query(
    "coerced_counts",
    """
    SELECT count(*) AS rows, count(*) FILTER (CAST(sku AS BIGINT) % 11 = 0) AS coerced_on_hand,
           count(*) FILTER (CAST(sku AS BIGINT) % 17 = 0) AS coerced_lead_time_days FROM inventory""",
    "inventory",
)
def _(spark, folder):
    # Validity is read off the raw cells, in the same pass as the counts of the renamed table.
    renamed, _ = alias_headers(marts.raw_inventory(spark, folder))
    valid = {c: F.coalesce(F.trim(c).rlike(PLAIN_NUMBER), F.lit(False)) for c in ("on_hand", "lead_time_days")}
    numbers = renamed.withColumn("days_of_cover", F.lit(0.0))
    return A.clean_stats(numbers, valid).select("rows", "coerced_on_hand", "coerced_lead_time_days")


@query("chat_stats", "SELECT role, count(*) AS messages FROM conversations GROUP BY 1")
def _(spark, folder):
    return A.chat_stats(marts.messages(spark, folder))


@query(
    "pie_share",
    "SELECT category, on_hand, items, round(on_hand / sum(on_hand) OVER (), 6) AS share FROM (SELECT category, sum(on_hand) AS on_hand, count(*) AS items FROM inventory GROUP BY 1)",
    "inventory",
)
def _(spark, folder):
    return rounded(A.pie_share(A.inventory_by_category(marts.inventory(spark, folder)), "on_hand"), 6, "share")


@query(
    "histogram_bins",
    """
    , s AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi, greatest(1, least(20, count(*) // 2)) AS bins FROM lineitem),
    c AS (SELECT least(floor((l_quantity - lo) / ((hi - lo) / bins)), bins - 1) AS bin, count(*) AS n FROM lineitem, s GROUP BY 1)
    SELECT CAST(b AS INTEGER) AS bin, round(lo + b * ((hi - lo) / bins), 6) AS left_edge, round(lo + (b + 1) * ((hi - lo) / bins), 6) AS right_edge, coalesce(n, 0) AS n
    FROM (SELECT lo, hi, bins, unnest(range(bins)) AS b FROM s) LEFT JOIN c ON c.bin = b""",
    "days",
)
def _(spark, folder):
    return rounded(A.histogram_bins(marts.table(spark, folder, "lineitem"), "l_quantity"), 6, "left_edge", "right_edge")


@query(
    "rmse",
    """
    SELECT round(sqrt(avg((l_discount - l_tax) * (l_discount - l_tax))), 8) AS rmse, round(avg(abs(l_discount - l_tax)), 8) AS mean_abs_error FROM lineitem""",
)
def _(spark, folder):
    return rounded(A.rmse(marts.table(spark, folder, "lineitem"), "l_tax", "l_discount"), 8, "rmse", "mean_abs_error")


@query(
    "rmsse_denominator",
    f", {WEIGHTS} SELECT store_id, item_id, round(denominator, 6) AS denominator FROM scale",
    "panel",
)
def _(spark, folder):
    panel = checkpointed(marts.panel(spark, folder))
    history = panel.where(F.col("date") < split_day(panel))
    return rounded(evaluate.rmsse_denominator(history), 6, "denominator")


@query(
    "wrmsse_bottom",
    f""", {WEIGHTS}
    SELECT round(sum(coalesce(w.weight * e.rmsse, 0)), 8) AS wrmsse
    FROM weights w LEFT JOIN errors e ON e.store_id = w.store_id AND e.item_id = w.item_id""",
    "panel",
)
def _(spark, folder):
    panel = checkpointed(marts.panel(spark, folder))
    start = split_day(panel)
    return rounded(evaluate.wrmsse_bottom(naive_predictions(panel, start), panel, start), 8, "wrmsse")


@query(
    "union_history",
    """
    SELECT store_id, item_id, date, sales FROM panel
    UNION ALL SELECT store_id, item_id, CAST(max(date) + 1 AS DATE), CAST(NULL AS DOUBLE) FROM panel GROUP BY 1, 2""",
    "panel",
)
def _(spark, folder):
    panel = marts.panel(spark, folder).select("store_id", "item_id", "date", "sales")
    next_day = panel.groupBy("store_id", "item_id").agg(F.date_add(F.max("date"), 1).alias("date"))
    return union_history(panel, next_day)


@query("distinct_pairs", "SELECT DISTINCT item_id, date, CAST(2000 AS DOUBLE) AS unit FROM sales", "sales")
def _(spark, folder):
    return encode.distinct_pairs(marts.sales(spark, folder), ["item_id", "date"], "unit", 2000.0)


@query("distinct_images", "SELECT DISTINCT 'order_' || l_orderkey || '.jpg' AS image FROM lineitem")
def _(spark, folder):
    boxes = marts.table(spark, folder, "lineitem")
    return boxes.select(F.concat(F.lit("order_"), F.col("l_orderkey").cast("string"), F.lit(".jpg")).alias("image")).distinct()
