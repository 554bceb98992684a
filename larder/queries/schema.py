"""Header and projection operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators import headers
from larder.plans.cleaning import derive_missing
from larder.plans.tidy import CALENDAR_COLUMNS, synth_day_key, tidy_calendar
from larder.queries.registry import query
from larder.sources import marts


@query(
    "alias_headers",
    """
    SELECT ' ' || sku || ' ' AS sku, '  ' || product_name || ' ' AS product_name,
           CASE WHEN CAST(sku AS BIGINT) % 11 = 0 THEN 'n/a' ELSE CAST(CAST(on_hand AS BIGINT) AS VARCHAR) END AS on_hand,
           CASE WHEN CAST(sku AS BIGINT) % 13 = 0 THEN '-5' ELSE CAST(CAST(stockroom_units AS BIGINT) AS VARCHAR) END AS stockroom_units,
           CASE WHEN CAST(sku AS BIGINT) % 7 = 0 THEN '1' ELSE CAST(CAST(shelf_units AS BIGINT) AS VARCHAR) END AS shelf_units,
           CASE WHEN CAST(sku AS BIGINT) % 17 = 0 THEN '1,000' ELSE CAST(CAST(lead_time_days AS BIGINT) AS VARCHAR) END AS lead_time_days,
           round(CASE WHEN CAST(sku AS BIGINT) % 19 = 0 THEN 0 ELSE avg_daily_sales END, 6) AS avg_daily_sales, category
    FROM inventory""",
    "inventory",
)
def _(spark, folder):
    renamed, _ = headers.alias_headers(marts.raw_inventory(spark, folder))
    return renamed.withColumn("avg_daily_sales", F.round("avg_daily_sales", 6))


@query("snake_headers", "SELECT l_orderkey AS order_key, l_partkey AS part_key_no, l_quantity AS qty_units FROM lineitem")
def _(spark, folder):
    line = marts.table(spark, folder, "lineitem")
    raw = line.select(
        F.col("l_orderkey").alias(" Order-Key "), F.col("l_partkey").alias("Part Key (No.)"), F.col("l_quantity").alias("__Qty/Units")
    )
    return headers.snake_headers(raw)


@query(
    "derive_missing",
    """
    SELECT item_id AS sku, date, day_units AS sold_qty, item_id AS product_name, CAST(0 AS DOUBLE) AS stockroom_units,
           CAST(0 AS DOUBLE) AS shelf_units, CAST(7 AS DOUBLE) AS lead_time_days, CAST(0 AS DOUBLE) AS on_hand,
           round(avg(day_units) OVER (PARTITION BY item_id ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS avg_daily_sales
    FROM (SELECT item_id, date, sum(sale) AS day_units FROM sales GROUP BY 1, 2)""",
    "sales",
)
def _(spark, folder):
    daily = marts.sales(spark, folder).groupBy(F.col("item_id").alias("sku"), "date").agg(F.sum("sale").alias("sold_qty"))
    return derive_missing(daily).withColumn("avg_daily_sales", F.round("avg_daily_sales", 6))


@query("require_columns", "SELECT sku, product_name, on_hand, stockroom_units, shelf_units, lead_time_days FROM inventory", "inventory")
def _(spark, folder):
    return headers.require_columns(marts.inventory(spark, folder), headers.CANONICAL).select(
        "sku", "product_name", "on_hand", "stockroom_units", "shelf_units", "lead_time_days"
    )


@query(
    "order_columns",
    "SELECT sku, product_name, on_hand, stockroom_units, shelf_units, round(avg_daily_sales, 6) AS avg_daily_sales, lead_time_days, category, selling_price FROM inventory",
    "inventory",
)
def _(spark, folder):
    mixed = marts.inventory(spark, folder).withColumn("avg_daily_sales", F.round("avg_daily_sales", 6))
    return headers.order_columns(mixed.select(*sorted(mixed.columns, reverse=True)), headers.CANONICAL + headers.DERIVED)


@query(
    "project_keep",
    "SELECT d, date, wm_yr_wk, wday, month, year, event_name_1, event_type_1, event_name_2, event_type_2, snap_ca, snap_tx, snap_wi FROM calendar",
    "calendar",
)
def _(spark, folder):
    calendar = marts.calendar(spark, folder).withColumn("note", F.lit("not kept"))
    return headers.project_keep(calendar, CALENDAR_COLUMNS)


@query(
    "wide_to_long",
    """
    SELECT item_id || '_' || store_id AS id, item_id, dept_id, cat_id, store_id, state_id, d, sold_qty FROM week_cells
    UNION ALL
    SELECT item_id || '_' || store_id, item_id, dept_id, cat_id, store_id, state_id, d, sold_qty + 1 FROM week_cells
    WHERE item_id LIKE '%0' OR item_id LIKE '%5'""",
    "week_cells",
)
def _(spark, folder):
    ids = ["id", "item_id", "dept_id", "cat_id", "store_id", "state_id"]
    return headers.wide_to_long(marts.wide_sales(spark, folder), ids)


@query("synth_day_key", "SELECT 'd_' || row_number() OVER (ORDER BY date) AS d, date FROM calendar", "calendar")
def _(spark, folder):
    return synth_day_key(marts.calendar(spark, folder).select("date")).select("d", "date")


@query(
    "tidy_calendar",
    "SELECT d, date, event_name_1, snap_ca FROM calendar",
    "calendar",
)
def _(spark, folder):
    raw = marts.calendar(spark, folder).select(
        F.concat("d", F.lit(" ")).alias("D"), F.date_format("date", "M/d/yyyy").alias("Date"), "event_name_1",
        F.col("snap_ca").cast("string").alias("snap_CA"),
    )
    return tidy_calendar(raw)
