"""Row selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators import filters, search
from larder.plans.features import demand_features
from larder.queries.registry import query
from larder.session import scratch_path
from larder.sources import catalog, marts

INVENTORY_COLUMNS = ["sku", "product_name", "on_hand", "stockroom_units", "shelf_units", "lead_time_days", "category"]
INVENTORY = ", ".join(INVENTORY_COLUMNS)


def _inventory(spark, folder):
    return marts.inventory(spark, folder).select(*INVENTORY_COLUMNS, "avg_daily_sales")


@query(
    "search_inventory",
    f"SELECT {INVENTORY} FROM inventory WHERE lower(sku) LIKE '%ring%' OR lower(product_name) LIKE '%ring%' ORDER BY sku LIMIT 500",
    "inventory",
)
def _(spark, folder):
    return filters.search_inventory(_inventory(spark, folder), "RING", 500).select(*INVENTORY_COLUMNS)


@query(
    "search_inventory_index",
    f"SELECT {INVENTORY} FROM inventory WHERE lower(sku) LIKE '%ring%' OR lower(product_name) LIKE '%ring%'",
    "inventory",
)
def _(spark, folder):
    """The same search, all its rows, through posting lists."""
    path = search.write_search_index(_inventory(spark, folder), scratch_path(spark, "search"), "sku", ["sku", "product_name"])
    return search.search(spark, path, "sku", ["sku", "product_name"], "RING").select(*INVENTORY_COLUMNS)


@query(
    "filter_chat",
    "SELECT conv_id, turn, role, content FROM messages WHERE role IN ('user', 'assistant') AND lower(content) LIKE '%forecast%'",
    "messages",
)
def _(spark, folder):
    newest = [F.desc("conv_id"), F.desc("turn")]
    return filters.filter_chat(marts.messages(spark, folder), ["user", "assistant"], "Forecast", newest)


@query(
    "lookup_sku",
    """
    SELECT sku, CAST(floor(on_hand) AS BIGINT) AS on_hand, CAST(floor(shelf_units) AS BIGINT) AS shelf,
           CAST(floor(stockroom_units) AS BIGINT) AS stockroom,
           CASE WHEN avg_daily_sales > 0 THEN round_even(floor(on_hand) / avg_daily_sales, 2) END AS days_cover, lead_time_days
    FROM inventory WHERE lower(sku) LIKE '%17%' ORDER BY CASE WHEN lower(sku) = '17' THEN 0 ELSE 1 END, sku LIMIT 1""",
    "inventory",
)
def _(spark, folder):
    return filters.lookup_sku(_inventory(spark, folder), "17")


@query("filter_equals", "SELECT item_id, store_id, date, sale FROM lines WHERE dept_id = 'HOBBIES_1'", "lines")
def _(spark, folder):
    return filters.filter_equals(marts.lines(spark, folder), dept_id="HOBBIES_1").select("item_id", "store_id", "date", "sale")


@query(
    "limit_entities",
    """
    SELECT item_id, store_id, date, sale FROM lines
    WHERE store_id IN (SELECT DISTINCT store_id FROM lines ORDER BY store_id LIMIT 2)
      AND item_id IN (SELECT DISTINCT item_id FROM lines ORDER BY item_id LIMIT 7)""",
    "lines",
)
def _(spark, folder):
    facts = marts.lines(spark, folder)
    kept = filters.limit_entities(filters.limit_entities(facts, "store_id", 2), "item_id", 7)
    return kept.select("item_id", "store_id", "date", "sale")


@query("last_n_days", "SELECT item_id, date, sale FROM sales WHERE date >= (SELECT max(date) - 90 FROM sales)", "sales")
def _(spark, folder):
    return filters.last_n_days(marts.sales(spark, folder), 90)


@query("filter_category", f"SELECT {INVENTORY} FROM inventory WHERE lower(category) LIKE '%econ%'", "inventory")
def _(spark, folder):
    return filters.filter_category(_inventory(spark, folder), "Econ").select(*INVENTORY_COLUMNS)


@query("sku_history", "SELECT item_id AS sku, date, sale AS demand FROM item_daily WHERE item_id = '42'", "item_daily")
def _(spark, folder):
    history = marts.sales(spark, folder).groupBy(F.col("item_id").alias("sku"), "date").agg(F.sum("sale").alias("demand"))
    return filters.sku_history(history, "42")


@query("sku_history_keyed", "SELECT item_id AS sku, date, sale AS demand FROM item_daily WHERE item_id = '42'", "item_daily")
def _(spark, folder):
    """The same lookup on a table laid out for it."""
    history = marts.sales(spark, folder).groupBy(F.col("item_id").alias("sku"), "date").agg(F.sum("sale").alias("demand"))
    path = catalog.write_keyed(history, scratch_path(spark, "history"), "sku", ["date"])
    return filters.sku_history(spark.read.parquet(path), "42")


@query(
    "drop_null_features",
    """
    SELECT store_id, item_id, date, sales, round(lag7, 6) AS sales_lag_7 FROM (
      SELECT store_id, item_id, date, sales, lag(sales, 7) OVER (PARTITION BY store_id, item_id ORDER BY date) AS lag7,
             lag(sales, 56) OVER (PARTITION BY store_id, item_id ORDER BY date) AS lag56 FROM panel)
    WHERE lag7 IS NOT NULL AND lag56 IS NOT NULL""",
    "panel",
)
def _(spark, folder):
    rows = demand_features(marts.panel(spark, folder))
    kept = filters.drop_null_features(rows, ["sales_lag_7", "sales_lag_56"])
    return kept.select("store_id", "item_id", "date", "sales", F.round("sales_lag_7", 6).alias("sales_lag_7"))


KEYED = """
    SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 9 = 0 THEN NULL WHEN l_orderkey % 10 = 0 THEN '' ELSE CAST(l_partkey AS VARCHAR) END AS sku
    FROM lineitem"""


@query("drop_missing_keys", f"SELECT * FROM ({KEYED}) WHERE sku IS NOT NULL AND sku <> ''")
def _(spark, folder):
    k = F.col("l_orderkey")
    sku = F.when(k % 9 == 0, None).when(k % 10 == 0, "").otherwise(F.col("l_partkey").cast("string"))
    keyed = marts.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", sku.alias("sku"))
    return filters.drop_missing_keys(keyed, ["sku", "location_id"])


@query("threshold_filter", "SELECT item_id, date, sale FROM sales WHERE sale > 20 AND sale < 40", "sales")
def _(spark, folder):
    return filters.threshold_filter(marts.sales(spark, folder), "sale", above=20, below=40)


@query("exclude_item", "SELECT item_id, unit FROM inv WHERE item_id NOT IN ('3', '5')", "inv")
def _(spark, folder):
    return filters.exclude_item(marts.inv(spark, folder), ["3", "5"])
