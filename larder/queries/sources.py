"""Readers, writers and table maintenance, each exercised by writing to the shared folder and reading back."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators.headers import wide_to_long
from larder.plans.cleaning import clean_inventory
from larder.plans.forecast import forecast_items
from larder.queries.registry import query
from larder.session import scratch_path
from larder.sources import catalog, marts, readers, writers

INVENTORY = "SELECT sku, product_name, on_hand, stockroom_units, shelf_units, avg_daily_sales, lead_time_days, category, selling_price FROM inventory"


@query("read_inventory", INVENTORY, "inventory")
def _(spark, folder):
    inventory = marts.inventory(spark, folder)
    path = writers.write_parquet(inventory, scratch_path(spark, "inventory") + ".parquet")
    return readers.read_inventory(spark, path)


@query("write_csv", INVENTORY, "inventory")
def _(spark, folder):
    inventory = marts.inventory(spark, folder)
    path = writers.write_csv(inventory, scratch_path(spark, "inventory-csv"))
    return readers.read_inventory(spark, path, inventory.schema)


@query("write_parquet", INVENTORY, "inventory")
def _(spark, folder):
    path = writers.write_parquet(marts.inventory(spark, folder), scratch_path(spark, "inventory"))
    return spark.read.parquet(path)


@query(
    "read_raw_strings",
    """
    SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber,
           CASE k % 4 WHEN 0 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) WHEN 3 THEN 'N/A' END AS quantity
    FROM (SELECT *, l_orderkey + l_linenumber AS k FROM lineitem)""",
)
def _(spark, folder):
    line = marts.table(spark, folder, "lineitem")
    k = (F.col("l_orderkey") + F.col("l_linenumber")) % 4
    quantity = (
        F.when(k == 0, F.col("l_quantity").cast("long").cast("string")).when(k == 1, "n/a").when(k == 2, "-").otherwise("N/A")
    )
    path = writers.write_csv(line.select("l_orderkey", "l_linenumber", quantity.alias("quantity")), scratch_path(spark, "raw"))
    return readers.read_raw_strings(spark, path)


@query(
    "read_m5",
    """
    SELECT 'calendar' AS source, d AS key1, CAST(date AS VARCHAR) AS key2, CAST(wm_yr_wk AS VARCHAR) AS key3, event_name_1 AS value, CAST(snap_ca AS VARCHAR) AS flag, NULL AS load_no FROM calendar
    UNION ALL SELECT 'prices', store_id, item_id, CAST(wm_yr_wk AS VARCHAR), CAST(CAST(round(sell_price * 10000) AS BIGINT) AS VARCHAR), NULL, NULL FROM prices
    UNION ALL SELECT 'sales', store_id, item_id, d, CAST(sold_qty AS VARCHAR), NULL, '1' FROM week_cells
    UNION ALL SELECT 'sales', store_id, item_id, d, CAST(sold_qty + 1 AS VARCHAR), NULL, '0' FROM week_cells WHERE regexp_matches(item_id, '[05]$')""",
    "calendar prices week_cells",
)
def _(spark, folder):
    calendar = marts.calendar(spark, folder).select("d", "date", "wm_yr_wk", "event_name_1", F.col("snap_ca").alias("snap_CA"))
    paths = [
        writers.write_csv(df, scratch_path(spark, name))
        for name, df in (
            ("sales", marts.wide_sales(spark, folder)), ("calendar", calendar), ("prices", marts.prices(spark, folder)),
        )
    ]
    sales, days, prices = readers.read_m5(spark, *paths)
    none = F.lit(None).cast("string")
    # The daily columns of the wide table as rows, of both loads; prices in hundredths of a cent.
    cells = wide_to_long(sales, ["store_id", "item_id", "load_no"])
    cents = F.round(F.col("sell_price").cast("double") * 10000).cast("long").cast("string")
    return (
        days.select(F.lit("calendar").alias("source"), F.col("d").alias("key1"), F.col("date").alias("key2"), F.col("wm_yr_wk").alias("key3"), F.col("event_name_1").alias("value"), F.col("snap_ca").alias("flag"), none.alias("load_no"))
        .unionByName(prices.select(F.lit("prices").alias("source"), F.col("store_id").alias("key1"), F.col("item_id").alias("key2"), F.col("wm_yr_wk").alias("key3"), cents.alias("value"), none.alias("flag"), none.alias("load_no")))
        .unionByName(cells.select(F.lit("sales").alias("source"), F.col("store_id").alias("key1"), F.col("item_id").alias("key2"), F.col("d").alias("key3"), F.col("sold_qty").alias("value"), none.alias("flag"), "load_no"))
    )


@query("write_json_records", "SELECT item_id, CAST(date AS VARCHAR) AS date, sale FROM sales", "sales")
def _(spark, folder):
    path = writers.write_json_records(marts.sales(spark, folder), scratch_path(spark, "json"))
    return readers.read_json_records(spark, path, "item_id string, date string, sale double")


@query("read_json_records", "SELECT item_id, description, price, lead_time, holding_cost FROM item_dim", "item_dim")
def _(spark, folder):
    items = marts.item_dim(spark, folder)
    path = writers.write_json_records(items, scratch_path(spark, "json"))
    return readers.read_json_records(spark, path, items.schema)


@query(
    "write_parquet_partitioned",
    "SELECT item_id, dept_id, cat_id, date, sale, list_price, state_id, store_id FROM lines",
    "lines",
)
def _(spark, folder):
    path = scratch_path(spark, "by-store")
    writers.write_parquet_partitioned(marts.lines(spark, folder), path, ["state_id", "store_id"])
    return spark.read.parquet(path)


@query(
    "write_forecast",
    """
    SELECT ds AS date, round(yhat, 4) AS forecast_sales, round(yhat_lower, 4) AS forecast_lower_bound,
           round(yhat_upper, 4) AS forecast_upper_bound, item_id FROM forecast""",
    "forecast",
)
def _(spark, folder):
    path = writers.write_forecast(forecast_items(marts.sales(spark, folder)), scratch_path(spark, "forecast"))
    bounds = ["forecast_sales", "forecast_lower_bound", "forecast_upper_bound"]
    return spark.read.parquet(path).withColumns({c: F.round(c, 4) for c in bounds})


@query(
    "replace_table",
    "SELECT sku, product_name, on_hand, round(days_of_cover, 6) AS days_of_cover, restock_needed, safety_stock FROM clean_inv",
    "clean_inv",
)
def _(spark, folder):
    cleaned = clean_inventory(marts.inventory(spark, folder))
    path = scratch_path(spark, "inventory")
    name = "larder_" + path.rsplit("-", 1)[1]
    table = catalog.replace_table(cleaned, name, path)
    return table.select(
        "sku", "product_name", "on_hand", F.round("days_of_cover", 6).alias("days_of_cover"), "restock_needed", "safety_stock"
    )


@query(
    "append_rows",
    "SELECT role, text AS content, TRUE AS stamped FROM conversations UNION ALL SELECT 'note' AS role, p_name AS content, TRUE AS stamped FROM part",
)
def _(spark, folder):
    path = scratch_path(spark, "chat")
    talk = marts.table(spark, folder, "conversations").select("role", F.col("text").alias("content"))
    notes = marts.table(spark, folder, "part").select(F.lit("note").alias("role"), F.col("p_name").alias("content"))
    catalog.append_rows(talk, path)
    catalog.append_rows(notes, path)
    return spark.read.parquet(path).select("role", "content", F.col("created_at").isNotNull().alias("stamped"))


UPSERTED = """
    SELECT p_partkey AS id, CASE WHEN best.q IS NULL THEN p_name ELSE 'sold ' || best.q END AS label
    FROM part LEFT JOIN (
      SELECT l_partkey, arg_max(CAST(l_quantity AS BIGINT), CAST(l_shipdate AS VARCHAR) || lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || lpad(CAST(l_linenumber AS VARCHAR), 3, '0') || lpad(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), 6, '0')) AS q
      FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) best ON l_partkey = p_partkey"""


def _returned(spark, folder):
    """New labels of returned items, and the order in which they were given."""
    returned = marts.table(spark, folder, "lineitem").where("l_returnflag = 'R'")
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_quantity"]
    label = F.concat(F.lit("sold "), F.col("l_quantity").cast("long").cast("string")).alias("label")
    return returned.select(F.col("l_partkey").alias("id"), label, *order), [F.col(c) for c in order]


def _items(spark, folder):
    path = scratch_path(spark, "items")
    name = "larder_items_" + path.rsplit("-", 1)[1]
    part = marts.table(spark, folder, "part")
    catalog.replace_table(part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label")), name, path)
    changes, order = _returned(spark, folder)
    location = catalog.upsert_by_key(spark, name, changes, "id", order)
    spark.sql(f"DROP TABLE {name}")
    return spark.read.parquet(location)


@query("upsert_by_key", UPSERTED)
def _(spark, folder):
    return _items(spark, folder)


@query("list_ordered", UPSERTED)
def _(spark, folder):
    return catalog.list_ordered(_items(spark, folder))


@query(
    "sample_first_n",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem ORDER BY 1, 2, 3, 4, 5 LIMIT 1000",
)
def _(spark, folder):
    columns = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    first = catalog.sample_first_n(marts.table(spark, folder, "lineitem").select(*columns), columns, 1000)
    path = writers.write_csv(first, scratch_path(spark, "sample"))
    return readers.read_inventory(spark, path, first.schema)


@query(
    "table_profile",
    """
    SELECT 'part' AS table_name, 'p_partkey' AS column_name, 'bigint' AS data_type, CAST(count(*) FILTER (p_partkey IS NULL) AS BIGINT) AS nulls, min(CAST(p_partkey AS VARCHAR)) AS example FROM part
    UNION ALL SELECT 'part', 'p_name', 'string', count(*) FILTER (p_name IS NULL), min(p_name) FROM part
    UNION ALL SELECT 'part', 'p_brand', 'string', count(*) FILTER (p_brand IS NULL), min(p_brand) FROM part
    UNION ALL SELECT 'part', 'p_type', 'string', count(*) FILTER (p_type IS NULL), min(p_type) FROM part
    UNION ALL SELECT 'part', 'p_size', 'int', count(*) FILTER (p_size IS NULL), min(CAST(p_size AS VARCHAR)) FROM part
    UNION ALL SELECT 'part', 'p_retailprice', 'double', count(*) FILTER (p_retailprice IS NULL), min(CAST(p_retailprice AS VARCHAR)) FROM part""",
)
def _(spark, folder):
    return catalog.table_profile(marts.table(spark, folder, "part"), "part")


@query(
    "table_samples",
    """
    WITH texts AS (
        SELECT [CAST(p_partkey AS VARCHAR), p_name, p_brand, p_type, CAST(p_size AS VARCHAR), CAST(p_retailprice AS VARCHAR)] AS cells FROM part
    ), ranked AS (
        SELECT cells, row_number() OVER (ORDER BY sha256(array_to_string([coalesce(strlen(c) || ':' || c, '-') FOR c IN cells], '')), cells) AS position FROM texts
    )
    SELECT 'part' AS table_name, CAST(position AS INTEGER) AS position, cells[1] AS p_partkey, cells[2] AS p_name, cells[3] AS p_brand, cells[4] AS p_type,
           cells[5] AS p_size, cells[6] AS p_retailprice FROM ranked WHERE position <= 3""",
)
def _(spark, folder):
    return catalog.table_samples(marts.table(spark, folder, "part"), "part")


@query("upsert_buckets", UPSERTED)
def _(spark, folder):
    path = scratch_path(spark, "items")
    part = marts.table(spark, folder, "part")
    catalog.write_buckets(part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label")), path, "id", buckets=16)
    changes, order = _returned(spark, folder)
    catalog.upsert_buckets(spark, path, changes, "id", order)
    return catalog.read_buckets(spark, path)


@query(
    "run_sql",
    """
    SELECT i.item_id, i.description, sum(s.sale) AS total_sales FROM sales s JOIN item_dim i ON i.item_id = s.item_id
    WHERE s.sale > 20 GROUP BY 1, 2""",
    "sales item_dim",
)
def _(spark, folder):
    text = """
        SELECT i.item_id, i.description, sum(s.sale) AS total_sales
        FROM {sales} s JOIN {item_dim} i ON i.item_id = s.item_id
        WHERE s.sale > :above GROUP BY i.item_id, i.description"""
    tables = {"sales": marts.sales(spark, folder), "item_dim": marts.item_dim(spark, folder)}
    return catalog.run_sql(spark, text, tables, {"above": 20})


@query(
    "scan_images",
    """
    SELECT DISTINCT p_brand AS brand, 'part-.png' AS file, CAST(octet_length(encode(p_brand)) + 1 AS BIGINT) AS length, p_brand || chr(10) AS content FROM part
    WHERE CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INTEGER) % 2 = 0""",
)
def _(spark, folder):
    # One folder per brand, files of even brands ending in .png and of odd ones in .txt.  The writer's
    # extension option makes real file endings; the scan must list the former only.
    base = scratch_path(spark, "shelf")
    brands = marts.table(spark, folder, "part").select("p_brand").distinct().withColumn("brand", F.col("p_brand"))
    even = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int") % 2 == 0
    for ending, rows in (("png", brands.where(even)), ("txt", brands.where(~even))):
        rows.repartition("brand").write.mode("append").option("extension", ending).partitionBy("brand").csv(base)
    found = readers.scan_images(spark, base)
    # Spark numbers its files and gives them random names, which are left out.
    return found.select(
        F.url_decode(F.regexp_extract("path", r"brand=([^/]+)", 1)).alias("brand"),
        F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"^part-.*(\.\w+)$", "part-$1").alias("file"),
        "length",
        F.col("content").cast("string").alias("content"),
    )
