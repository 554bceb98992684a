"""Logical retail tables derived from order data (lineitem, part, supplier, ...), all by expression.

Items are parts; the denser panel used for daily models takes brands as items and regions as stores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.operators.joins import gap_fill

FIRST_MONDAY = "1995-01-02"
# How far a brand's number decides its category; three categories of two departments each.
CATEGORIES = ["FOODS", "HOBBIES", "HOUSEHOLD"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sales(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order line: item_id, date, sale."""
    return table(spark, folder, "lineitem").select(
        F.col("l_partkey").cast("string").alias("item_id"),
        F.to_date("l_shipdate").alias("date"),
        F.col("l_quantity").alias("sale"),
    )


def item_dim(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_partkey").cast("string").alias("item_id"),
        F.col("p_name").alias("description"),
        F.col("p_retailprice").alias("price"),
        (1 + F.col("p_size") % 14).alias("lead_time"),
        F.lit(0.5).alias("holding_cost"),
    )


def item_categories(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        F.col("p_partkey").cast("string").alias("item_id"), F.col("p_type").alias("category")
    )


def inv(spark: SparkSession, folder: str) -> DataFrame:
    """Twice the largest sale of each item."""
    return sales(spark, folder).groupBy("item_id").agg((F.max("sale") * 2).alias("unit"))


def stock(spark: SparkSession, folder: str) -> DataFrame:
    """Stock of varying depth: the derived stock times (1 .. 7) / 20 by item."""
    depth = (1 + F.col("item_id").cast("long") % 7) / F.lit(20.0)
    return inv(spark, folder).withColumn("unit", F.floor(F.col("unit") * depth).cast("double"))


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    daily = sales(spark, folder).groupBy("item_id", "date").agg(F.sum("sale").alias("s"))
    stats = daily.groupBy("item_id").agg((F.max("s") * 2).alias("unit"), F.avg("s").alias("ads"))
    parts = table(spark, folder, "part").withColumn("item_id", F.col("p_partkey").cast("string"))
    unit = F.coalesce("unit", F.lit(0.0))
    shelf = F.floor(unit * 0.3).cast("double")
    return parts.join(stats, "item_id", "left").select(
        F.col("item_id").alias("sku"),
        F.col("p_name").alias("product_name"),
        unit.alias("on_hand"),
        (unit - shelf).alias("stockroom_units"),
        shelf.alias("shelf_units"),
        F.coalesce("ads", F.lit(0.0)).alias("avg_daily_sales"),
        (1 + F.col("p_size") % 14).cast("double").alias("lead_time_days"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").alias("selling_price"),
    )


def raw_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """The inventory as an upload would look: other headers, padded names, numbers as text, some unusable."""
    key = F.col("sku").cast("long")
    return inventory(spark, folder).select(
        F.concat(F.lit(" "), "sku", F.lit(" ")).alias("Item Number"),
        F.concat(F.lit("  "), "product_name", F.lit(" ")).alias("Description"),
        F.when(key % 11 == 0, "n/a").otherwise(F.col("on_hand").cast("long").cast("string")).alias("Qty On-Hand"),
        F.when(key % 13 == 0, "-5").otherwise(F.col("stockroom_units").cast("long").cast("string")).alias("BOH (units)"),
        F.when(key % 7 == 0, "1").otherwise(F.col("shelf_units").cast("long").cast("string")).alias("shelf"),
        F.when(key % 17 == 0, "1,000").otherwise(F.col("lead_time_days").cast("long").cast("string")).alias("Lead-Time"),
        F.when(key % 19 == 0, F.lit(0.0)).otherwise(F.col("avg_daily_sales")).alias("ADS"),
        "category",
    )


def brand_number() -> Column:
    return F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int")


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines with store (region), item (brand within its department), date and list price."""
    n = brand_number()
    category = F.get(F.array(*[F.lit(c) for c in CATEGORIES]), n % 3)
    dept = F.concat(category, F.lit("_"), (1 + n % 2).cast("string"))
    brands = table(spark, folder, "part").select(
        F.col("p_partkey").alias("l_partkey"),
        F.concat(dept, F.lit("_"), F.lpad(n.cast("string"), 3, "0")).alias("item_id"),
        dept.alias("dept_id"),
        category.alias("cat_id"),
        F.col("p_retailprice").alias("list_price"),
    )
    facts = table(spark, folder, "lineitem").select(
        "l_partkey", "l_suppkey", F.to_date("l_shipdate").alias("date"), F.col("l_quantity").alias("sale")
    )
    supplier = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    nation = table(spark, folder, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
    region = table(spark, folder, "region").select(
        F.col("r_regionkey").alias("n_regionkey"),
        F.col("r_name").alias("store_id"),
        F.substring("r_name", 1, 2).alias("state_id"),
    )
    # Facts first, then one small table after the other: each side's size is known from its own files, so
    # each can be broadcast.  Joined among themselves first, their estimated size would be the product.
    joined = facts.join(brands, "l_partkey").join(supplier, "l_suppkey").join(nation, "s_nationkey")
    return joined.join(region, "n_regionkey").select(
        "item_id", "dept_id", "cat_id", "store_id", "state_id", "date", "sale", "list_price"
    )


def day_index(date: Column | str) -> Column:
    return F.date_diff(date, F.lit(FIRST_MONDAY).cast("date"))


def price_period(date: Column | str) -> Column:
    """Prices hold for four weeks."""
    return (11000 + F.floor(day_index(date) / 28)).cast("int").cast("string")


def calendar(spark: SparkSession, folder: str, step: int = 1) -> DataFrame:
    """One row per ``step`` days over the span of the sales, with events and benefit-day flags by number."""
    line = table(spark, folder, "lineitem").select(F.to_date("l_shipdate").alias("date"))
    span = line.agg(
        F.struct(F.floor(F.min(day_index("date")) / step).alias("lo"), F.floor(F.max(day_index("date")) / step).alias("hi")).alias("s")
    ).scalar()
    k = F.col("k")
    date = F.date_add(F.lit(FIRST_MONDAY).cast("date"), (k * step).cast("int"))
    days = spark.range(1).select(F.explode(F.sequence(span["lo"], span["hi"])).alias("k"))
    return days.select(
        F.concat(F.lit("d_"), (k + 1).cast("string")).alias("d"),
        date.alias("date"),
        price_period(date).alias("wm_yr_wk"),
        F.weekday(date).cast("int").alias("wday"),
        F.month(date).alias("month"),
        F.year(date).alias("year"),
        F.when(k % 13 == 0, "Festival").when(k % 17 == 0, "Market").when(k % 29 == 0, "Parade").alias("event_name_1"),
        F.when(k % 13 == 0, "Cultural").when(k % 17 == 0, "Local").when(k % 29 == 0, "Cultural").alias("event_type_1"),
        F.when(k % 221 == 0, "Fair").alias("event_name_2"),
        F.when(k % 221 == 0, "Local").alias("event_type_2"),
        (k % 2).cast("tinyint").alias("snap_ca"),
        F.when(k % 3 == 0, 1).otherwise(0).cast("tinyint").alias("snap_tx"),
        F.when(k % 5 == 0, 1).otherwise(0).cast("tinyint").alias("snap_wi"),
    )


def prices(spark: SparkSession, folder: str) -> DataFrame:
    """Highest list price per store, item and price period."""
    return (
        lines(spark, folder)
        .withColumn("wm_yr_wk", price_period("date"))
        .groupBy("store_id", "item_id", "wm_yr_wk")
        .agg(F.max("list_price").alias("sell_price"))
    )


def wide_sales(spark: SparkSession, folder: str) -> DataFrame:
    """Weekly units per store and item, one ``d_`` column per week of the sales span.

    Every fifth brand comes twice: a stale row (load_no 0, one unit more) and the final one (load_no 1).
    """
    weekly = lines(spark, folder).withColumn("w", F.floor(day_index("date") / 7).cast("int"))
    lo, hi = weekly.agg(F.min("w"), F.max("w")).first()
    ids = ["item_id", "dept_id", "cat_id", "store_id", "state_id"]
    # At most one entry per week: sums first, then one map per store and item.
    sums = weekly.groupBy(*ids, "w").agg(F.sum("sale").cast("long").alias("units"))
    cells = sums.groupBy(*ids).agg(F.map_from_entries(F.collect_list(F.struct("w", "units"))).alias("m"))
    filled = F.transform(
        F.sequence(F.lit(lo), F.lit(hi)), lambda w: F.coalesce(F.try_element_at("m", w), F.lit(0).cast("long"))
    )
    twice = F.col("item_id").rlike("[05]$")
    loads = F.when(twice, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))
    rows = cells.withColumn("cells", filled).withColumn("load_no", F.explode(loads))
    days = [f"cells[{w - lo}] + 1 - load_no AS d_{w + 1}" for w in range(lo, hi + 1)]
    return rows.selectExpr("concat(item_id, '_', store_id) AS id", *ids, *days, "load_no")


def panel(spark: SparkSession, folder: str) -> DataFrame:
    """Daily units per store and item without gaps, with price, events and flags: the model input."""
    keys = ["store_id", "item_id", "dept_id", "cat_id", "state_id"]
    daily = lines(spark, folder).groupBy(*keys, "date").agg(
        F.sum("sale").alias("sales"), F.max("list_price").alias("list_price")
    )
    dense = gap_fill(daily, keys, value="sales", keep=["list_price"])
    # Rows already lie together by series, so the price per period needs no further shuffle.
    period = Window.partitionBy(*keys, price_period("date"))
    priced = dense.withColumn("sell_price", F.max("list_price").over(period)).drop("list_price")
    cal = calendar(spark, folder).drop("d", "wm_yr_wk", "wday", "month", "year")
    return priced.join(cal, "date", "left")


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """Chat log: each conversation turn followed by a question typical of a store chat."""
    asks = [
        "Forecast FOODS_3_090 for the next 14 days and save it",
        "show me the top 10 selling items as a bar chart",
        "What is the reorder point of foods_1_012?",
        "which items need to be ordered",
        "predict vanilla ice cream for 2 weeks",
        "Lookup SKU: AB-12 please",
        "plot the sales trend of milk over 3 months",
        "gap detect shelf_01.jpg",
        "pie chart of inventory by category",
        "orange juice next week",
        "compare the distribution of sales",
        "thanks",
    ]
    phrase = F.get(F.array(*[F.lit(a) for a in asks]), (F.col("conv_id") * 7 + F.col("turn")).cast("int") % len(asks))
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", "role", F.concat("text", F.lit(" "), phrase).alias("content")
    )


def pixels(spark: SparkSession, folder: str) -> DataFrame:
    """Grey pixels: 48 vectors make one 48 x 64 picture; contrast grows from left to right."""
    at = table(spark, folder, "embeddings").select("vec_id", F.posexplode("embedding").alias("x", "v"))
    lum = F.floor(128 + F.col("v").cast("double") * 32 * (1 + F.floor(F.col("x") / 8)))
    return at.select(
        F.floor(F.col("vec_id") / 48).cast("int").alias("image"),
        (F.col("vec_id") % 48).cast("int").alias("y"),
        "x",
        F.least(F.greatest(lum, F.lit(0)), F.lit(255)).cast("int").alias("lum"),
    )


def image_files(spark: SparkSession, folder: str) -> DataFrame:
    """The same pictures as binary PGM files: (path, content)."""
    by_row = F.sort_array(F.collect_list(F.struct("y", "x", "lum")))
    images = pixels(spark, folder).groupBy("image").agg(by_row.alias("p"), (F.max("y") + 1).alias("h"))
    body = F.array_join(F.transform("p", lambda q: F.lpad(F.hex(q["lum"]), 2, "0")), "")
    header = F.concat(F.lit("P5\n64 "), F.col("h").cast("string"), F.lit("\n255\n"))
    return images.select(
        F.concat(F.lit("/shelf/SKU-"), F.col("image").cast("string"), F.lit(" front.pgm")).alias("path"),
        F.unhex(F.concat(F.hex(header), body)).alias("content"),
    )


def raw_export(spark: SparkSession, folder: str) -> DataFrame:
    """A stockroom export from order lines: odd headers, codes, numbers, units and dates as text."""
    line = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
        F.to_date("l_shipdate").alias("day"),
    )
    k = F.col("l_orderkey") + F.col("l_linenumber")
    quantity = F.col("l_quantity").cast("long").cast("string")
    cents = F.format_string("%.2f", F.col("l_extendedprice"))
    return line.select(
        F.when(k % 41 == 0, "").when(k % 43 == 0, None)
        .otherwise(F.concat(F.lit(" sku-"), F.col("l_partkey").cast("string"), F.lit("\t_a "))).alias(" SKU "),
        F.concat(F.lit("wh "), F.col("l_suppkey").cast("string"), F.lit("  x")).alias("Location-ID"),
        F.when(k % 5 == 0, F.concat(F.lit("1,"), F.lpad(quantity, 3, "0")))
        .when(k % 7 == 0, "?").when(k % 11 == 0, F.concat(F.lit("-"), quantity)).when(k % 13 == 0, F.concat(quantity, F.lit(".7")))
        .when(k % 17 == 0, "2000000").otherwise(quantity).alias("Qty On Hand"),
        F.when(k % 6 == 0, "N/A").when(k % 19 == 0, "x12").when(k % 23 == 0, F.concat(F.lit("-"), cents)).otherwise(cents).alias("Unit Cost"),
        F.get(F.array(*[F.lit(u) for u in (" Each", "PCS", "kg", "LBS", "box ", "oz", "g")]), (k % 7).cast("int")).alias("UOM"),
        F.when(k % 4 == 0, F.date_format("day", "M/d/yyyy")).when(k % 4 == 1, F.date_format("day", "yyyy-MM-dd"))
        .when(k % 4 == 2, F.date_format("day", "MMM d, yyyy")).otherwise("soon").alias("Received At"),
        "l_orderkey",
        "l_linenumber",
        "day",
    )
