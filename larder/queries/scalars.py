"""Column expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.functions import boxes, cleaning, messages, paths, stock
from larder.functions.calendar import calendar_parts, date_shift, snap_flags
from larder.operators.encode import category_codes, event_vocabularies, onehot_topk
from larder.queries.aggregates import rounded
from larder.queries.registry import query
from larder.sources import marts

RAW = """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_orderkey + l_linenumber AS k,
           CAST(l_shipdate AS DATE) AS day, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS q,
           format('{:.2f}', l_extendedprice) AS cents FROM lineitem"""

SKU_TEXT = """CASE WHEN k % 41 = 0 THEN '' WHEN k % 43 = 0 THEN NULL ELSE ' sku-' || l_partkey || chr(9) || '_a ' END"""
QTY_TEXT = """CASE WHEN k % 5 = 0 THEN '1,' || lpad(q, 3, '0') WHEN k % 7 = 0 THEN '?' WHEN k % 11 = 0 THEN '-' || q
    WHEN k % 13 = 0 THEN q || '.7' WHEN k % 17 = 0 THEN '2000000' ELSE q END"""
COST_TEXT = """CASE WHEN k % 6 = 0 THEN 'N/A' WHEN k % 19 = 0 THEN 'x12' WHEN k % 23 = 0 THEN '-' || cents ELSE cents END"""
DATE_TEXT = """CASE k % 4 WHEN 0 THEN strftime(day, '%-m/%-d/%Y') WHEN 1 THEN strftime(day, '%Y-%m-%d') WHEN 2 THEN strftime(day, '%b %-d, %Y') ELSE 'soon' END"""
UOM_TEXT = """list_value(' Each', 'PCS', 'kg', 'LBS', 'box ', 'oz', 'g')[1 + CAST(k % 7 AS INTEGER)]"""


def _export(spark, folder, *columns):
    raw = marts.raw_export(spark, folder)
    named = {" SKU ": "sku", "Location-ID": "location", "Qty On Hand": "qty", "Unit Cost": "cost", "UOM": "uom", "Received At": "received"}
    return raw.withColumnsRenamed(named).select("l_orderkey", "l_linenumber", *columns)


@query(
    "clean_text",
    rf"SELECT l_orderkey, l_linenumber, trim(regexp_replace(regexp_replace(t, '[\x00-\x1F\x7F]', '', 'g'), '\s+', ' ', 'g')) AS text FROM (SELECT *, {SKU_TEXT} AS t FROM ({RAW}))",
)
def _(spark, folder):
    return _export(spark, folder, cleaning.clean_text("sku").alias("text"))


@query(
    "clean_text_documents",
    r"SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[\x00-\x1F\x7F]', '', 'g'), '\s+', ' ', 'g')) AS text FROM documents",
)
def _(spark, folder):
    return marts.table(spark, folder, "documents").select("doc_id", cleaning.clean_text("text").alias("text"))


@query(
    "normalize_sku",
    f"SELECT l_orderkey, l_linenumber, regexp_replace(upper(t), '[^A-Za-z0-9]', '', 'g') AS sku FROM (SELECT *, {SKU_TEXT} AS t FROM ({RAW}))",
)
def _(spark, folder):
    return _export(spark, folder, cleaning.normalize_sku("sku").alias("sku"))


@query(
    "normalize_uom",
    f"""
    SELECT l_orderkey, l_linenumber, CASE lower(trim(t)) WHEN 'each' THEN 'EA' WHEN 'pcs' THEN 'EA' WHEN 'kg' THEN 'KG' WHEN 'lbs' THEN 'LB'
           WHEN 'oz' THEN 'OZ' WHEN 'g' THEN 'G' ELSE upper(trim(t)) END AS uom FROM (SELECT *, {UOM_TEXT} AS t FROM ({RAW}))""",
)
def _(spark, folder):
    return _export(spark, folder, cleaning.normalize_uom("uom").alias("uom"))


@query(
    "coerce_int",
    f"""
    SELECT l_orderkey, l_linenumber, CASE WHEN t <> '?' THEN CAST(trunc(CAST(replace(t, ',', '') AS DOUBLE)) AS BIGINT) END AS qty
    FROM (SELECT *, {QTY_TEXT} AS t FROM ({RAW}))""",
)
def _(spark, folder):
    return _export(spark, folder, cleaning.coerce_int("qty").alias("qty"))


@query(
    "coerce_float",
    f"SELECT l_orderkey, l_linenumber, TRY_CAST(t AS DOUBLE) AS cost FROM (SELECT *, {COST_TEXT} AS t FROM ({RAW}))",
)
def _(spark, folder):
    return _export(spark, folder, cleaning.coerce_float("cost").alias("cost"))


@query(
    "coerce_or_zero",
    f"SELECT l_orderkey, l_linenumber, coalesce(TRY_CAST(t AS DOUBLE), 0) AS qty FROM (SELECT *, {QTY_TEXT} AS t FROM ({RAW}))",
)
def _(spark, folder):
    return _export(spark, folder, cleaning.coerce_or_zero("qty").alias("qty"))


@query(
    "parse_date_any",
    f"SELECT l_orderkey, l_linenumber, CASE WHEN k % 4 <> 3 THEN day END AS received FROM ({RAW})",
)
def _(spark, folder):
    return _export(spark, folder, F.to_date(cleaning.parse_date_any("received")).alias("received"))


@query(
    "null_out_of_bounds",
    f"""
    SELECT l_orderkey, l_linenumber, CASE WHEN t BETWEEN 0 AND 1000000 THEN t END AS qty
    FROM (SELECT l_orderkey, l_linenumber, TRY_CAST(replace({QTY_TEXT}, ',', '') AS DOUBLE) AS t FROM ({RAW}))""",
)
def _(spark, folder):
    qty = cleaning.null_out_of_bounds(cleaning.coerce_float("qty"), *cleaning.QUANTITY_RANGE)
    return _export(spark, folder, qty.alias("qty"))


@query("revenue", "SELECT l_orderkey, l_linenumber, round(l_quantity * p_retailprice, 2) AS revenue FROM lineitem LEFT JOIN part ON p_partkey = l_partkey")
def _(spark, folder):
    line, part = marts.table(spark, folder, "lineitem"), marts.table(spark, folder, "part")
    joined = line.join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
    return joined.select("l_orderkey", "l_linenumber", F.round(cleaning.revenue("l_quantity", "p_retailprice"), 2).alias("revenue"))


@query("days_of_cover", "SELECT sku, round(CASE WHEN avg_daily_sales > 0 THEN on_hand / avg_daily_sales ELSE 0 END, 6) AS days_of_cover FROM inventory", "inventory")
def _(spark, folder):
    cover = stock.days_of_cover(F.col("on_hand"), F.col("avg_daily_sales"))
    return marts.inventory(spark, folder).select("sku", F.round(cover, 6).alias("days_of_cover"))


@query("restock_flag", "SELECT sku, shelf_units < 25 AND stockroom_units > 0 AS restock_needed FROM inventory", "inventory")
def _(spark, folder):
    flag = stock.restock_flag(F.col("shelf_units"), F.col("stockroom_units"), 25)
    return marts.inventory(spark, folder).select("sku", flag.alias("restock_needed"))


@query("clip_nonneg", "SELECT c_custkey, greatest(c_acctbal - 3000, 0) AS clipped FROM customer")
def _(spark, folder):
    return marts.table(spark, folder, "customer").select("c_custkey", stock.clip_nonneg(F.col("c_acctbal") - 3000).alias("clipped"))


@query("safety_stock_default", "SELECT sku, CAST(3.5 AS DOUBLE) AS safety_stock FROM inventory", "inventory")
def _(spark, folder):
    from larder.plans.cleaning import clean_inventory

    return clean_inventory(marts.inventory(spark, folder), safety_stock=3.5).select("sku", "safety_stock")


@query(
    "calendar_parts",
    """
    SELECT o_orderkey, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS day_of_week, CAST(month(o_orderdate) AS INTEGER) AS month,
           CAST(quarter(o_orderdate) AS INTEGER) AS quarter, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders""",
)
def _(spark, folder):
    parts = calendar_parts(F.to_date("o_orderdate"))
    return marts.table(spark, folder, "orders").select("o_orderkey", *[c.alias(n) for n, c in parts.items()])


@query("snap_flags", "SELECT date, CAST(CASE WHEN month = 3 THEN 0 ELSE snap_ca END AS INTEGER) AS snap_ca, 0 AS snap_nv FROM calendar", "calendar")
def _(spark, folder):
    calendar = marts.calendar(spark, folder).withColumn("snap_ca", F.when(F.col("month") != 3, F.col("snap_ca")))
    flags = snap_flags(calendar, ["snap_ca", "snap_nv"])
    return calendar.select("date", *[c.alias(n) for n, c in flags.items()])


@query(
    "category_codes",
    """
    , names AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT p_name AS v FROM part WHERE p_name <> 'red widget'))
    SELECT p_partkey, names.v AS p_name, coalesce(code, -1)::BIGINT AS name_code FROM part LEFT JOIN names ON v = p_name""",
    "days",
)
def _(spark, folder):
    named = marts.table(spark, folder, "part").select(
        "p_partkey", F.when(F.col("p_name") != "red widget", F.col("p_name")).alias("p_name")
    )
    return category_codes(named, {"name_code": "p_name"})


@query(
    "onehot_topk",
    """
    , top AS (SELECT event_name_1 AS v FROM calendar WHERE event_name_1 IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 2),
    kept AS (SELECT date, CASE WHEN event_name_1 IN (SELECT v FROM top) THEN event_name_1 ELSE 'OTHER' END AS e FROM calendar)
    SELECT date, CAST(e = 'Market' AS INTEGER) AS event_name_1_Market, CAST(e = 'OTHER' AS INTEGER) AS event_name_1_OTHER FROM kept""",
    "calendar",
)
def _(spark, folder):
    calendar = marts.calendar(spark, folder).select("date", "event_name_1")
    return onehot_topk(calendar, "event_name_1", event_vocabularies(calendar, ["event_name_1"], 2)["event_name_1"]).drop("event_name_1")


@query(
    "date_shift",
    "SELECT item_id, CAST(date + CAST(DATE '2025-06-30' - (SELECT max(date) FROM sales) AS INTEGER) AS DATE) AS date, sale FROM sales",
    "sales",
)
def _(spark, folder):
    return date_shift(marts.sales(spark, folder), "date", "2025-06-30")


@query(
    "sku_from_path",
    r"""
    SELECT p_partkey, regexp_extract(stem, '^([A-Za-z0-9_-]+)', 1) AS sku, regexp_extract(stem, '([0-9]{2})$', 1) AS last_two
    FROM (SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN '(' || p_name ELSE replace(p_name, ' ', '_') || '-' || p_partkey END AS stem FROM part)""",
)
def _(spark, folder):
    key = F.col("p_partkey")
    stem = F.when(key % 9 == 0, F.concat(F.lit("("), "p_name")).otherwise(
        F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("-"), key.cast("string"))
    )
    path = F.concat(F.lit("/shelf/"), "p_brand", F.lit("/"), stem, F.lit(".JPG"))
    return marts.table(spark, folder, "part").select(
        "p_partkey", paths.sku_from_path(path).alias("sku"), paths.sku_from_path(path, r"(\d{2})$").alias("last_two")
    )


@query(
    "sku_from_text",
    r"SELECT conv_id, turn, CASE WHEN content LIKE '%Lookup SKU: AB-12 please' THEN 'AB-12' END AS sku FROM messages",
    "messages",
)
def _(spark, folder):
    return marts.messages(spark, folder).select("conv_id", "turn", paths.sku_from_text("content").alias("sku"))


@query(
    "item_from_text",
    r"""
    SELECT conv_id, turn, CASE
      WHEN regexp_matches(upper(content), 'FOODS_[0-9]+_[0-9]+') THEN regexp_extract(upper(content), '(FOODS_[0-9]+_[0-9]+)', 1)
      WHEN contains(lower(content), 'vanilla ice cream') THEN 'FOODS_3_090' WHEN contains(lower(content), 'chocolate ice cream') THEN 'FOODS_3_282'
      WHEN contains(lower(content), 'strawberry') THEN NULL WHEN contains(lower(content), 'milk') THEN 'FOODS_3_586'
      WHEN contains(lower(content), 'yogurt') THEN 'FOODS_3_555' WHEN contains(lower(content), 'apple') THEN 'FOODS_3_252'
      WHEN contains(lower(content), 'banana') THEN 'FOODS_3_226' WHEN contains(lower(content), 'cheese') THEN 'FOODS_3_714'
      WHEN contains(lower(content), 'orange juice') THEN 'FOODS_3_681' END AS item_id
    FROM messages""",
    "messages",
)
def _(spark, folder):
    return marts.messages(spark, folder).select("conv_id", "turn", messages.item_from_text(F.col("content")).alias("item_id"))


@query(
    "horizon_from_text",
    r"""
    SELECT conv_id, turn, CASE
      WHEN regexp_matches(lower(content), '[0-9]+\s*days?') THEN CAST(regexp_extract(lower(content), '([0-9]+)\s*days?', 1) AS BIGINT)
      WHEN regexp_matches(lower(content), '[0-9]+\s*weeks?') THEN 7 * CAST(regexp_extract(lower(content), '([0-9]+)\s*weeks?', 1) AS BIGINT)
      WHEN regexp_matches(lower(content), '[0-9]+\s*months?') THEN 30 * CAST(regexp_extract(lower(content), '([0-9]+)\s*months?', 1) AS BIGINT)
      WHEN regexp_matches(lower(content), 'next\s+week') THEN 7 WHEN regexp_matches(lower(content), 'next\s+month') THEN 30
      ELSE 30 END AS days
    FROM messages""",
    "messages",
)
def _(spark, folder):
    return marts.messages(spark, folder).select("conv_id", "turn", messages.horizon_from_text(F.col("content")).alias("days"))


def _any(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(content), '{w}')" for w in words) + ")"


# The words are written out here on their own: a wrong list in the code under test must not pass.
@query(
    "intent_flags",
    r"""
    SELECT conv_id, turn,
           regexp_matches(lower(content), 'inventory|stock|stocks|in stock|out of stock|availability|available|quantity|quantities|units|sku|skus|' ||
           'restock|re-stock|backorder|back-ordered|timeline|timelines|schedule|schedules|deadline|deadlines|' ||
           'milestone|milestones|when|date|dates|roadmap|release|ship|shipping|deliver|delivery|forecast|forecasts|' ||
           'predict|prediction|predictions|projection|projections|outlook|trend|trends|demand|supply|price forecast|' ||
           'capacity') AS is_allowed,
           regexp_matches(lower(content), 'summary|overview|snapshot|status') AS wants_summary,
           regexp_matches(lower(content), 'reorder plan|reorder|restock plan|restock') AND NOT regexp_matches(content, '(?i)(?:^|\b)sku\s*[:#]?\s*([\w\-]+)') AS wants_reorder,
           regexp_matches(lower(content), 'forecast|predict|projection|future|predict sales|forecast sales|sales projection|future sales|' ||
           'predict demand|demand forecast|sales forecast|trend forecast|next month|next week|coming days|upcoming|' ||
           'prophet|prediction') AS wants_forecast,
           regexp_matches(lower(content), 'plot|chart|graph|visualize|show|display|draw|trend|over time|historical|sales over|monthly|daily|weekly|' ||
           'yearly|compare|comparison|distribution|pattern|pie|bar|line|scatter|time-series|time series|histogram|' ||
           'box plot|heatmap|correlation|regression|forecast') AS wants_chart,
           regexp_matches(lower(content), 'days of cover|coverage|inventory|stock level|reorder point') AS about_inventory,
           regexp_matches(lower(content), 'which items need to be ordered|reorder priority|order soon|reorder list|who needs ordering') AS multi_item_reorder,
           regexp_matches(lower(content), 'this|that|it|them|those|previous|last|above') AS is_follow_up,
           regexp_matches(lower(content), 'save|export|parquet|file') AS wants_save,
           regexp_matches(lower(content), 'plot|chart|graph|visualize|show') AS wants_plot,
           regexp_matches(content, '(?i)\bgap\s*(?:detect|detection)\s+(.+)$') AS gap_request
    FROM messages""",
    "messages",
)
def _(spark, folder):
    flags = messages.intent_flags(F.col("content"))
    return marts.messages(spark, folder).select("conv_id", "turn", *[c.alias(n) for n, c in flags.items()])


@query(
    "message_intent",
    r"""
    SELECT conv_id, turn,
           CASE WHEN regexp_matches(lower(content), '\b(show trends|over time|change|trend)') THEN 'trend'
                WHEN regexp_matches(lower(content), '\b(compare|vs|versus)') THEN 'comparison'
                WHEN regexp_matches(lower(content), '\b(forecast|predict|future)') THEN 'forecast'
                WHEN regexp_matches(lower(content), '\b(analyze|why|relationship)') THEN 'analysis'
                WHEN regexp_matches(lower(content), '\b(summary|overview|total)') THEN 'summary' ELSE 'other' END AS intent,
           nullif(regexp_replace(regexp_extract(lower(content), '\b(last|next|this)\s+(day|week|month|quarter|year)\b'), '\s+', ' '), '') AS time_frame
    FROM messages""",
    "messages",
)
def _(spark, folder):
    text = F.col("content")
    return marts.messages(spark, folder).select(
        "conv_id", "turn", messages.intent_class(text).alias("intent"), messages.time_frame(text).alias("time_frame")
    )


@query(
    "chart_type",
    f"""
    SELECT conv_id, turn, CASE WHEN {_any(['pie'])} THEN 'Pie Chart' WHEN {_any(['bar', 'column'])} THEN 'Bar Chart'
           WHEN {_any(['line', 'trend', 'time'])} THEN 'Line Chart' WHEN {_any(['scatter', 'correlation'])} THEN 'Scatter Plot'
           WHEN {_any(['histogram', 'distribution'])} THEN 'Histogram' WHEN {_any(['heatmap'])} THEN 'Heatmap' ELSE 'Custom Chart' END AS chart_type
    FROM messages""",
    "messages",
)
def _(spark, folder):
    return marts.messages(spark, folder).select("conv_id", "turn", messages.chart_type(F.col("content")).alias("chart_type"))


@query(
    "bbox_normalize",
    """
    SELECT l_orderkey, l_linenumber, round((x1 / w + x2 / w) / 2, 12) AS x_center, round((y1 / h + y2 / h) / 2, 12) AS y_center,
           round(x2 / w - x1 / w, 12) AS box_width, round(y2 / h - y1 / h, 12) AS box_height
    FROM (SELECT *, CAST(l_linenumber * 37 AS DOUBLE) AS x1, CAST(l_linenumber * 37 + l_quantity AS DOUBLE) AS x2,
                 CAST(l_suppkey % 100 AS DOUBLE) AS y1, CAST(l_suppkey % 100 + 2 * l_quantity AS DOUBLE) AS y2,
                 CAST(1 + l_orderkey % 2 AS DOUBLE) * 640 AS w, CAST(480 AS DOUBLE) AS h FROM lineitem)""",
)
def _(spark, folder):
    line = marts.table(spark, folder, "lineitem").withColumns(
        {
            "x1": (F.col("l_linenumber") * 37).cast("int"), "x2": (F.col("l_linenumber") * 37 + F.col("l_quantity")).cast("int"),
            "y1": (F.col("l_suppkey") % 100).cast("int"), "y2": (F.col("l_suppkey") % 100 + 2 * F.col("l_quantity")).cast("int"),
            "w": ((1 + F.col("l_orderkey") % 2) * 640).cast("int"), "h": F.lit(480),
        }
    )
    box = boxes.bbox_normalize("x1", "y1", "x2", "y2", "w", "h")
    return rounded(line.select("l_orderkey", "l_linenumber", *[c.alias(n) for n, c in box.items()]), 12, *box)
