"""Whole computations."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.plans import cleaning, forecast, insights, mart, reorder, shelf, tidy, turning
from larder.queries.aggregates import rounded
from larder.queries.ctes import forecast_cte
from larder.queries.registry import query
from larder.queries.scalars import COST_TEXT, DATE_TEXT, QTY_TEXT, RAW, SKU_TEXT, UOM_TEXT
from larder.session import scratch_path
from larder.sources import marts


@query(
    "clean_inventory",
    """
    , raw AS (SELECT sku, product_name, CAST(sku AS BIGINT) AS k, on_hand, stockroom_units, shelf_units, lead_time_days, avg_daily_sales, category FROM inventory),
    bad AS (SELECT sku, product_name, category, CASE WHEN k % 11 = 0 THEN 0 ELSE on_hand END AS on_hand,
                   CASE WHEN k % 13 = 0 THEN -5 ELSE stockroom_units END AS stockroom_units, CASE WHEN k % 7 = 0 THEN 1 ELSE shelf_units END AS shelf_units,
                   CASE WHEN k % 19 = 0 THEN 0 ELSE avg_daily_sales END AS avg_daily_sales, CASE WHEN k % 17 = 0 THEN 0 ELSE lead_time_days END AS lead_time_days FROM raw)
    SELECT sku, product_name, on_hand, greatest(stockroom_units, 0) AS stockroom_units, shelf_units, round(avg_daily_sales, 6) AS avg_daily_sales, lead_time_days,
           round(CASE WHEN avg_daily_sales > 0 THEN on_hand / avg_daily_sales ELSE 0 END, 6) AS days_of_cover,
           shelf_units < 3 AND stockroom_units > 0 AS restock_needed, CAST(2.0 AS DOUBLE) AS safety_stock, category
    FROM bad""",
    "inventory",
)
def _(spark, folder):
    cleaned = cleaning.clean_inventory(marts.raw_inventory(spark, folder))
    return rounded(cleaned, 6, "avg_daily_sales", "days_of_cover")


EXPORT = f"""
    typed AS (
      SELECT l_orderkey, l_linenumber, day, regexp_replace(upper({SKU_TEXT}), '[^A-Za-z0-9]', '', 'g') AS sku, 'wh ' || l_suppkey || ' x' AS location_id,
             CASE WHEN {QTY_TEXT} <> '?' THEN CAST(trunc(CAST(replace({QTY_TEXT}, ',', '') AS DOUBLE)) AS BIGINT) END AS qty,
             TRY_CAST({COST_TEXT} AS DOUBLE) AS cost, CASE WHEN k % 4 <> 3 THEN day END AS received_at,
             CASE lower(trim({UOM_TEXT})) WHEN 'each' THEN 'EA' WHEN 'pcs' THEN 'EA' WHEN 'kg' THEN 'KG' WHEN 'lbs' THEN 'LB' ELSE upper(trim({UOM_TEXT})) END AS uom
      FROM ({RAW})),
    kept AS (SELECT *, row_number() OVER (PARTITION BY sku, location_id ORDER BY l_orderkey DESC, l_linenumber DESC, day DESC) AS rn FROM typed WHERE sku IS NOT NULL AND sku <> ''),
    cleaned AS (SELECT sku, location_id, CASE WHEN qty BETWEEN 0 AND 1000000 THEN qty END AS qty_on_hand,
                       CASE WHEN cost BETWEEN 0 AND 1000000 THEN cost END AS unit_cost, uom, received_at, l_orderkey, l_linenumber, day,
                       coalesce(qty NOT BETWEEN 0 AND 1000000, FALSE) AS bad_qty, coalesce(cost NOT BETWEEN 0 AND 1000000, FALSE) AS bad_cost FROM kept WHERE rn = 1)"""


@query(
    "clean_export",
    f", {EXPORT} SELECT sku, location_id, qty_on_hand, unit_cost, uom, received_at, l_orderkey, l_linenumber, day FROM cleaned",
    "days",
)
def _(spark, folder):
    cleaned = cleaning.clean_export(marts.raw_export(spark, folder), ["l_orderkey", "l_linenumber", "day"])
    return cleaned.withColumn("received_at", F.to_date("received_at"))


@query(
    "dq_report",
    f"""
    , {EXPORT}, counts AS (SELECT
      (SELECT count(*) FROM typed) AS initial_rows, (SELECT count(*) FROM typed WHERE sku IS NULL OR sku = '') AS missing_keys,
      (SELECT count(*) FROM kept WHERE rn > 1) AS duplicates_dropped, count(*) AS final_rows, count(*) FILTER (bad_qty) AS out_of_bounds_qty,
      count(*) FILTER (bad_cost) AS out_of_bounds_price, count(*) FILTER (sku IS NULL) AS null_sku, count(*) FILTER (location_id IS NULL) AS null_location_id,
      count(*) FILTER (qty_on_hand IS NULL) AS null_qty_on_hand, count(*) FILTER (unit_cost IS NULL) AS null_unit_cost, count(*) FILTER (uom IS NULL) AS null_uom,
      count(*) FILTER (received_at IS NULL) AS null_received_at, count(*) FILTER (l_orderkey IS NULL) AS null_l_orderkey,
      count(*) FILTER (l_linenumber IS NULL) AS null_l_linenumber, count(*) FILTER (day IS NULL) AS null_day FROM cleaned)
    UNPIVOT counts ON * INTO NAME metric VALUE value""",
    "days",
)
def _(spark, folder):
    return cleaning.export_report(marts.raw_export(spark, folder), ["l_orderkey", "l_linenumber", "day"])


TIDY = """
    tidy AS (
      SELECT c.state_id, c.store_id, c.dept_id, c.cat_id, c.item_id, c.item_id || '_' || c.store_id AS id, c.d, w.date, w.wm_yr_wk, w.month, w.year,
             w.event_name_1, w.event_type_1, w.event_name_2, w.event_type_2, w.snap_ca, w.snap_tx, w.snap_wi,
             c.sold_qty, p.sell_price, c.sold_qty * p.sell_price AS revenue, w.wday
      FROM week_cells c LEFT JOIN week_calendar w ON w.d = c.d
      LEFT JOIN prices p ON p.store_id = c.store_id AND p.item_id = c.item_id AND p.wm_yr_wk = w.wm_yr_wk)"""


TIDY_COLUMNS = (
    "state_id store_id dept_id cat_id item_id id d date wm_yr_wk month year event_name_1 event_type_1 event_name_2 event_type_2"
    " snap_ca snap_tx snap_wi sold_qty sell_price revenue wday"
).split()


@query("m5_tidy", f", {TIDY} SELECT * REPLACE (round(revenue, 2) AS revenue) FROM tidy", "week_cells week_calendar prices")
def _(spark, folder):
    rows = tidy.m5_tidy(
        marts.wide_sales(spark, folder), marts.calendar(spark, folder, 7), marts.prices(spark, folder), [F.col("load_no")]
    )
    return rounded(rows, 2, "revenue")


@query(
    "m5_report",
    f"""
    , {TIDY}, counts AS (SELECT count(*) AS final_rows_long,
      CAST((SELECT count(DISTINCT item_id || store_id) + count(DISTINCT CASE WHEN item_id LIKE '%0' OR item_id LIKE '%5' THEN item_id || store_id END) FROM tidy) AS BIGINT) AS initial_rows_wide,
      CAST((SELECT count(*) FROM tidy WHERE item_id LIKE '%0' OR item_id LIKE '%5') AS BIGINT) AS duplicates_removed,
      count(*) FILTER (sold_qty < 0) AS out_of_bounds_qty, count(*) FILTER (sell_price < 0) AS out_of_bounds_price,
      {", ".join(f"count(*) FILTER ({c} IS NULL) AS null_{c}" for c in TIDY_COLUMNS)} FROM tidy)
    UNPIVOT counts ON * INTO NAME metric VALUE value""",
    "week_cells week_calendar prices",
)
def _(spark, folder):
    return tidy.m5_report(
        marts.wide_sales(spark, folder), marts.calendar(spark, folder, 7), marts.prices(spark, folder), [F.col("load_no")]
    )


PLAN = """SELECT sku, product_name, on_hand, stockroom_units, shelf_units, round(avg_daily_sales, 6) AS avg_daily_sales, lead_time_days,
    safety_stock, round(days_of_cover, 6) AS days_of_cover, reorder_qty, reorder_flag FROM plan"""


def reorder_query(spark, folder):
    plan = reorder.reorder_plan(cleaning.clean_inventory(marts.inventory(spark, folder)))
    return rounded(plan, 6, "avg_daily_sales", "days_of_cover")


query("reorder_plan", PLAN, "plan")(reorder_query)

BANDS = ["yhat", "yhat_lower", "yhat_upper", "trend"]


@query(
    "forecast_items",
    "SELECT item_id, ds, round(yhat, 4) AS yhat, round(yhat_lower, 4) AS yhat_lower, round(yhat_upper, 4) AS yhat_upper, round(trend, 4) AS trend FROM forecast",
    "forecast",
)
def _(spark, folder):
    return rounded(forecast.forecast_items(marts.sales(spark, folder)), 4, *BANDS)


@query(
    "forecast_from_state",
    "SELECT item_id, ds, round(yhat, 4) AS yhat, round(yhat_lower, 4) AS yhat_lower, round(yhat_upper, 4) AS yhat_upper, round(trend, 4) AS trend FROM forecast",
    "forecast",
)
def _(spark, folder):
    """The item forecast from sums of an earlier load, to which later and late sales are added."""
    sales = marts.sales(spark, folder)
    # A seventh of all sales comes late, and so do all from 1997 on.
    later = (F.pmod(F.xxhash64("item_id", "date", "sale"), F.lit(7)) == 0) | (F.col("date") >= "1997-01-01")
    keys = ["item_id"]
    stored = {}
    days = sales.where(~later).groupBy(*keys, "date").agg(F.sum("sale").alias("sale"))
    for name, df in (("days", days), ("sums", forecast.fit_sums(days, keys, "date", "sale"))):
        path = scratch_path(spark, name)
        df.write.parquet(path)
        stored[name] = spark.read.parquet(path)
    changes = forecast.changed_days(stored["days"], sales.where(later), keys)
    fits = forecast.fits_of(forecast.merged_sums(stored["sums"], changes, keys), keys)
    return rounded(forecast.forecast_of(fits, keys), 4, *BANDS)


def _brand_forecast_sql() -> str:
    """The long-way forecast over brands, with fitted history."""
    from larder.queries import ctes

    own = forecast_cte("brand_sales", "item_id", "date", "sale")
    saved = {k: ctes.CTES[k] for k in own}
    ctes.CTES.update(own)
    try:
        head = ctes.resolve(["f_rows"])
    finally:
        ctes.CTES.update(saved)
    shown = ", ".join(f"round({c}, 4) AS {c}" for c in BANDS)
    return head + f"SELECT item_id, ds, {shown} FROM f_rows"


@query("forecast_with_history", _brand_forecast_sql())
def _(spark, folder):
    sales = marts.lines(spark, folder).select("item_id", "date", "sale")
    return rounded(forecast.forecast_items(sales, include_history=True), 4, *BANDS)


def _turning_sql(source: str, history: bool) -> str:
    """The turning forecast over the gap-filled series: normal equations per item, solved by elimination.

    Twelve knots; columns of the design are the constant, the day, six waves of the week and the days since each knot.
    """
    size = 2 + 6 + 12
    waves = [f"{f}(2 * pi() * d * {j} / 7)" for f in ("cos", "sin") for j in (1, 2, 3)]
    knot = [f"(g.first + floor(width * (0.8 * {k} / 12)))" for k in range(1, 13)]
    hinges = [f"greatest(d - {k}, 0) / width" for k in knot]
    design = ", ".join(["1.0", "(d - g.first) / width", *waves, *hinges])
    penalty = "[" + ", ".join(["0.0", *["0.001"] * 7, *["0.1"] * 12]) + "]"
    products = ", ".join(
        "[" + ", ".join(f"sum(x[{min(i, j)}] * x[{max(i, j)}])" for j in range(1, size + 1)) + f", sum(x[{i}] * y)]" for i in range(1, size + 1)
    )
    ridge = f"[[m[i][j] + CASE WHEN i = j THEN {penalty}[i] ELSE 0 END FOR j IN range(1, {size + 2})] FOR i IN range(1, {size + 1})]"
    day = "CAST(({}) - DATE '2000-01-03' AS INTEGER)"
    shown = ", ".join(f"round({c}, 4) AS {c}" for c in BANDS)
    return f"""
    daily AS (SELECT item_id, date, sum(sale) AS y FROM {source} GROUP BY 1, 2),
    g AS (SELECT {day.format("min(date)")} AS first, greatest({day.format("max(date)")} - {day.format("min(date)")}, 1) AS width FROM daily),
    span AS (SELECT item_id, {day.format("min(date)")} AS lo, {day.format("max(date)")} AS hi FROM daily GROUP BY item_id),
    dense AS (
        SELECT s.item_id, lo, hi, s.d, coalesce(y, 0) AS y
        FROM (SELECT *, unnest(range(lo, hi + 1)) AS d FROM span) s
        LEFT JOIN daily ON daily.item_id = s.item_id AND {day.format("daily.date")} = s.d
    ), designed AS (SELECT item_id, lo, hi, d, y, [{design}] AS x FROM dense, g),
    normal AS (SELECT item_id, any_value(lo) AS lo, any_value(hi) AS hi, [{products}] AS m FROM designed GROUP BY item_id),
    eliminated AS (
        SELECT item_id, lo, hi, 0 AS k, {ridge} AS m FROM normal
        UNION ALL
        SELECT item_id, lo, hi, k + 1,
               [CASE WHEN i = k + 1 THEN [v / m[k + 1][k + 1] FOR v IN m[i]]
                     ELSE [m[i][j] - m[i][k + 1] / m[k + 1][k + 1] * m[k + 1][j] FOR j IN range(1, {size + 2})] END
                FOR i IN range(1, {size + 1})]
        FROM eliminated WHERE k < {size}
    ), fits AS (SELECT item_id, lo, hi, [row[{size + 1}] FOR row IN m] AS b FROM eliminated WHERE k = {size}),
    spread AS (
        SELECT f.item_id, sqrt(avg(power(y - list_inner_product(b, x), 2))) AS sigma
        FROM designed JOIN fits f ON f.item_id = designed.item_id GROUP BY f.item_id
    ), ahead AS (
        SELECT item_id, hi, b, d, [{design}] AS x FROM (SELECT *, unnest(range({"lo" if history else "hi + 1"}, hi + 31)) AS d FROM fits), g
    ), f_turning AS (
        SELECT a.item_id, CAST(DATE '2000-01-03' + CAST(d AS INTEGER) AS DATE) AS ds, sigma,
               list_inner_product(b, x) AS mean, list_inner_product(b[1:2], x[1:2]) + list_inner_product(b[9:], x[9:]) AS trend
        FROM ahead a JOIN spread s ON s.item_id = a.item_id
    ), f_bands AS (
        SELECT item_id, ds, trend, greatest(mean, 0) AS yhat, greatest(mean - {forecast.BAND_Z} * sigma, 0) AS yhat_lower,
               greatest(mean + {forecast.BAND_Z} * sigma, 0) AS yhat_upper FROM f_turning
    )
    SELECT item_id, ds, {shown} FROM f_bands"""


@query("forecast_turning", "," + _turning_sql("sales", False), "sales")
def _(spark, folder):
    return rounded(turning.forecast_turning(marts.sales(spark, folder)), 4, *BANDS)


@query("forecast_turning_history", "," + _turning_sql("brand_sales", True), "brand_sales")
def _(spark, folder):
    sales = marts.lines(spark, folder).select("item_id", "date", "sale")
    return rounded(turning.forecast_turning(sales, include_history=True), 4, *BANDS)


def _forecast(spark, folder):
    return forecast.forecast_fits(marts.sales(spark, folder))


def _inputs(spark, folder):
    return _forecast(spark, folder), marts.stock(spark, folder), marts.item_dim(spark, folder)


@query(
    "coverage",
    "SELECT item_id, cover_until, coverage_days, coverage_status, round(remaining_inventory, 4) AS remaining_inventory FROM insights",
    "insights",
)
def _(spark, folder):
    return rounded(insights.coverage(*_inputs(spark, folder)), 4, "remaining_inventory")


@query("reorder_point", "SELECT item_id, lead_time_demand, reorder_point, reorder_safety_stock FROM insights", "insights")
def _(spark, folder):
    return insights.reorder_point(*_inputs(spark, folder))


MONEY = "expected_revenue, expected_sales, total_demand, avg_inventory, holding_cost_total, gross_profit, profit_margin"


@query("financials", f"SELECT item_id, {MONEY} FROM insights", "insights")
def _(spark, folder):
    return insights.financials(*_inputs(spark, folder))


@query(
    "inventory_insights",
    f"""
    SELECT item_id, description, price, lead_time, holding_cost, current_inventory, forecast_days, cover_until, coverage_days, coverage_status,
           round(remaining_inventory, 4) AS remaining_inventory, lead_time_demand, reorder_point, reorder_safety_stock, {MONEY}, below_reorder_point,
           array_to_string(recommendations, '; ') AS recommendations FROM advised""",
    "advised",
)
def _(spark, folder):
    found = insights.inventory_insights(*_inputs(spark, folder)).drop("coverage_days_number", "avg_daily_demand")
    return rounded(found, 4, "remaining_inventory").withColumn("recommendations", F.array_join("recommendations", "; "))


@query(
    "reorder_priority",
    """
    SELECT item_id, description, current_inventory, coverage_days, coverage_status, reorder_point, below_reorder_point, expected_revenue, profit_margin,
           urgency_score, priority, array_to_string(urgency_reasons, '; ') AS urgency_reasons, array_to_string(recommendations, '; ') AS recommendations
    FROM priority""",
    "priority",
)
def _(spark, folder):
    ranked = insights.reorder_priority(insights.inventory_insights(*_inputs(spark, folder)))
    return ranked.withColumns({c: F.array_join(c, "; ") for c in ("urgency_reasons", "recommendations")})


@query(
    "risk_grades",
    """
    , graded AS (
      SELECT a.*, s.mean, CASE WHEN days_number <= 3 THEN 'Critical' WHEN days_number <= 7 THEN 'High' WHEN days_number <= 14 THEN 'Medium' ELSE 'Low' END AS stockout,
             CASE WHEN profit_margin < 10 THEN 'High' WHEN profit_margin < 20 THEN 'Medium' ELSE 'Low' END AS finance
      FROM advised a JOIN (SELECT item_id, avg(yhat) AS mean FROM forecast GROUP BY 1) s ON s.item_id = a.item_id)
    SELECT item_id, upper(coverage_status) AS status,
           CASE WHEN coverage_status = 'critical' OR below_reorder_point THEN 'HIGH' WHEN coverage_status = 'low' THEN 'MEDIUM' ELSE 'LOW' END AS priority_level,
           CASE WHEN mean > 500 THEN 'High demand item' WHEN mean > 200 THEN 'Moderate demand item' ELSE 'Low demand item' END AS demand_level,
           CASE WHEN profit_margin >= 30 THEN 'Excellent' WHEN profit_margin >= 20 THEN 'Good' WHEN profit_margin >= 10 THEN 'Acceptable' ELSE 'Poor' END AS roi_status,
           stockout AS stockout_risk, finance AS financial_risk,
           CASE WHEN stockout = 'Critical' OR finance = 'High' THEN 'HIGH' WHEN stockout IN ('High', 'Medium') OR finance = 'Medium' THEN 'MEDIUM' ELSE 'LOW' END AS overall_risk,
           forecast_days AS forecast_period_days
    FROM graded""",
    "advised forecast",
)
def _(spark, folder):
    return insights.risk_grades(insights.inventory_insights(*_inputs(spark, folder)))


@query(
    "build_retail_mart",
    """
    , daily AS (SELECT c.item_id, w.date, sum(CASE WHEN c.item_id LIKE '%0' OR c.item_id LIKE '%5' THEN 2 * c.sold_qty + 1 ELSE c.sold_qty END) AS sale
                FROM week_cells c JOIN week_calendar w ON w.d = c.d GROUP BY 1, 2),
    recent AS (SELECT * FROM daily WHERE date >= (SELECT max(date) - 90 FROM daily)),
    top AS (SELECT item_id FROM (SELECT item_id, sum(sale) AS s FROM recent GROUP BY 1 ORDER BY s DESC, item_id LIMIT 12) WHERE item_id <> 'FOODS_2_015')
    SELECT r.item_id, CAST(r.date + CAST(DATE '2025-01-31' - (SELECT max(date) FROM recent) AS INTEGER) AS DATE) AS date, r.sale::BIGINT AS sale,
           (2 * max(r.sale) OVER (PARTITION BY r.item_id))::BIGINT AS unit, i.description, round(p.price, 10) AS price, 3 AS lead_time, CAST(0.5 AS DOUBLE) AS holding_cost
    FROM recent r JOIN top t ON t.item_id = r.item_id
    JOIN (SELECT DISTINCT item_id, dept_id AS description FROM lines) i ON i.item_id = r.item_id
    LEFT JOIN (SELECT item_id, avg(sell_price) AS price FROM prices GROUP BY 1) p ON p.item_id = r.item_id""",
    "week_cells week_calendar prices lines",
)
def _(spark, folder):
    names = marts.lines(spark, folder).select("item_id", F.col("dept_id").alias("description")).distinct()
    tables = mart.build_retail_mart(
        marts.wide_sales(spark, folder), marts.calendar(spark, folder, 7), marts.prices(spark, folder), names,
        exclude=["FOODS_2_015"], last_day="2025-01-31",
    )
    joined = tables["sales"].join(tables["inv"], "item_id").join(tables["item_dim"], "item_id")
    return rounded(joined, 10, "price").select(
        "item_id", "date", "sale", "unit", "description", "price", "lead_time", "holding_cost"
    )


@query(
    "shelf_gap_global",
    """
    SELECT image, round_even(1 - least(1, greatest(0, var_pop(lum) / 5000)), 3) AS gap_score, 'global' AS mode,
           format('global var={:.1f} (ref=5000)', var_pop(lum)) AS notes FROM pixels GROUP BY image""",
    "pixels",
)
def _(spark, folder):
    return shelf.shelf_gap_global(marts.pixels(spark, folder))


LOCAL = """
    , tiles AS (SELECT image, y // 16 AS ty, x // 16 AS tx, count(*) AS n, var_pop(lum) AS v FROM pixels GROUP BY ALL),
    scores AS (SELECT image, count(*) FILTER (n = 256) AS whole, count(*) FILTER (n = 256 AND v < 800) AS flat FROM tiles GROUP BY 1),
    fallback AS (SELECT image, var_pop(lum) AS v FROM pixels GROUP BY 1),
    local AS (SELECT s.image, CASE WHEN whole > 0 THEN round_even(CAST(flat AS DOUBLE) / whole, 3) ELSE round_even(1 - least(1, v / 5000), 3) END AS gap_score,
           CASE WHEN whole > 0 THEN 'local' ELSE 'global' END AS mode,
           CASE WHEN whole > 0 THEN format('local tiles={}, uniform={} ({:.2f}%), thresh=800', whole, flat, CAST(flat AS DOUBLE) / whole * 100)
                ELSE format('fallback-global (image too small), var={:.1f}', v) END AS notes
    FROM scores s JOIN fallback f ON f.image = s.image)"""


@query("shelf_gap_local", LOCAL + " SELECT * FROM local", "pixels")
def _(spark, folder):
    return shelf.shelf_gap_local(marts.pixels(spark, folder), tile=16)


@query(
    "gap_batch",
    LOCAL + " SELECT 'SKU-' || image AS sku, gap_score, mode, notes, '/shelf/SKU-' || image || ' front.pgm' AS image_path FROM local",
    "pixels",
)
def _(spark, folder):
    return shelf.gap_batch(marts.image_files(spark, folder), tile=16)
