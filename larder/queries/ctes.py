"""SQL text of the logical tables, written apart from the Spark code so that results can be compared."""

from __future__ import annotations

Z80 = "1.2815515655446004"

# name -> (names it builds on, body)
CTES: dict[str, tuple[str, str]] = {
    "sales": (
        "",
        "SELECT CAST(l_partkey AS VARCHAR) AS item_id, CAST(l_shipdate AS DATE) AS date, l_quantity AS sale FROM lineitem",
    ),
    "item_dim": (
        "",
        "SELECT CAST(p_partkey AS VARCHAR) AS item_id, p_name AS description, p_retailprice AS price, "
        "1 + p_size % 14 AS lead_time, CAST(0.5 AS DOUBLE) AS holding_cost FROM part",
    ),
    "inv": ("sales", "SELECT item_id, 2 * max(sale) AS unit FROM sales GROUP BY item_id"),
    "stock": (
        "inv",
        "SELECT item_id, floor(unit * ((1 + CAST(item_id AS BIGINT) % 7) / CAST(20.0 AS DOUBLE))) AS unit FROM inv",
    ),
    "item_daily": ("sales", "SELECT item_id, date, sum(sale) AS sale FROM sales GROUP BY item_id, date"),
    "item_stats": ("item_daily", "SELECT item_id, 2 * max(sale) AS unit, avg(sale) AS ads FROM item_daily GROUP BY item_id"),
    "inventory": (
        "item_stats",
        """
        SELECT CAST(p_partkey AS VARCHAR) AS sku, p_name AS product_name, coalesce(unit, 0) AS on_hand,
               coalesce(unit, 0) - floor(coalesce(unit, 0) * CAST(0.3 AS DOUBLE)) AS stockroom_units,
               floor(coalesce(unit, 0) * CAST(0.3 AS DOUBLE)) AS shelf_units,
               coalesce(ads, 0) AS avg_daily_sales, CAST(1 + p_size % 14 AS DOUBLE) AS lead_time_days,
               p_type AS category, p_retailprice AS selling_price
        FROM part LEFT JOIN item_stats ON item_id = CAST(p_partkey AS VARCHAR)""",
    ),
    "clean_inv": (
        "inventory",
        """
        SELECT sku, product_name, on_hand, stockroom_units, shelf_units, avg_daily_sales, lead_time_days,
               CASE WHEN avg_daily_sales > 0 THEN on_hand / avg_daily_sales ELSE 0 END AS days_of_cover,
               shelf_units < 3 AND stockroom_units > 0 AS restock_needed,
               CAST(2.0 AS DOUBLE) AS safety_stock, category, selling_price
        FROM inventory""",
    ),
    "lines": (
        "",
        """
        SELECT list_value('FOODS', 'HOBBIES', 'HOUSEHOLD')[1 + n % 3] || '_' || (1 + n % 2) || '_' || lpad(CAST(n AS VARCHAR), 3, '0') AS item_id,
               list_value('FOODS', 'HOBBIES', 'HOUSEHOLD')[1 + n % 3] || '_' || (1 + n % 2) AS dept_id,
               list_value('FOODS', 'HOBBIES', 'HOUSEHOLD')[1 + n % 3] AS cat_id,
               r_name AS store_id, substring(r_name, 1, 2) AS state_id,
               CAST(l_shipdate AS DATE) AS date, l_quantity AS sale, list_price
        FROM lineitem
        JOIN (SELECT p_partkey, p_retailprice AS list_price, CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INTEGER) AS n FROM part) p
          ON l_partkey = p_partkey
        JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey""",
    ),
    "prices": (
        "lines",
        """
        SELECT store_id, item_id, CAST(11000 + (date - DATE '1995-01-02') // 28 AS VARCHAR) AS wm_yr_wk, max(list_price) AS sell_price
        FROM lines GROUP BY ALL""",
    ),
    "days": (
        "",
        """
        SELECT unnest(range(min(CAST(l_shipdate AS DATE) - DATE '1995-01-02'), max(CAST(l_shipdate AS DATE) - DATE '1995-01-02') + 1)) AS k
        FROM lineitem""",
    ),
    "weeks": (
        "",
        """
        SELECT unnest(range(min(CAST(l_shipdate AS DATE) - DATE '1995-01-02') // 7, max(CAST(l_shipdate AS DATE) - DATE '1995-01-02') // 7 + 1)) AS k
        FROM lineitem""",
    ),
    "calendar": ("days", "{CAL1}"),
    "week_calendar": ("weeks", "{CAL7}"),
    "week_cells": (
        "lines weeks",
        """
        SELECT item_id, dept_id, cat_id, store_id, state_id, 'd_' || (k + 1) AS d, k,
               CAST(coalesce(sum(sale), 0) AS BIGINT) AS sold_qty
        FROM (SELECT DISTINCT item_id, dept_id, cat_id, store_id, state_id FROM lines) s
        CROSS JOIN weeks
        LEFT JOIN (SELECT item_id, store_id, (date - DATE '1995-01-02') // 7 AS k, sale FROM lines) l USING (item_id, store_id, k)
        GROUP BY ALL""",
    ),
    "panel": (
        "lines prices calendar",
        """
        SELECT s.store_id, s.item_id, s.dept_id, s.cat_id, s.state_id, CAST(s.date AS DATE) AS date,
               coalesce(q.sales, 0) AS sales, p.sell_price,
               c.event_name_1, c.event_type_1, c.event_name_2, c.event_type_2, c.snap_ca, c.snap_tx, c.snap_wi
        FROM (SELECT store_id, item_id, dept_id, cat_id, state_id,
                     CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date
              FROM lines GROUP BY 1, 2, 3, 4, 5) s
        LEFT JOIN (SELECT store_id, item_id, date, sum(sale) AS sales FROM lines GROUP BY 1, 2, 3) q
          ON q.store_id = s.store_id AND q.item_id = s.item_id AND q.date = s.date
        LEFT JOIN prices p ON p.store_id = s.store_id AND p.item_id = s.item_id
          AND p.wm_yr_wk = CAST(11000 + (s.date - DATE '1995-01-02') // 28 AS VARCHAR)
        LEFT JOIN calendar c ON c.date = s.date""",
    ),
    "thinned": (
        "panel",
        "SELECT store_id, item_id, date, CASE WHEN day(date) <> 1 THEN sell_price END AS p FROM panel",
    ),
    "brand_sales": (
        "lines",
        "SELECT item_id, date, sum(sale) AS sale FROM lines GROUP BY item_id, date",
    ),
    "messages": (
        "",
        """
        SELECT conv_id, turn, role, text || ' ' || list_value(
          'Forecast FOODS_3_090 for the next 14 days and save it', 'show me the top 10 selling items as a bar chart',
          'What is the reorder point of foods_1_012?', 'which items need to be ordered',
          'predict vanilla ice cream for 2 weeks', 'Lookup SKU: AB-12 please',
          'plot the sales trend of milk over 3 months', 'gap detect shelf_01.jpg',
          'pie chart of inventory by category', 'orange juice next week',
          'compare the distribution of sales', 'thanks')[1 + CAST((conv_id * 7 + turn) % 12 AS INTEGER)] AS content
        FROM conversations""",
    ),
    "pixels": (
        "",
        """
        SELECT CAST(vec_id // 48 AS INTEGER) AS image, CAST(vec_id % 48 AS INTEGER) AS y, CAST(x AS INTEGER) AS x,
               CAST(least(greatest(floor(128 + CAST(v AS DOUBLE) * 32 * (1 + x // 8)), 0), 255) AS INTEGER) AS lum
        FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS x FROM embeddings)""",
    ),
}


def _calendar(source: str, step: int) -> str:
    return f"""
        SELECT 'd_' || (k + 1) AS d, CAST(DATE '1995-01-02' + CAST(k * {step} AS INTEGER) AS DATE) AS date,
               CAST(11000 + (k * {step}) // 28 AS VARCHAR) AS wm_yr_wk,
               CAST(isodow(DATE '1995-01-02' + CAST(k * {step} AS INTEGER)) - 1 AS INTEGER) AS wday,
               CAST(month(DATE '1995-01-02' + CAST(k * {step} AS INTEGER)) AS INTEGER) AS month,
               CAST(year(DATE '1995-01-02' + CAST(k * {step} AS INTEGER)) AS INTEGER) AS year,
               CASE WHEN k % 13 = 0 THEN 'Festival' WHEN k % 17 = 0 THEN 'Market' WHEN k % 29 = 0 THEN 'Parade' END AS event_name_1,
               CASE WHEN k % 13 = 0 THEN 'Cultural' WHEN k % 17 = 0 THEN 'Local' WHEN k % 29 = 0 THEN 'Cultural' END AS event_type_1,
               CASE WHEN k % 221 = 0 THEN 'Fair' END AS event_name_2, CASE WHEN k % 221 = 0 THEN 'Local' END AS event_type_2,
               CAST(k % 2 AS TINYINT) AS snap_ca, CAST(CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS TINYINT) AS snap_tx,
               CAST(CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS TINYINT) AS snap_wi
        FROM {source}"""


CTES["calendar"] = ("days", _calendar("days", 1))
CTES["week_calendar"] = ("weeks", _calendar("weeks", 7))

def forecast_cte(source: str, keys: str, date: str, value: str) -> dict[str, tuple[str, str]]:
    """The forecast written out the long way: fill the gaps, regress, average residuals by weekday."""
    return {
        "f_daily": (source, f"SELECT {keys} AS item_id, {date} AS date, sum({value}) AS y FROM {source} GROUP BY 1, 2"),
        "f_span": ("f_daily", "SELECT item_id, min(date) AS lo, max(date) AS hi FROM f_daily GROUP BY item_id"),
        "f_dense": (
            "f_span",
            """
            SELECT g.item_id, g.lo, g.hi, CAST(g.date AS DATE) AS date, CAST(g.date AS DATE) - g.lo AS t, coalesce(d.y, 0) AS y
            FROM (SELECT item_id, lo, hi, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM f_span) g
            LEFT JOIN f_daily d ON d.item_id = g.item_id AND d.date = g.date""",
        ),
        "f_line": (
            "f_dense",
            """
            SELECT item_id, any_value(lo) AS lo, any_value(hi) AS hi, coalesce(regr_slope(y, t), 0) AS b,
                   coalesce(regr_intercept(y, t), avg(y)) AS a
            FROM f_dense GROUP BY item_id""",
        ),
        "f_season": (
            "f_line",
            """
            SELECT d.item_id, d.t % 7 AS k, avg(d.y - l.a - l.b * d.t) AS s
            FROM f_dense d JOIN f_line l ON l.item_id = d.item_id GROUP BY 1, 2""",
        ),
        "f_sigma": (
            "f_season",
            """
            SELECT d.item_id, stddev_pop(d.y - l.a - l.b * d.t - s.s) AS sigma
            FROM f_dense d JOIN f_line l ON l.item_id = d.item_id
            JOIN f_season s ON s.item_id = d.item_id AND s.k = d.t % 7 GROUP BY 1""",
        ),
        "f_rows": (
            "f_sigma",
            f"""
            SELECT r.item_id, CAST(r.lo + CAST(r.t AS INTEGER) AS DATE) AS ds, r.t, r.n,
                   r.a + r.b * r.t AS trend,
                   greatest(r.a + r.b * r.t + coalesce(s.s, 0), 0) AS yhat,
                   greatest(r.a + r.b * r.t + coalesce(s.s, 0) - {Z80} * g.sigma, 0) AS yhat_lower,
                   greatest(r.a + r.b * r.t + coalesce(s.s, 0) + {Z80} * g.sigma, 0) AS yhat_upper
            FROM (SELECT item_id, lo, a, b, hi - lo + 1 AS n, unnest(range(0, hi - lo + 1 + 30)) AS t FROM f_line) r
            LEFT JOIN f_season s ON s.item_id = r.item_id AND s.k = r.t % 7
            JOIN f_sigma g ON g.item_id = r.item_id""",
        ),
        "forecast": ("f_rows", "SELECT item_id, ds, yhat, yhat_lower, yhat_upper, trend FROM f_rows WHERE t >= n"),
    }


CTES |= forecast_cte("sales", "item_id", "date", "sale")

CTES |= {
    "running": (
        "forecast stock item_dim",
        """
        SELECT f.item_id, f.ds, f.yhat, CAST(floor(s.unit) AS BIGINT) AS current_inventory, i.description, i.price, i.lead_time, i.holding_cost,
               sum(f.yhat) OVER w AS cum_demand, row_number() OVER w AS rn, count(*) OVER (PARTITION BY f.item_id) AS n
        FROM forecast f JOIN stock s ON s.item_id = f.item_id JOIN item_dim i ON i.item_id = f.item_id
        WINDOW w AS (PARTITION BY f.item_id ORDER BY f.ds)""",
    ),
    "item_numbers": (
        "running",
        """
        SELECT item_id, any_value(description) AS description, any_value(price) AS price, any_value(lead_time) AS lead_time,
               any_value(holding_cost) AS holding_cost, any_value(current_inventory) AS current_inventory, any_value(n) AS forecast_days,
               min(ds) AS first_ds, min(ds) FILTER (cum_demand >= current_inventory) AS cover_until, sum(yhat) AS total,
               CASE WHEN any_value(n) < any_value(lead_time) THEN avg(yhat) * any_value(lead_time)
                    ELSE coalesce(sum(yhat) FILTER (rn <= lead_time), 0) END AS ltd,
               avg(greatest(current_inventory - cum_demand, 0)) AS avg_inv
        FROM running GROUP BY item_id""",
    ),
    "insights": (
        "item_numbers",
        """
        SELECT *, CASE WHEN cover_until IS NULL THEN '>' || forecast_days ELSE CAST(cover_until - first_ds AS VARCHAR) END AS coverage_days,
               CASE WHEN cover_until IS NULL THEN 'sufficient' WHEN cover_until - first_ds <= 7 THEN 'critical'
                    WHEN cover_until - first_ds <= 14 THEN 'low' ELSE 'adequate' END AS coverage_status,
               cover_until - first_ds AS days_number,
               CASE WHEN cover_until IS NULL THEN current_inventory - total ELSE 0 END AS remaining_inventory,
               CAST(round_even(ltd, 0) AS BIGINT) AS lead_time_demand, CAST(round_even(ltd * 1.25, 0) AS BIGINT) AS reorder_point,
               CAST(round_even(ltd * 0.25, 0) AS BIGINT) AS reorder_safety_stock,
               round_even(least(current_inventory, total) * price, 2) AS expected_revenue,
               CAST(round_even(least(current_inventory, total), 0) AS BIGINT) AS expected_sales,
               CAST(round_even(total, 0) AS BIGINT) AS total_demand, round_even(avg_inv, 1) AS avg_inventory,
               round_even(avg_inv * holding_cost * forecast_days, 2) AS holding_cost_total,
               round_even(least(current_inventory, total) * price - avg_inv * holding_cost * forecast_days, 2) AS gross_profit,
               CASE WHEN least(current_inventory, total) * price > 0
                    THEN round_even((least(current_inventory, total) * price - avg_inv * holding_cost * forecast_days)
                                    / (least(current_inventory, total) * price) * 100, 1) ELSE 0 END AS profit_margin
        FROM item_numbers""",
    ),
    "advised": (
        "insights",
        """
        SELECT *, current_inventory <= reorder_point AS below_reorder_point,
               list_filter(list_value(
                 CASE coverage_status WHEN 'critical' THEN 'reorder immediately' WHEN 'low' THEN 'reorder soon' END,
                 CASE WHEN current_inventory <= reorder_point THEN 'stock at or below reorder point' END,
                 CASE WHEN profit_margin < 10 THEN 'adjust stock to improve margin' END), lambda x: x IS NOT NULL) AS recommendations
        FROM insights""",
    ),
    "scored": (
        "advised",
        """
        SELECT *, CAST(CASE coverage_status WHEN 'critical' THEN 100 WHEN 'low' THEN 50 ELSE 0 END
               + CASE WHEN below_reorder_point THEN 75 ELSE 0 END - CASE WHEN profit_margin < 10 THEN 20 ELSE 0 END AS INTEGER) AS urgency_score
        FROM advised""",
    ),
    "priority": (
        "scored",
        """
        SELECT item_id, description, current_inventory, coverage_days, coverage_status, reorder_point, below_reorder_point,
               expected_revenue, profit_margin, urgency_score,
               CASE WHEN urgency_score >= 75 THEN 'HIGH' WHEN urgency_score >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS priority,
               list_filter(list_value(
                 CASE coverage_status WHEN 'critical' THEN 'CRITICAL: ' || coverage_days || ' days coverage'
                                      WHEN 'low' THEN 'LOW: ' || coverage_days || ' days coverage' END,
                 CASE WHEN below_reorder_point THEN 'Below ROP: ' || current_inventory || ' <= ' || reorder_point END,
                 CASE WHEN profit_margin < 10 THEN 'Low margin: ' || format('{:.1f}', profit_margin) || '%' END), lambda x: x IS NOT NULL) AS urgency_reasons,
               recommendations
        FROM scored""",
    ),
    "plan": (
        "clean_inv",
        """
        SELECT sku, product_name, on_hand, stockroom_units, shelf_units, avg_daily_sales, lead_time_days, safety_stock, days_of_cover,
               CAST(ceil(greatest(lead_time_days + safety_stock - days_of_cover, 0) * avg_daily_sales) AS BIGINT) AS reorder_qty,
               ceil(greatest(lead_time_days + safety_stock - days_of_cover, 0) * avg_daily_sales) > 0 AS reorder_flag
        FROM clean_inv""",
    ),
}


def resolve(names: list[str]) -> str:
    """A WITH clause of the named subqueries and all they build on; "" for none."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered or name not in CTES:
            return
        for parent in CTES[name][0].split():
            visit(parent)
        ordered.append(name)

    for name in names:
        visit(name)
    if not ordered:
        return ""
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in ordered) + "\n"
