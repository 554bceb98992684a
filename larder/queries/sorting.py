"""Heads of sorted tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.operators import aggregates, ranking
from larder.plans import insights
from larder.plans.cleaning import clean_inventory
from larder.plans.forecast import forecast_fits
from larder.plans.reorder import reorder_plan
from larder.queries.registry import query
from larder.sources import marts

PRIORITY = """item_id, description, current_inventory, coverage_days, coverage_status, reorder_point, below_reorder_point,
    expected_revenue, profit_margin, urgency_score, priority"""


def ranked_items(spark, folder):
    forecast = forecast_fits(marts.sales(spark, folder))
    found = insights.inventory_insights(forecast, marts.stock(spark, folder), marts.item_dim(spark, folder))
    return insights.reorder_priority(found)


@query(
    "reorder_top_n",
    "SELECT sku, product_name, reorder_qty, reorder_flag FROM plan ORDER BY reorder_qty DESC, sku LIMIT 20",
    "plan",
)
def _(spark, folder):
    plan = reorder_plan(clean_inventory(marts.inventory(spark, folder)))
    return ranking.reorder_top_n(plan).select("sku", "product_name", "reorder_qty", "reorder_flag")


@query("top_sellers", "SELECT item_id, sum(sale) AS sales FROM sales GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12", "sales")
def _(spark, folder):
    return ranking.top_sellers(marts.sales(spark, folder))


@query("chart_top10", "SELECT item_id, sum(sale) AS sales FROM sales GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", "sales")
def _(spark, folder):
    return ranking.chart_top10(aggregates.total_sales_by_item(marts.sales(spark, folder)), "item_id", "sales")


@query("urgency_sort", f"SELECT {PRIORITY} FROM priority ORDER BY urgency_score DESC, item_id", "priority")
def _(spark, folder):
    return ranking.urgency_sort(ranked_items(spark, folder)).drop("urgency_reasons", "recommendations")


@query(
    "medium_top3",
    """
    SELECT item_id, urgency_score, greatest((SELECT count(*) FROM priority WHERE priority = 'MEDIUM') - 3, 0) AS more_items
    FROM priority WHERE priority = 'MEDIUM' ORDER BY urgency_score DESC, item_id LIMIT 3""",
    "priority",
)
def _(spark, folder):
    return ranking.medium_top3(ranked_items(spark, folder)).select("item_id", "urgency_score", "more_items")


@query(
    "preview",
    "SELECT sku, product_name, on_hand, restock_needed FROM clean_inv ORDER BY sku LIMIT 100",
    "clean_inv",
)
def _(spark, folder):
    cleaned = clean_inventory(marts.inventory(spark, folder))
    return ranking.preview(cleaned, ["sku"]).select("sku", "product_name", "on_hand", "restock_needed")


@query("priority_counts", """
    SELECT priority, count(*) AS items, round(sum(CASE WHEN priority = 'HIGH' THEN expected_revenue ELSE 0 END), 2) AS revenue_at_risk
    FROM priority GROUP BY 1""", "priority")
def _(spark, folder):
    counts = aggregates.priority_counts(ranked_items(spark, folder))
    return counts.withColumn("revenue_at_risk", F.round("revenue_at_risk", 2))


@query("filter_priority", f"SELECT {PRIORITY} FROM priority WHERE priority = 'HIGH'", "priority")
def _(spark, folder):
    from larder.operators.filters import filter_priority

    return filter_priority(ranked_items(spark, folder), "high").drop("urgency_reasons", "recommendations")


@query(
    "plan_panel_kpis",
    """
    SELECT count(*) FILTER (current_inventory <= reorder_point) AS needing_reorder, count(*) FILTER (priority = 'HIGH') AS high_priority,
           CAST(sum(greatest(reorder_point - current_inventory, 0)) AS BIGINT) AS total_suggested FROM priority""",
    "priority",
)
def _(spark, folder):
    suggested = F.greatest(F.col("reorder_point") - F.col("current_inventory"), F.lit(0))
    return aggregates.plan_panel_kpis(ranked_items(spark, folder).withColumn("suggested_units", suggested))
