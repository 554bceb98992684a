"""Forecast, insights and priorities against plain Python."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.operators.aggregates import forecast_summary, priority_counts
from larder.plans import evaluate, insights
from larder.plans.forecast import BAND_Z, forecast_fits, forecast_items, forecast_series
from larder.queries import QUERIES

START = dt.date(2024, 3, 5)


def series(days: int, seed: int) -> dict[int, float]:
    rng = random.Random(seed)
    sold = {d: float(rng.randrange(1, 40)) for d in range(days) if rng.random() < 0.6}
    return {0: 5.0, **sold, days - 1: 9.0}


def expected(sold: dict[int, float], horizon: int):
    n = max(sold) + 1
    t = np.arange(n)
    y = np.array([sold.get(d, 0.0) for d in t])
    slope, icpt = np.polyfit(t, y, 1) if n > 1 else (0.0, y[0])
    residual = y - icpt - slope * t
    season = np.array([residual[t % 7 == k].mean() if (t % 7 == k).any() else 0.0 for k in range(7)])
    sigma = (residual - season[t % 7]).std()
    ahead = np.arange(n + horizon)
    yhat = icpt + slope * ahead + season[ahead % 7]
    return np.clip(yhat, 0, None), np.clip(yhat - BAND_Z * sigma, 0, None), np.clip(yhat + BAND_Z * sigma, 0, None)


def frame(spark, items: dict[str, dict[int, float]]):
    # Every sale is split over two rows: the forecast has to total them per day.
    rows = [(i, START + dt.timedelta(days=d), v / 2) for i, s in items.items() for d, v in s.items() for _ in range(2)]
    return spark.createDataFrame(rows, "item_id string, date date, sale double")


def test_forecast_matches_the_long_way(spark):
    items = {"long": series(200, 1), "short": series(5, 2), "week": series(7, 3), "one": {0: 4.0}, "two": {0: 3.0, 1: 8.0}}
    got = forecast_items(frame(spark, items), 14, include_history=True).collect()
    for item, sold in items.items():
        want = expected(sold, 14)
        own = sorted((r for r in got if r["item_id"] == item), key=lambda r: r["ds"])
        assert own[0]["ds"] == START and len(own) == max(sold) + 1 + 14
        for column, values in zip(("yhat", "yhat_lower", "yhat_upper"), want):
            np.testing.assert_allclose([r[column] for r in own], values, atol=1e-6)


def test_future_rows_only_by_default(spark):
    sold = series(30, 4)
    got = forecast_items(frame(spark, {"a": sold}), 30)
    assert got.count() == 30 and got.agg(F.min("ds")).first()[0] == START + dt.timedelta(days=30)


def brute(yhat, unit, price, lead, holding):
    cum = np.cumsum(yhat)
    hit = np.nonzero(cum >= unit)[0]
    ltd = np.mean(yhat) * lead if len(yhat) < lead else sum(yhat[:lead])
    sales = min(unit, sum(yhat))
    revenue, hold = sales * price, np.clip(unit - cum, 0, None).mean() * holding * len(yhat)
    profit = revenue - hold
    status = "sufficient" if not len(hit) else "critical" if hit[0] <= 7 else "low" if hit[0] <= 14 else "adequate"
    margin = round(profit / revenue * 100 if revenue > 0 else 0, 1)
    score = {"critical": 100, "low": 50}.get(status, 0) + (75 if unit <= round(ltd * 1.25) else 0) - (20 if margin < 10 else 0)
    return {
        "coverage_days": f">{len(yhat)}" if not len(hit) else str(hit[0]), "coverage_status": status,
        "reorder_point": round(ltd * 1.25), "lead_time_demand": round(ltd), "expected_revenue": round(revenue, 2),
        "holding_cost_total": round(hold, 2), "gross_profit": round(profit, 2), "profit_margin": margin,
        "avg_inventory": round(np.clip(unit - cum, 0, None).mean(), 1), "urgency_score": score,
        "priority": "HIGH" if score >= 75 else "MEDIUM" if score >= 25 else "LOW",
    }


def test_insights_match_plain_python(spark):
    rng = random.Random(9)
    items = {}
    for i in range(40):
        yhat = [rng.uniform(0, 12) for _ in range(rng.choice([5, 20, 30]))]
        items[f"i{i:02d}"] = (yhat, rng.choice([0, 20, 60, 150, 900]), rng.uniform(1, 9), rng.choice([1, 3, 10, 14]), 0.05)
    rows = [(k, START + dt.timedelta(days=d), v) for k, (ys, *_) in items.items() for d, v in enumerate(ys)]
    forecast = spark.createDataFrame(rows, "item_id string, ds date, yhat double")
    inv = spark.createDataFrame([(k, float(v[1])) for k, v in items.items()], "item_id string, unit double")
    dim = spark.createDataFrame(
        [(k, f"item {k}", v[2], v[3], v[4]) for k, v in items.items()],
        "item_id string, description string, price double, lead_time int, holding_cost double",
    )
    found = insights.inventory_insights(forecast, inv, dim)
    ranked = insights.reorder_priority(found)
    merged = {r["item_id"]: r.asDict() for r in found.collect()}
    for r in ranked.collect():
        merged[r["item_id"]] |= r.asDict()
    for key, (yhat, unit, price, lead, holding) in items.items():
        for column, value in brute(yhat, unit, price, lead, holding).items():
            got = merged[key][column]
            assert got == (pytest.approx(value) if isinstance(value, float) else value), (key, column)
    assert sum(r["items"] for r in priority_counts(ranked).collect()) == len(items)
    means = {r["item_id"]: r["avg_daily_demand"] for r in forecast_summary(forecast).collect()}
    assert all(means[k] == pytest.approx(sum(v[0]) / len(v[0])) for k, v in items.items())
    grades = insights.risk_grades(found).collect()
    assert len(grades) == len(items)
    assert all(g["stockout_risk"] == "Low" for g in grades if g["status"] == "SUFFICIENT")


def test_wrmsse_of_two_series(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(6)]
    sales = {"a": [1, 3, 2, 5, 4, 6], "b": [2, 2, 2, 2, 1, 3]}
    rows = [("s", k, d, float(v), 2.0) for k, vs in sales.items() for d, v in zip(days, vs)]
    panel = spark.createDataFrame(rows, "store_id string, item_id string, date date, sales double, sell_price double")
    start = F.lit(days[4])
    predictions = panel.where(F.col("date") >= start).select(
        "store_id", "item_id", "date", F.col("sales").alias("y_true"), (F.col("sales") + 1).alias("y_pred")
    )
    # b never changes before the split, so it has no scale and contributes 0; a's weight is 10 / 14.
    scale = np.sqrt(np.mean(np.diff([1, 3, 2, 5]) ** 2))
    got = evaluate.wrmsse_bottom(predictions, panel, start).first()["wrmsse"]
    assert got == pytest.approx(10 / 14 * 1 / scale)
    weights = evaluate.validation_weights(panel, start)
    assert weights.agg(F.sum("weight")).first()[0] == pytest.approx(1.0)
    free = evaluate.validation_weights(panel.withColumn("sell_price", F.lit(0.0)), start)
    assert {r["weight"] for r in free.collect()} == {0.5}


def stocks(spark, items):
    inv = spark.createDataFrame([(k, 40.0 * (i + 1)) for i, k in enumerate(items)], "item_id string, unit double")
    dim = spark.createDataFrame(
        [(k, f"item {k}", 2.0, 3 + 20 * i, 0.5) for i, k in enumerate(items)],
        "item_id string, description string, price double, lead_time int, holding_cost double",
    )
    return inv, dim


def test_series_give_what_rows_give_and_no_day_is_sorted(spark):
    rng = random.Random(4)
    items = {k: {d: float(rng.randrange(9)) for d in range(25)} for k in ("a", "b", "c")}
    sales, (inv, dim) = frame(spark, items), stocks(spark, items)
    rows, series = forecast_items(sales).select("item_id", "ds", "yhat"), forecast_series(sales)
    spread_out = series.select("item_id", F.inline(F.arrays_zip("ds", "yhat")))
    assert sorted(spread_out.collect()) == sorted(rows.collect())
    own = insights.inventory_insights(series, inv, dim)
    assert sorted(own.collect()) == sorted(insights.inventory_insights(rows, inv, dim).collect())
    plan = own._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan
    running = [insights.cumulative_demand(f).select("item_id", "ds", "yhat", "cum_demand") for f in (series, rows)]
    assert sorted(running[0].collect()) == sorted(running[1].collect())
    assert "Window" not in running[0]._jdf.queryExecution().optimizedPlan().toString()


def test_days_without_a_forecast(spark):
    days = [START + dt.timedelta(days=d) for d in range(4)]
    rows = [("a", days[2], 25.0), ("a", days[0], None), ("a", days[1], 20.0), ("a", days[3], None), ("b", days[0], None)]
    inv, dim = stocks(spark, ["a", "b"])
    forecast = spark.createDataFrame(rows, "item_id string, ds date, yhat double")
    a, b = insights.item_sums(forecast, inv, dim).orderBy("item_id").collect()
    assert (a.forecast_days, a["__first_ds"], a.cover_until, a["__total"], a["__first_k"]) == (4, days[0], days[2], 45.0, 45.0)
    assert (a["__avg_inventory"], a.avg_daily_demand) == (5.0, 22.5)
    assert (b.forecast_days, b.cover_until, b["__total"], b["__first_k"], b.avg_daily_demand) == (1, None, None, None, None)


def test_fits_give_what_rows_give(spark):
    rng = random.Random(5)
    items = {k: {d: float(rng.randrange(9)) for d in range(25)} for k in ("a", "b", "c")}
    odd = [("a", START, None), ("b", START + dt.timedelta(days=40), None), ("c", None, 8.0), ("d", None, 3.0), ("e", START, None)]
    sales = frame(spark, items).unionByName(spark.createDataFrame(odd, "item_id string, date date, sale double"))
    inv, dim = stocks(spark, [*items, "d", "e"])
    rows, fits = forecast_items(sales).select("item_id", "ds", "yhat"), forecast_fits(sales)
    found = [sorted(insights.inventory_insights(f, inv, dim).collect(), key=str) for f in (fits, rows)]
    assert [r.item_id for r in found[0]] == ["a", "b", "c", "e"] and found[0] == found[1]
    running = [insights.cumulative_demand(f).select("item_id", "ds", "yhat", "cum_demand") for f in (fits, rows)]
    assert sorted(running[0].collect(), key=str) == sorted(running[1].collect(), key=str)


@pytest.mark.parametrize("name", [
    "plan_panel_kpis", "reorder_point", "reorder_priority", "risk_grades", "urgency_sort", "filter_priority", "financials",
    "first_k_sum", "inventory_insights", "priority_counts", "medium_top3", "coverage", "inventory_projection",
])
def test_sales_are_summed_by_item_and_days_come_after_the_joins(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Aggregate [item_id" in line and "date#" in line.split("]")[0]]
    lines = [line.lstrip(" :+-") for line in plan.splitlines()]
    with_days = [i for i, line in enumerate(lines) if line.startswith("Project") and "transform(" in line]
    assert with_days and all(sum(line.startswith("Join") for line in lines[i:]) >= 2 for i in with_days)
