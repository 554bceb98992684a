"""The forecast with a trend that may turn, against plain least squares and on a demand that turned."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.plans import turning

START = dt.date(2024, 3, 5)


def frame(spark, items):
    rows = [(i, START + dt.timedelta(days=d), v / 2) for i, s in items.items() for d, v in s.items() for _ in range(2)]
    return spark.createDataFrame(rows, "item_id string, date date, sale double")


def expected(items, item, knots, horizon, stiffness=turning.KNOT_PENALTY):
    """Stacked least squares: the design rows, then one row per penalty."""
    days = [d for s in items.values() for d in s]
    origin = (START - dt.date(2000, 1, 3)).days
    first, width = origin + min(days), max(max(days) - min(days), 1)
    at = np.array([first + int(np.floor(width * (0.8 * k / knots))) for k in range(1, knots + 1)])
    sold = items[item]
    lo, hi = origin + min(sold), origin + max(sold)

    def design(d):
        waves = [f(2 * np.pi * d * j / 7) for f in (np.cos, np.sin) for j in (1, 2, 3)]
        return np.column_stack([np.ones(len(d)), (d - first) / width, *waves, *[np.maximum(d - k, 0) / width for k in at]])

    d = np.arange(lo, hi + 1)
    y = np.array([sold.get(int(x) - origin, 0.0) for x in d])
    penalty = np.sqrt(np.diag([0.0, *[1e-3] * 7, *[stiffness] * knots]))
    beta = np.linalg.lstsq(np.vstack([design(d), penalty]), np.concatenate([y, np.zeros(len(penalty))]), rcond=None)[0]
    sigma = np.sqrt(np.mean((y - design(d) @ beta) ** 2))
    mean = design(np.arange(lo, hi + 1 + horizon)) @ beta
    return np.clip(mean, 0, None), np.clip(mean - turning.BAND_Z * sigma, 0, None), np.clip(mean + turning.BAND_Z * sigma, 0, None)


@pytest.mark.parametrize("knots", [0, 5, 12])
def test_matches_stacked_least_squares(spark, knots):
    rng = random.Random(knots)
    draw = lambda a, b: {d: float(rng.randrange(1, 40)) for d in range(a, b) if rng.random() < 0.6} | {a: 3.0, b - 1: 9.0}
    items = {"long": draw(0, 400), "late": draw(350, 400), "short": draw(20, 25), "one": {37: 4.0}, "two": {3: 3.0, 4: 8.0}}
    got = turning.forecast_turning(frame(spark, items), 14, include_history=True, knots=knots).collect()
    for item in items:
        own = sorted((r for r in got if r["item_id"] == item), key=lambda r: r["ds"])
        for column, values in zip(("yhat", "yhat_lower", "yhat_upper"), expected(items, item, knots, 14)):
            np.testing.assert_allclose([r[column] for r in own], values, atol=1e-6)


def test_a_demand_that_turned_is_forecast_from_its_last_slope(spark):
    # Up by 0.5 a day for 300 days, then down by 0.4; weekends sell more.
    sold = {d: 20 + (0.5 * d if d < 300 else 150 - 0.4 * (d - 300)) + 6 * ((START + dt.timedelta(days=d)).weekday() >= 5) for d in range(500)}
    ahead = turning.forecast_turning(frame(spark, {"a": sold}), 30).orderBy("ds").collect()
    assert ahead[0]["ds"] == START + dt.timedelta(days=500) and len(ahead) == 30
    slope = (ahead[28]["trend"] - ahead[0]["trend"]) / 28
    assert slope == pytest.approx(-0.4, abs=0.05)
    truth = [20 + 150 - 0.4 * (d - 300) + 6 * ((START + dt.timedelta(days=d)).weekday() >= 5) for d in range(500, 530)]
    assert np.mean([abs(r["yhat"] - t) for r, t in zip(ahead, truth)]) < 3
    # The day of the turn as a knot: all but exact.
    exact = turning.forecast_turning(frame(spark, {"a": sold}), 30, knots=[START + dt.timedelta(days=300)], stiffness=1e-6).orderBy("ds").collect()
    assert np.mean([abs(r["yhat"] - t) for r, t in zip(exact, truth)]) < 0.1


def test_nothing_and_nulls(spark):
    empty = spark.createDataFrame([], "item_id string, date date, sale double")
    assert turning.forecast_turning(empty).collect() == []
    rows = [("a", None, 5.0), ("a", START, None), ("a", START + dt.timedelta(days=1), 2.0), (None, START, 1.0)]
    got = turning.forecast_turning(spark.createDataFrame(rows, "item_id string, date date, sale double"), 3)
    assert got.where("yhat IS NULL OR isnan(yhat)").count() == 0
    assert {(r["item_id"], r["n"]) for r in got.groupBy("item_id").agg(F.count("*").alias("n")).collect()} == {("a", 3), (None, 3)}
