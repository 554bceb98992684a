"""Model table, training and the recursive forecast, checked step by step in plain Python."""

import datetime as dt
import random

import duckdb
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from larder.plans import boosting, features, training

FIRST = dt.date(2024, 1, 1)


@pytest.fixture(scope="module")
def panel(spark):
    rng = random.Random(5)
    rows = []
    for store in ("S1", "S2"):
        for item in ("A", "B"):
            for day in range(150):
                date = FIRST + dt.timedelta(days=day)
                price = None if item == "B" and store == "S2" else 2.0 + (day // 40) * 0.5
                event = "Fair" if day % 10 == 0 else "Market" if day % 15 == 7 else None
                sold = float(rng.randrange(4) + 3 * (date.weekday() == 5) + (4 if event == "Fair" else 0))
                rows.append((store, item, "D" + item, "C", "TX", date, sold, price, event, 1 if day % 2 else 0))
    schema = (
        "store_id string, item_id string, dept_id string, cat_id string, state_id string, date date, sales double, "
        "sell_price double, event_name_1 string, snap_ca int"
    )
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def fitted(panel):
    vocabulary = features.vocabularies(panel)
    rows, names = features.feature_table(panel, vocabulary)
    table = training.stored(rows)
    model, predictions, start = training.train_validate(table, names, "gbt", maxIter=5)
    return vocabulary, table, names, model, predictions, start


def test_feature_table(fitted, panel):
    vocabulary, table, names, *_ = fitted
    assert vocabulary == {"event_name_1": ["Fair", "Market", "OTHER"]}
    assert {"event_name_1_Market", "event_name_1_OTHER"} <= set(names) and "event_name_1_Fair" not in names
    assert table.count() == 4 * (150 - 56)
    sales = {(r["store_id"], r["item_id"], r["date"]): r["sales"] for r in panel.collect()}
    for r in table.collect():
        past = [sales[r["store_id"], r["item_id"], r["date"] - dt.timedelta(days=k)] for k in range(1, 57)]
        assert (r["sales_lag_1"], r["sales_lag_28"], r["sales_lag_56"]) == (past[0], past[27], past[55])
        assert r["sales_rmean_14"] == pytest.approx(sum(past[:14]) / 14)
        assert (r["item_code"], r["store_code"]) == ("AB".index(r["item_id"]), ["S1", "S2"].index(r["store_id"]))
    # The series without any price gets the overall median.
    unpriced = table.where("item_id = 'B' AND store_id = 'S2'").select("sell_price").distinct().collect()
    assert [r[0] for r in unpriced] == [2.5]


def test_validation_covers_the_last_28_days(fitted):
    *_, predictions, start = fitted
    assert start == FIRST + dt.timedelta(days=122)
    assert predictions.count() == 4 * 28 and predictions.where("abs_err < 0 OR y_pred IS NULL").count() == 0


def test_recursion_feeds_predictions_back(spark, fitted):
    vocabulary, table, names, model, *_ = fitted
    last = FIRST + dt.timedelta(days=149)
    calendar = spark.createDataFrame(
        [(last + dt.timedelta(days=i), "Fair" if i == 3 else None, i % 2) for i in range(1, 29)], "date date, event_name_1 string, snap_ca int"
    )
    out = training.forecast_recursive_28(training.model_step(model, names), table, names, vocabulary, calendar)
    got = {(r["store_id"], r["item_id"], r["date"]): r["y_pred"] for r in out.collect()}
    assert len(got) == 4 * 28
    own = table.where("store_id = 'S1' AND item_id = 'A'").orderBy("date").collect()
    history, row = [r["sales"] for r in own], own[-1].asDict()
    for step in range(1, 11):
        day = last + dt.timedelta(days=step)
        event = "Fair" if step == 3 else "OTHER"
        row |= {f"sales_lag_{k}": history[-k] for k in features.LAGS}
        row |= {f"sales_rmean_{n}": sum(history[-n:]) / n for n in features.MEAN_ROWS}
        row |= {"day_of_week": day.weekday(), "month": day.month, "quarter": (day.month + 2) // 3, "year": day.year}
        row |= {"snap_ca": step % 2, "snap_tx": 0, "snap_wi": 0, "event_name_1_Market": 0, "event_name_1_OTHER": int(event == "OTHER")}
        one = spark.createDataFrame([tuple(float(row[n]) for n in names)], names)
        vector = VectorAssembler(inputCols=names, outputCol="features").transform(one).first()["features"]
        prediction = model.predict(vector)
        assert got["S1", "A", day] == pytest.approx(prediction)
        history.append(prediction)


@pytest.fixture(scope="module")
def staged(fitted):
    _, table, names, *_ = fitted
    return boosting.train_validate_staged(table, names, rounds=12, patience=3, maxDepth=3)


def test_arrays_predict_what_spark_predicts(spark, fitted):
    _, table, names, model, *_ = fitted
    rows = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep").transform(table.where("item_id = 'A'"))
    forest = training.make_regressor("rf", numTrees=7, maxDepth=4, featuresCol="features", labelCol="sales").fit(rows)
    for m in (model, forest):
        got = m.transform(rows).select(*names, F.col(m.getPredictionCol()).alias("guess")).toPandas()
        trees = boosting.Trees.of(m, spark)
        assert trees.predict(got[names].to_numpy(float)) == pytest.approx(got["guess"].to_numpy())


def test_stop_rule():
    assert boosting.stopped_at([5, 4, 3, 3, 3, 2], 3) == (6, False)
    assert boosting.stopped_at([5, 4, 3, 3, 3, 3, 2], 3) == (3, True)
    assert boosting.stopped_at([1.0], 3) == (1, False)


def test_staged_validation(fitted, staged):
    """Metrics of the stored predictions by SQL; errors per round as Spark's own; a run that stops early."""
    _, table, names, *_ = fitted
    rows = staged.predictions.toPandas()
    sql = "SELECT sqrt(avg(power(y_true - y_pred, 2))), max(abs(abs_err - abs(y_true - y_pred))), count(*) FROM rows"
    rmse, gap, n = duckdb.sql(sql).fetchall()[0]
    assert (rmse, gap, n) == (pytest.approx(staged.rmse), 0, 4 * 28)
    assert staged.best_round == staged.errors.index(min(staged.errors[: staged.best_round + 3])) + 1
    vectors = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep").transform(table)
    model = training.make_regressor("gbt", maxDepth=3, maxIter=len(staged.errors), featuresCol="features", labelCol="sales")
    model = model.fit(vectors.where(F.col("date") < F.lit(staged.start)))
    own = model.evaluateEachIteration(vectors.where(F.col("date") >= F.lit(staged.start)), "squared")
    assert [e * e for e in staged.errors] == pytest.approx(own)


def test_recursion_in_blocks_equals_the_recursion_step_by_step(spark, fitted):
    vocabulary, table, names, model, *_ = fitted
    last = FIRST + dt.timedelta(days=149)
    calendar = spark.createDataFrame(
        [(last + dt.timedelta(days=i), "Fair" if i == 3 else None, i % 2) for i in range(1, 29)], "date date, event_name_1 string, snap_ca int"
    )
    short = table.where("store_id = 'S1' OR date > '2024-04-20'")  # series of under 56 rows too
    want = training.forecast_recursive_28(training.model_step(model, names), short, names, vocabulary, calendar)
    trees = boosting.Trees.of(model, spark)
    got = boosting.forecast_blocks(lambda rows, names: trees.predict(rows), short, names, vocabulary, calendar)
    key = lambda df: {(r["store_id"], r["item_id"], r["date"]): r["y_pred"] for r in df.collect()}
    assert key(got) == pytest.approx(key(want)) and len(key(got)) == 4 * 28
