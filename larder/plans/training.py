"""Pooled demand model: training, validation and the recursive forecast.

The fitted numbers are Spark ML's; other libraries' boosters or forests give other numbers on the same
features.  What is kept is the split, the features, the metrics and the recursion.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.ml import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.calendar import calendar_parts
from larder.operators import joins, windows
from larder.operators.encode import OTHER, dummy_name
from larder.plans.features import EVENT_COLUMNS, LAGS, MEAN_ROWS, SERIES, SNAP_FLAGS
from larder.session import checkpointed, scratch_path

VALIDATION_DAYS = 28
HISTORY_ROWS = 56
STEPS_PER_CHECKPOINT = 7


def make_regressor(kind: str = "gbt", **settings):
    """Boosted trees, or a forest of 200 trees; seed 42."""
    if kind == "gbt":
        return GBTRegressor(**{"maxIter": 100, "maxDepth": 5, "stepSize": 0.1, "seed": 42, **settings})
    if kind == "rf":
        return RandomForestRegressor(**{"numTrees": 200, "maxDepth": 10, "seed": 42, **settings})
    raise ValueError(f"unknown model kind: {kind}")


def stored(features: DataFrame) -> DataFrame:
    """The feature table written once and read back: fitting passes over it many times."""
    path = scratch_path(features.sparkSession, "features")
    features.write.parquet(path)
    return features.sparkSession.read.parquet(path)


def validation_start(features: DataFrame, days: int = VALIDATION_DAYS) -> dt.date:
    return features.agg(F.date_sub(F.max("date"), days - 1)).first()[0]


def train_validate(
    features: DataFrame, names: list[str], kind: str = "gbt", **settings
) -> tuple[Model, DataFrame, dt.date]:
    """Fit on all but the last 28 days, predict those; returns model, predictions and first validation day.

    ``features`` should be a stored table (see ``stored``).
    """
    start = validation_start(features)
    assembler = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep")
    rows = assembler.transform(features).select(*SERIES, "date", F.col("sales").cast("double").alias("label"), "features")
    regressor = make_regressor(kind, featuresCol="features", labelCol="label", predictionCol="y_pred", **settings)
    model = regressor.fit(rows.where(F.col("date") < F.lit(start)))
    scored = model.transform(rows.where(F.col("date") >= F.lit(start)))
    predictions = scored.select(
        *SERIES, "date", F.col("label").alias("y_true"), "y_pred", F.abs(F.col("label") - F.col("y_pred")).alias("abs_err")
    )
    return model, predictions, start


def union_history(history: DataFrame, rows: DataFrame) -> DataFrame:
    """History with skeleton or predicted rows below it; columns one side lacks are NULL."""
    return history.unionByName(rows, allowMissingColumns=True)


def series_state(features: DataFrame, keep: list[str]) -> DataFrame:
    """One row per series: its last row's columns and its last 56 sales, oldest first."""
    tail = windows.last_rows(features.select(*SERIES, "date", "sales", *keep), SERIES, [F.col("date")], HISTORY_ROWS)
    pairs = F.collect_list(F.struct((-F.col("from_end")).alias("o"), F.col("sales").cast("double").alias("s")))
    return tail.groupBy(*SERIES).agg(
        F.sort_array(pairs)["s"].alias("hist"),
        *[F.max(F.when(F.col("from_end") == 1, F.col(c))).alias(c) for c in keep],
    )


def _future_days(features: DataFrame, calendar: DataFrame, horizon: int) -> list[dict]:
    """Flags and events of the forecast days; ``horizon`` rows."""
    spark = features.sparkSession
    last = features.agg(F.max("date")).first()[0]
    dates = spark.createDataFrame([(last + dt.timedelta(days=i),) for i in range(1, horizon + 1)], "date date")
    joined = joins.join_future_events(dates, calendar, SNAP_FLAGS, EVENT_COLUMNS)
    return [r.asDict() for r in joined.orderBy("date").collect()]


def future_features(features: DataFrame, vocabulary: dict[str, list[str]], calendar: DataFrame, horizon: int) -> list[dict]:
    """Of every forecast day its date, calendar parts, flags and event indicators."""
    spark, days = features.sparkSession, _future_days(features, calendar, horizon)
    dates = spark.createDataFrame([(d["date"],) for d in days], "date date").withColumns(calendar_parts("date"))
    parts = {r["date"]: r.asDict() for r in dates.collect()}
    out = []
    for day in days:
        seen = {c: day[c] if day[c] in vocabulary.get(c, []) else OTHER for c in EVENT_COLUMNS}
        events = {dummy_name(c, v): int(seen[c] == v) for c, values in vocabulary.items() for v in values[1:]}
        out.append(parts[day["date"]] | {f: int(day[f]) for f in SNAP_FLAGS} | events)
    return out


def _history_features() -> dict:
    at = {k: F.try_element_at("hist", F.lit(-k)) for k in LAGS}
    out = {f"sales_lag_{k}": F.coalesce(v, F.lit(0.0)) for k, v in at.items()}
    for n in MEAN_ROWS:
        total = F.aggregate(F.slice("hist", -n, n), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
        out[f"sales_rmean_{n}"] = F.when(F.size("hist") >= n, total / n).otherwise(F.lit(0.0))
    return out


def model_step(model: Model, names: list[str]) -> Callable[[DataFrame], DataFrame]:
    """The step of a fitted model: adds ``y_pred`` to rows that have all its features."""
    assembler = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep")
    return lambda rows: model.transform(assembler.transform(rows))


def forecast_recursive_28(
    step: Callable[[DataFrame], DataFrame],
    features: DataFrame,
    names: list[str],
    vocabulary: dict[str, list[str]],
    calendar: DataFrame,
    horizon: int = 28,
) -> DataFrame:
    """Day-by-day forecast in which each prediction becomes history for the next day.

    ``step`` adds ``y_pred`` to rows that have the named features: a fitted model (``model_step``) or any expression.

    A series is one row holding its last 56 sales as an array, so a step is a projection: no window, join or
    shuffle inside the loop, whatever the number of series.  Static and price columns stay at the series'
    last known values.  Lineage is cut every few steps.
    """
    own = {*_history_features(), *calendar_parts("date"), *SNAP_FLAGS}
    events = {dummy_name(c, v): (c, v) for c, values in vocabulary.items() for v in values[1:]}
    static = [c for c in names if c not in own and c not in events]

    days = _future_days(features, calendar, horizon)
    no_predictions = F.array().cast("array<double>")
    state = checkpointed(series_state(features, static).withColumn("preds", no_predictions))
    state = state.fillna(0.0, subset=static)
    for number, day in enumerate(days, 1):
        flags = {f: F.lit(int(day[f])) for f in SNAP_FLAGS}
        seen = {c: day[c] if day[c] in vocabulary.get(c, []) else OTHER for c in EVENT_COLUMNS}
        dummies = {n: F.lit(int(seen[c] == v)) for n, (c, v) in events.items()}
        row = state.withColumns({**_history_features(), **calendar_parts(F.lit(day["date"])), **flags, **dummies})
        predicted = step(row)
        longer = F.concat("hist", F.array("y_pred"))
        state = predicted.select(
            *SERIES,
            *static,
            F.when(F.size(longer) > HISTORY_ROWS, F.slice(longer, -HISTORY_ROWS, HISTORY_ROWS)).otherwise(longer).alias("hist"),
            F.concat("preds", F.array("y_pred")).alias("preds"),
        )
        if number % STEPS_PER_CHECKPOINT == 0:
            state = checkpointed(state)
    first = F.lit(days[0]["date"])
    out = state.select(*SERIES, F.posexplode("preds").alias("__i", "y_pred"))
    return out.select(*SERIES, F.date_add(first, F.col("__i")).alias("date"), "y_pred")
