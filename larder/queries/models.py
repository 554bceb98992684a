"""Model table, training, validation and recursive forecast on the daily panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.plans import boosting, features, training
from larder.queries.aggregates import rounded
from larder.queries.registry import query
from larder.queries.windows import _full, _past
from larder.session import checkpointed
from larder.sources import marts

# Rounds of the registered boosting runs, which have to end within minutes; the library's defaults are larger.
QUERY_ROUNDS, QUERY_PATIENCE = 80, 10

DUMMIES = {
    "event_name_1": ["Market", "OTHER", "Parade"], "event_type_1": ["Local", "OTHER"], "event_name_2": ["OTHER"], "event_type_2": ["OTHER"],
}
EVENTS_SQL = ", ".join(
    f"CAST(coalesce({column}, 'OTHER') = '{value}' AS INTEGER) AS {column}_{value}" for column, values in DUMMIES.items() for value in values
)
ROUNDED = [
    *[f"sales_rmean_{n}" for n in (7, 14, 28, 56)],
    "price_pct_change", "price_roll7_mean", "price_roll28_mean", "price_roll7_dev",
]
FEATURES = f"""
    , filled AS (SELECT * REPLACE (
        coalesce(last_value(sell_price IGNORE NULLS) OVER (PARTITION BY store_id, item_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                 first_value(sell_price IGNORE NULLS) OVER (PARTITION BY store_id, item_id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS sell_price) FROM panel),
    feats AS (
      SELECT *, {", ".join(f"lag(sales, {k}) OVER w AS sales_lag_{k}" for k in (1, 7, 14, 28, 56))},
             {_past(7)}, {_past(14)}, {_past(28)}, {_past(56)}, round(coalesce(sell_price / lag(sell_price) OVER w - 1, 0), 6) AS price_pct_change,
             CAST(coalesce(sell_price / lag(sell_price) OVER w - 1, 0) < 0 AS INTEGER) AS price_drop_flag,
             round({_full(7)}, 6) AS price_roll7_mean, round({_full(28)}, 6) AS price_roll28_mean, round(sell_price - {_full(7)}, 6) AS price_roll7_dev,
             dense_rank() OVER (ORDER BY item_id) - 1 AS item_code, dense_rank() OVER (ORDER BY store_id) - 1 AS store_code,
             dense_rank() OVER (ORDER BY dept_id) - 1 AS dept_code, dense_rank() OVER (ORDER BY cat_id) - 1 AS cat_code
      FROM filled WINDOW w AS (PARTITION BY store_id, item_id ORDER BY date)),
    model_rows AS (SELECT * FROM feats WHERE sales_rmean_56 IS NOT NULL AND price_roll28_mean IS NOT NULL)"""


@query(
    "feature_table",
    f"""{FEATURES}
    SELECT store_id, item_id, date, sales, {", ".join(f"sales_lag_{k}" for k in (1, 7, 14, 28, 56))}, {", ".join(f"sales_rmean_{n}" for n in (7, 14, 28, 56))},
           sell_price, price_pct_change, price_drop_flag, price_roll7_mean, price_roll28_mean, price_roll7_dev,
           CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CAST(month(date) AS INTEGER) AS month, CAST(quarter(date) AS INTEGER) AS quarter, CAST(year(date) AS INTEGER) AS year,
           CAST(snap_ca AS INTEGER) AS snap_ca, CAST(snap_tx AS INTEGER) AS snap_tx, CAST(snap_wi AS INTEGER) AS snap_wi,
           item_code, store_code, dept_code, cat_code, {EVENTS_SQL}
    FROM model_rows""",
    "panel",
)
def _(spark, folder):
    rows, names = features.feature_table(marts.panel(spark, folder))
    return rounded(rows.select("store_id", "item_id", "date", "sales", *names), 6, *ROUNDED)


def prepared(spark, folder):
    """Stored features, their names and vocabulary."""
    panel = marts.panel(spark, folder)
    vocabulary = features.vocabularies(panel)
    rows, names = features.feature_table(panel, vocabulary)
    return training.stored(rows), names, vocabulary


def validated(spark, folder, kind: str):
    """Validation rows of a full-size model, the split day, and whether it beats last month's sales as a forecast."""
    table, names, _ = prepared(spark, folder)
    _, predictions, start = training.train_validate(table, names, kind)
    lag = table.where(F.col("date") >= F.lit(start)).select("store_id", "item_id", "date", "sales_lag_28")
    both = checkpointed(predictions.join(lag, ["store_id", "item_id", "date"]))
    square = lambda guess: F.avg((F.col("y_true") - F.col(guess)) * (F.col("y_true") - F.col(guess)))
    better = both.select(square("y_pred") < square("sales_lag_28")).scalar()
    return both.select("store_id", "item_id", "date", "y_true", F.lit(start).alias("split_day"), better.alias("beats_last_month"))


VALIDATED = f"""{FEATURES}
    SELECT store_id, item_id, date, sales AS y_true, CAST((SELECT max(date) - 27 FROM model_rows) AS DATE) AS split_day, TRUE AS beats_last_month
    FROM model_rows WHERE date >= (SELECT max(date) - 27 FROM model_rows)"""


@query("train_validate", VALIDATED, "panel")
def _(spark, folder):
    return validated(spark, folder, "gbt")


@query("train_validate_forest", VALIDATED, "panel")
def _(spark, folder):
    return validated(spark, folder, "rf")


@query("train_validate_staged")
def _(spark, folder):
    """Validation rows with their predictions at the best round of a boosting run, and the error of that round."""
    table, names, _ = prepared(spark, folder)
    found = boosting.train_validate_staged(table, names, rounds=QUERY_ROUNDS, patience=QUERY_PATIENCE)
    return found.predictions.withColumns(
        {"split_day": F.lit(found.start), "best_round": F.lit(found.best_round), "rmse": F.lit(found.rmse), "rounds_fitted": F.lit(len(found.errors))}
    )


@query("forecast_recursive_model")
def _(spark, folder):
    """28 days ahead by a fitted boosting model, each prediction being history for the next day."""
    table, names, vocabulary = prepared(spark, folder)
    trees = boosting.train_validate_staged(table, names, rounds=QUERY_ROUNDS, patience=QUERY_PATIENCE).trees
    future = marts.calendar(spark, folder).withColumn("date", F.add_months("date", 84))
    return boosting.forecast_blocks(lambda rows, names: trees.predict(rows), table, names, vocabulary, future)


def weighted_step(rows, names):
    """A stated formula in place of a model: half of last week's day, the rest from the last month and yesterday."""
    column = dict(zip(names, rows.T, strict=True))
    return column["sales_lag_7"] * 0.5 + column["sales_rmean_28"] * 0.25 + column["sales_lag_1"] * 0.25


@query(
    "forecast_recursive_28",
    f"""{FEATURES},
    ends AS (SELECT store_id, item_id, list(sales ORDER BY date)[-56:] AS hist FROM model_rows GROUP BY 1, 2),
    steps AS (
      SELECT store_id, item_id, hist, 0 AS step, CAST(NULL AS DOUBLE) AS y_pred FROM ends
      UNION ALL
      SELECT store_id, item_id, list_append(hist, y)[-56:], step + 1, y
      FROM (SELECT *, hist[-7] * 0.5 + list_sum(hist[-28:]) / 28 * 0.25 + hist[-1] * 0.25 AS y FROM steps WHERE step < 28))
    SELECT store_id, item_id, CAST((SELECT max(date) FROM model_rows) + step AS DATE) AS date, round(y_pred, 6) AS y_pred FROM steps WHERE step > 0""",
    "panel",
)
def _(spark, folder):
    table, names, vocabulary = prepared(spark, folder)
    future = marts.calendar(spark, folder).withColumn("date", F.add_months("date", 84))
    return rounded(boosting.forecast_blocks(weighted_step, table, names, vocabulary, future), 6, "y_pred")
