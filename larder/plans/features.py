"""Model table of a daily panel: price, calendar, event, lag and code columns per (store, item) series.

The panel has one row per series and day, so each window partition is at most as long as the calendar.  All
windows share one partitioning and order: one shuffle, one sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.calendar import calendar_parts, snap_flags
from larder.operators import encode, windows
from larder.operators.ordering import exact_median
from larder.session import checkpointed

SERIES = ["store_id", "item_id"]
LAGS = [1, 7, 14, 28, 56]
MEAN_ROWS = [7, 14, 28, 56]
SNAP_FLAGS = ["snap_ca", "snap_tx", "snap_wi"]
EVENT_COLUMNS = ["event_name_1", "event_type_1", "event_name_2", "event_type_2"]
CODES = {"item_code": "item_id", "store_code": "store_id", "dept_code": "dept_id", "cat_code": "cat_id"}
PRICE_FEATURES = [
    "sell_price", "price_pct_change", "price_drop_flag", "price_roll7_mean", "price_roll28_mean", "price_roll7_dev",
]
CALENDAR_FEATURES = ["day_of_week", "month", "quarter", "year"]


def global_median_fill(df: DataFrame, column: str) -> DataFrame:
    """NULLs become the exact median of the column."""
    median = exact_median(df, column)
    return df if median is None else df.withColumn(column, F.coalesce(column, F.lit(median)))


def fill_prices(panel: DataFrame, keys: list[str] = SERIES, median: bool = True) -> DataFrame:
    """Last known price, else next known one, per series; with ``median``, then the overall median."""
    w = windows.series_window(keys, ["date"])
    filled = panel.withColumn("sell_price", windows.fill_forward_back(w, "sell_price"))
    return global_median_fill(filled, "sell_price") if median else filled


def series_codes(panel: DataFrame) -> DataFrame:
    """One row per series: the codes of its item, store, department and category, and its known prices."""
    series = panel.groupBy(*SERIES).agg(
        F.max("dept_id").alias("dept_id"), F.max("cat_id").alias("cat_id"), F.count("sell_price").alias("priced_days")
    )
    return checkpointed(encode.category_codes(checkpointed(series), CODES)).drop("dept_id", "cat_id")


def price_features(panel: DataFrame, keys: list[str] = SERIES) -> DataFrame:
    w = windows.series_window(keys, ["date"])
    df = panel.withColumns(
        {
            "price_pct_change": windows.pct_change(w, "sell_price"),
            "price_roll7_mean": windows.full_mean(w, "sell_price", 7),
            "price_roll28_mean": windows.full_mean(w, "sell_price", 28),
        }
    )
    return df.withColumns(
        {
            "price_drop_flag": (F.col("price_pct_change") < 0).cast("int"),
            "price_roll7_dev": F.col("sell_price") - F.col("price_roll7_mean"),
        }
    )


def demand_features(panel: DataFrame, keys: list[str] = SERIES, value: str = "sales") -> DataFrame:
    w = windows.series_window(keys, ["date"])
    lagged = panel.withColumns(windows.lag_columns(w, value, LAGS, "sales"))
    return windows.add_past_means(lagged, w, value, MEAN_ROWS, "sales")


def vocabularies(panel: DataFrame, columns: list[str] | None = None) -> dict[str, list[str]]:
    present = [c for c in columns or EVENT_COLUMNS if c in panel.columns]
    return encode.event_vocabularies(panel, present) if present else {}


def feature_names(vocabulary: dict[str, list[str]]) -> list[str]:
    events = [encode.dummy_name(c, v) for c, values in vocabulary.items() for v in values[1:]]
    return [
        *[f"sales_lag_{k}" for k in LAGS],
        *[f"sales_rmean_{k}" for k in MEAN_ROWS],
        *PRICE_FEATURES,
        *CALENDAR_FEATURES,
        *SNAP_FLAGS,
        *CODES,
        *events,
    ]


def feature_table(panel: DataFrame, vocabulary: dict[str, list[str]] | None = None) -> tuple[DataFrame, list[str]]:
    """Panel (series keys, date, sales, sell_price, ...) to model rows; returns rows and feature names.

    Rows with an unknown feature or target, such as the first 56 days of a series, are left out.
    """
    # Written once: vocabularies, codes, medians and the windows all start from these rows.
    panel = checkpointed(panel)
    vocabulary = vocabularies(panel) if vocabulary is None else vocabulary
    codes = series_codes(panel)
    # Only a series with no price at all is left open by the per-series fill.
    unpriced = not codes.where("priced_days = 0").isEmpty()
    df = demand_features(price_features(fill_prices(panel, median=unpriced)))
    # The windows leave rows laid out by series, so this join moves only the one-row-per-series side.
    df = df.join(codes.drop("priced_days"), SERIES)
    df = df.withColumns({**calendar_parts("date"), **snap_flags(df, SNAP_FLAGS)})
    for column, values in vocabulary.items():
        df = encode.onehot_topk(df, column, values)
    names = feature_names(vocabulary)
    return df.dropna(subset=[*names, "sales"]), names
