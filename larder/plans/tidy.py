"""Wide daily sales plus calendar and prices to one tidy row per store, item and day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import cleaning as C
from larder.operators import headers
from larder.operators.joins import join_calendar, join_prices
from larder.operators.ordering import number_rows
from larder.operators.windows import dedupe_keep_last

# Columns kept from each input.
ID_COLUMNS = ["id", "item_id", "dept_id", "cat_id", "store_id", "state_id"]
CALENDAR_COLUMNS = [
    "d", "date", "wm_yr_wk", "weekday", "wday", "month", "year",
    "event_name_1", "event_type_1", "event_name_2", "event_type_2",
    "snap_ca", "snap_tx", "snap_wi",
]
PRICE_COLUMNS = ["store_id", "item_id", "wm_yr_wk", "sell_price"]
SNAP_COLUMNS = ["snap_ca", "snap_tx", "snap_wi"]


def synth_day_key(calendar: DataFrame, order: str = "date") -> DataFrame:
    """Number a calendar's rows d_1, d_2, ... when it has no day key of its own."""
    if "d" in calendar.columns:
        return calendar
    numbered = number_rows(calendar, [order], "__d", start=1)
    return numbered.withColumn("d", F.concat(F.lit("d_"), F.col("__d").cast("string"))).drop("__d")


def tidy_calendar(calendar: DataFrame, order: str = "date") -> DataFrame:
    """Kept calendar columns, cleaned; the day key is made from row order if the calendar has none."""
    texts = ["weekday", "event_name_1", "event_type_1", "event_name_2", "event_type_2"]
    cal = headers.project_keep(headers.snake_headers(calendar), CALENDAR_COLUMNS)
    fixes: dict[str, Column] = {c: C.clean_text(c) for c in texts if c in cal.columns}
    if "date" in cal.columns and cal.schema["date"].dataType.typeName() == "string":
        fixes["date"] = C.parse_date_any(C.clean_text("date")).cast("date")
    if "d" in cal.columns:
        fixes["d"] = F.trim(F.col("d").cast("string"))
    fixes |= {c: F.col(c).cast("string").try_cast("tinyint") for c in SNAP_COLUMNS if c in cal.columns}
    cal = cal.withColumns(fixes) if fixes else cal
    return synth_day_key(cal, order)


def tidy_prices(prices: DataFrame) -> DataFrame:
    kept = headers.project_keep(headers.snake_headers(prices), PRICE_COLUMNS)
    texts = {c: C.clean_text(F.col(c).cast("string")) for c in PRICE_COLUMNS[:3] if c in kept.columns}
    if "sell_price" in kept.columns and kept.schema["sell_price"].dataType.typeName() == "string":
        texts["sell_price"] = C.coerce_float("sell_price")
    return kept.withColumns(texts)


def long_sales(wide: DataFrame, order: list[Column]) -> DataFrame:
    """Cleaned long sales, one row per store, item and day.

    Repeated (store, item) rows are settled before the unpivot: the day columns of one wide row go together,
    so keeping the last wide row keeps the same cells as keeping the last long row per day, on a table
    smaller by the number of days.  ``order`` gives the row order, which a table does not have by itself.  A table
    with neither key column keeps all its rows.
    """
    if not order:
        raise ValueError("keeping the last row per key needs a row order")
    wide = headers.snake_headers(wide)
    ids = [c for c in ID_COLUMNS if c in wide.columns]
    wide = wide.withColumns({c: C.clean_text(F.col(c).cast("string")) for c in ids})
    keys = [k for k in ("store_id", "item_id") if k in ids]
    if keys:
        wide = dedupe_keep_last(wide, keys, order)
    long = headers.wide_to_long(wide, ids)
    if long.schema["sold_qty"].dataType.typeName() == "string":
        return long.withColumn("sold_qty", C.coerce_int("sold_qty"))
    return long.withColumn("sold_qty", F.col("sold_qty").cast("long"))


def mark_and_bound(df: DataFrame) -> DataFrame:
    fixes: dict[str, Column] = {}
    if "sold_qty" in df.columns:
        fixes["sold_qty"] = C.null_out_of_bounds("sold_qty", *C.QUANTITY_RANGE)
    if "sell_price" in df.columns:
        fixes["sell_price"] = C.null_out_of_bounds("sell_price", *C.PRICE_RANGE)
    df = df.withColumns(fixes)
    if {"sold_qty", "sell_price"} <= set(df.columns):
        df = df.withColumn("revenue", C.revenue("sold_qty", "sell_price"))
    return df


def m5_tidy(
    wide: DataFrame, calendar: DataFrame, prices: DataFrame, order: list[Column]
) -> DataFrame:
    """The tidy table: unpivot, calendar, prices, range rules, revenue, column order."""
    out = join_calendar(long_sales(wide, order), tidy_calendar(calendar))
    if "wm_yr_wk" in out.columns:
        out = out.withColumn("wm_yr_wk", F.col("wm_yr_wk").cast("string"))
    out = mark_and_bound(join_prices(out, tidy_prices(prices)))
    return headers.order_columns(out, headers.TIDY_ORDER, rest_sorted=False)


def m5_report(
    wide: DataFrame, calendar: DataFrame, prices: DataFrame, order: list[Column]
) -> DataFrame:
    """Rows in and out, duplicates, out-of-range cells and NULLs per column of the tidy job."""
    snake = headers.snake_headers(wide)
    days = len([c for c in snake.columns if c.startswith("d_")])
    start = snake.select(F.count(F.lit(1))).scalar()
    joined = join_prices(
        join_calendar(long_sales(wide, order), tidy_calendar(calendar)).withColumn(
            "wm_yr_wk", F.col("wm_yr_wk").cast("string")
        ),
        tidy_prices(prices),
    )
    marked = joined.withColumns(
        {
            "__bad_quantity": C.out_of_bounds("sold_qty", *C.QUANTITY_RANGE),
            "__bad_price": C.out_of_bounds("sell_price", *C.PRICE_RANGE),
        }
    )
    done = mark_and_bound(marked)
    nulls = {f"null_{c}": F.count_if(F.col(c).isNull()) for c in done.columns if not c.startswith("__")}
    final = done.agg(
        F.count(F.lit(1)).alias("final_rows_long"),
        F.count_if("__bad_quantity").alias("out_of_bounds_qty"),
        F.count_if("__bad_price").alias("out_of_bounds_price"),
        *[c.alias(n) for n, c in nulls.items()],
    )
    both = final.withColumn("initial_rows_wide", start)
    both = both.withColumn("duplicates_removed", F.col("initial_rows_wide") * days - F.col("final_rows_long"))
    return both.unpivot([], both.columns, "metric", "value")
