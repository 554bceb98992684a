"""Data-quality report of an export as a (metric, value) table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.cleaning import PRICE_RANGE, QUANTITY_RANGE, out_of_bounds
from larder.operators.filters import missing_key


def dq_report(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows in and out, rows without key, duplicates, out-of-range values and NULLs per column.

    ``rows`` has the last row of every key, cleaned and with its marks of out-of-range cells, and in ``__rows`` how many
    rows of the export it stands for; rows with a missing key are among them.
    """
    stays = ~missing_key(keys)
    total = lambda count: F.coalesce(F.sum(count), F.lit(0).cast("long"))
    nulls = {f"null_{c}": F.count_if(stays & F.col(c).isNull()) for c in rows.columns if not c.startswith("__")}
    found = rows.agg(
        total(F.col("__rows")).alias("initial_rows"),
        total(F.when(~stays, F.col("__rows"))).alias("missing_keys"),
        total(F.when(stays, F.col("__rows") - 1)).alias("duplicates_dropped"),
        F.count_if(stays).alias("final_rows"),
        F.count_if(stays & F.col("__bad_quantity")).alias("out_of_bounds_qty"),
        F.count_if(stays & F.col("__bad_price")).alias("out_of_bounds_price"),
        *[test.alias(name) for name, test in nulls.items()],
    )
    return found.unpivot([], found.columns, "metric", "value")


def bounds_columns(df: DataFrame, quantity: str, price: str | None) -> DataFrame:
    """Mark out-of-range quantity and price, then set them to NULL."""
    marks = {"__bad_quantity": F.lit(False), "__bad_price": F.lit(False)}
    fixes = {}
    if quantity in df.columns:
        marks["__bad_quantity"] = out_of_bounds(quantity, *QUANTITY_RANGE)
        fixes[quantity] = F.when(~F.col("__bad_quantity"), F.col(quantity))
    if price and price in df.columns:
        marks["__bad_price"] = out_of_bounds(price, *PRICE_RANGE)
        fixes[price] = F.when(~F.col("__bad_price"), F.col(price))
    return df.withColumns(marks).withColumns(fixes)
