"""Stock arithmetic on a cleaned inventory row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHELF_LOW = 3
DEFAULT_SAFETY_STOCK = 2.0


def days_of_cover(on_hand: Column, daily_sales: Column) -> Column:
    """Stock divided by daily sales; 0 without sales, never negative."""
    return F.greatest(
        F.when(daily_sales > 0, on_hand / F.nullif(daily_sales, F.lit(0.0))).otherwise(F.lit(0.0)), F.lit(0.0)
    )


def restock_flag(shelf: Column, stockroom: Column, shelf_low: float = SHELF_LOW) -> Column:
    """The shelf is low and the stockroom has something to put on it."""
    return (shelf < F.lit(shelf_low)) & (stockroom > 0)


def clip_nonneg(value: Column) -> Column:
    return F.greatest(value, F.lit(0.0))


def reorder_quantity(lead_time: Column, safety: Column, cover: Column, daily_sales: Column) -> Column:
    """Units that close the gap between wanted cover (lead time + safety days) and present cover."""
    missing_days = F.greatest(lead_time + safety - cover, F.lit(0.0))
    return F.ceil(missing_days * daily_sales)
