"""The retail mart: recent daily sales of the best-selling items, their details, and derived stock."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators import aggregates, headers, joins, ranking


def recent_day_columns(wide: DataFrame, calendar: DataFrame, days: int) -> tuple[list[str], dt.date]:
    """Day columns dated at most ``days`` before the latest one, and that latest date.

    The answer is a part of the column names, so it is as small as they are.
    """
    columns = [c for c in wide.columns if c.startswith("d_")]
    dated = calendar.where(F.col("d").isin(columns) & F.col("date").isNotNull()).select("d", "date")
    rows = dated.distinct().collect()
    last = max(r["date"] for r in rows)
    recent = {r["d"] for r in rows if r["date"] >= last - dt.timedelta(days=days)}
    return [c for c in columns if c in recent], last


def build_retail_mart(
    wide: DataFrame,
    calendar: DataFrame,
    prices: DataFrame,
    descriptions: DataFrame,
    days: int = 90,
    top_n: int = 12,
    exclude: list[str] | None = None,
    last_day: str | None = None,
) -> dict[str, DataFrame]:
    """Returns the tables ``sales``, ``item_dim`` and ``inv``.

    Only the recent day columns are read from the wide table.  The names of the best sellers (at most
    ``top_n``) are fetched once and become a filter on the scans of all three tables.
    """
    columns, last = recent_day_columns(wide, calendar, days)
    long = headers.wide_to_long(wide.select("item_id", "store_id", *columns), ["item_id", "store_id"])
    totals = aggregates.total_sales_by_item(long.select("item_id", F.col("sold_qty").alias("sale")))
    best = [r["item_id"] for r in ranking.top_rows(totals, "sales", top_n, "item_id").collect()]
    chosen = F.col("item_id").isin([i for i in best if i not in (exclude or [])])

    shift = (dt.date.fromisoformat(last_day) - last).days if last_day else 0
    daily = aggregates.store_rollup(long.where(chosen)).join(calendar.select("d", "date"), "d")
    sales = daily.select("item_id", F.date_add("date", shift).alias("date"), F.col("sales").alias("sale"))
    item_dim = joins.build_item_dim(descriptions.where(chosen), prices.where(chosen))
    return {"sales": sales, "item_dim": item_dim, "inv": aggregates.derive_inv(sales)}
