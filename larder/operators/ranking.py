"""Sorted heads.  Spark plans sort-and-limit as a per-task heap, so no full sort happens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top_rows(df: DataFrame, by: str, n: int, ties: str) -> DataFrame:
    return df.orderBy(F.desc(by), ties).limit(n)


def reorder_top_n(plan: DataFrame, n: int = 20) -> DataFrame:
    return top_rows(plan, "reorder_qty", n, "sku")


def top_sellers(sales: DataFrame, n: int = 12) -> DataFrame:
    totals = sales.groupBy("item_id").agg(F.sum("sale").alias("sales"))
    return top_rows(totals, "sales", n, "item_id")


def chart_top10(df: DataFrame, category: str, value: str, n: int = 10) -> DataFrame:
    """Bars for a chart: the ``n`` largest values.  Whether a chart has room for all is the caller's choice."""
    return top_rows(df.select(category, value), value, n, category)


def urgency_sort(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("urgency_score"), "item_id")


def medium_top3(ranked: DataFrame, shown: int = 3) -> DataFrame:
    """The most urgent MEDIUM items, with how many more there are."""
    medium = ranked.where(F.col("priority") == "MEDIUM")
    total = medium.select(F.count(F.lit(1))).scalar()
    more = F.greatest(total - shown, F.lit(0)).cast("long")
    return urgency_sort(medium).limit(shown).withColumn("more_items", more)


def preview(df: DataFrame, order: list[str], rows: int = 100) -> DataFrame:
    return df.orderBy(*order).limit(rows)
