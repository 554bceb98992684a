"""Row selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def search_inventory(df: DataFrame, text: str, max_rows: int, order: str = "sku") -> DataFrame:
    """Rows whose sku or product name contains the text, any case; at most ``max_rows`` of them by sku."""
    wanted = text.lower()
    found = F.lower("sku").contains(wanted) | F.lower("product_name").contains(wanted)
    return df.where(found).orderBy(order).limit(max_rows)


def filter_chat(
    df: DataFrame, roles: list[str] | None = None, text: str | None = None, newest: list[Column] | None = None
) -> DataFrame:
    """Messages of the given roles containing the text (any case), newest first."""
    if roles:
        df = df.where(F.col("role").isin(roles))
    if text:
        df = df.where(F.lower("content").contains(text.lower()))
    return df.orderBy(*newest) if newest else df


def lookup_sku(df: DataFrame, sku: str) -> DataFrame:
    """Stock line of a product: the first whose code equals the text (any case), else the first containing it."""
    wanted = sku.lower()
    code = F.lower(F.col("sku"))
    ads = F.col("avg_daily_sales")
    cover = F.when(ads > 0, F.bround(F.floor("on_hand") / F.nullif(ads, F.lit(0.0)), 2))
    return (
        df.where(code.contains(wanted))
        .withColumn("match_rank", F.when(code == wanted, 0).otherwise(1))
        .orderBy("match_rank", "sku")
        .limit(1)
        .select(
            "sku",
            F.floor("on_hand").alias("on_hand"),
            F.floor("shelf_units").alias("shelf"),
            F.floor("stockroom_units").alias("stockroom"),
            cover.alias("days_cover"),
            F.col("lead_time_days").cast("double").alias("lead_time_days"),
        )
    )


def filter_equals(df: DataFrame, **values: object) -> DataFrame:
    for column, value in values.items():
        df = df.where(F.col(column) == F.lit(value))
    return df


def limit_entities(df: DataFrame, column: str, count: int) -> DataFrame:
    """Rows of the first ``count`` distinct values of the column, in value order."""
    first = df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).limit(count)
    return df.join(first, column, "left_semi")


def last_n_days(df: DataFrame, days: int, column: str = "date") -> DataFrame:
    """Rows dated at most ``days`` before the latest date (both ends kept).

    The cutoff is a scalar subquery, so it reaches the file scan as a filter value at run time.
    """
    cutoff = df.select(F.date_sub(F.max(column), days)).scalar()
    return df.where(F.col(column) >= cutoff)


def filter_category(df: DataFrame, term: str) -> DataFrame:
    return df.where(F.lower("category").contains(term.lower()))


def sku_history(df: DataFrame, sku: str) -> DataFrame:
    return df.where(F.col("sku") == sku)


def drop_null_features(df: DataFrame, features: list[str]) -> DataFrame:
    return df.dropna(subset=features)


def missing_key(columns: list[str]) -> Column:
    test = F.lit(False)
    for c in columns:
        test = test | F.col(c).isNull() | (F.length(F.col(c).cast("string")) == 0)
    return test


def drop_missing_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.where(~missing_key([k for k in keys if k in df.columns]))


def threshold_filter(df: DataFrame, column: str, above: float | None = None, below: float | None = None) -> DataFrame:
    if above is not None:
        df = df.where(F.col(column) > above)
    if below is not None:
        df = df.where(F.col(column) < below)
    return df


def filter_priority(df: DataFrame, band: str, column: str = "priority") -> DataFrame:
    """One priority band, any case; "all" keeps every row."""
    return df if band.lower() == "all" else df.where(F.lower(column) == band.lower())


def exclude_item(df: DataFrame, items: list[str], column: str = "item_id") -> DataFrame:
    return df.where(~F.col(column).isin(items))
