"""Calendar columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def calendar_parts(date: Column | str) -> dict[str, Column]:
    """Monday-based weekday, month, quarter and year."""
    return {
        "day_of_week": F.weekday(date).cast("int"),
        "month": F.month(date).cast("int"),
        "quarter": F.quarter(date).cast("int"),
        "year": F.year(date).cast("int"),
    }


def snap_flags(df: DataFrame, columns: list[str]) -> dict[str, Column]:
    """Benefit-day flags as 0/1; NULL and absent columns are 0."""
    return {
        c: F.coalesce(F.col(c).try_cast("int"), F.lit(0)) if c in df.columns else F.lit(0) for c in columns
    }


def day_number(d: Column | str) -> Column:
    """Numeric part of a ``d_10`` style day key, so that d_10 sorts after d_9."""
    c = F.col(d) if isinstance(d, str) else d
    return F.regexp_extract(c.cast("string"), r"(\d+)$", 1).try_cast("long")


def date_shift(df: DataFrame, column: str, last_day: str | Column) -> DataFrame:
    """Move every date by the same number of days so that the latest one becomes ``last_day``."""
    target = F.lit(last_day).cast("date") if isinstance(last_day, str) else last_day
    days = df.select(F.date_diff(target, F.max(F.col(column)))).scalar()
    return df.withColumn(column, F.date_add(F.col(column), days))
