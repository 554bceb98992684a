"""File writers.  All of them write directories of part files, in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FORECAST_NAMES = {
    "ds": "date",
    "yhat": "forecast_sales",
    "yhat_lower": "forecast_lower_bound",
    "yhat_upper": "forecast_upper_bound",
    "item_id": "item_id",
}


def write_csv(df: DataFrame, path: str, mode: str = "error") -> str:
    df.write.mode(mode).option("header", True).csv(path)
    return path


def write_parquet(df: DataFrame, path: str, mode: str = "error") -> str:
    df.write.mode(mode).parquet(path)
    return path


def write_parquet_partitioned(
    df: DataFrame, path: str, columns: list[str], mode: str = "error", rows_per_file: int = 5_000_000
) -> str:
    """Hive-style folders by the given columns.

    Rows of one folder are brought together so that a task does not open a file in every folder.  The
    rebalance hint lets AQE split a folder holding far more rows than others over several tasks.
    """
    laid_out = df.hint("rebalance", *[F.col(c) for c in columns])
    laid_out.write.mode(mode).option("maxRecordsPerFile", rows_per_file).partitionBy(*columns).parquet(path)
    return path


def write_json_records(df: DataFrame, path: str, mode: str = "error") -> str:
    """One JSON record per line; dates and timestamps as text, NULLs kept."""
    as_text = [
        F.col(f.name).cast("string").alias(f.name)
        if f.dataType.typeName() in ("date", "timestamp", "timestamp_ntz")
        else F.col(f.name)
        for f in df.schema.fields
    ]
    df.select(*as_text).write.mode(mode).option("ignoreNullFields", False).json(path)
    return path


def forecast_rows(forecast: DataFrame) -> DataFrame:
    return forecast.select(*[F.col(old).alias(new) for old, new in FORECAST_NAMES.items()])


def write_forecast(forecast: DataFrame, path: str, mode: str = "error") -> str:
    return write_parquet(forecast_rows(forecast), path, mode)
