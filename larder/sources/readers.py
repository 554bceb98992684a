"""File readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.functions.cleaning import missing_to_null
from larder.functions.paths import IMAGE_ENDINGS, file_ending
from larder.operators.headers import snake_headers


def read_inventory(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet by its ending, anything else as CSV with a header.

    Give ``schema`` for large CSV input: without it Spark reads the data once more to infer types.
    """
    if path.lower().rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_raw_strings(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """CSV with every column as text; the missing-value spellings become NULL."""
    raw = spark.read.option("header", True).option("multiLine", False).csv(path, inferSchema=False)
    return raw.select(*[missing_to_null(F.col(f"`{c}`")).alias(c) for c in raw.columns])


def read_m5(
    spark: SparkSession, sales: str, calendar: str, prices: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Wide sales, calendar and prices as text columns with snake-case headers."""
    return tuple(snake_headers(read_raw_strings(spark, p)) for p in (sales, calendar, prices))


def read_json_records(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, one_array: bool = False
) -> DataFrame:
    """JSON records: one per line (splittable), or with ``one_array`` a file holding one array of them."""
    reader = spark.read.option("multiLine", one_array)
    return (reader.schema(schema) if schema else reader).json(path)


def scan_images(spark: SparkSession, folder: str) -> DataFrame:
    """Every image below the folder: path, modificationTime, length, content.

    Content is read only if the plan uses it, so listing alone touches no file bodies.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.where(file_ending(F.col("path")).isin(IMAGE_ENDINGS))
