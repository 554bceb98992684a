"""Model inputs from categories."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.operators.ordering import number_rows

OTHER = "OTHER"


def code_table(values: DataFrame) -> DataFrame:
    """(column, value) pairs to (column, value, code): the value's 0-based place among its column's values.

    All columns are numbered by one global sort; a column's codes start at its own first number.
    """
    numbered = number_rows(values.where(F.col("value").isNotNull()).distinct(), ["column", "value"], "n")
    firsts = numbered.groupBy("column").agg(F.min("n").alias("first"))  # one row per column
    return numbered.join(firsts, "column").select("column", "value", (F.col("n") - F.col("first")).alias("code"))


def category_codes(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add code columns {name: source column}: 0-based place in sort order, -1 for NULL."""
    pairs = df.select(
        F.inline(F.array(*[F.struct(F.lit(n).alias("column"), F.col(c).cast("string").alias("value")) for n, c in columns.items()]))
    )
    codes = code_table(pairs)
    for name, column in columns.items():
        own = codes.where(F.col("column") == name).select(F.col("value").alias(f"__{name}"), F.col("code").alias(name))
        df = df.join(own, F.col(column).cast("string") == F.col(f"__{name}"), "left").drop(f"__{name}")
    return df.withColumns({name: F.coalesce(name, F.lit(-1)).cast("long") for name in columns})


def event_vocabularies(df: DataFrame, columns: list[str], k: int = 10) -> dict[str, list[str]]:
    """Per column the ``k`` most frequent values plus OTHER, sorted, from one pass over the table.

    At most k + 1 values per column reach the driver.  Ties go to the smaller value.
    """
    pairs = df.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    )
    counts = pairs.where(F.col("value").isNotNull()).groupBy("column", "value").count()
    w = Window.partitionBy("column").orderBy(F.desc("count"), "value")
    top = counts.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= k).collect()
    return {c: sorted({*(r["value"] for r in top if r["column"] == c), OTHER}) for c in columns}


def dummy_name(column: str, value: str) -> str:
    return f"{column}_" + re.sub(r"[^0-9A-Za-z]+", "_", value)


def onehot_topk(df: DataFrame, column: str, vocabulary: list[str]) -> DataFrame:
    """0/1 column per vocabulary value except the first; values outside it, and NULL, count as OTHER."""
    kept = F.when(F.col(column).isin(vocabulary), F.col(column)).otherwise(F.lit(OTHER))
    dummies = {dummy_name(column, v): (kept == v).cast("int") for v in vocabulary[1:]}
    return df.withColumns(dummies) if dummies else df


def distinct_pairs(df: DataFrame, columns: list[str], name: str, value: object) -> DataFrame:
    return df.select(*columns).distinct().withColumn(name, F.lit(value))
