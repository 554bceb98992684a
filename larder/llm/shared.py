"""Helpers of the operators: reading tables, checkpoints, and a membership filter of fixed size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.session import checkpointed

FILTER_BITS = 1 << 23


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """The rows written to the shared checkpoint folder, so that they are computed once and outlive executors."""
    return checkpointed(df)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that was written for a later step and has been read by it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def remainder(doc_id: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % divisor


def hash_bitmap(df: DataFrame, key: str, bits: int = FILTER_BITS) -> np.ndarray:
    """One bit for each value of a long column modulo ``bits``, as bytes: at most bits / 8 of them (1 MB) whatever
    the input.  A filter before an exact join: with many keys it fills up and lets more rows pass, never fewer."""
    slot = F.pmod(F.col(key), F.lit(bits))
    words = (
        df.select(slot.alias("slot"))
        .groupBy(F.shiftright("slot", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("mask"))
        .collect()
    )
    out = np.zeros(bits // 64, np.int64)
    for word, mask in words:
        out[word] = mask
    return out.view(np.uint8)


def in_bitmap(keys: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Which of the 64-bit keys may be in the filter."""
    slots = keys.astype(np.uint64) & np.uint64(len(bitmap) * 8 - 1)
    return (bitmap[(slots >> np.uint64(3)).astype(np.int64)] >> (slots & np.uint64(7)).astype(np.uint8)) & 1 == 1


HEAVY_SHARE = 1000


def join_counted(rows: DataFrame, counted: DataFrame, key: str, n: str) -> DataFrame:
    """Inner join with a table that says for each key, in column ``n``, how many rows of ``rows`` have it.

    Keys with more than one in HEAVY_SHARE of all counted rows, so fewer than HEAVY_SHARE keys, are joined by broadcast:
    their rows stay where they are.  What is shuffled has no hot key left.
    """
    total = counted.agg(F.sum(n)).first()[0] or 0
    large = F.col(n) * HEAVY_SHARE > total
    heavy = F.broadcast(counted.where(large))
    light = rows.join(F.broadcast(counted.where(large).select(key)), key, "left_anti").join(counted.where(~large), key)
    return rows.join(heavy, key).unionByName(light)


def with_fields(df: DataFrame, *fields: tuple[str, T.DataType]) -> T.StructType:
    """The schema of a table with further columns."""
    return T.StructType([*df.schema.fields, *(T.StructField(name, kind) for name, kind in fields)])
