"""Table maintenance and SQL access."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larder.operators.windows import dedupe_keep_last
from larder.session import checkpointed, scratch_path

# Columns and types of the application's log and item tables.
TABLES = {
    "shelf_gaps": "image string, gap_score double, notes string, created_at timestamp",
    "chat_logs": "role string, content string, created_at timestamp",
    "items": "id int, label string",
}


def replace_table(df: DataFrame, name: str, location: str | None = None) -> DataFrame:
    """Create or replace a table from a frame, and return the table."""
    writer = df.write.mode("overwrite").format("parquet")
    if location:
        writer = writer.option("path", location)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def with_created_at(rows: DataFrame) -> DataFrame:
    """Rows with ``created_at`` filled in where it is absent or NULL."""
    now = F.current_timestamp()
    given = F.coalesce(F.col("created_at"), now) if "created_at" in rows.columns else now
    return rows.withColumn("created_at", given)


def append_rows(rows: DataFrame, path: str, stamped: bool = True) -> str:
    (with_created_at(rows) if stamped else rows).write.mode("append").parquet(path)
    return path


def merge_by_key(target: DataFrame, source: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Target rows whose key the source lacks, plus the last source row of each key."""
    latest = dedupe_keep_last(source, [key], order)
    return target.join(latest, key, "left_anti").unionByName(latest.select(*target.columns))


def upsert_by_key(spark: SparkSession, name: str, source: DataFrame, key: str, order: list[Column]) -> str:
    """Replace or add rows by key in an external Parquet table.  One writer at a time.

    The merged rows go to a new folder, and only when that is complete does the table's location change.  A failure
    before that leaves the table as it was, and readers that began earlier go on reading the old folder, which stays.
    Returns the new location.
    """
    location = scratch_path(spark, name)
    merge_by_key(spark.table(name), source, key, order).write.parquet(location)
    spark.sql(f"ALTER TABLE {name} SET LOCATION '{location}'")
    spark.catalog.refreshTable(name)
    return location


BUCKET = "key_bucket"


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_buckets(df: DataFrame, path: str, key: str, buckets: int) -> str:
    """A table with one folder of files for each bucket of keys, which ``upsert_buckets`` can replace one by one.

    Every bucket is there, also where it has no rows, so that the number of buckets can be read off the folders.
    """
    spark = df.sparkSession
    keyed = df.withColumn(BUCKET, _bucket(key, buckets))
    every = spark.range(buckets).select(F.col("id").cast("int").alias(BUCKET))
    _write_buckets(keyed.withColumn("__filler", F.lit(False)).unionByName(every.withColumn("__filler", F.lit(True)), allowMissingColumns=True), path, "errorifexists")
    return path


def _write_buckets(keyed: DataFrame, path: str, mode: str) -> None:
    laid = keyed.repartition(BUCKET)
    laid.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).where("NOT __filler").drop(BUCKET, "__filler")


def upsert_buckets(spark: SparkSession, path: str, source: DataFrame, key: str, order: list[Column]) -> list[int]:
    """Replace or add rows by key in a table of ``write_buckets``; returns the buckets that were rewritten.

    Only buckets with a key of the source are read and written; the files of all others stay as they are.  The merged rows
    are checkpointed before their old files go, so a task that fails while writing does not need those again.  Keys of
    the table are expected once each.  A null key has a bucket too, and two null keys are not equal.  One writer at a time.
    """
    table = spark.read.parquet(path)
    buckets = table.select(BUCKET).distinct().count()
    latest = checkpointed(dedupe_keep_last(source, [key], order).withColumn(BUCKET, _bucket(key, buckets)))
    touched = sorted(r[0] for r in latest.select(BUCKET).distinct().collect())  # at most as many as there are buckets
    if not touched:
        return touched
    old = table.where(F.col(BUCKET).isin(touched))
    merged = old.join(latest.where(F.col(key).isNotNull()).select(key), key, "left_anti").unionByName(
        latest.withColumn("__filler", F.lit(False)).select(*old.columns)
    )
    _write_buckets(checkpointed(merged), path, "overwrite")
    return touched


def write_keyed(df: DataFrame, path: str, key: str, sort: list[str], files: int | None = None, row_group: int = 16 << 20) -> str:
    """A Parquet layout for lookups by key: files by key ranges, rows sorted in them, small row groups, Bloom filters.

    A reader with an equality on the key skips files and row groups by their smallest and largest key, and of the others
    those whose Bloom filter does not know the key.
    """
    laid = df.repartitionByRange(files, key, *sort) if files else df.repartitionByRange(key, *sort)
    writer = laid.sortWithinPartitions(key, *sort).write.option("parquet.block.size", row_group)
    writer.option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(path)
    return path


def list_ordered(items: DataFrame) -> DataFrame:
    return items.select("id", "label").orderBy("id")


def sample_first_n(df: DataFrame, order: list[str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def table_profile(df: DataFrame, name: str) -> DataFrame:
    """One row per column: type, whether NULLs are declared possible, NULLs found, and an example value.

    One pass over the table; the example is the smallest value as text.
    """
    fields = df.schema.fields
    texts = {f.name: F.col(f"`{f.name}`").cast("string") for f in fields}
    counts = [
        F.struct(
            F.count_if(texts[f.name].isNull()).alias("nulls"), F.min(texts[f.name]).alias("example")
        ).alias(f.name)
        for f in fields
    ]
    wide = df.agg(*counts)
    kinds = F.create_map(*[F.lit(x) for f in fields for x in (f.name, f.dataType.simpleString())])
    rows = wide.unpivot([], [f"`{f.name}`" for f in fields], "column_name", "found")
    return rows.select(
        F.lit(name).alias("table_name"),
        "column_name",
        kinds[F.col("column_name")].alias("data_type"),
        F.col("found.nulls").alias("nulls"),
        F.col("found.example").alias("example"),
    )


def table_samples(df: DataFrame, name: str, n: int = 3) -> DataFrame:
    """``n`` whole rows of a table, as text, the same in every run: those with the smallest hashes.

    Every task keeps its n smallest and the merge keeps n of those, so no more than that moves.
    """
    texts = [F.col(f"`{c}`").cast("string") for c in df.columns]
    written = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    rows = df.select(F.sha2(F.concat(*written), 256).alias("__hash"), F.struct(*[t.alias(c) for t, c in zip(texts, df.columns, strict=True)]).alias("__row"))
    first = rows.orderBy("__hash", "__row").limit(n)
    position = F.row_number().over(Window.orderBy("__hash", "__row"))  # n rows
    return first.select(F.lit(name).alias("table_name"), position.cast("int").alias("position"), "__row.*")


def run_sql(spark: SparkSession, query: str, tables: dict[str, DataFrame], args: dict | list | None = None) -> DataFrame:
    """A SQL query over the given frames, which the text names in braces, such as ``FROM {sales}``.

    ``:name`` or ``?`` markers take their values from ``args``.  Views of the session are neither made nor replaced.
    """
    return spark.sql(query, args=args, **tables)


def query_result(spark: SparkSession, query: str, tables: dict[str, DataFrame], args: dict | list | None = None) -> dict:
    """What a caller gets: success flag, lazy data and row count, or the error text."""
    try:
        data = run_sql(spark, query, tables, args)
        return {"success": True, "data": data, "row_count": data.count()}
    except Exception as problem:
        return {"success": False, "error": str(problem), "data": None, "row_count": 0}
