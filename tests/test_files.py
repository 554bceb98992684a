"""Readers, writers, table maintenance, tidy job."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from larder.plans.mart import build_retail_mart
from larder.plans.tidy import m5_report, m5_tidy
from larder.session import shared_folder
from larder.sources import catalog, readers, writers


def test_shared_folder_is_the_configured_one(spark):
    assert shared_folder(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")


def test_raw_strings_and_inventory_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("sku,v\n001,n/a\n002, n/a\n003,N/A\n004,\n")
    got = {r["sku"]: r["v"] for r in readers.read_raw_strings(spark, str(tmp_path / "a.csv")).collect()}
    assert got == {"001": None, "002": " n/a", "003": "N/A", "004": None}
    path = writers.write_parquet(spark.range(10), str(tmp_path / "i.parquet"))
    assert readers.read_inventory(spark, path).count() == 10


def test_json_array_and_lines(spark, tmp_path):
    (tmp_path / "i.json").write_text('[{"sku": "a", "on_hand": 1},\n {"sku": "b"}]')
    assert readers.read_json_records(spark, str(tmp_path / "i.json"), one_array=True).count() == 2
    dated = spark.createDataFrame([("a", dt.date(2024, 1, 2), None)], "k string, d date, x double")
    path = writers.write_json_records(dated, str(tmp_path / "out"))
    assert readers.read_json_records(spark, path, "k string, d string, x double").first().asDict() == {"k": "a", "d": "2024-01-02", "x": None}


def test_upsert_replaces_adds_and_keeps(spark, tmp_path):
    path = str(tmp_path / "items")
    catalog.replace_table(spark.createDataFrame([(1, "slime"), (2, "velvet")], "id int, label string"), "upserted", path)
    changes = spark.createDataFrame([(2, "old", 1), (2, "silk", 2), (3, "wool", 1)], "id int, label string, n int")
    location = catalog.upsert_by_key(spark, "upserted", changes, "id", [F.col("n")])
    rows = catalog.list_ordered(spark.table("upserted")).collect()
    assert [tuple(r) for r in rows] == [(1, "slime"), (2, "silk"), (3, "wool")]
    # The old folder is untouched, so readers of it and a failed upsert lose nothing.
    assert location != path and spark.read.parquet(path).count() == 2
    broken = changes.withColumn("label", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        catalog.upsert_by_key(spark, "upserted", broken, "id", [F.col("n")])
    assert spark.table("upserted").count() == 3
    spark.sql("DROP TABLE upserted")


def test_append_stamps_rows(spark, tmp_path):
    rows = spark.createDataFrame([("user", "hi")], "role string, content string")
    for _ in range(2):
        catalog.append_rows(rows, str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == 2 and log.where("created_at IS NULL").count() == 0


def test_sql_results_and_errors(spark):
    tables = {"t": spark.range(5)}
    spark.range(3).createOrReplaceTempView("t")
    good = catalog.query_result(spark, "SELECT * FROM {t} WHERE id > ?", tables, [2])
    assert good["success"] and good["row_count"] == 2
    assert not catalog.query_result(spark, "SELECT nope FROM {t}", tables)["success"]
    assert spark.table("t").count() == 3  # the caller's own view of that name
    spark.catalog.dropTempView("t")


def test_partitioned_write(spark, tmp_path):
    df = spark.range(100).select((F.col("id") % 3).alias("store"), "id")
    writers.write_parquet_partitioned(df, str(tmp_path / "p"), ["store"])
    assert sorted(p.name for p in (tmp_path / "p").iterdir() if p.is_dir()) == ["store=0", "store=1", "store=2"]
    assert spark.read.parquet(str(tmp_path / "p")).count() == 100


WIDE = [
    ("1", "FOODS_1", "FOODS_1", "FOODS", "S1", "TX", "1", "-2", "n/a", 1),
    ("1", "FOODS_1", "FOODS_1", "FOODS", "S1", "TX", "1,000", "3", "4", 2),
    ("2", "FOODS_2", "FOODS_1", "FOODS", "S1", "TX", "-7", "5.0", "6", 3),
]


def tidy_inputs(spark):
    wide = spark.createDataFrame(
        WIDE, "id string, item_id string, dept_id string, cat_id string, store_id string, state_id string, d_1 string, d_2 string, d_3 string, row int"
    )
    calendar = spark.createDataFrame(
        [("d_1", "2024-01-01", "w1", "1"), ("d_2", "2024-01-02", "w1", None)], "d string, date string, wm_yr_wk string, snap_CA string"
    )
    prices = spark.createDataFrame([("S1", "FOODS_1", "w1", "2.5"), ("S1", "FOODS_2", "w1", "2e7")], "store_id string, item_id string, wm_yr_wk string, sell_price string")
    return wide, calendar, prices


def test_tidy_rows_and_report(spark):
    wide, calendar, prices = tidy_inputs(spark)
    rows = {(r["item_id"], r["d"]): r for r in m5_tidy(wide, calendar, prices, [F.col("row")]).collect()}
    assert len(rows) == 6
    first = rows["FOODS_1", "d_1"]
    assert (first["sold_qty"], first["sell_price"], first["revenue"], first["date"]) == (1000, 2.5, 2500.0, dt.date(2024, 1, 1))
    assert rows["FOODS_2", "d_1"]["sold_qty"] is None and rows["FOODS_2", "d_2"]["sell_price"] is None
    assert rows["FOODS_1", "d_3"]["date"] is None and rows["FOODS_1", "d_3"]["sold_qty"] == 4
    report = {r["metric"]: r["value"] for r in m5_report(wide, calendar, prices, [F.col("row")]).collect()}
    assert (report["initial_rows_wide"], report["final_rows_long"], report["duplicates_removed"]) == (3, 6, 3)
    assert (report["out_of_bounds_qty"], report["out_of_bounds_price"], report["null_date"]) == (1, 2, 2)


def test_tidy_rejects_an_ambiguous_calendar(spark):
    wide, calendar, prices = tidy_inputs(spark)
    with pytest.raises(Exception, match="many-to-one"):
        m5_tidy(wide, calendar.unionByName(calendar), prices, [F.col("row")]).collect()


def test_retail_mart(spark):
    wide = spark.createDataFrame([("A", "S1", 5, 1), ("A", "S2", 1, 0), ("B", "S1", 9, 9), ("C", "S1", 0, 1)], "item_id string, store_id string, d_1 int, d_2 int")
    calendar = spark.createDataFrame([("d_1", dt.date(2024, 1, 1)), ("d_2", dt.date(2024, 1, 2))], "d string, date date")
    prices = spark.createDataFrame([("A", 2.0), ("A", 4.0), ("B", 1.0)], "item_id string, sell_price double")
    names = spark.createDataFrame([(k, k.lower()) for k in "ABC"], "item_id string, description string")
    mart = build_retail_mart(wide, calendar, prices, names, top_n=2, exclude=["B"], last_day="2025-01-02")
    assert sorted((str(r["date"]), r["sale"]) for r in mart["sales"].collect()) == [("2025-01-01", 6), ("2025-01-02", 1)]
    assert mart["inv"].first()["unit"] == 12
    assert mart["item_dim"].first().asDict() == {"item_id": "A", "description": "a", "price": 3.0, "lead_time": 3, "holding_cost": 0.5}


def test_sales_without_keys_keep_all_rows(spark):
    from larder.plans.tidy import long_sales

    wide = spark.createDataFrame([("a", 1, 2, 1), ("b", 3, 4, 2)], "id string, d_1 int, d_2 int, row int")
    assert long_sales(wide, [F.col("row")]).count() == 4
    with pytest.raises(ValueError, match="order"):
        long_sales(wide, [])


def files_of(path, bucket):
    import glob

    return {(f, __import__("os").path.getmtime(f)) for f in glob.glob(f"{path}/{catalog.BUCKET}={bucket}/*.parquet")}


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "items")
    rows = [(i, f"old {i}") for i in range(40)] + [(None, "no key")]
    catalog.write_buckets(spark.createDataFrame(rows, "id long, label string"), path, "id", buckets=8)
    before = {b: files_of(path, b) for b in range(8)}
    assert all(before.values())
    changes = spark.createDataFrame([(3, "older", 1), (3, "new 3", 2), (100, "new 100", 1)], "id long, label string, n int")
    touched = catalog.upsert_buckets(spark, path, changes, "id", [F.col("n")])
    assert 1 <= len(touched) <= 2
    for b in range(8):
        assert (files_of(path, b) == before[b]) == (b not in touched)
    got = {r["id"]: r["label"] for r in catalog.read_buckets(spark, path).collect()}
    assert got == {i: f"old {i}" for i in range(40)} | {3: "new 3", 100: "new 100", None: "no key"}
    assert catalog.upsert_buckets(spark, path, changes.limit(0), "id", [F.col("n")]) == []
    assert catalog.read_buckets(spark, path).count() == 42


def test_keyed_layout_is_read_in_part(spark, tmp_path):
    history = spark.range(100_000).selectExpr("concat('k', id % 1000) AS sku", "id AS day", "id * 2 AS demand")
    path = catalog.write_keyed(history, str(tmp_path / "keyed"), "sku", ["day"], files=10)
    found = spark.read.parquet(path).where("sku = 'k500'")
    assert sorted(r["day"] for r in found.collect()) == list(range(500, 100_000, 1000))
    leaf = found._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert leaf.metrics().apply("numOutputRows").value() < 25_000
    absent = spark.read.parquet(path).where("sku = 'k500x'")  # within the range of a file, but not in its Bloom filter
    assert absent.collect() == []
    leaf = absent._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert leaf.metrics().apply("numOutputRows").value() == 0


def test_samples_are_whole_rows_and_the_same_again(spark):
    df = spark.createDataFrame([(i, None if i % 3 else "x", float(i)) for i in range(50)], "a long, `b c` string, d double")
    first = catalog.table_samples(df.repartition(3), "t").collect()
    assert first == catalog.table_samples(df.repartition(7), "t").collect() and len(first) == 3
    rows = {tuple(None if v is None else str(v) for v in r) for r in df.collect()}
    assert all((r["a"], r["b c"], r["d"]) in rows for r in first)
    assert catalog.table_samples(df.limit(0), "t").collect() == []
