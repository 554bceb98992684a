"""Ordering, windows, joins and encoders on small frames."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from larder.operators import aggregates, encode, filters, joins, ranking
from larder.operators import windows as W
from larder.operators.ordering import exact_median, number_rows


def test_number_rows_is_global(spark):
    values = [f"v{i:04d}" for i in range(500)]
    random.Random(1).shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(7)
    got = number_rows(df, ["v"], "n", start=1).collect()
    assert {r["v"]: r["n"] for r in got} == {v: i for i, v in enumerate(sorted(values), 1)}


@pytest.mark.parametrize("size", [1, 2, 99, 100])
def test_exact_median(spark, size):
    values = [float(random.Random(size).randrange(20)) + i % 3 for i in range(size)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v double").repartition(5)
    assert exact_median(df, "v") == statistics.median(values)


def test_median_of_nothing(spark):
    assert exact_median(spark.createDataFrame([(None,)], "v double"), "v") is None


@pytest.mark.parametrize("block_rows", [10, 64, 10_000])
def test_hot_series_is_cut_into_blocks_without_changing_results(spark, block_rows):
    rng = random.Random(3)
    rows = [("hot", i, float(rng.randrange(50))) for i in range(400)] + [(f"k{i % 5}", i, 1.0 * i) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, i int, v double").repartition(6)
    got = W.rolling_mean_min1(df, ["k"], ["i"], "v", "m", 7, block_rows).collect()
    assert len(got) == len(rows)
    for key in {r[0] for r in rows}:
        series = sorted((i, v) for k, i, v in rows if k == key)
        means = {r["i"]: r["m"] for r in got if r["k"] == key}
        for at, (i, _) in enumerate(series):
            frame = [v for _, v in series[max(0, at - 6) : at + 1]]
            assert means[i] == pytest.approx(sum(frame) / len(frame))


def test_hot_group_of_copies_is_split(spark):
    df = spark.range(300).select(F.lit("hot").alias("k"), F.lit(1).alias("i"), F.lit(2.0).alias("v"))
    got = W.rolling_mean_min1(df, ["k"], ["i"], "v", "m", 7, 20)
    assert [r["m"] for r in got.collect()] == [2.0] * 300
    with pytest.raises(ValueError, match="order"):
        W.rolling_mean_min1(df, ["k"], [], "v", "m")


def test_rows_that_tie_follow_their_other_columns(spark):
    rows = [("a", 1, float(v), f"x{v}") for v in (9, 1, 5)]
    for parts in (1, 3):
        df = spark.createDataFrame(rows, "k string, i int, v double, name string").repartition(parts)
        got = W.rolling_mean_min1(df, ["k"], ["i"], "v", "m", 7).collect()
        assert {r["name"]: r["m"] for r in got} == {"x1": 1.0, "x5": 3.0, "x9": 5.0}


def test_keep_last_prefilters_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    kept = W.dedupe_keep_last(df, ["k"], [F.col("id")])
    assert sorted(r["id"] for r in kept.collect()) == [97, 98, 99]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "row_number(), 1, Partial" in plan
    assert W.dedupe_keep_last(kept, ["k"], [F.col("id")]).count() == 3


def test_past_means_and_fill(spark):
    rows = [("a", i, None if i < 2 or i == 5 else float(i)) for i in range(9)]
    df = spark.createDataFrame(rows, "k string, i int, v double")
    w = W.series_window(["k"], ["i"])
    filled = df.withColumn("f", W.fill_forward_back(w, "v")).orderBy("i").collect()
    assert [r["f"] for r in filled] == [2.0, 2.0, 2.0, 3.0, 4.0, 4.0, 6.0, 7.0, 8.0]
    means = W.add_past_means(df, w, "v", [2], "v").orderBy("i").collect()
    assert [r["v_rmean_2"] for r in means] == [None, None, None, None, 2.5, 3.5, None, None, 6.5]


def test_many_to_one_is_enforced(spark):
    facts = spark.createDataFrame([("a", 1), ("b", 2)], "d string, x int")
    good = spark.createDataFrame([("a", 5)], "d string, y int")
    assert joins.join_calendar(facts, good).count() == 2
    bad = spark.createDataFrame([("a", 5), ("a", 6)], "d string, y int")
    joined = joins.join_calendar(facts, bad)
    for result in (joined, joined.select("x"), joined.select("d", "x"), joined.select("y"), joined.agg(F.count(F.lit(1)))):
        with pytest.raises(Exception, match="many-to-one"):
            result.collect()
    with pytest.raises(Exception, match="many-to-one"):
        joined.count()


def test_insights_refuse_repeated_items(spark):
    forecast = spark.createDataFrame([("a", 5.0), ("a", 5.0)], "item_id string, yhat double")
    inv = spark.createDataFrame([("a", 3.0)], "item_id string, unit double")
    items = spark.createDataFrame([("a", "thing", 1.0, 3, 0.5)], "item_id string, description string, price double, lead_time int, holding_cost double")
    assert joins.join_inventory_forecast(forecast, inv, items).count() == 2
    for one, two in ((inv.union(inv), items), (inv, items.union(items))):
        with pytest.raises(Exception, match="many-to-one"):
            joins.join_inventory_forecast(forecast, one, two).agg(F.sum("yhat")).collect()


def test_gap_fill_covers_every_day(spark):
    df = spark.sql("SELECT * FROM VALUES ('a', DATE'2024-02-27', 3D), ('a', DATE'2024-03-02', 1D), ('b', DATE'2024-01-01', 2D) AS t(k, date, sale)")
    got = joins.gap_fill(df, ["k"]).orderBy("k", "date").collect()
    assert [r["sale"] for r in got] == [3.0, 0.0, 0.0, 0.0, 1.0, 2.0]
    assert [str(r["date"]) for r in got][:5] == ["2024-02-27", "2024-02-28", "2024-02-29", "2024-03-01", "2024-03-02"]


def test_codes_and_dummies(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",), ("b",)], "v string")
    codes = encode.category_codes(df, {"code": "v"})
    assert {r["v"]: r["code"] for r in codes.collect()} == {"a": 0, "b": 1, "c": 2, None: -1}
    words = encode.event_vocabularies(df, ["v"], 2)["v"]
    assert words == ["OTHER", "a", "b"]
    hot = encode.onehot_topk(df, "v", words)
    assert {(r["v"], r["v_a"], r["v_b"]) for r in hot.collect()} == {("b", 0, 1), ("a", 1, 0), (None, 0, 0), ("c", 0, 0)}


def test_histogram_edges(spark):
    df = spark.range(0, 101).select(F.col("id").cast("double").alias("v"))
    bins = aggregates.histogram_bins(df, "v").orderBy("bin").collect()
    assert [b["n"] for b in bins] == [5] * 19 + [6] and (bins[0]["left_edge"], bins[-1]["right_edge"]) == (0.0, 100.0)
    assert [b["n"] for b in aggregates.histogram_bins(df, "v", 4).orderBy("bin").collect()] == [25, 25, 25, 26]
    flat = aggregates.histogram_bins(spark.createDataFrame([(4.0,)] * 4, "v double"), "v").orderBy("bin").collect()
    assert [(b["left_edge"], b["n"]) for b in flat] == [(3.5, 0), (4.0, 4)]


def test_chart_top10_shows_the_largest(spark):
    for n in (5, 20, 21):
        rows = spark.range(n).select(F.col("id").cast("string").alias("c"), "id")
        got = sorted(r["id"] for r in ranking.chart_top10(rows, "c", "id").collect())
        assert got == list(range(max(0, n - 10), n))
    assert ranking.chart_top10(rows, "c", "id", 21).count() == 21


def test_lookup_prefers_exact(spark):
    schema = "sku string, on_hand double, shelf_units double, stockroom_units double, avg_daily_sales double, lead_time_days double"
    df = spark.createDataFrame([("A-17", 9.0, 1.0, 8.0, 2.0, 3.0), ("a17", 4.0, 1.0, 3.0, 0.0, 3.0)], schema)
    assert filters.lookup_sku(df, "A17").first()["sku"] == "a17"
    assert filters.lookup_sku(df, "17").first()["days_cover"] == 4.5
    assert filters.lookup_sku(df, "zz").count() == 0


def test_last_n_days_keeps_both_ends(spark):
    df = spark.sql("SELECT explode(sequence(DATE'2024-01-01', DATE'2024-12-31')) AS date")
    assert filters.last_n_days(df, 90).count() == 91
