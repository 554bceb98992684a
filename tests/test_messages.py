import pytest
from pyspark.sql import functions as F

from larder.functions import messages as M
from larder.functions.paths import sku_from_path, sku_from_text
from larder.plans.dialogue import recent_messages


def one(spark, text, *columns):
    return spark.createDataFrame([(text,)], "t string").select(*columns).first()


@pytest.mark.parametrize(
    "text, item, days, chart",
    [
        ("forecast foods_3_090 for 14 days", "FOODS_3_090", 14, "Custom Chart"),
        ("Vanilla ice cream next week, as a bar", "FOODS_3_090", 7, "Bar Chart"),
        ("milk for 2 weeks over time", "FOODS_3_586", 14, "Line Chart"),
        ("strawberry milk in 3 months, pie", None, 90, "Pie Chart"),
        ("next  month correlation", None, 30, "Scatter Plot"),
        ("distribution", None, 30, "Histogram"),
    ],
)
def test_item_horizon_and_chart(spark, text, item, days, chart):
    c = F.col("t")
    assert tuple(one(spark, text, M.item_from_text(c), M.horizon_from_text(c), M.chart_type(c))) == (item, days, chart)


def test_flags(spark):
    def flags(text):
        return one(spark, text, *[c.alias(n) for n, c in M.intent_flags(F.col("t")).items()]).asDict()

    asked = flags("Show stock status and reorder plan, export it")
    assert all(asked[k] for k in ("is_allowed", "wants_summary", "wants_reorder", "wants_save", "wants_plot", "is_follow_up"))
    assert not flags("reorder sku: A-1")["wants_reorder"]
    assert flags("Which items need to be ordered?")["multi_item_reorder"]
    assert flags("gap detect a.jpg")["gap_request"]
    assert not any(flags("Bonjour")[k] for k in ("is_allowed", "wants_forecast", "wants_chart"))
    # Capitals in the word list never match, as the text is lower-cased first.
    assert not flags("ETA?")["is_allowed"]


def test_pruned_words_find_the_same(spark):
    texts = ["restocking", "out of stock", "price forecasts", "backorders", "whenever", "none"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", M.mentions_any(F.lower("t"), M.ALLOWED_WORDS).alias("f")).collect()
    assert {r["t"]: r["f"] for r in got} == {t: any(w in t for w in M.ALLOWED_WORDS) for t in texts}


def test_codes_in_paths_and_text(spark):
    assert one(spark, "/x/y/AB-1_z (2).tar.png", sku_from_path("t"))[0] == "AB-1_z"
    assert one(spark, "/x/(none).png", sku_from_path("t"))[0] == ""
    assert one(spark, "/x/shot12345.png", sku_from_path("t", r"\d{5}"))[0] == "12345"
    assert one(spark, "where is SKU # A-1?", sku_from_text("t"))[0] == "A-1"
    assert one(spark, "nothing", sku_from_text("t"))[0] is None


def test_recent_context(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"m{i} " + "x" * 200) for i in range(9)]
    rows += [(1, 9, "assistant", "Intro KEY FINDINGS\nmilk sells BUSINESS RECOMMENDATIONS buy"), (2, 0, "user", "alone")]
    got = recent_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, content string")).collect()
    assert [r["conv_id"] for r in got] == [1]
    lines = got[0]["context"].split("\n")
    assert lines[0].startswith("User: m4 ") and len(lines[0]) == len("User: ") + 100 + 3
    assert got[0]["context"].count("...") == 6 and "AI found: " in got[0]["context"] and "buy" not in got[0]["context"]
