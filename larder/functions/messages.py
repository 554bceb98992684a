"""What a chat message asks for: topic flags, item, horizon and chart kind, as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.functions.paths import SKU_MENTION

# Words whose presence (as lower-case substrings) marks each kind of request.
ALLOWED_WORDS = [
    "inventory", "stock", "stocks", "in stock", "out of stock", "availability", "available",
    "quantity", "quantities", "units", "sku", "skus", "restock", "re-stock", "backorder", "back-ordered",
    "timeline", "timelines", "schedule", "schedules", "deadline", "deadlines", "milestone", "milestones",
    "ETA", "ETAs", "when", "date", "dates", "roadmap", "release", "ship", "shipping", "deliver", "delivery",
    "forecast", "forecasts", "predict", "prediction", "predictions", "projection", "projections", "outlook",
    "trend", "trends", "demand", "supply", "price forecast", "capacity",
]
SUMMARY_WORDS = ["summary", "overview", "snapshot", "status"]
REORDER_WORDS = ["reorder plan", "reorder", "restock plan", "restock"]
FORECAST_WORDS = [
    "forecast", "predict", "projection", "future", "predict sales", "forecast sales", "sales projection",
    "future sales", "predict demand", "demand forecast", "sales forecast", "trend forecast", "next month",
    "next week", "coming days", "upcoming", "prophet", "prediction",
]
CHART_WORDS = [
    "plot", "chart", "graph", "visualize", "show", "display", "draw", "trend", "over time", "historical",
    "sales over", "monthly", "daily", "weekly", "yearly", "compare", "comparison", "distribution", "pattern",
    "pie", "bar", "line", "scatter", "time-series", "time series", "histogram", "box plot", "heatmap",
    "correlation", "regression", "forecast",
]
INVENTORY_WORDS = ["days of cover", "coverage", "inventory", "stock level", "reorder point"]
MULTI_ITEM_WORDS = [
    "which items need to be ordered", "reorder priority", "order soon", "reorder list", "who needs ordering",
]
FOLLOW_UP_WORDS = ["this", "that", "it", "them", "those", "previous", "last", "above"]
SAVE_WORDS = ["save", "export", "parquet", "file"]
PLOT_WORDS = ["plot", "chart", "graph", "visualize", "show"]

# Product names and the item each stands for, in order of precedence.  A bare "strawberry"
# is recognised but stands for no item.
PRODUCT_ITEMS = {
    "vanilla ice cream": "FOODS_3_090",
    "chocolate ice cream": "FOODS_3_282",
    "strawberry": None,
    "milk": "FOODS_3_586",
    "yogurt": "FOODS_3_555",
    "apple": "FOODS_3_252",
    "banana": "FOODS_3_226",
    "cheese": "FOODS_3_714",
    "orange juice": "FOODS_3_681",
}
ITEM_CODE = r"(FOODS_\d+_\d+)"

# Fixed value: how a message asks for a shelf picture to be checked.
GAP_REQUEST = r"(?i)\bgap\s*(?:detect|detection)\s+(.+)$"

# Chart kinds and the words that pick them, in order of precedence.
CHART_KINDS = [
    ("Pie Chart", ["pie"]),
    ("Bar Chart", ["bar", "column"]),
    ("Line Chart", ["line", "trend", "time"]),
    ("Scatter Plot", ["scatter", "correlation"]),
    ("Histogram", ["histogram", "distribution"]),
    ("Heatmap", ["heatmap"]),
]
OTHER_CHART = "Custom Chart"

# Kinds of analysis a question asks for and the words that mark them, in order of precedence.
INTENT_CLASSES = [
    ("trend", ["show trends", "over time", "change", "trend"]),
    ("comparison", ["compare", "vs", "versus"]),
    ("forecast", ["forecast", "predict", "future"]),
    ("analysis", ["analyze", "why", "relationship"]),
    ("summary", ["summary", "overview", "total"]),
]
TIME_FRAME = r"\b(last|next|this)\s+(day|week|month|quarter|year)\b"

DEFAULT_HORIZON = 30


def mentions_any(lowered: Column, words: list[str]) -> Column:
    """True if any word occurs as a substring of the lower-cased text.

    A word that contains another listed word adds nothing and is not searched for; neither is a word with
    capitals, which lower-cased text cannot contain.
    """
    small = [w for w in words if w == w.lower()]
    needed = [w for w in small if not any(v != w and v in w for v in small)]
    return reduce(or_, [lowered.contains(w) for w in needed])


def intent_flags(text: Column) -> dict[str, Column]:
    low = F.lower(text)
    has_sku = text.rlike(SKU_MENTION)
    flags = {
        "is_allowed": mentions_any(low, ALLOWED_WORDS),
        "wants_summary": mentions_any(low, SUMMARY_WORDS),
        "wants_reorder": mentions_any(low, REORDER_WORDS) & ~has_sku,
        "wants_forecast": mentions_any(low, FORECAST_WORDS),
        "wants_chart": mentions_any(low, CHART_WORDS),
        "about_inventory": mentions_any(low, INVENTORY_WORDS),
        "multi_item_reorder": mentions_any(low, MULTI_ITEM_WORDS),
        "is_follow_up": mentions_any(low, FOLLOW_UP_WORDS),
        "wants_save": mentions_any(low, SAVE_WORDS),
        "wants_plot": mentions_any(low, PLOT_WORDS),
        "gap_request": text.rlike(GAP_REQUEST),
    }
    return {name: F.coalesce(flag, F.lit(False)) for name, flag in flags.items()}


def _word_in(lowered: Column, words: list[str]) -> Column:
    """Whether any of the words or phrases stands in the text by itself, not as part of a longer word to its left."""
    return lowered.rlike(r"\b(?:" + "|".join(words) + ")")


def intent_class(text: Column) -> Column:
    """The first kind of analysis that the text has a word of, else "other"."""
    low = F.coalesce(F.lower(text), F.lit(""))
    picked = None
    for kind, words in INTENT_CLASSES:
        test = _word_in(low, words)
        picked = F.when(test, kind) if picked is None else picked.when(test, kind)
    return picked.otherwise("other")


def time_frame(text: Column) -> Column:
    """The first relative time frame, such as "last month", in lower case with one space; NULL without one."""
    low = F.lower(text)
    parts = F.concat_ws(" ", F.regexp_extract(low, TIME_FRAME, 1), F.regexp_extract(low, TIME_FRAME, 2))
    return F.when(low.rlike(TIME_FRAME), parts)


def item_from_text(text: Column) -> Column:
    """Item code written in the text (any case), else the item of the first known product name, else NULL."""
    low = F.lower(text)
    code = F.regexp_extract(F.upper(text), ITEM_CODE, 1)
    picked = F.when(code != "", code)
    for name, item in PRODUCT_ITEMS.items():
        picked = picked.when(low.contains(name), F.lit(item).cast("string"))
    return picked


# How a span of days is written, tried in this order, and how many days the unit or phrase stands for.
SPANS = [(r"(\d+)\s*days?", 1), (r"(\d+)\s*weeks?", 7), (r"(\d+)\s*months?", 30)]
NEXT_SPANS = [(r"next\s+week", 7), (r"next\s+month", 30)]


def horizon_from_text(text: Column, default: int = DEFAULT_HORIZON) -> Column:
    """Days ahead: "N days", "N weeks" x 7, "N months" x 30, "next week", "next month", else the default."""
    low = F.lower(text)
    picked = F
    for pattern, days in SPANS:
        picked = picked.when(low.rlike(pattern), F.regexp_extract(low, pattern, 1).try_cast("long") * days)
    for pattern, days in NEXT_SPANS:
        picked = picked.when(low.rlike(pattern), F.lit(days).cast("long"))
    return picked.otherwise(F.lit(default).cast("long"))


def chart_type(text: Column) -> Column:
    low = F.lower(text)
    picked = None
    for kind, words in CHART_KINDS:
        test = mentions_any(low, words)
        picked = F.when(test, kind) if picked is None else picked.when(test, kind)
    return picked.otherwise(OTHER_CHART)
