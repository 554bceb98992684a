"""Inventory cleaning (bad numbers become 0) and export cleaning (bad numbers become NULL)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions import cleaning as C
from larder.functions import stock
from larder.functions.calendar import day_number
from larder.operators import headers
from larder.operators.filters import drop_missing_keys
from larder.operators.quality import bounds_columns, dq_report
from larder.operators.windows import dedupe_keep_last, rolling_mean_min1
from larder.session import spread

DEFAULT_LEAD_TIME = 7.0
ROLLING_ROWS = 7


def derive_missing(df: DataFrame, tiebreak: list[Column] | None = None) -> DataFrame:
    """Fill in absent canonical columns from what is there.

    Daily sales come from a 7-row mean of ``sold_qty`` per sku, ordered by ``date`` or by the number in
    ``d``; without a sku from the overall mean; without ``sold_qty`` they are 0.  ``tiebreak`` orders rows
    of one sku and day; it is required where there is neither ``date`` nor ``d``, because a table has no row order.
    """
    missing = [c for c in headers.CANONICAL if c not in df.columns]
    added: dict[str, Column] = {}
    if "sku" in df.columns:
        df = df.withColumn("sku", F.trim(F.col("sku").cast("string")))
        if "product_name" in missing:
            added["product_name"] = F.col("sku")
    for units in ("stockroom_units", "shelf_units"):
        if units in missing:
            added[units] = F.lit(0.0)
    if "lead_time_days" in missing:
        added["lead_time_days"] = F.lit(DEFAULT_LEAD_TIME)
    df = df.withColumns(added) if added else df
    if "on_hand" in missing:
        parts = [
            F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) for c in ("stockroom_units", "shelf_units")
        ]
        df = df.withColumn("on_hand", parts[0] + parts[1])
    if "avg_daily_sales" in missing:
        df = _derive_daily_sales(df, tiebreak or [])
    return df


def _derive_daily_sales(df: DataFrame, tiebreak: list[Column]) -> DataFrame:
    if "sold_qty" not in df.columns:
        return df.withColumn("avg_daily_sales", F.lit(0.0))
    df = df.withColumn("sold_qty", C.coerce_or_zero("sold_qty", df.schema["sold_qty"].dataType.typeName()))
    if "sku" not in df.columns:
        return df.withColumn("avg_daily_sales", df.select(F.avg("sold_qty")).scalar())
    order: list[Column] = []
    if "date" in df.columns:
        if df.schema["date"].dataType.typeName() == "string":
            df = df.withColumn("date", C.parse_date_any("date"))
        order = [F.col("date").asc_nulls_last()]
    elif "d" in df.columns:
        order = [day_number("d").asc_nulls_last(), F.col("d")]
    order += tiebreak
    if not order:
        raise ValueError("daily sales need a row order: a date or d column, or tiebreak")
    return rolling_mean_min1(df, ["sku"], order, "sold_qty", "avg_daily_sales", ROLLING_ROWS)


def clean_inventory(
    df: DataFrame,
    shelf_low: float = stock.SHELF_LOW,
    add_safety_stock: bool = True,
    safety_stock: float = stock.DEFAULT_SAFETY_STOCK,
    ordered: bool = True,
    tiebreak: list[Column] | None = None,
    spellings: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Any inventory upload to the canonical table with cover, restock flag and safety stock.

    ``spellings`` maps canonical columns to further headers, beside those of ``HEADER_SPELLINGS``.

    One narrow projection over the scan, unless daily sales have to be derived (one window).
    """
    df, _ = headers.alias_headers(df, spellings)
    df = headers.require_columns(derive_missing(df, tiebreak), headers.CANONICAL)
    kinds = {c: df.schema[c].dataType.typeName() for c in headers.NUMERIC}
    df = df.withColumns(
        {
            "sku": F.trim(F.col("sku").cast("string")),
            "product_name": F.trim(F.col("product_name").cast("string")),
            **{c: C.coerce_or_zero(c, kinds[c]) for c in headers.NUMERIC},
        }
    )
    added = {
        "days_of_cover": stock.days_of_cover(F.col("on_hand"), F.col("avg_daily_sales")),
        "restock_needed": stock.restock_flag(F.col("shelf_units"), F.col("stockroom_units"), shelf_low),
    }
    if add_safety_stock and "safety_stock" not in df.columns:
        added["safety_stock"] = F.lit(float(safety_stock))
    df = df.withColumns(added)
    df = df.withColumns({c: stock.clip_nonneg(F.col(c)) for c in [*headers.NUMERIC, "days_of_cover"]})
    return headers.order_columns(df, headers.CANONICAL + headers.DERIVED) if ordered else df


@dataclass
class ExportLayout:
    """Which export columns are keys, dates, whole numbers and decimals."""

    keys: list[str] = field(default_factory=lambda: ["sku", "location_id"])
    dates: list[str] = field(default_factory=lambda: ["received_at", "expires_at", "last_counted_at"])
    integers: list[str] = field(default_factory=lambda: ["qty_on_hand", "reorder_point"])
    decimals: list[str] = field(default_factory=lambda: ["unit_cost", "unit_price"])
    quantity: str = "qty_on_hand"
    prices: tuple[str, ...] = ("unit_cost", "unit_price", "price")


def type_export(df: DataFrame, layout: ExportLayout, columns: list[str] | None = None) -> DataFrame:
    """Text, numbers, dates, product codes and units of the given columns (all by default)."""
    chosen = df.columns if columns is None else columns
    texts = {f.name for f in df.schema.fields if f.dataType.typeName() == "string"}
    df = df.withColumns({c: C.clean_text(c) for c in chosen if c in texts})
    typed: dict[str, Column] = {}
    typed |= {c: C.coerce_int(c) for c in layout.integers if c in chosen}
    typed |= {c: C.coerce_float(c) for c in layout.decimals if c in chosen}
    typed |= {c: C.parse_date_any(c) for c in layout.dates if c in chosen and c in texts}
    if "sku" in chosen:
        typed["sku"] = C.normalize_sku("sku")
    if "uom" in chosen:
        typed["uom"] = C.normalize_uom("uom")
    return df.withColumns(typed)


def _keyed(df: DataFrame, layout: ExportLayout) -> tuple[DataFrame, list[str]]:
    df = headers.snake_headers(df)
    keys = [k for k in layout.keys if k in df.columns]
    return type_export(df, layout, keys), keys


def _finish_export(keyed: DataFrame, keys: list[str], layout: ExportLayout, order: list[str]) -> DataFrame:
    """Drop rows without key and earlier duplicates, then clean the other columns of what is left.

    Which rows stay depends on the key columns only, so the costly cleaning runs once per surviving row,
    after the shuffle.
    """
    kept = drop_missing_keys(keyed, keys)
    if keys:
        kept = dedupe_keep_last(kept, keys, [F.col(headers.snake_name(c)) for c in order])
    typed = type_export(kept, layout, [c for c in kept.columns if c not in keys])
    return bounds_columns(typed, layout.quantity, price_column(typed, layout))


def price_column(df: DataFrame, layout: ExportLayout) -> str | None:
    """The range rule looks at one price column only, the first that exists."""
    return next((p for p in layout.prices if p in df.columns), None)


def clean_export(df: DataFrame, order: list[str], layout: ExportLayout | None = None) -> DataFrame:
    """Clean a generic export.  ``order`` names the columns giving row order, for keep-last."""
    layout = layout or ExportLayout()
    keyed, keys = _keyed(spread(df), layout)
    return _finish_export(keyed, keys, layout, order).drop("__bad_quantity", "__bad_price")


def export_report(df: DataFrame, order: list[str], layout: ExportLayout | None = None) -> DataFrame:
    """The data-quality report of the same cleaning, from one scan.

    One aggregate keeps the last row of each key and counts the others; rows without key are groups of it too, so nothing
    has to be counted before they are dropped.
    """
    layout = layout or ExportLayout()
    keyed, keys = _keyed(spread(df), layout)
    columns = keyed.columns
    if keys:
        last = F.max_by(F.struct(*columns), F.struct(*[F.col(headers.snake_name(c)) for c in order]))
        counted = keyed.groupBy(*[F.col(k).alias(f"__key_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("__rows"), last.alias("__last"))
        counted = counted.select("__rows", "__last.*")
    else:
        counted = keyed.withColumn("__rows", F.lit(1).cast("long"))
    typed = type_export(counted, layout, [c for c in columns if c not in keys])
    return dq_report(bounds_columns(typed, layout.quantity, price_column(typed, layout)), keys)
