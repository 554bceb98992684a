"""Demand forecast per item: linear trend plus a weekly pattern, with an 80 % band.

The model is least squares on the gap-filled daily series (days without sales count as 0), then the mean
residual of each weekday, then a band of 1.28 residual standard deviations.  All of it follows from a few
sums per item: zeros add nothing to sums of y, and how many days of each weekday a span holds is
arithmetic.  So the zero days are never materialised, one partial aggregate per item does the fit, and a hot
item costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.cleaning import once

BAND_Z = 1.2815515655446004  # 10th and 90th percentile of the normal distribution
HORIZON = 30


def item_fits(daily: DataFrame, keys: list[str], date: str, value: str) -> DataFrame:
    """One row per item: span, intercept, slope, seven weekday effects, residual spread.

    Day numbers count from the item's first day; effect k belongs to days k, k + 7, ...
    """
    return fits_of(fit_sums(daily, keys, date, value), keys)


# Sums are taken against a fixed day and re-based to the item's first day afterwards, which saves the extra pass that
# would be needed to learn the first day before summing, and lets sums of several loads be added up.
ORIGIN = "2000-01-03"


def fit_sums(daily: DataFrame, keys: list[str], date: str, value: str, before: str | None = None) -> DataFrame:
    """The sums per item that the fit needs, of one row per item and day.

    With ``before``, the column of what these days had until now, they are what the sums grow by.
    """
    day = F.date_diff(F.col(date), F.lit(ORIGIN).cast("date"))
    y = F.col(value).cast("double")
    old = F.col(before).cast("double") if before else F.lit(0.0)
    more = y - old
    by_weekday = [F.sum(F.when(F.pmod(day, F.lit(7)) == k, more).otherwise(0.0)) for k in range(7)]
    return daily.groupBy(*keys).agg(
        F.min(day).alias("__lo"),
        F.max(day).alias("__hi"),
        F.sum(more).alias("__sy"),
        F.sum(day.cast("double") * more).alias("__sdy"),
        F.sum(y * y - old * old).alias("__syy"),
        F.array(*by_weekday).alias("__wy"),
    )


def changed_days(days: DataFrame, sales: DataFrame, keys: list[str], date: str = "date", value: str = "sale") -> DataFrame:
    """The days that new sales fall on: what they had in ``days`` (0 for none) and what they have now.

    Only the days of the increment are looked up; sales that come late are among them like any others.
    """
    fresh = sales.groupBy(*keys, date).agg(F.sum(value).alias("__more"))
    known = days.select(*keys, date, F.col(value).alias("__before"))
    both = fresh.join(known, [*keys, date], "left").withColumn("__before", F.coalesce("__before", F.lit(0)))
    return both.withColumn(value, F.col("__before") + F.col("__more")).drop("__more")


def merged_days(days: DataFrame, changes: DataFrame, keys: list[str], date: str = "date", value: str = "sale") -> DataFrame:
    """Day sums with the changed days in place of what they were."""
    return days.join(changes, [*keys, date], "left_anti").unionByName(changes.select(*days.columns))


def merged_sums(sums: DataFrame, changes: DataFrame, keys: list[str], date: str = "date", value: str = "sale") -> DataFrame:
    """Sums per item grown by the changed days."""
    both = sums.unionByName(fit_sums(changes, keys, date, value, "__before"))
    added = {c: F.sum(c) for c in ("__sy", "__sdy", "__syy")}
    by_weekday = F.array(*[F.sum(F.get("__wy", F.lit(k))) for k in range(7)])
    return both.groupBy(*keys).agg(
        F.min("__lo").alias("__lo"), F.max("__hi").alias("__hi"), *[x.alias(c) for c, x in added.items()], by_weekday.alias("__wy")
    )


def fits_of(sums: DataFrame, keys: list[str]) -> DataFrame:
    """The fits that follow from the sums."""
    origin = F.lit(ORIGIN).cast("date")
    n = (F.col("__hi") - F.col("__lo") + 1).cast("double")
    sty = F.col("__sdy") - F.col("__lo") * F.col("__sy")
    mean_t = (n - 1) / 2
    var_t = n * (n * n - 1) / 12
    step1 = sums.withColumns(
        {
            "__n": n,
            "__slope": F.coalesce(F.try_divide(sty - mean_t * F.col("__sy"), var_t), F.lit(0.0)),
            "__start": F.date_add(origin, F.col("__lo")),
            "__end": F.date_add(origin, F.col("__hi")),
        }
    ).withColumn("__icpt", F.col("__sy") / F.col("__n") - F.col("__slope") * mean_t)

    def days_of(k: int) -> Column:
        return F.greatest(F.floor((F.col("__n") - 1 - k) / 7) + 1, F.lit(0)).cast("double")

    def effect(k: int) -> Column:
        m = days_of(k)
        sum_t = k * m + 7 * m * (m - 1) / 2
        own = F.get(F.col("__wy"), F.pmod(F.col("__lo") + k, F.lit(7)))
        total = own - F.col("__icpt") * m - F.col("__slope") * sum_t
        return F.when(m > 0, total / F.nullif(m, F.lit(0.0))).otherwise(0.0)

    step2 = step1.withColumn("__season", F.array(*[effect(k) for k in range(7)]))
    explained = sum((days_of(k) * F.get("__season", F.lit(k)) * F.get("__season", F.lit(k)) for k in range(7)), F.lit(0.0))
    trend_part = F.col("__slope") * F.col("__slope") * var_t
    squares = F.col("__syy") - F.col("__sy") * F.col("__sy") / F.col("__n") - trend_part - explained
    return step2.withColumn("__sigma", F.sqrt(F.greatest(squares, F.lit(0.0)) / F.col("__n"))).select(
        *keys, "__start", "__end", "__n", "__icpt", "__slope", "__season", "__sigma"
    )


def forecast_items(
    sales: DataFrame,
    horizon: int = HORIZON,
    include_history: bool = False,
    keys: list[str] | None = None,
    date: str = "date",
    value: str = "sale",
    z: float = BAND_Z,
) -> DataFrame:
    """Rows (ds, yhat, yhat_lower, yhat_upper, trend, keys) for the next ``horizon`` days of every item.

    ``include_history`` adds the fitted values of the item's own days.  Forecast and band never go below 0.
    """
    keys = keys or ["item_id"]
    daily = sales.groupBy(*keys, date).agg(F.sum(value).alias(value))
    return forecast_of(item_fits(daily, keys, date, value), keys, horizon, include_history, z)


def forecast_of(fits: DataFrame, keys: list[str], horizon: int = HORIZON, include_history: bool = False, z: float = BAND_Z) -> DataFrame:
    """The rows of ``forecast_items`` from fits, which may come from stored sums."""
    first = F.lit(0) if include_history else F.col("__n").cast("int")
    rows = fits.withColumn("__t", F.explode(F.sequence(first, F.col("__n").cast("int") + (horizon - 1))))
    trend = F.col("__icpt") + F.col("__slope") * F.col("__t")
    yhat = trend + F.get("__season", F.col("__t") % 7)
    spread = F.col("__sigma") * z
    return rows.select(
        F.date_add("__start", F.col("__t")).alias("ds"),
        F.greatest(yhat, F.lit(0.0)).alias("yhat"),
        F.greatest(yhat - spread, F.lit(0.0)).alias("yhat_lower"),
        F.greatest(yhat + spread, F.lit(0.0)).alias("yhat_upper"),
        trend.alias("trend"),
        *keys,
    )


def forecast_fits(sales: DataFrame, horizon: int = HORIZON, keys: list[str] | None = None, date: str = "date", value: str = "sale") -> DataFrame:
    """What the yhat of ``forecast_items`` follow from, one row per item without its days.

    Joins and sorts of items move these; ``days_within`` puts the days in afterwards.  Span, level, slope and weekdays need
    plain sums only, so sales are summed by item at once; only the band needs the squares of whole days.
    """
    keys = keys or ["item_id"]
    fits = fits_of(fit_sums(sales, keys, date, value), keys).drop("__end", "__sigma")
    return fits.withColumn("__horizon", F.lit(horizon))


def is_fits(forecast: DataFrame) -> bool:
    return "__horizon" in forecast.columns


def days_within(fits: DataFrame) -> DataFrame:
    """Fits with the arrays ``ds`` and ``yhat``, in day order, in place of their columns; other columns stay."""
    own = ["__start", "__n", "__icpt", "__slope", "__season", "__horizon"]
    n = F.col("__n").cast("int")
    days = fits.withColumn("__t", F.sequence(n, n + (F.col("__horizon") - 1)))
    # Bound once: the optimizer would put the formulas of the fit in place of its columns, to be worked out for every day.
    fit = F.struct("__icpt", "__slope", "__season")

    def of_day(fit: Column, t: Column) -> Column:
        return F.greatest(fit["__icpt"] + fit["__slope"] * t + F.get(fit["__season"], t % 7), F.lit(0.0))

    return days.select(
        *[c for c in fits.columns if c not in own],
        F.transform("__t", lambda t: F.date_add("__start", t)).alias("ds"),
        once(fit, lambda fit: F.transform("__t", lambda t: of_day(fit, t))).alias("yhat"),
    )


def forecast_series(sales: DataFrame, horizon: int = HORIZON, keys: list[str] | None = None, date: str = "date", value: str = "sale") -> DataFrame:
    """The days and yhat of ``forecast_items`` as one row per item: keys, and the arrays ``ds`` and ``yhat`` in day order.

    What sums or accumulates a forecast item by item needs no sort of its days then.
    """
    return days_within(forecast_fits(sales, horizon, keys, date, value))
