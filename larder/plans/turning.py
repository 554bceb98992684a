"""Demand forecast per item with a trend that may turn: piecewise linear, with a weekly Fourier pattern.

The model is penalised least squares on the gap-filled daily series.  Its columns are a constant, the day, three waves of
the week, and for every knot the days since.  Nothing but sums reaches the fit: days without sales add nothing to X'y, so
that is one partial aggregate of some twenty sums per item, and X'X depends on the item's first and last day alone, so it
is a difference of running totals over the calendar.  Solving one system of fixed size per item is all that is left, in
batches of numpy.  A hot item costs no more than any other.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BAND_Z = 1.2815515655446004  # 10th and 90th percentile of the normal distribution
HORIZON = 30
KNOTS = 12
KNOT_SHARE = 0.8  # knots lie in the first so much of the history, so that the last slope has days to rest on
WAVES = 3
# Penalties of squared coefficients, with time running from 0 to 1 over the table's history; the constant has none.
SLOPE_PENALTY, WAVE_PENALTY, KNOT_PENALTY = 1e-3, 1e-3, 0.1

_ORIGIN = dt.date(2000, 1, 3)  # a Monday
_FIRST_KNOT = 2 + 2 * WAVES


def _waves(day: np.ndarray) -> np.ndarray:
    angle = 2 * np.pi * np.asarray(day)[..., None] * np.arange(1, WAVES + 1) / 7
    return np.concatenate((np.cos(angle), np.sin(angle)), axis=-1)


def _basis(day: np.ndarray, first: float, width: float, knots: np.ndarray) -> np.ndarray:
    """One row of the design per day number."""
    since = np.clip(day[:, None] - knots[None, :], 0, None) / width
    return np.column_stack((np.ones(len(day)), (day - first) / width, _waves(day), since))


def _penalties(knots: int, stiffness: float) -> np.ndarray:
    return np.array([0.0, SLOPE_PENALTY, *[WAVE_PENALTY] * (2 * WAVES), *[stiffness] * knots])


def _solved(stiffness: float):
    """Coefficients of every item of a batch from its sums."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                yield batch.assign(__base=0.0, __slope=0.0, __bends=[[]] * 0, __season=[[]] * 0, __sigma=0.0)
                continue
            first, width, knots = float(batch["__first"].iloc[0]), float(batch["__width"].iloc[0]), np.asarray(batch["__knots"].iloc[0], float)
            lo, hi = batch["__lo"].to_numpy(), batch["__hi"].to_numpy()
            start = int(lo.min())
            rows = _basis(np.arange(start, int(hi.max()) + 1, dtype=float), first, width, knots)
            # Running totals of the products of every two columns.
            a, b = np.triu_indices(rows.shape[1])
            totals = np.zeros((len(rows) + 1, len(a)))
            np.cumsum(rows[:, a] * rows[:, b], axis=0, out=totals[1:])
            gram = np.empty((len(batch), rows.shape[1], rows.shape[1]))
            gram[:, a, b] = gram[:, b, a] = totals[hi - start + 1] - totals[lo - start]

            weekday = np.stack(batch["__wy"].to_numpy())
            total = weekday.sum(axis=1)
            target = np.column_stack(
                (
                    total,
                    (batch["__sdy"].to_numpy() - first * total) / width,
                    weekday @ _waves(np.arange(7)),
                    np.stack(batch["__since"].to_numpy()) / width if len(knots) else np.zeros((len(batch), 0)),
                )
            )
            ridge = gram + np.diag(_penalties(len(knots), stiffness))
            found = np.linalg.solve(ridge, target[:, :, None])[:, :, 0]
            squares = batch["__syy"].to_numpy() - 2 * (found * target).sum(axis=1) + np.einsum("ni,nij,nj->n", found, gram, found)
            season = found[:, 2:_FIRST_KNOT] @ _waves(np.arange(7)).T
            yield batch.assign(
                __base=found[:, 0],
                __slope=found[:, 1],
                __bends=list(found[:, _FIRST_KNOT:]),
                __season=list(season),
                __sigma=np.sqrt(np.clip(squares, 0, None) / (hi - lo + 1)),
            )

    return run


def turning_fits(
    daily: DataFrame, keys: list[str], date: str, value: str, knots: int | Sequence[dt.date], stiffness: float
) -> DataFrame:
    """One row per item: first and last day number, time scale, knots, base, slope, change of slope at each knot,
    seven weekday effects (Monday first) and the residual spread."""
    day = F.date_diff(F.col(date), F.lit(_ORIGIN))
    span = daily.agg(F.struct(F.min(day).alias("first"), F.max(day).alias("last")).alias("s")).scalar()
    width = F.greatest(span["last"] - span["first"], F.lit(1))
    if isinstance(knots, int):
        places = [span["first"] + F.floor(width * (KNOT_SHARE * k / knots)).cast("int") for k in range(1, knots + 1)]
    else:
        places = [F.lit((k - _ORIGIN).days) for k in sorted(set(knots))]
    y = F.col(value).cast("double")
    since = [F.sum(F.greatest(day - place, F.lit(0)).cast("double") * y) for place in places]
    sums = daily.groupBy(*keys).agg(
        F.min(day).alias("__lo"),
        F.max(day).alias("__hi"),
        F.sum(day.cast("double") * y).alias("__sdy"),
        F.sum(y * y).alias("__syy"),
        F.array(*[F.sum(F.when(F.pmod(day, F.lit(7)) == k, y).otherwise(0.0)) for k in range(7)]).alias("__wy"),
        F.array(*since).cast("array<double>").alias("__since"),
    )
    sums = sums.withColumns({"__first": span["first"], "__width": width, "__knots": F.array(*places).cast("array<int>")})
    kinds = {f.name: f.dataType.simpleString() for f in sums.schema.fields}
    extra = {"__base": "double", "__slope": "double", "__bends": "array<double>", "__season": "array<double>", "__sigma": "double"}
    schema = ", ".join(f"`{n}` {k}" for n, k in (kinds | extra).items())
    return sums.mapInPandas(_solved(stiffness), schema).drop("__sdy", "__syy", "__wy", "__since")


def forecast_turning(
    sales: DataFrame,
    horizon: int = HORIZON,
    include_history: bool = False,
    keys: list[str] | None = None,
    date: str = "date",
    value: str = "sale",
    z: float = BAND_Z,
    knots: int | Sequence[dt.date] = KNOTS,
    stiffness: float = KNOT_PENALTY,
) -> DataFrame:
    """Rows (ds, yhat, yhat_lower, yhat_upper, trend, keys) as of ``forecast_items``, from a trend that may turn.

    ``knots`` are the days at which the slope can change: so many at equal distances over the first four fifths of the
    table's history, or given dates.  ``stiffness`` is the penalty of a change of slope; the last slope goes on beyond the
    history.  Rows without a date or with a null value count as no sale.
    """
    keys = keys or ["item_id"]
    known = sales.where(F.col(date).isNotNull())
    daily = known.groupBy(*keys, date).agg(F.coalesce(F.sum(value), F.lit(0)).alias(value))
    fits = turning_fits(daily, keys, date, value, knots, stiffness)
    first = F.col("__lo") if include_history else F.col("__hi") + 1
    rows = fits.withColumn("__day", F.explode(F.sequence(first, F.col("__hi") + horizon)))

    def since(place: Column) -> Column:
        return F.greatest(F.col("__day") - place, F.lit(0)) / F.col("__width")

    count = knots if isinstance(knots, int) else len(set(knots))
    trend = F.col("__base") + F.col("__slope") * (F.col("__day") - F.col("__first")) / F.col("__width")
    for k in range(count):
        trend = trend + F.get("__bends", F.lit(k)) * since(F.get("__knots", F.lit(k)))
    rows = rows.withColumn("trend", trend)
    yhat = F.col("trend") + F.get("__season", F.pmod(F.col("__day"), F.lit(7)))
    spread = F.col("__sigma") * z
    return rows.select(
        F.date_add(F.lit(_ORIGIN), F.col("__day")).alias("ds"),
        F.greatest(yhat, F.lit(0.0)).alias("yhat"),
        F.greatest(yhat - spread, F.lit(0.0)).alias("yhat_lower"),
        F.greatest(yhat + spread, F.lit(0.0)).alias("yhat_upper"),
        "trend",
        *keys,
    )
