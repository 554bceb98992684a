"""Tree ensembles as arrays: validation round by round, early stopping, and a recursive forecast in one pass.

A fitted ensemble of Spark ML is a few arrays, whose size is bounded by its number of trees and their depth.  As arrays it
goes to the tasks once and is evaluated on whole batches, for every round of a boosting run or for every step of a
recursion, without a plan for each round or step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.plans import training
from larder.plans.features import LAGS, MEAN_ROWS, SERIES
from larder.session import checkpointed, remove_path, scratch_path

ROUNDS, PATIENCE = 600, 50


@dataclass(frozen=True)
class Trees:
    """Node arrays of shape (trees, nodes); a leaf leads to itself.  ``weights`` has one number per tree."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    weights: np.ndarray
    depth: int

    @classmethod
    def of(cls, model: Model, spark) -> Trees:
        """The arrays of a fitted boosting or forest regressor, read from its saved form."""
        path = scratch_path(spark, "model")
        model.write().save(path)
        rows = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()  # trees x nodes of one model
        remove_path(spark, path)
        count, size = model.getNumTrees, 1 + max(r["id"] for r in rows)
        feature, left = np.zeros((count, size), np.int32), np.tile(np.arange(size, dtype=np.int32), (count, 1))
        right, threshold, value = left.copy(), np.full((count, size), np.inf), np.zeros((count, size))
        for r in rows:
            at = r["treeID"], r["id"]
            value[at] = r["prediction"]
            if r["leftChild"] >= 0:
                if r["split"]["numCategories"] >= 0:
                    raise ValueError("only splits of continuous features are supported")
                feature[at], threshold[at] = r["split"]["featureIndex"], r["split"]["leftCategoriesOrThreshold"][0]
                left[at], right[at] = r["leftChild"], r["rightChild"]
        summed = type(model).__name__.startswith("GBT")
        weights = np.array(model.treeWeights) if summed else np.full(count, 1 / count)
        return cls(feature, threshold, left, right, value, weights, max(t.depth for t in model.trees))

    def first(self, rounds: int) -> Trees:
        """The ensemble after so many rounds."""
        parts = ("feature", "threshold", "left", "right", "value", "weights")
        return replace(self, **{p: getattr(self, p)[:rounds] for p in parts})

    def staged(self, rows: np.ndarray) -> Iterator[np.ndarray]:
        """Predictions for a (rows, features) matrix after the first tree, after two trees, and so on."""
        every, total = np.arange(len(rows)), np.zeros(len(rows))
        for k, weight in enumerate(self.weights):
            node = np.zeros(len(rows), np.int32)
            for _ in range(self.depth):
                # A missing value is not below any threshold, as in Spark.
                goes_left = rows[every, self.feature[k, node]] <= self.threshold[k, node]
                node = np.where(goes_left, self.left[k, node], self.right[k, node])
            total = total + weight * self.value[k, node]
            yield total

    def predict(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows))
        for out in self.staged(rows):  # noqa: B007
            pass
        return out


def matrix(batch: pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    """Named columns as doubles; nulls become NaN."""
    return np.column_stack([batch.column(n).cast(pa.float64()).to_numpy(zero_copy_only=False) for n in names]) if names else np.zeros((len(batch), 0))


def staged_squares(rows: DataFrame, trees: Trees, names: list[str], label: str = "sales") -> tuple[int, np.ndarray]:
    """Number of rows and, for every round, the sum of their squared errors."""
    shared = rows.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            truth = batch.column(label).cast(pa.float64()).to_numpy(zero_copy_only=False)
            squares = [float(((truth - y) ** 2).sum()) for y in shared.value.staged(matrix(batch, names))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(squares)), pa.int32()), pa.array(squares), pa.array([len(batch)] * len(squares), pa.int64())],
                names=["round", "squares", "n"],
            )

    sums = rows.select(label, *names).mapInArrow(run, "round int, squares double, n long").groupBy("round")
    found = sums.agg(F.sum("squares"), F.sum("n")).orderBy("round").collect()  # one row per round
    return (found[0][2], np.array([r[1] for r in found])) if found else (0, np.zeros(len(trees.weights)))


def stopped_at(errors: Sequence[float], patience: int) -> tuple[int, bool]:
    """The round (from 1) with the least error before ``patience`` rounds in a row have brought nothing better, and
    whether the run stops there; of equal errors the first."""
    best = 0
    for k, error in enumerate(errors):
        if error < errors[best]:
            best = k
        elif k - best >= patience:
            return best + 1, True
    return best + 1, False


@dataclass(frozen=True)
class Validated:
    trees: Trees  # up to the best round
    predictions: DataFrame  # series, date, y_true, y_pred, abs_err
    start: object  # first validation day
    errors: list[float]  # RMSE on the validation days after each round that was fitted
    best_round: int

    @property
    def rmse(self) -> float:
        return self.errors[self.best_round - 1]


def train_validate_staged(
    features: DataFrame, names: list[str], rounds: int = ROUNDS, patience: int = PATIENCE, **settings
) -> Validated:
    """Boosting on all but the last 28 days, stopped when those have not got better for ``patience`` rounds.

    Spark fits a given number of rounds.  A run of few is fitted first and validated round by round in one pass; as long
    as it ends before the stop is certain, a run of twice as many is.  Earlier rounds come out the same, so the result is
    that of one run that stops, for at most twice its rounds.  ``features`` should be a stored table.
    """
    spark, start = features.sparkSession, training.validation_start(features)
    known = features.where(F.col("sales").isNotNull())
    train, valid = (known.where(c) for c in (F.col("date") < F.lit(start), F.col("date") >= F.lit(start)))
    assembler = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep")
    rows = assembler.transform(train).select(F.col("sales").cast("double").alias("label"), "features")
    fitted = min(rounds, 2 * patience)
    while True:
        model = training.make_regressor("gbt", featuresCol="features", labelCol="label", **{**settings, "maxIter": fitted}).fit(rows)
        trees = Trees.of(model, spark)
        n, squares = staged_squares(valid, trees, names)
        errors = np.sqrt(squares / max(n, 1)).tolist()
        best, certain = stopped_at(errors, patience)
        if certain or fitted >= rounds:
            break
        fitted = min(rounds, 2 * fitted)
    trees = trees.first(best)
    return Validated(trees, predicted(valid, trees, names), start, errors, best)


def predicted(rows: DataFrame, trees: Trees, names: list[str]) -> DataFrame:
    """Series, date, y_true, y_pred and abs_err of feature rows."""
    shared = rows.sparkSession.sparkContext.broadcast(trees)
    kept = rows.select(*SERIES, "date", F.col("sales").cast("double").alias("y_true"), *[F.col(n).cast("double").alias(n) for n in names])
    schema = T.StructType([*kept.select(*SERIES, "date", "y_true").schema.fields, T.StructField("y_pred", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [*SERIES, "date", "y_true"]
            guess = shared.value.predict(matrix(batch, names))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(guess)], names=[*own, "y_pred"])

    return kept.mapInArrow(run, schema).withColumn("abs_err", F.abs(F.col("y_true") - F.col("y_pred")))


def forecast_blocks(
    predict: Callable[[np.ndarray, list[str]], np.ndarray],
    features: DataFrame,
    names: list[str],
    vocabulary: dict[str, list[str]],
    calendar: DataFrame,
    horizon: int = 28,
) -> DataFrame:
    """Day-by-day forecast in which each prediction becomes history for the next day: series, date, y_pred.

    ``predict`` takes the matrix of the named features of many series and returns a number for each; a fitted ensemble
    is ``lambda rows, names: trees.predict(rows)``.  A series is one row with its last sales; a batch of series goes
    through all steps within one pass over the data, so the plan does not grow with the horizon.
    """
    own = [*[f"sales_lag_{k}" for k in LAGS], *[f"sales_rmean_{n}" for n in MEAN_ROWS]]
    days = training.future_features(features, vocabulary, calendar, horizon)
    static = [c for c in names if c not in own and c not in days[0]]
    state = checkpointed(training.series_state(features, static)).fillna(0.0, subset=static)
    state = state.select(*SERIES, "hist", *[F.col(c).cast("double").alias(c) for c in static])
    reach = training.HISTORY_ROWS
    schema = T.StructType([*state.select(*SERIES).schema.fields, T.StructField("date", T.DateType()), T.StructField("y_pred", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count, lists = len(batch), batch.column("hist")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            # Right-aligned: what a short history lacks counts as no sale.
            sold = np.zeros((count, reach + len(days)))
            row = np.repeat(np.arange(count), sizes)
            place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + reach - sizes[row]
            sold[row, place] = np.nan_to_num(lists.flatten().to_numpy(zero_copy_only=False))
            fixed = dict(zip(static, matrix(batch, static).T, strict=True))
            for step, day in enumerate(days):
                now = reach + step
                found = fixed | {n: np.full(count, float(v)) for n, v in day.items() if n != "date"}
                found |= {f"sales_lag_{k}": sold[:, now - k] for k in LAGS}
                for n in MEAN_ROWS:
                    long = np.minimum(sizes + step, reach) >= n
                    found[f"sales_rmean_{n}"] = np.where(long, sold[:, now - n : now].sum(axis=1) / n, 0.0)
                sold[:, now] = predict(np.column_stack([found[n] for n in names]), names)
            dates = pa.array([d["date"] for d in days] * count, pa.date32())
            repeated = np.repeat(np.arange(count), len(days))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(pa.array(repeated)) for c in SERIES), dates, pa.array(sold[:, reach:].reshape(-1))],
                names=[*SERIES, "date", "y_pred"],
            )

    return state.mapInArrow(run, schema)
