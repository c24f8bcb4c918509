"""Baseline forecasts in the prediction schema: naive rules, and least squares from Gram matrices that merge.

A part of the data (a year, a fold) is summed up by the products of its columns, so training on any union
of parts, or on all but one, is a sum or a difference of small matrices. Only these reach the driver,
one of width x width for each part.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.config import DATE, SYMBOL
from barloom.functions.windows import prior, rolling
from barloom.operators.base_features import daily_return
from barloom.operators.targets import future_return

# ship these small functions inside the task, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Partial matrices of a part are added up in so many groups before the last sum.
SLOTS = 32
PARTIAL = "part string, slot int, products binary"


def naive_forecasts(panel: DataFrame, horizon: int = 5, window: int = 20, price: str = "close") -> DataFrame:
    """``rule, sample_id, label_date, y_pred, y_true, pred_risk``: one row per bar and rule.

    ``mean``: the horizon times the mean daily return of the last ``window`` bars; ``momentum``: the return of the last
    ``horizon`` bars; ``reversal``: its negative. The risk is the squared deviation of the window's daily returns.
    """
    returns = panel.withColumn("_ret", daily_return(price))
    past = F.try_divide(F.col(price), prior(price, horizon)) - 1.0
    deviation = rolling(F.stddev_samp, "_ret", window)
    rules = {"mean": rolling(F.avg, "_ret", window) * float(horizon), "momentum": past, "reversal": -past}
    rows = returns.select(
        F.concat_ws(":", SYMBOL, F.col(DATE).cast("string")).alias("sample_id"), F.col(DATE).alias("label_date"),
        future_return(price, horizon).alias("y_true"), (deviation * deviation).alias("pred_risk"),
        F.array(*[F.struct(F.lit(name).alias("rule"), value.alias("y_pred")) for name, value in rules.items()]).alias("_rules"),
    )
    return rows.select(F.inline("_rules"), "sample_id", "label_date", "y_true", "pred_risk")


def gram_matrices(df: DataFrame, features: Sequence[str], target: str, part: Column) -> dict[str, np.ndarray]:
    """For each part, the products of (1, features, target) summed over its rows without a null or NaN.

    Tasks add up their rows, then matrices of a part in ``SLOTS`` groups, then those.
    """
    width = len(features) + 2

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), object)
            values = np.ones((batch.num_rows, width))
            for k in range(1, width):
                values[:, k] = batch.column(k).to_numpy(zero_copy_only=False)
            whole = np.isfinite(values).all(axis=1)
            for name in set(names[whole].tolist()):
                own = values[whole & (names == name)]
                sums[name] = sums.get(name, 0.0) + own.T @ own
        yield rows(sums, TaskContext.get().partitionId() % SLOTS)

    def rows(sums: dict[str, np.ndarray], slot: int) -> pa.RecordBatch:
        blobs = [m.tobytes() for m in sums.values()]
        return pa.record_batch(
            [pa.array(list(sums), pa.string()), pa.array([slot] * len(sums), pa.int32()), pa.array(blobs, pa.binary())], names=["part", "slot", "products"]
        )

    def added(table: pa.Table) -> pa.Table:
        total = reduce(np.add, (np.frombuffer(b.as_py()) for b in table.column("products")))
        return pa.table([table.column("part").slice(0, 1), table.column("slot").slice(0, 1), pa.array([total.tobytes()], pa.binary())], names=["part", "slot", "products"])

    wanted = df.select(part.cast("string").alias("part"), *[F.col(c).cast("double") for c in (*features, target)]).where("part is not null")
    partial = wanted.mapInArrow(products, PARTIAL)
    whole = partial.groupBy("part", "slot").applyInArrow(added, PARTIAL).groupBy("part").applyInArrow(added, PARTIAL)
    return {r.part: np.frombuffer(bytes(r.products)).reshape(width, width) for r in whole.collect()}


@dataclass(frozen=True)
class LinearModel:
    intercept: float
    coefficients: tuple[float, ...]
    residual_variance: float


def solve(gram: np.ndarray, alpha: float = 0.0) -> LinearModel:
    """Least squares with an intercept; ``alpha`` weighs squared coefficients of features scaled to deviation 1.

    A feature without variation has coefficient 0; of collinear ones the shortest solution is taken.
    """
    n = gram[0, 0]
    mean = gram[0, 1:] / n
    moments = gram[1:, 1:] / n - np.outer(mean, mean)
    scale = np.sqrt(np.clip(np.diag(moments)[:-1], 0.0, None))
    moves = scale > 1e-12 * np.maximum(1.0, np.abs(mean[:-1]))
    unit = np.where(moves, scale, 1.0)
    inner = np.where(np.outer(moves, moves), moments[:-1, :-1] / np.outer(unit, unit), 0.0) + alpha * np.eye(len(unit))
    toward = np.where(moves, moments[:-1, -1] / unit, 0.0)
    b = np.linalg.lstsq(inner, toward, rcond=None)[0] / unit
    variance = moments[-1, -1] - 2 * b @ moments[:-1, -1] + b @ moments[:-1, :-1] @ b
    return LinearModel(float(mean[-1] - b @ mean[:-1]), tuple(map(float, b)), float(max(variance, 0.0)))


def leave_one_out(grams: dict[str, np.ndarray], alpha: float = 0.0) -> dict[str, LinearModel]:
    """For each part, the model of all other parts; a part without other rows has none."""
    total = reduce(np.add, grams.values()) if grams else None
    rest = {part: total - own for part, own in grams.items()}
    return {part: solve(gram, alpha) for part, gram in rest.items() if gram[0, 0] >= 0.5}


def walk_forward(grams: dict[str, np.ndarray], alpha: float = 0.0) -> dict[str, LinearModel]:
    """For each part but the first, the model of all parts that sort before it."""
    models, sofar = {}, None
    for part in sorted(grams):
        if sofar is not None:
            models[part] = solve(sofar, alpha)
        sofar = grams[part] if sofar is None else sofar + grams[part]
    return models


def forecast(df: DataFrame, models: dict[str, LinearModel], features: Sequence[str], part: Column, sample_id: Column, day: str, target: str) -> DataFrame:
    """``sample_id, label_date, y_pred, y_true, pred_risk``: each row by its part's model, null without one or with a gap."""
    table = df.sparkSession.createDataFrame(
        [(p, m.intercept, list(m.coefficients), m.residual_variance) for p, m in models.items()],
        "_part string, _intercept double, _coefficients array<double>, _variance double",
    )
    rows = df.withColumn("_part", part.cast("string")).join(F.broadcast(table), "_part", "left")  # one row per part
    y_pred = reduce(lambda total, k: total + F.col("_coefficients")[k] * F.col(features[k]), range(len(features)), F.col("_intercept"))
    return rows.select(sample_id.alias("sample_id"), F.col(day).alias("label_date"), y_pred.alias("y_pred"), F.col(target).alias("y_true"), F.col("_variance").alias("pred_risk"))
