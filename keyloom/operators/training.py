"""Training the logistic model on Spark, with baselines. Features come from the whole stream; only rows of a split are fitted.

The objective is the mean log loss plus half the penalty times the squared weights; the bias is free. Its value, gradient and second
derivatives at a model are sums over rows, taken in one aggregation of built-in functions (45 sums for seven features), so a Newton step
is one pass that sends one row a partition; the driver solves eight equations.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.columns import FEATURES
from keyloom.sources.events import LogisticModel
from keyloom.sources.store import written

#: Half the squared Newton decrement, which is the objective still to be gained, below which the next step is the last one.
GAIN = 1e-12


def examples(features: DataFrame, cohort: DataFrame, split: str = "train", columns: tuple[str, ...] = FEATURES) -> DataFrame:
    """seq, label and the feature columns of a split's labelled rows."""
    rows = features.join(cohort.filter(F.col("split") == split).filter(F.col("label").isin(0, 1)).select("seq", "label"), "seq")
    return rows.select("seq", F.col("label").cast("double").alias("label"), *columns)


def _inputs(rows: DataFrame) -> list[Column]:
    return [F.lit(1.0), *[F.col(c) for c in rows.columns if c not in ("seq", "label")]]


def _sums(rows: DataFrame, model: LogisticModel, curvature: bool) -> list[Column]:
    x, y = _inputs(rows), F.col("label")
    z = F.lit(float(model.bias))
    for w, v in zip(model.weights, x[1:], strict=True):
        z = z + F.lit(float(w)) * v
    small = F.exp(-F.abs(z))
    p = F.when(z >= 0, 1 / (1 + small)).otherwise(small / (1 + small))
    out = [F.count("*").alias("n"), F.count(z + y).alias("whole"), F.sum(F.greatest(z, F.lit(0.0)) - y * z + F.log1p(small)).alias("loss")]
    out += [F.sum((p - y) * v).alias(f"g{i}") for i, v in enumerate(x)]
    if curvature:
        out += [F.sum(p * (1 - p) * x[i] * x[j]).alias(f"h{i}_{j}") for i in range(len(x)) for j in range(i, len(x))]
    return out


def loss_and_gradient(rows: DataFrame, model: LogisticModel, penalty: float = 1e-4) -> DataFrame:
    """One row: n, objective, and its derivatives g0 (by the bias), g1, ... (by the weights)."""
    weights = [float(w) for w in model.weights]
    one = rows.agg(*_sums(rows, model, False))
    return one.select("n", (F.col("loss") / F.col("n") + penalty / 2 * sum(w * w for w in weights)).alias("objective"), *[(F.col(f"g{i}") / F.col("n") + penalty * w).alias(f"g{i}") for i, w in enumerate([0.0, *weights])])


def _point(rows: DataFrame, at: np.ndarray, penalty: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Objective, gradient and second derivatives at bias and weights."""
    one, k = rows.agg(*_sums(rows, LogisticModel(float(at[0]), tuple(at[1:].tolist())), True)).first(), len(at)
    if one["n"] == 0 or one["n"] != one["whole"]:
        raise ValueError("no rows to fit" if one["n"] == 0 else "null features")
    free = np.append(0.0, np.full(k - 1, penalty))
    loss = one["loss"] / one["n"] + float(free @ (at * at)) / 2
    slope = np.array([one[f"g{i}"] for i in range(k)]) / one["n"] + free * at
    bend = np.array([[one[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) / one["n"] + np.diag(free)
    if not (math.isfinite(loss) and np.isfinite(slope).all() and np.isfinite(bend).all()):
        raise ValueError("features or scores are not finite")
    return loss, slope, bend


def prior(rows: DataFrame) -> LogisticModel:
    """The model that knows the share of positives alone."""
    p = min(max(rows.agg(F.avg("label")).first()[0] or 0.0, 1e-6), 1 - 1e-6)
    return LogisticModel(math.log(p / (1 - p)), (0.0,) * (len(rows.columns) - 2))


def fit(rows: DataFrame, penalty: float = 1e-4, iterations: int = 200) -> tuple[LogisticModel, list[float]]:
    """(model, objective before each step) from the prior on by Newton steps, halved where they would raise the objective. With one class
    only there is no optimum, and the prior is the model. No rows, null and infinite features are errors. The values have ten digits: what lies
    behind them depends on the order of the sums."""
    if penalty <= 0:
        raise ValueError("the penalty must be positive")
    rows = written(rows.drop("seq"), "examples")
    low, high = rows.agg(F.min("label"), F.max("label")).first()
    start = prior(rows.select(F.lit(0).alias("seq"), "*"))
    at = np.array([start.bias, *start.weights])
    loss, slope, bend = _point(rows, at, penalty)
    history = [loss]
    while low != high and len(history) < iterations:
        step = np.linalg.solve(bend, slope)
        gain = float(slope @ step) / 2
        if gain <= GAIN:  # steps converge quadratically: after this one nothing is left but rounding
            at = at - step
            break
        share = 1.0
        while (there := _point(rows, at - share * step, penalty))[0] > loss and share > 2**-40:
            share /= 2
        if there[0] > loss:
            break
        at, (loss, slope, bend) = at - share * step, there
        history.append(loss)
    bias, *weights = (float(f"{v:.9e}") for v in at)
    return LogisticModel(bias, tuple(weights)), history
