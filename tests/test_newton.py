"""Newton steps from sums in Spark, beside numpy."""

import numpy as np
import pytest

from keyloom.operators import training
from keyloom.sources.events import LogisticModel


def table(spark, x, y):
    return spark.createDataFrame([(i, float(l), *map(float, v)) for i, (l, v) in enumerate(zip(y, x, strict=True))], "seq long, label double, " + ", ".join(f"x{i} double" for i in range(x.shape[1])))


def objective(x, y, b, w, penalty):
    z = x @ w + b
    off = 1 / (1 + np.exp(-z)) - y
    return np.mean(np.logaddexp(0, z) - y * z) + penalty / 2 * w @ w, np.append(off.mean(), x.T @ off / len(y) + penalty * w)


def test_loss_and_gradient(spark):
    r = np.random.default_rng(70)
    x, y, w = r.normal(0, 2, (200, 3)), r.integers(0, 2, 200), np.array([0.3, -40.0, 25.0])  # scores far out on both sides
    got = training.loss_and_gradient(table(spark, x, y), LogisticModel(-1.5, tuple(w.tolist())), 0.01).first()
    loss, slope = objective(x, y, -1.5, w, 0.01)
    assert got["n"] == 200 and got["objective"] == pytest.approx(loss) and [got[f"g{i}"] for i in range(4)] == pytest.approx(slope.tolist())


@pytest.mark.parametrize("scale", [1.0, 1e4])
def test_optimum(spark, scale):
    """Features of any scale; the objective falls at every step; the gradient vanishes by SQL sums and by numpy; partitions do not matter."""
    r = np.random.default_rng(71)
    x = r.normal(0, 1, (400, 4)) * [scale, 1, 1 / scale, 3]
    y = (r.random(400) < 1 / (1 + np.exp(-x[:, 1] + x[:, 3] - 2))).astype(int)
    rows = table(spark, x, y)
    model, history = training.fit(rows)
    slope = objective(x, y, model.bias, np.array(model.weights), 1e-4)[1]
    assert np.abs(slope / np.array([1, scale, 1, 1, 1])).max() < 1e-8
    assert all(a > b for a, b in zip(history, history[1:], strict=False)) and len(history) < 15
    got = training.loss_and_gradient(rows, model).first()
    assert abs(got["g0"]) < 1e-8 and got["objective"] <= history[-1] + 1e-15
    assert training.fit(rows.repartition(7))[0].weights == pytest.approx(model.weights, rel=1e-8)


def test_classes_that_part(spark):
    """Classes that a plane parts have an optimum only by the penalty; whole steps overshoot there and are halved."""
    x = np.concatenate([np.linspace(-9, -1, 30), np.linspace(1, 9, 30)])[:, None]
    y = (x[:, 0] > 0).astype(int)
    model, history = training.fit(table(spark, x, y), penalty=1e-6)
    assert np.abs(objective(x, y, model.bias, np.array(model.weights), 1e-6)[1]).max() < 1e-8 and history == sorted(history, reverse=True)


def test_defined_results(spark):
    x = np.ones((4, 1))
    model, history = training.fit(table(spark, x, [1, 1, 1, 1]))
    assert model.weights == (0.0,) and model.bias == pytest.approx(np.log((1 - 1e-6) / 1e-6)) and len(history) == 1
    rows = table(spark, x, [0, 1, 0, 1])
    for bad, said in ((rows.limit(0), "no rows"), (rows.selectExpr("seq", "label", "if(seq = 1, null, x0) AS x0"), "null"), (rows.selectExpr("seq", "label", "if(seq = 1, double('nan'), x0) AS x0"), "finite")):
        with pytest.raises(ValueError, match=said):
            training.fit(bad)
