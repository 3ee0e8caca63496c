"""Ranking metrics of many draws by ranges of scores, beside each draw ranked on its own."""

import numpy as np
import pytest

from keyloom.operators import inference, ranked_draws


def plain(metric, y, p, w):
    """By definition, a row counting ``w`` times; nan with one class."""
    if not (w * y).sum() or not (w * (1 - y)).sum():
        return np.nan
    if metric == "auroc":
        won = (p[:, None] > p) + 0.5 * (p[:, None] == p)
        return ((w * y)[:, None] * (w * (1 - y)) * won).sum() / (w * y).sum() / (w * (1 - y)).sum()
    return sum((w * y * (p == s)).sum() * (w * y * (p >= s)).sum() / max((w * (p >= s)).sum(), 1) for s in np.unique(p)) / (w * y).sum()


@pytest.mark.parametrize("metric", ["auroc", "average_precision"])
def test_draws_by_ranges(spark, monkeypatch, metric):
    """Weights from 0 to 3 and swaps, ties, a score that a third of all rows share, ranges of some eight cells, draws in several tasks."""
    r = np.random.default_rng(51)
    n, k, draws = 150, 9, 70
    y, g = r.integers(0, 2, n), r.integers(0, k, n)
    a, b = np.round(r.random(n), 2), np.where(r.random(n) < 0.34, 0.5, np.round(r.random(n), 1))
    w, s = r.integers(0, 4, (draws, k)).astype(float), r.integers(0, 2, (draws, k))
    w[3], w[4] = 0, 1
    w[5, :] = 0  # one cluster alone
    w[5, 2] = 2
    rows = spark.createDataFrame([(f"g{i}", int(l), float(p), float(q)) for i, l, p, q in zip(g, y, a, b, strict=True)], "group_id string, label int, a double, b double")
    monkeypatch.setattr(ranked_draws, "RANGE", 8)
    table = ranked_draws.cells(rows.repartition(5), [f"g{i}" for i in range(k)])
    bounds = [(x["low"], x["high"]) for x in table.groupBy("part").agg({"score": "min"}).withColumnRenamed("min(score)", "low").join(table.groupBy("part").agg({"score": "max"}).withColumnRenamed("max(score)", "high"), "part").orderBy("part").collect()]
    assert len(bounds) > 10 and all(lower[1] < upper[0] for upper, lower in zip(bounds, bounds[1:], strict=False))
    got = ranked_draws.differences(table, metric, draws, k, lambda ids: w[ids], lambda ids: s[ids])
    for d in range(draws):
        swap = s[d][g] == 1
        want = plain(metric, y, np.where(swap, b, a), w[d][g]) - plain(metric, y, np.where(swap, a, b), w[d][g])
        assert got[d] == pytest.approx(want, abs=1e-12, nan_ok=True)
    assert np.isnan(got[3])


def test_ranked_groups_without_exact_swaps(spark):
    """More clusters than are enumerated: seeded swaps, an interval around the effect, the same again on other partitions."""
    r = np.random.default_rng(52)
    n, k = 600, 20
    y, g = r.integers(0, 2, n), r.integers(0, k, n)
    a, b = (np.clip(0.5 + (y - 0.5) * f + r.normal(0, 0.2, n), 0.01, 0.99) for f in (0.5, 0.1))
    rows = spark.createDataFrame([(f"g{i}", int(l), float(p), float(q)) for i, l, p, q in zip(g, y, a, b, strict=True)], "group_id string, label int, a double, b double")
    x = inference.paired_groups(rows, "auroc", draws=150).first()
    assert not x["exact"] and x["low"] < x["effect"] < x["high"] and x["effect"] > 0.1 and x["p_value"] < 0.05
    assert inference.paired_groups(rows.repartition(7), "auroc", draws=150).first() == x
