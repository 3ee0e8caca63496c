"""Scans of keys that are cut into ranges, beside plain folds."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.functions import chains
from keyloom.functions.columns import FEATURES, WEIGHTS
from keyloom.functions.scan import affine, chained
from keyloom.operators import features, policies

S = 1_000_000_000


@pytest.fixture
def ranges(spark):
    """Ranges stay as they are dealt."""
    names = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "7"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def made(spark, rows):
    return spark.createDataFrame(rows, "seq long, event_ts_ns long, key long, behavior_code int, alpha double, pressure double").repartition(3)


def keyed(seed, n, hot=0.8, step=lambda r: r.choice([0, 1, S, 5 * S, 40 * S])):
    """Most events are of key 7; some have no key."""
    r, t, out = random.Random(seed), 1_700_000_000 * S, []
    for i in range(n):
        t += step(r)
        key = 7 if r.random() < hot else r.choice([None, 1, 2, 3, 9, 11])
        out.append((i, t, key, r.randrange(4), r.choice([0.1, 0.5, 1.0, 0.01]), r.choice([0.0, 0.1, 0.5, 0.85, 1.0, 1.5, -1.0])))
    return out


def folded(rows):
    state, out = {}, {}
    for seq, ts, key, code, alpha, _ in rows:
        s, g, last, pv, cf, buy, n = state.get(key, (0.0, 0.0, None, 0, 0, 0, 0))
        gap = 0.0 if last is None else (ts - last) / 1e9
        s, g = s + alpha * (WEIGHTS[code] - s), g + alpha * (gap - g)
        state[key] = s, g, ts, pv + (code == 0), cf + (code in (1, 2)), buy + (code == 3), n + 1
        pv, cf, buy, n = state[key][3:]
        out[seq] = s, np.log1p(pv), np.log1p(cf), min(gap, 3600.0) / 3600.0, buy / n, np.log1p(buy), g
    return out


@pytest.mark.parametrize(("hot", "hot_rows"), [(1.0, 20), (0.8, 20), (0.8, 1 << 20)])
def test_features_of_a_key_in_ranges_are_the_fold(spark, ranges, hot, hot_rows):
    rows = keyed(1, 700, hot)
    want = folded(rows)
    got = features.vector(made(spark, rows), F.col("alpha"), hot_rows).collect()
    assert len(got) == len(rows)
    for r in got:
        assert [r[x] for x in FEATURES] == pytest.approx(want[r["seq"]], rel=1e-12, abs=1e-12)


def test_a_key_of_all_rows_runs_in_as_many_tasks_as_ranges(spark, ranges):
    rows = made(spark, keyed(2, 700, 1.0))
    got = features.vector(rows, F.col("alpha"), 20).withColumn("task", F.spark_partition_id())
    assert got.groupBy("task").count().count() >= 5


def published_by(rows, hit):
    state, out = {}, {}
    for row in rows:
        version, pending, public = state.get(row[2], (0, 0, None))
        yes = hit(row, version, pending, public)
        state[row[2]] = version, pending, public = (version + 1, 0, row[1]) if yes else (version, pending + 1, public)
        out[row[0]] = yes, version, pending
    return out


STEPS = {
    "mixed": lambda r: r.choice([0, 1, S, 5 * S, 40 * S]), "even": lambda r: S, "all at once": lambda r: 0, "bursts": lambda r: 0 if r.random() < 0.97 else 500 * S,
}


@pytest.mark.parametrize(("steps", "threshold"), [("mixed", 0), ("mixed", 100 * S), ("even", 3 * S), ("all at once", 1), ("bursts", 3 * S), ("bursts", 10_000_000 * S)])
def test_elapsed_in_ranges_is_the_fold(spark, ranges, steps, threshold):
    rows = keyed(3, 400, 0.9, STEPS[steps])
    want = published_by(rows, lambda row, version, pending, public: public is None or row[1] - public >= threshold)
    got = policies.publish(made(spark, rows), policies.Policy("elapsed", elapsed_ns=threshold), hot_rows=20).collect()
    assert {r["seq"]: (r["published"], r["version_id"], r["pending"]) for r in got} == want and "public_ns" not in got[0]


@pytest.mark.parametrize(("hot", "bounds"), [(1.0, (1, 16)), (0.7, (2, 40)), (1.0, (3, 3))])
def test_adaptive_in_ranges_is_the_fold(spark, ranges, hot, bounds):
    low, high = bounds
    rows = keyed(4, 500, hot)  # the pressure changes at every event
    cadence = lambda p: min(max(low + int(min(max(p, 0.0), 1.0) * (high - low)), low), high)
    want = published_by(rows, lambda row, version, pending, public: pending + 1 >= cadence(row[5]))
    got = policies.publish(made(spark, rows), policies.Policy("adaptive", cadence=low, cadence_max=high), hot_rows=20).collect()
    assert {r["seq"]: (r["published"], r["version_id"], r["pending"]) for r in got} == want


def test_batches_go_on_where_the_last_one_ended():
    """The work on a batch, cut anywhere, by hand."""
    rows = sorted(keyed(5, 300, 0.5), key=lambda r: (r[2] is None, r[2] or 0, r[0]))
    c = {n: np.array([r[i] for r in rows]) for n, i in (("event_ts_ns", 1), ("behavior_code", 3), ("alpha", 4), ("pressure", 5))}
    starts = np.array([i == 0 or rows[i][2] != rows[i - 1][2] for i in range(len(rows))])
    for by in (features.AVERAGES, chains.elapsed(7 * S), chains.adaptive(1, 16)):
        whole, _ = by.run(c, starts, None)
        for step in (1, 13):
            state, parts = None, []
            for a in range(0, len(rows), step):
                part, state = by.run({k: v[a : a + step] for k, v in c.items()}, starts[a : a + step], state)
                parts.append(part)
            for name in whole:
                assert np.concatenate([p[name] for p in parts]) == pytest.approx(whole[name], rel=1e-12)


def test_time_that_runs_back(spark):
    """A key in one task takes events in order of seq; one that is cut into ranges needs its times in order."""
    rows = [(i, (100 - i) * S if i % 7 else i * S, 1, 0, 0.1, 0.0) for i in range(60)]
    want = published_by(rows, lambda row, version, pending, public: public is None or row[1] - public >= 5 * S)
    got = policies.publish(made(spark, rows), policies.Policy("elapsed", elapsed_ns=5 * S)).collect()
    assert {r["seq"]: (r["published"], r["version_id"], r["pending"]) for r in got} == want


def test_doubling_is_following():
    r = np.random.default_rng(6)
    for n in (1, 2, 3, 50):
        successor = np.array([r.integers(i + 1, n + 1) for i in range(n)])
        mark, at = np.zeros(n, bool), 0
        while at < n:
            mark[at] = True
            at = successor[at]
        assert (chained(successor, np.array([0])) == mark).all()
        m, b = r.random(n), r.random(n)
        s = 0.0
        for i, x in enumerate(affine(m, b, np.arange(n) == 0)[1]):
            s = m[i] * s + b[i]
            assert x == pytest.approx(s, rel=1e-12)


@pytest.mark.parametrize("alpha", [0.0, 1.5, -0.1, float("nan")])
def test_a_step_outside_its_bounds_is_refused(spark, alpha):
    rows = made(spark, keyed(7, 5))
    with pytest.raises(ValueError, match="alpha"):
        features.vector(rows, alpha)
    with pytest.raises(Exception, match="alpha"):
        features.vector(rows, F.lit(alpha)).collect()


@pytest.mark.parametrize("code", [4, 9, -1])
def test_a_behaviour_outside_its_domain_is_refused(spark, code):
    with pytest.raises(Exception, match="behaviour"):
        features.vector(made(spark, [(0, 0, 1, code, 0.1, 0.0)])).collect()
