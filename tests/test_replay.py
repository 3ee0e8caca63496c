"""Predictions of an engine worked out again: sound ones pass, and each way to be wrong is told by its rule and no other."""

import math
import random

import pytest
from pyspark.sql import functions as F

from keyloom.operators import features as feat
from keyloom.operators import reconcile, replay
from keyloom.sources.events import EVENT, LogisticModel

MODEL = LogisticModel(0.2, (0.4, -0.1, 0.3, 0.2, -0.4, 0.1, 0.000001))
KIND = {"key": "long", "behavior_code": "int", "pressure_available": "int", "item_id": "long", "category_id": "long"}
TOLD = "seq long, " + ", ".join(f"{c} {KIND.get(c, 'long' if c.endswith('_ns') or 'generation' in c else 'double')}" for c in replay.TOLD)


def made(n, keys, seed):
    """Events and their predictions by a plain loop, with a step that changes at every event."""
    rng, now, state, events, told = random.Random(seed), 0, {}, [], []
    for seq in range(n):
        now += rng.randrange(0, 3 * 10**9)
        key, code, alpha = rng.choice(keys), rng.randrange(4), rng.choice((0.02, 0.3, 1.0, rng.random() * 0.9 + 0.05))
        s = state.setdefault(key, [0.0, 0.0, 0, 0, 0, 0, None])
        gap = (now - s[6]) / 1e9 if s[6] is not None else 0.0
        s[0], s[1] = s[0] + alpha * ((1, 3, 2, 5)[code] - s[0]), s[1] + alpha * (gap - s[1])
        s[2], s[3], s[4], s[5], s[6] = s[2] + (code == 0), s[3] + (code in (1, 2)), s[4] + (code == 3), s[5] + 1, now
        xs = [s[0], math.log1p(s[2]), math.log1p(s[3]), min(gap, 3600) / 3600, s[4] / s[5], math.log1p(s[4]), s[1]]
        z = MODEL.bias + sum(w * x for w, x in zip(MODEL.weights, xs, strict=True))
        events.append((seq, now, key, seq % 7, seq % 3, code))
        row = dict(zip(replay.IDENTITY, (now, key, seq % 7, seq % 3, code), strict=True)) | {"alpha_used": alpha, "score": 1 / (1 + math.exp(-z))} | {f"x{i}": x for i, x in enumerate(xs)}
        row |= {"source_created_ns": 1000 * seq, "pressure_loaded_ns": 1000 * seq + 10, "scored_ns": 1000 * seq + 500, "latency_ns": 500}
        on = int(seq > 5)
        row |= {"pressure_available": on, "pressure_generation_used": on, "pressure_sampled_ns": on * 5, "pressure_used": on * 0.5, "batch_pressure_generation": 1}
        told.append({"seq": seq} | row)
    return events, told


def frames(spark, events, told):
    names = [x.split()[0] for x in TOLD.split(", ")]
    return spark.createDataFrame(events, EVENT), spark.createDataFrame([tuple(t[c] for c in names) for t in told], TOLD)


def found(spark, events, told, **more):
    return sorted((r["seq"], r["rule"]) for r in replay.faults(*frames(spark, events, told), MODEL, **more).collect())


def test_sound_predictions_pass(spark):
    events, told = made(400, [1, 1, 1, 2, 3, None], 1)
    assert found(spark, events, told) == [] and found(spark, events, told, hot_rows=20) == []
    e, p = frames(spark, events, told)
    clash = e.withColumns({"t_x0": F.lit("?"), "since": F.lit(1), "step": F.lit(0), "copies": F.lit(9)})
    assert replay.replay(clash, p.withColumn("there", F.lit(0)), MODEL, {"read": 400, "written": 400}) == 400
    with pytest.raises(reconcile.Mismatch, match="stage scored"):
        replay.replay(e, p, MODEL, {"read": 400, "scored": 399})


def test_each_fault_is_told_by_its_rule(spark):
    events, told = made(300, [1, 2, 3], 2)
    due = []

    def spoil(seq, rule, **changes):
        told[seq] |= changes
        due.append((seq, rule))

    for seq, c in ((10, "event_ts_ns"), (11, "key"), (12, "item_id"), (13, "category_id"), (14, "behavior_code")):
        spoil(seq, c, **{c: told[seq][c] + 1})
    for i in range(7):
        spoil(20 + i, f"x{i}", **{f"x{i}": told[20 + i][f"x{i}"] + 1e-9})
    spoil(30, "score", score=told[30]["score"] * (1 + 1e-10))
    spoil(31, "latency_ns", latency_ns=501)
    spoil(32, "pressure_loaded_ns", pressure_loaded_ns=31_999, pressure_sampled_ns=1)
    spoil(33, "scored_ns", pressure_loaded_ns=33_501)
    spoil(34, "pressure_available", pressure_available=2)
    spoil(35, "pressure_sampled_ns", pressure_sampled_ns=35_011)
    spoil(36, "pressure_generation_used", pressure_generation_used=2)
    spoil(37, "pressure_used", pressure_available=0, pressure_generation_used=0, pressure_sampled_ns=0)
    spoil(38, "score", score=None)
    spoil(39, "item_id", item_id=None)
    told.append(dict(told[50]))
    told.append(dict(told[60]) | {"seq": 5000})
    due += [(50, "twice"), (5000, "phantom")]
    assert found(spark, events, told) == sorted(due) == found(spark, events, told, hot_rows=30)
    with pytest.raises(reconcile.Mismatch, match="'phantom': 1.*'twice': 1"):
        replay.replay(*frames(spark, events, told), MODEL)


@pytest.mark.parametrize("lost", [True, False])
def test_what_follows_a_step_that_is_not_known(spark, lost):
    events, told = made(200, [1, 2], 3)
    first = next(i for i, e in enumerate(events) if e[2] == 1 and i > 50)
    later = [i for i, e in enumerate(events) if e[2] == 1 and i > first]
    told[later[3]] |= {"x0": 99.0, "x6": 99.0, "score": 0.5}  # cannot be told any more
    told[later[4]] |= {"x1": 99.0}
    told[first] |= {"alpha_used": 0.0}
    kept = [t for t in told if not (lost and t["seq"] == first)]
    assert found(spark, events, kept) == sorted([(first, "missing" if lost else "alpha_used"), (later[4], "x1")])


def test_falls_over_ranges_and_nulls(spark):
    rng = random.Random(4)
    values = [rng.choice([None, rng.randrange(50)]) for _ in range(500)]
    plain, last = 0, None
    for v in values:
        if v is not None:
            plain, last = plain + (last is not None and v < last), v
    rows = spark.createDataFrame([(i, v, None) for i, v in enumerate(values)], "seq long, a long, b long").repartition(5)
    assert tuple(replay.falls(rows, ("a", "b")).first()) == (plain, 0)


def test_empty(spark):
    e, p = frames(spark, [], [])
    assert replay.faults(e, p, MODEL).count() == 0 and replay.replay(e, p, MODEL) == 0
    events, told = made(3, [1], 5)
    assert found(spark, events, []) == [(i, "missing") for i in range(3)] and found(spark, [], told) == [(i, "phantom") for i in range(3)]
    assert tuple(replay.falls(p).first()) == (0, 0, 0)
