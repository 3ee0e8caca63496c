"""Runs of the stream that end in a receipt, and one that fails in each phase."""

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from keyloom.functions.columns import FEATURES
from keyloom.operators import features, policies
from keyloom.plans.registry import MODEL
from keyloom.sources import events as src
from keyloom.streaming import engine, run

CADENCE = policies.Policy("fixed_cadence", cadence=3)


def put(spark, base, rows):
    spark.createDataFrame(rows, src.EVENT).coalesce(1).write.mode("append").parquet(f"{base}/in")


def go(spark, base, report=None, **more):
    return run.run(engine.event_stream(spark, f"{base}/in", files_per_batch=1), more.pop("model", MODEL), f"{base}/out", f"{base}/check", report, **{"policy": CADENCE, **more})


def some(start, stop, keys=5):
    r = random.Random(start)
    return [(i, i * 1_000_000_000, r.randrange(keys), i, 1, r.randrange(4)) for i in range(start, stop)]


def test_receipts(spark, tmp_path):
    """Two runs on one checkpoint, each of two micro-batches: counts agree, rows and state are those of a batch."""
    base, rows = tmp_path.as_uri(), some(0, 120)
    for k in range(2):
        for part in (rows[60 * k : 60 * k + 30], rows[60 * k + 30 : 60 * k + 60]):
            put(spark, base, part)
        got = go(spark, base, str(tmp_path / f"receipt{k}"), max_keys=5)
        assert [got[s] for s in run.STAGES] == [60] * 4 and got["keys"] == 5 and got["published"] + got["coalesced"] == 60
        assert json.loads((tmp_path / f"receipt{k}").read_text()) == got
    df = spark.createDataFrame(rows, src.EVENT)
    batch = policies.publish(features.vector(df), CADENCE)
    plain = lambda rows: {x["seq"]: (*(x[f] for f in FEATURES), x["published"], x["version_id"], x["pending"]) for x in rows.collect()}
    assert plain(run.public(spark, f"{base}/out")) == plain(batch)
    state = {x["key"]: x for x in run.key_state(spark, f"{base}/check").collect()}
    last = {x["key"]: x for x in batch.orderBy("seq").collect()}
    assert state.keys() == last.keys()
    for key, x in last.items():
        assert (state[key]["engagement"], state[key]["gap"], state[key]["version"], state[key]["pending"], state[key]["last_seq"]) == (x["x0"], x["x6"], x["version_id"], x["pending"], x["seq"])
    nothing = go(spark, base)
    assert [nothing[s] for s in run.STAGES] == [0] * 4 and nothing["keys"] in (0, 5)


def test_keys_share_buckets(spark, tmp_path):
    """More keys than buckets: a call of the stream and a row of its state are of a bucket and not of a key; rows and states are those of a batch."""
    base, n = tmp_path.as_uri(), 3 * engine.BUCKETS
    rows = [(i, i * 1_000_000_000, i * 7919 % n, i, 1, i % 4) for i in range(2 * n)]
    for k in range(2):
        put(spark, base, rows[k * n : k * n + n])
    assert go(spark, base, max_keys=n)["keys"] == n
    held = spark.read.format("statestore").option("path", f"{base}/check").option("stateVarName", "state").load()
    assert held.count() <= engine.BUCKETS
    batch = policies.publish(features.vector(spark.createDataFrame(rows, src.EVENT)), CADENCE)
    seen = run.public(spark, f"{base}/out").select("seq", "key", *FEATURES, "published", "version_id", "pending")
    assert seen.exceptAll(batch.select(*seen.columns)).isEmpty() and seen.count() == 2 * n
    states = run.key_state(spark, f"{base}/check")
    assert states.columns == ["key", *(f.split()[0] for f in engine.HELD.split(", "))]
    last = batch.filter(f"seq >= {n}").selectExpr("key", "x0 engagement", "x6 gap", "version_id version", "pending", "seq last_seq")
    assert states.select(*last.columns).exceptAll(last).isEmpty() and states.count() == n


class Held:
    """A bucket's state without a store."""

    value = None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def test_a_bucket_in_parts(spark, monkeypatch):
    """Keys of one bucket, one of them hot, over two micro-batches that come and go in parts: rows are those of a batch, in bounded frames; a
    key's disorder and an event without a key are errors."""
    monkeypatch.setattr(engine, "ROWS", 40)
    r = random.Random(3)
    rows = [(i, i * 1_000_000_000, r.choice([7, 7, 7, 2**60, 0, 3]), i, 1, r.randrange(4)) for i in range(400)]
    columns = [f.split()[0] for f in src.EVENT.split(", ")]
    made = engine.KeyedFeatures(features.ALPHA, MODEL, CADENCE)
    made.state, out = Held(), []
    for part in (rows[:200], rows[200:]):
        r.shuffle(part)
        out += made.handleInputRows((0,), iter([pd.DataFrame(part[a : a + 50], columns=columns) for a in range(0, 200, 50)]), None)
    assert [len(x) for x in out] == [40] * 10
    got = {x["seq"]: x for x in pd.concat(out).to_dict("records")}
    due = {x["seq"]: x for x in policies.publish(features.vector(spark.createDataFrame(rows, src.EVENT)), CADENCE).collect()}
    names = ["key", "event_ts_ns", *FEATURES, "published", "version_id", "pending"]
    assert {k: [x[n] for n in names] for k, x in got.items()} == {k: [x[n] for n in names] for k, x in due.items()}
    assert sorted(made.state.value[0]) == [0, 3, 7, 2**60]
    for wrong, told in (([rows[0]], "out of order"), ([(500, 10**15, None, 1, 1, 0)], "without a key")):
        with pytest.raises(ValueError, match=told):
            list(made.handleInputRows((0,), iter([pd.DataFrame(wrong, columns=columns)]), None))


def failing(spark, tmp_path, phase, **more):
    with pytest.raises(run.RunFailed) as e:
        go(spark, tmp_path.as_uri(), str(tmp_path / "report"), **more)
    told = json.loads((tmp_path / "report").read_text())
    assert e.value.phase == told["phase"] == phase and told["status"] == "failed"
    return told["error"]


def test_one_key_too_many(spark, tmp_path):
    """The micro-batch with the key beyond the budget is not public; with a larger budget the run goes on from there."""
    base, rows = tmp_path.as_uri(), some(0, 40, 4)
    put(spark, base, rows)
    assert go(spark, base, max_keys=4)["keys"] == 4
    put(spark, base, [(40, 40_000_000_000, 9, 1, 1, 0), (41, 41_000_000_000, 1, 1, 1, 0)])
    assert "5 keys, 4 at most" in failing(spark, tmp_path, "features", max_keys=4)
    assert run.public(spark, f"{base}/out").count() == 40
    got = go(spark, base, max_keys=5)
    assert (got["written"], got["keys"]) == (2, 5) and run.public(spark, f"{base}/out").count() == 42


def test_no_event(spark, tmp_path):
    put(spark, tmp_path.as_uri(), [*some(0, 10), (10, 10, 1, 1, 1, 9)])
    assert "no event" in failing(spark, tmp_path, "source")


def test_unreadable(spark, tmp_path):
    put(spark, tmp_path.as_uri(), some(0, 10))
    next((tmp_path / "in").glob("*.parquet")).write_bytes(b"no table")
    failing(spark, tmp_path, "source")


def test_disorder(spark, tmp_path):
    for rows in ([(5, 5, 1, 0, 0, 0)], [(4, 7, 1, 0, 0, 0)]):
        put(spark, tmp_path.as_uri(), rows)
    assert "out of order" in failing(spark, tmp_path, "features")


def test_score(spark, tmp_path):
    put(spark, tmp_path.as_uri(), some(0, 10))
    failing(spark, tmp_path, "score", model=src.LogisticModel(1e308, (1e308,) * 7))


def test_sink(spark, tmp_path):
    put(spark, tmp_path.as_uri(), some(0, 10))
    (tmp_path / "out").write_text("a file where the folder should be")
    failing(spark, tmp_path, "sink")


def test_deadline(spark, tmp_path):
    put(spark, tmp_path.as_uri(), some(0, 10))
    failing(spark, tmp_path, "deadline", timeout_s=0.05)
