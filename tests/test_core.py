"""Closed-form vectors, invariances, mutations and boundaries of the events engine."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.functions import columns as C
from keyloom.functions.fold import ordered_fold
from keyloom.operators import cache, canonical, controllers, features, inference, labels, metrics, policies, reconcile, taxonomy, training, workload
from keyloom.sources import events as src
from keyloom.sources import sinks
from keyloom.streaming import engine

S = C.NS


def events(spark, rows):
    """rows: (seq, seconds, key, code)"""
    return spark.createDataFrame([(q, int(t * S), k, i, 1, c) for i, (q, t, k, c) in enumerate(rows)], src.EVENT)


def raw(spark, rows):
    return spark.createDataFrame(rows, "seq long, event_ts_ns long, key long, item_id long, category_id long, behavior string")


MODEL = src.LogisticModel(0.2, (0.4, -0.1, 0.3, 0.2, -0.4, 0.1, 0.01))


def test_closed_form_features(spark):
    got = features.scored(features.vector(events(spark, [(10, 0, 1, 0), (30, 1, 1, 3), (70, 2, 2, 1)])), MODEL).orderBy("seq").collect()
    ln2 = math.log(2)
    want = [[0.1, ln2, 0, 0, 0, 0, 0], [0.59, ln2, 0, 1 / 3600, 0.5, ln2, 0.1], [0.3, 0, ln2, 0, 0, 0, 0]]
    for r, w in zip(got, want, strict=True):
        assert [r[x] for x in C.FEATURES] == pytest.approx(w, abs=1e-15)
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-(0.2 + sum(a * b for a, b in zip(MODEL.weights, w, strict=True))))))


def test_time_zero_counts_as_seen(spark):
    got = features.vector(events(spark, [(0, 0, 1, 0), (1, 1, 1, 0)]), alpha=1.0).orderBy("seq").collect()
    assert [r["x6"] for r in got] == [0.0, 1.0]


def test_features_do_not_depend_on_partitions_or_row_order(spark):
    r = random.Random(1)
    rows = [(i, i * 0.5, r.randrange(9), r.randrange(4)) for i in range(400)]
    a = features.vector(events(spark, rows)).select("seq", *C.FEATURES).orderBy("seq").collect()
    r.shuffle(rows)
    assert a == features.vector(events(spark, rows).repartition(7)).select("seq", *C.FEATURES).orderBy("seq").collect()
    state, alpha = {}, 0.1  # an independent fold
    for q, t, k, c in sorted(rows):
        s, g, last = state.get(k, (0.0, 0.0, None))
        gap = 0.0 if last is None else (int(t * S) - last) / 1e9
        s += alpha * (C.WEIGHTS[c] - s)
        g += alpha * (gap - g)
        state[k] = s, g, int(t * S)
        assert a[q]["x0"] == s and a[q]["x6"] == g


def test_long_key_in_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        df = spark.range(1000).select((F.col("id") % 2).alias("key"), "id", F.lit(1.0).alias("x"))
        got = ordered_fold(df, ["key"], ["id"], ["x"], lambda: 0.0, lambda s, x: (s + x, s + x), "total double").groupBy("key").agg(F.max("total"), F.count("*")).collect()
        assert {tuple(r)[1:] for r in got} == {(500.0, 500)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_canonical(spark):
    t = 1_704_100_000 * S
    rows = [(0, t, 10, 1, 1, "buy"), (1, t, 5, 2, 1, "buy"), (2, t, 5, 1, 1, "cart"), (3, t, 5, 1, 1, "fav"), (4, t, 5, 1, 1, "pv"), (5, t, 5, 1, 1, "pv"), (6, -5, 1, 1, 1, "pv"), (7, 5, 1, 1, 1, "pv"), (8, t * 2, 1, 1, 1, "pv"), (9, t, 1, 1, 1, None)]
    got = canonical.canonical(raw(spark, rows)).orderBy("seq").collect()
    assert [(r["seq"], r["key"], r["item_id"], r["behavior_code"]) for r in got] == [(0, 5, 1, 0), (1, 5, 1, 2), (2, 5, 1, 1), (3, 5, 2, 3), (4, 10, 1, 3)]
    one = canonical.ledger(raw(spark, rows)).first()
    assert (one["raw"], one["n_negative"], one["n_before"], one["n_after"], one["n_domain"], one["duplicates"], one["emitted"], one["conserved"]) == (10, 1, 1, 1, 1, 1, 5, True)
    random.Random(2).shuffle(rows)
    assert canonical.canonical(raw(spark, rows).repartition(5)).orderBy("seq").collect() == got
    assert canonical.ledger(raw(spark, [])).first()["conserved"] and canonical.canonical(raw(spark, [])).count() == 0


def test_campaign_bounds_are_inclusive(spark):
    a, b = canonical.CAMPAIGN
    rows = [(i, t, 1, 1, 1, "pv") for i, t in enumerate((a * S - 1, a * S, b * S, b * S + 1))]
    assert [r["reason"] for r in canonical.with_reason(raw(spark, rows)).orderBy("seq").collect()] == ["before", None, None, "after"]


def test_order_checks(spark):
    bad = events(spark, [(0, 5, 1, 0), (1, 4, 1, 0), (1, 9, 2, 0), (2, 8, 3, 0)])
    one = canonical.order_violations(bad).first()
    assert one["duplicate_seq"] == 1 and one["key_regressions"] == 1 and one["global_regressions"] == 2
    with pytest.raises(Exception, match="out of order"):
        canonical.checked_order(bad).count() and canonical.checked_order(bad).collect()
    assert canonical.key_budget(bad, 2).first()["within_budget"] is False


def test_dense_index(spark):
    df = spark.range(1000).withColumn("v", F.col("id") * 7919 % 1000).repartition(9)
    assert canonical.dense_index(df, ["v"], "i").filter("i != v").count() == 0


def test_labels_at_bounds(spark):
    e = events(spark, [(0, 5, 1, 3), (1, 5, 1, 0), (2, 15, 1, 3), (3, 25, 2, 3), (4, 15, 2, 0)])
    got = {r["seq"]: (r["label"], r["censored"], r["positive_witness_seq"]) for r in labels.causal_labels(e, 10 * S, 100 * S).collect()}
    assert got[0] == (1, 0, 2) and got[1] == (1, 0, 2) and got[4] == (1, 0, 3) and got[2] == (0, 0, None)
    late = {r["seq"]: (r["label"], r["censored"]) for r in labels.causal_labels(e, 10 * S, 20 * S).collect()}
    assert late[0] == (1, 0) and late[2] == (None, 1) and late[4] == (None, 1)  # even though a buy is seen


def test_splits(spark):
    spec = labels.SplitSpec(0, 9 * 3600 - 1, 11 * 3600 - 1, 15 * 3600 - 1, 17 * 3600 - 1, 20 * 3600 - 1, 24 * 3600 - 1, 10)
    assert spec.holds(7200) and not spec.holds(7201)
    with pytest.raises(ValueError):
        labels.SplitSpec(0, 9, 5, 12, 13, 14, 15)
    rows = [(q, h * 3600, k, 0) for q, (h, k) in enumerate((h, k) for h in range(22) for k in range(1, 60))]
    c = labels.assign_splits(labels.causal_labels(events(spark, rows), 3600 * S, 21 * 3600 * S), spec)
    kinds = {r["split"]: r["n"] for r in labels.split_summary(c).collect()}
    assert set(kinds) == {"train", "train_embargo", "validation", "val_embargo", "test", "tail_censored", "ood"} and kinds["ood"] > 0
    assert tuple(labels.overlaps(c).first()) == (0, 0, 0)
    assert {r["group_id"] for r in c.filter("split = 'test'").select("group_id").distinct().collect()} == {f"test_hour_{h:02d}" for h in range(3)}
    assert c.filter("split = 'tail_censored' and label is not null").count() == 0
    assert {r["split"] for r in labels.evaluated_only(c).select("split").distinct().collect()} == {"train", "validation", "test", "ood"}


def test_policies(spark):
    ten = events(spark, [(i, i, 1, 0) for i in range(10)])
    got = policies.publish(ten, policies.Policy("fixed_cadence", cadence=4)).orderBy("seq").collect()
    assert [r["published"] for r in got].count(True) == 2 and got[-1]["pending"] == 2 and got[-1]["version_id"] == 2
    one = policies.accounting(policies.publish(ten, policies.Policy("fixed_cadence", cadence=4))).first()
    assert (one["processed"], one["published"], one["coalesced"], one["conserved"]) == (10, 2, 8, True)
    assert [r["published"] for r in policies.publish(ten, policies.Policy("elapsed", elapsed_ns=3 * S)).orderBy("seq").collect()] == [i % 3 == 0 for i in range(10)]
    quota = policies.publish(ten, policies.Policy("quota", quota=3), total=10).orderBy("seq").collect()
    acc, want = 0, []
    for _ in range(10):
        acc += 3
        want.append(acc >= 10)
        acc -= 10 * (acc >= 10)
    assert [r["published"] for r in quota] == want
    for pressure, k in ((0.1, 2), (0.85, 13), (5.0, 16), (-1.0, 1)):
        adaptive = policies.publish(events(spark, [(i, i, 1, 0) for i in range(40)]).withColumn("pressure", F.lit(pressure)), policies.Policy("adaptive", cadence=1, cadence_max=16))
        assert adaptive.filter("published").count() == 40 // k
    assert policies.Policy.of("FixedCadence", 5) == policies.Policy("fixed_cadence", 5) and policies.Policy.of("ADAPTIVE").cadence_max == 16
    with pytest.raises(ValueError):
        policies.Policy.of("whenever")


def test_cold_pending_and_warm_queries(spark):
    p = policies.publish(features.vector(events(spark, [(0, 0, 42, 0), (1, 1, 42, 1), (2, 2, 42, 3), *[(3 + i, 3 + i, 7, 0) for i in range(5)]])), policies.Policy("fixed_cadence", cadence=5))
    q = spark.createDataFrame([(1, 999, 9 * S), (2, 42, 9 * S), (3, 7, 9 * S), (4, 7, 1 * S)], src.QUERY)
    got = {r["query_id"]: r for r in cache.query_final(q, p).collect()}
    assert got[1]["cold_start"] and got[1]["feature_error"] == 0 and got[1]["update_staleness"] == 0 and got[1]["event_time_age_ns"] == 9 * S
    assert got[2]["cold_start"] and got[2]["version_id"] == 0 and got[2]["update_staleness"] == 3 and got[2]["feature_error"] > 0
    assert not got[3]["cold_start"] and got[3]["version_id"] == 1 and got[3]["feature_error"] == 0 and got[3]["event_time_age_ns"] == 2 * S and got[4]["event_time_age_ns"] == 0


def test_metrics(spark):
    def rank(y, s):
        r = metrics.ranking(spark.createDataFrame(list(zip(y, s, strict=True)), "label int, score double")).first()
        return r["auroc"], r["ap"]

    assert rank([0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9]) == (1, 1) and rank([0, 0, 1, 1], [0.9, 0.8, 0.2, 0.1])[0] == 0 and rank([0, 1, 0, 1], [0.5] * 4) == (0.5, 0.5) and rank([1, 1], [0.1, 0.2]) == (None, None)
    one = metrics.proper_scores(spark.createDataFrame([(1, 0.9), (0, 0.1), (1, 0.8), (0, 0.2), (1, 0.7)], "label int, score double")).first()
    assert one["accuracy"] == one["f1"] == 1 and one["brier"] == pytest.approx(0.038)
    half = metrics.proper_scores(spark.createDataFrame([(1, 0.5), (0, 0.5)], "label int, score double")).first()
    assert half["log_loss"] == pytest.approx(math.log(2))
    r = random.Random(3)
    y, s = [r.randrange(2) for _ in range(200)], [r.randrange(20) / 20 for _ in range(200)]
    pos, neg = [b for a, b in zip(y, s, strict=True) if a], [b for a, b in zip(y, s, strict=True) if not a]
    assert rank(y, s)[0] == pytest.approx(np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg]))
    bins = metrics.reliability(spark.createDataFrame([(1, 1.0), (0, 0.95)], "label int, score double")).orderBy("bin").collect()
    assert (bins[9]["n"], bins[9]["observed"], bins[0]["mean_score"]) == (2, 0.5, 0.05)


def test_holm(spark):
    for p, want in (([0.005, 0.01, 0.03, 0.04], [0.02, 0.03, 0.06, 0.06]), ([0.04, 0.005, 0.03, 0.01], [0.06, 0.02, 0.06, 0.03])):
        df = spark.createDataFrame(list(enumerate(p)), "id int, p double")
        assert [r["adjusted"] for r in metrics.holm(df).orderBy("id").collect()] == pytest.approx(want)


def test_reconciliation_can_fail(spark):
    cohort = spark.createDataFrame([(100 + i, i, i % 2) for i in range(1, 6)], "seq long, user_id long, label int")
    good = [(100 + i, i, 0.5, i % 2) for i in range(1, 6)]
    frame = lambda rows: spark.createDataFrame(rows, "seq long, user_id long, score double, label int")
    assert reconcile.checked(reconcile.reconcile(cohort, frame(good))) == {"ok": 5}
    for change in ([*good, good[0]], [*good, (999, 1, 0.5, 1)], [(101, 9, 0.5, 1), *good[1:]], [(101, 1, 0.5, 0), *good[1:]], good[1:], [(101, 1, float("nan"), 1), *good[1:]], [(101, 1, 1.01, 1), *good[1:]]):
        with pytest.raises(reconcile.Mismatch):
            reconcile.checked(reconcile.reconcile(cohort, frame(change)))


def test_replay_finds_each_mutation(spark):
    ours = features.scored(features.vector(events(spark, [(i, i, i % 3, i % 4) for i in range(60)])), MODEL)
    columns = [*C.FEATURES, "score"]
    assert reconcile.differences(ours, ours, "seq", columns).count() == 0
    for c in columns:
        changed = ours.withColumn(c, F.when(F.col("seq") == 17, F.col(c) + 1e-9).otherwise(F.col(c)))
        assert [(r["seq"], r["column"]) for r in reconcile.differences(ours, changed, "seq", columns).collect()] == [(17, c)]
    assert reconcile.differences(ours, ours.filter("seq != 4"), "seq", ["x0"]).count() == 1


def test_controllers(spark):
    one = spark.createDataFrame([(0, None), (1, 1.0), (2, 1.0)], "generation long, pressure double")
    assert [r["alpha"] for r in controllers.alpha_slew(one).orderBy("generation").collect()] == pytest.approx([0.01, 0.11, 0.21])
    idle = spark.createDataFrame([(0, 0.0), (1, 0.3), (2, 0.9)], "generation long, pressure double")
    assert [r["batch_target"] for r in controllers.batch_sizes(idle, controllers.BatchSize(8, 256, 0.3, 0.7, 0.7, 1.01)).orderBy("generation").collect()] == [9, 9, 8]
    for n in (0, 1, 7, 8, 9, 17, 257):
        rows = events(spark, [(i, i, 1, 0) for i in range(n)]).withColumn("rank", F.col("seq"))
        got = controllers.fixed_batches(rows, 8).collect()
        assert sum(r["actual_count"] for r in got) == n and sum(r["is_tail"] for r in got) == (n % 8 > 0)
    with pytest.raises(ValueError):
        controllers.AlphaSlew(low=0.5, high=0.1)


def test_kernel_and_response(spark):
    alphas, x, s0 = [0.02, 0.3, 0.1, 0.2], [1.0, 5.0, 2.0, 3.0], 2.5
    w = spark.createDataFrame([(alphas,)], "alphas array<double>").select(features.kernel_weights().alias("w")).first()["w"]
    s = s0
    for a, v in zip(alphas, x, strict=True):
        s += a * (v - s)
    assert sum(w) == pytest.approx(1) and sum(a * b for a, b in zip(w, [*x, s0], strict=True)) == pytest.approx(s)
    r = C.ema_response(F.lit(0.1), F.lit(0.0))
    assert spark.range(1).select(r["group_delay"].alias("d"), r["real"].alias("re")).first()[:] == (pytest.approx(9), pytest.approx(1))


def test_inference(spark):
    assert [inference.student_t_critical(0.05, df) for df in (1, 4, 30)] == pytest.approx([12.7062, 2.7764, 2.0423], abs=1e-3)
    sums = spark.createDataFrame([(i, float(d), 1) for i, d in enumerate([1, 2, 3, 4])], "group_id int, d_sum double, n long")
    one = inference.sign_flip(sums).first()
    assert one["exact"] and one["p_value"] == 2 / 16 and one["mean_difference"] == 2.5
    many = spark.createDataFrame([(i, 1.0 + i % 3, 1) for i in range(25)], "group_id int, d_sum double, n long")
    drawn = inference.sign_flip(many, draws=500).first()
    assert not drawn["exact"] and drawn["p_value"] < 0.02
    b = inference.bootstrap(many, draws=400).first()
    assert b["low"] < b["mean_difference"] < b["high"] and b["bca_low"] < b["mean_difference"] < b["bca_high"]


def test_bursts_against_counting(spark):
    r = random.Random(5)
    rows = [(i, r.randrange(0, 40_000), r.randrange(4)) for i in range(150)]
    df = spark.createDataFrame([(i, t * S, k) for i, t, k in rows], "seq long, event_ts_ns long, user_id long").withColumn("split", F.lit("test"))
    got = {x["seq"]: (x["burst"], x["prior"]) for x in taxonomy.recency(df).collect()}
    for i, t, k in rows:
        earlier = [(b, a) for a, b, c in rows if c == k and (b, a) < (t, i)]
        assert got[i] == (sum(b >= t - 3600 for b, _ in earlier), len(earlier))


def test_workload(spark):
    phases = workload.PHASES
    assert sum(p.events for p in phases) == 27_000 and sum(p.queries for p in phases) == 5_000
    rows = workload.cyclic(events(spark, [(i, i, i % 100, 0) for i in range(500)]).withColumn("rank", F.col("seq")), 27_000)
    s = workload.schedule(rows, phases).cache()
    assert s.count() == 27_000 and workload.phase_queries(s, phases).count() == 5_000
    t = {r["phase"]: r for r in workload.phase_telemetry(policies.publish(s.drop("seq").withColumnRenamed("place", "seq"), policies.Policy("fixed_cadence", cadence=5))).collect()}
    assert t[None]["events"] == 27_000 and all(r["conserved"] for r in t.values())
    sig = inference.signatures(workload.suite(s).withColumn("p", F.col("published").cast("int")), "config", ["p", "pending"])
    assert sig.filter("distinct").count() == len(workload.CONFIGS)
    with pytest.raises(ValueError):
        workload.cyclic(rows.limit(0), 5)


def test_training_ignores_test_labels(spark):
    r = random.Random(6)
    f = features.vector(events(spark, [(i, i, r.randrange(20), r.randrange(4)) for i in range(400)])).cache()
    cohort = [(i, "train" if i < 300 else "test", r.randrange(2)) for i in range(400)]
    frame = lambda rows: spark.createDataFrame(rows, "seq long, split string, label int")
    a, history = training.fit(training.examples(f, frame(cohort)))
    b, _ = training.fit(training.examples(f, frame([(i, s, 1 - y if s == "test" else y) for i, s, y in cohort])))
    assert a == b and history[-1] <= history[0]


def test_streaming_metrics(spark):
    summary = spark.createDataFrame([(100, 20, 80, 4, 4)], "events_processed long, writes_emitted long, events_absorbed long, queries_offered long, queries_answered long")
    q = spark.createDataFrame([("a", 1000, 2000, 1.0), ("b", 5000, 4000, None)], "query_id string, query_ts_ns long, feature_ts_ns long, latency_ms double")
    one = reconcile.streaming_metrics(summary, q, 5.0).first()
    assert (one["coverage"], one["write_work_ratio"], one["conserved"], one["deadline_utility"]) == (1.0, 0.2, True, 1.0)
    assert [(r["query_id"], r["leak_ns"]) for r in reconcile.leaks(q).collect()] == [("a", 1000)]
    assert not reconcile.streaming_metrics(summary.withColumn("events_absorbed", F.lit(70)), q, 5.0).first()["conserved"]


def test_stream_refuses_disorder(spark, tmp_path):
    base = tmp_path.as_uri()
    for rows in ([(5, 5, 1, 0), (6, 6, 1, 3)], [(4, 7, 1, 0)]):
        events(spark, rows).coalesce(1).write.mode("append").parquet(f"{base}/in")
    with pytest.raises(Exception, match="out of order|STREAM_FAILED"):
        engine.replay(engine.feature_stream(engine.event_stream(spark, f"{base}/in"), MODEL), f"{base}/out", f"{base}/check")


def test_files(spark, tmp_path):
    path = tmp_path / "events.csv"
    path.write_text("seq,event_ts_ns,key,item_id,category_id,behavior_code\n0,5,1,2,3,0\n1,6,1,2,3,3\n")
    assert src.read_events_csv(spark, str(path)).count() == 2
    path.write_text("seq,event_ts_ns,key,item_id,category_id,behavior_code\n0,5,1,2,x,0\n")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        src.read_events_csv(spark, str(path)).collect()
    rawfile = tmp_path / "raw.csv"
    rawfile.write_text("1,2,3,pv,1704100000\n1,2,3,buy,-5\n")
    assert {r["timestamp_s"] for r in src.read_raw_csv(spark, str(rawfile)).collect()} == {1704100000, -5}
    for bad in ("1,2,3,pv", "1,2,,pv,5", "-1,2,3,pv,5", "1,2,3,look,5", "1,2,3,pv,5,6"):
        rawfile.write_text(bad + "\n")
        with pytest.raises(Exception, match="malformed"):
            src.read_raw_csv(spark, str(rawfile)).collect()
    q = tmp_path / "q.csv"
    q.write_text("query_id,event_ts_ns,key,query_ts_ns\n1,0,7,9\n2,0,,9\n")
    assert [tuple(r) for r in src.read_queries_csv(spark, str(q)).collect()] == [(1, 7, 9)]
    t = tmp_path / "t.json"
    t.write_text(json.dumps({"summary": {"events_processed": 3}, "queries": [{"query_id": "a", "query_ts_ns": 5}]}, indent=1))
    s, qs = src.read_telemetry(spark, str(t))
    assert s.first()["events_processed"] == 3 and qs.first()["query_id"] == "a"
    assert src.inventory(spark, str(tmp_path)).filter("kind = 'data'").count() == 4
    with pytest.raises(ValueError):
        src.unique_json('{"a": 1, "a": 2}')
    with pytest.raises(ValueError):
        src.unique_json('{"a": NaN}')


def test_model_files_and_sinks(spark, tmp_path):
    path = str(tmp_path / "m.txt")
    model = src.LogisticModel(0.1 + 0.2, tuple(1 / (i + 3) for i in range(7)))
    model.save(path)
    assert src.LogisticModel.load(path) == model
    lines = open(path).read().splitlines()
    for bad in (lines[1:], [*lines, lines[-1]], lines[:-1], [*lines[:-1], "w6=inf"], [*lines[:-1], "w9=1"], [lines[0], "bias= 1", *lines[2:]]):
        open(path, "w").write("\n".join(bad))
        with pytest.raises(ValueError):
            src.LogisticModel.load(path)
    df = spark.createDataFrame([(1, True)], "n long, ok boolean")
    assert sinks.write_report(df, str(tmp_path / "r.json")) == {"n": 1, "ok": True} and not list(tmp_path.glob("*.pending"))
    sinks.write_csv(df, f"{tmp_path}/csv")
    with pytest.raises(Exception, match="exists"):
        sinks.write_csv(df, f"{tmp_path}/csv")
    assert [sinks.new_attempt(str(tmp_path)).name for _ in range(2)] == ["attempt0001", "attempt0002"]


def test_small_columns(spark):
    df = spark.createDataFrame([("12",), ("-1",), ("99999999999999999999",), ("1.5",), (" 1",), ("nan",), ("1e400",)], "t string")
    assert [r[0] for r in df.select(C.digits_only(F.col("t"))).collect()] == [12, None, None, None, None, None, None]
    assert [r[0] for r in df.select(C.finite_decimal(F.col("t"))).collect()] == [12.0, -1.0, 1e20, 1.5, None, None, None]
    p = spark.createDataFrame([("read /home/me/x.csv and /tmp/abc/d, not a/b",)], "t string").select(C.without_folders(F.col("t"))).first()[0]
    assert p == "read x.csv and d, not a/b"
