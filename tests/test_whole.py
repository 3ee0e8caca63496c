"""Operators over events beside plain versions, on inputs where a part of the job is easily left out."""

import json
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.functions import running
from keyloom.functions import columns as C
from keyloom.operators import cache, canonical, comparison, features, inference, metrics, policies, reconcile, taxonomy, training, workload
from keyloom.plans import registry
from keyloom.sources import events as src
from keyloom.sources import sinks
from keyloom.sources.pulled import pulled
from keyloom.streaming import engine


def test_kernel_rows(spark):
    r = random.Random(24)
    alphas = {1: [r.uniform(0, 0.3) for _ in range(20_000)], 2: [0.1, 1.0, 0.2], 3: [1.0], 4: [0.0, 0.5]}
    rows = [(k, i * 3, a) for k, xs in alphas.items() for i, a in enumerate(xs)]
    r.shuffle(rows)
    got = {(x["key"], x["i"]): x["weight"] for x in features.kernel_rows(spark.createDataFrame(rows, "key long, seq long, alpha double")).collect()}
    assert len(got) == len(rows) + len(alphas)
    for k, xs in alphas.items():
        left = 1.0
        for i in reversed(range(len(xs))):
            assert got[k, i] == pytest.approx(xs[i] * left, abs=1e-13)
            left *= 1 - xs[i]
        assert got[k, len(xs)] == pytest.approx(left, abs=1e-13)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_kernel_holds_no_key(spark):
    plan = registry.ema_kernel_weights(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "collect_list" not in plan


def test_running_sums(spark):
    r = random.Random(25)
    rows = [(r.choice("abc"), r.randrange(50), i, r.randrange(9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, s int, o int, v int").repartition(6)
    for by in ((), ("g",)):
        got = {x["o"]: x["v_before"] for x in running.before(df, [F.col("s").desc(), F.col("o")], ["v"], by).collect()}
        total = {}
        for g, s, o, v in sorted(rows, key=lambda x: (-x[1], x[2])):
            key = g if by else None
            assert got[o] == total.get(key, 0)
            total[key] = total.get(key, 0) + v


def test_quantiles(spark):
    r = random.Random(26)
    rows = [(k, r.choice([float(r.randrange(5)), r.gauss(0, 9)])) for k in "ab" for _ in range(r.randint(1, 400))] + [("c", 7.0), ("c", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    for x in metrics.summary(df, "v", ("k",)).collect():
        mine = [v for k, v in rows if k == x["k"] and v is not None]
        assert [x["p50"], x["p95"], x["p99"]] == pytest.approx(np.quantile(mine, [0.5, 0.95, 0.99]).tolist())
    medians = {x["k"]: x["upper_median"] for x in metrics.upper_median(df, "v", ("k",)).collect()}
    assert medians == {k: sorted(v for q, v in rows if q == k and v is not None)[sum(q == k and v is not None for q, v in rows) // 2] for k in "abc"}


def test_history_before_the_split_changes_the_category(spark):
    """Two events before the test within the hour make a miss one of lagging features; without them it is one after silence."""
    hour, t0 = 3600, 1_000_000
    early = [(1, t0 - 900, "validation"), (2, t0 - 600, "val_embargo")]
    test = [(10 + k, t0 + k * 5 * hour, "test") for k in range(5)]
    scores = spark.createDataFrame([(10, 0.1, 1), (11, 0.9, 0), (12, 0.5, 0), (13, 0.6, 0), (14, 0.2, 0)], "seq long, score double, label int")

    def categories(rows):
        df = spark.createDataFrame([(i, t * 1_000_000_000, 7, s) for i, t, s in rows], "seq long, event_ts_ns long, user_id long, split string")
        return {x["seq"]: (x["category"], x["prior"], x["gap_s"], x["threshold"]) for x in taxonomy.classify(taxonomy.recency(df).join(scores, "seq")).collect()}

    with_, without = categories(early + test), categories(test)
    assert with_[10] == ("stale_feature_lag_fn", 0, 600.0, 0.5) and without[10] == ("inter_arrival_decay_obsolescence", 0, None, 0.5)
    assert with_[11][0] == "cold_start_miscalibration_fp" and with_[11][1] == 1
    assert with_[12][:2] == ("cold_start_miscalibration_fp", 2) and with_[13][:2] == ("other", 3) and with_[14][0] == "none"
    shares = {x["category"]: x["n"] for x in taxonomy.prevalence(taxonomy.classify(taxonomy.recency(spark.createDataFrame([(10, 0, 7, "test")], "seq long, event_ts_ns long, user_id long, split string")).join(scores, "seq"))).collect()}
    assert set(taxonomy.CATEGORIES) <= set(shares) and sum(shares.values()) == 1


def test_student_quantiles():
    """Beside the density, integrated."""
    for df in (1, 2, 3, 4, 5, 10, 31, 400):
        t = inference.student_t_critical(0.05, df)
        x = np.linspace(0, t, 200_001)
        log = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi)
        y = np.exp(log - (df + 1) / 2 * np.log1p(x * x / df))
        assert 2 * float(((y[1:] + y[:-1]) / 2).sum() * (x[1] - x[0])) == pytest.approx(0.95, abs=1e-8)
    assert inference.student_t_critical(0.05, 200_000) == pytest.approx(inference.student_t_critical(0.05, 99_999), abs=1e-4)


def plain_metric(metric, y, p):
    if metric == "accuracy":
        return np.mean((p >= 0.5) == y)
    if metric == "brier":
        return np.mean((p - y) ** 2)
    if metric == "log_loss":
        return -np.mean(np.log(np.where(y == 1, p, 1 - p)))
    if metric == "f1":
        return 2 * np.sum((p >= 0.5) * y) / (np.sum(p >= 0.5) + np.sum(y))
    pos, neg = p[y == 1], p[y == 0]
    if metric == "auroc":
        return np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg))
    total = 0.0
    for s in np.unique(p):
        at = p >= s
        total += np.sum((p == s) * y) / np.sum(y) * np.sum(at * y) / np.sum(at)
    return total


@pytest.mark.parametrize("metric", inference.METRICS)
def test_paired_groups_beside_enumeration(spark, metric):
    r = np.random.default_rng(27)
    n, k = 60, 5
    y, g = r.integers(0, 2, n), r.integers(0, k, n)
    a = np.round(np.clip(0.5 + (y - 0.5) * 0.4 + r.normal(0, 0.2, n), 0.01, 0.99), 2)
    b = np.round(np.clip(0.5 + (y - 0.5) * 0.1 + r.normal(0, 0.2, n), 0.01, 0.99), 2)
    sign = -1 if metric in inference.LOSSES else 1
    value = lambda a, b, y=y: sign * (plain_metric(metric, y, a) - plain_metric(metric, y, b))
    observed, hits = value(a, b), 0
    for p in range(2**k):
        swap = (p >> g) & 1 == 1
        hits += abs(value(np.where(swap, b, a), np.where(swap, a, b))) >= abs(observed) - 1e-12
    rows = spark.createDataFrame([(f"g{i}", int(l), float(p), float(q)) for i, l, p, q in zip(g, y, a, b, strict=True)], "group_id string, label int, a double, b double")
    x = inference.paired_groups(rows, metric, draws=60).first()
    assert x["exact"] and x["n_clusters"] == k and x["effect"] == pytest.approx(observed) and x["p_value"] == hits / 2**k
    assert x["degenerate"] or x["low"] < x["high"]
    assert x["invalid_draws"] == 0 or x["degenerate"]


def test_paired_groups_refuses(spark):
    bad = lambda *rows: spark.createDataFrame(rows, "group_id string, label int, a double, b double")
    for rows in ([("a", 1, 0.5, 0.5)], [("a", 1, 0.5, 0.5), ("b", 1, 0.5, 0.5)], [("a", 1, 1.5, 0.5), ("b", 0, 0.5, 0.5)], [(" ", 1, 0.5, 0.5), ("b", 0, 0.5, 0.5)], [("a", 2, 0.5, 0.5), ("b", 0, 0.5, 0.5)]):
        with pytest.raises(ValueError):
            inference.paired_groups(bad(*rows), "brier", draws=10)
    one_class = bad(*[(f"g{k}", k % 2, 0.3 + 0.05 * k, 0.5) for k in range(8) for _ in range(2)])
    assert inference.paired_groups(one_class, "brier", draws=50).first()["stratified"]


def test_interval_by_definition():
    """Without bias or skew the accelerated interval is the percentile one; skew moves it; what is not defined is none."""
    draws = np.sort(np.random.default_rng(28).normal(0, 1, 20_001))
    even = inference.accelerated(draws, float(np.median(draws)), [np.array([-1.0, 1.0, -2.0, 2.0])])
    assert even == pytest.approx(np.quantile(draws, [0.025, 0.975]).tolist(), abs=0.02)
    skewed = inference.accelerated(draws, float(np.median(draws)), [np.array([-3.0, 1.0, 1.0, 1.0])])
    assert skewed[0] > even[0] and skewed[1] > even[1]
    assert inference.accelerated(np.ones(5), 1.0, [np.ones(3)]) is None


def test_rows_flipped(spark):
    """The distributed p-value beside a plain one, whatever the partitions."""
    r = np.random.default_rng(29)
    for shift in (0.0, 0.15):
        d = r.normal(shift, 1, 400)
        df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(d)], "seq long, d double")
        p = inference.row_sign_flip(df, "d", "seq", 2000)
        plain = np.mean(np.abs((r.integers(0, 2, (4000, 400)) * 2 - 1) @ d) >= abs(d.sum()))
        assert p == pytest.approx(plain, abs=0.05) and p == inference.row_sign_flip(df.repartition(7), "d", "seq", 2000)


def test_suite(spark):
    r = np.random.default_rng(30)
    rows = []
    for i in range(300):
        y = int(r.integers(0, 2))
        good = float(np.clip(0.5 + (y - 0.5) * 0.6 + r.normal(0, 0.1), 0.02, 0.98))
        rows += [(i, c, f"h{i % 6}", y, s) for c, s in (("fresh", good), ("same", good), ("bad", 0.5))]
    scores = spark.createDataFrame(rows, "seq long, config string, group_id string, label int, score double")
    got = {(x["candidate"], x["base"]): x for x in comparison.suite(scores, ["fresh", "same", "bad"], "fresh", "same", draws=300).collect()}
    assert set(got) == {("same", "fresh"), ("bad", "fresh"), ("bad", "same")}
    assert got["same", "fresh"]["effect"] == 0 and got["same", "fresh"]["p_rows"] == 1 and got["same", "fresh"]["p_clusters"] == 1
    worse = got["bad", "fresh"]
    assert worse["low"] < worse["effect"] < worse["high"] and worse["low"] > 0 and worse["p_rows"] < 0.01 and worse["significant_rows"] and worse["p_clusters"] == 2 / 64
    gaps = {x["config"]: x["mean_gap"] for x in comparison.loss_gaps(scores, "fresh").collect()}
    assert gaps["fresh"] == gaps["same"] == 0 < gaps["bad"]
    with pytest.raises(ValueError):
        comparison.suite(scores, ["bad"], "fresh")


def test_cohorts_that_fail(spark, tmp_path):
    head = "seq,user_id,event_ts_ns,split,group_id,label,censored\n"
    path = tmp_path / "cohort.csv"

    def load(text, split="validation"):
        path.write_text(text)
        return src.evaluation_cohort(spark, str(path), split)

    good = head + "1,5,10,validation,h1,1,0\n2,5,11,validation,h1,,1\n3,6,12,test,h2,0,0\n4,6,13,validation,h1,0,0\n"
    assert sorted(x["seq"] for x in load(good).collect()) == [1, 4]
    for text, split in ((good, "train"), (head, "validation"), (good + "1,5,10,validation,h1,1,0\n", "validation"), (good + "9,5,10,validation,h1,2,0\n", "validation"), (good + "9,5,10,validation, ,1,0\n", "validation"), (good + "x,5,10,validation,h1,1,0\n", "validation"), (good + "9,5,10,validation,h1,,0\n", "validation"), ("seq,label\n1,1\n", None)):
        with pytest.raises(src.BadCohort):
            load(text, split)


def test_window_of_events(spark):
    rows = spark.createDataFrame([(i, i * 1_000_000_000, 1) for i in range(100)], "seq long, event_ts_ns long, key long")
    assert [x["seq"] for x in src.window_events(rows, 10, 60, 50, 5).orderBy("seq").collect()] == [10, 11, 12, 13, 14]
    assert src.window_events(rows, 10, 60, 50, 500).count() == 40
    cohort = spark.createDataFrame([(12, "validation"), (13, "test"), (70, "validation")], "seq long, split string")
    assert [x["seq"] for x in src.window_events(rows, 10, 60, 50, 5, cohort).collect()] == [12]
    with pytest.raises(ValueError):
        src.window_events(rows, 200, 300, 400, 5)


def test_reports(spark, tmp_path):
    with pytest.raises(KeyError), sinks.failure_report(str(tmp_path / "failed.json"), "reading"):
        raise KeyError("gone")
    assert json.loads((tmp_path / "failed.json").read_text()) == {"status": "failed", "phase": "reading", "kind": "KeyError", "error": "'gone'"}
    with sinks.failure_report(str(tmp_path / "none.json"), "reading"):
        pass
    assert not (tmp_path / "none.json").exists()
    model = src.LogisticModel(0.1, (1 / 3,) * 7)
    rows = spark.createDataFrame([(1,), (0,), (0,)], "label int")
    found = sinks.model_manifest(model, [0.7, 0.5], rows, str(tmp_path / "model.json"))
    assert found["rows_by_label"] == {"0": 2, "1": 1} and float(found["values"]["w0"]) == 1 / 3 and len(found["sha256"]) == 64
    df = spark.createDataFrame([(1, 1 / 3, True)], "a long, b double, c boolean")
    sinks.write_layout(df, str(tmp_path / "out"), ["c", "b"])
    head, row = next(t for p in (tmp_path / "out").glob("*.csv") if len(t := p.read_text().split()) == 2)
    assert head == "c,b" and row.startswith("1,") and float(row[2:]) == 1 / 3
    with pytest.raises(ValueError):
        sinks.write_layout(df, str(tmp_path / "more"), sinks.ANSWER_COLUMNS)
    assert len(sinks.PREDICTION_COLUMNS) == 26 and len(sinks.ANSWER_COLUMNS) == 24


@pytest.mark.parametrize("policy", [policies.Policy("elapsed", elapsed_ns=40_000_000_000), policies.Policy("adaptive", cadence=1, cadence_max=6)])
def test_streams_publish_as_batches(spark, tmp_path, policy):
    """Policies on a stream of three micro-batches beside the same in a batch, and what the cache holds in the end."""
    r = random.Random(31)
    rows = [(i, i * 7_000_000_000, r.randrange(4), i, 1, r.randrange(4), r.random()) for i in range(120)]
    df = spark.createDataFrame(rows, "seq long, event_ts_ns long, key long, item_id long, category_id long, behavior_code int, pressure double")
    base = tmp_path.as_uri()
    schema = df.schema
    for k in range(3):
        df.filter(F.expr(f"seq div 40 = {k}")).write.mode("append").parquet(f"{base}/in")
        stream = engine.feature_stream(spark.readStream.schema(schema).parquet(f"{base}/in"), registry.MODEL, policy=policy)
        engine.cache_stream(stream, f"{base}/cache", f"{base}/check").awaitTermination()
    batch = policies.publish(features.vector(df), policy).filter("published")
    last = {x["key"]: (x["version_id"], x["seq"]) for x in batch.orderBy("seq").collect()}
    assert {x["key"]: (x["version_id"], x["latest_included_seq"]) for x in engine.latest_versions(spark, f"{base}/cache").collect()} == last
    assert spark.read.parquet(f"{base}/cache").count() == batch.count()


def test_order_across_ranges(spark):
    r = random.Random(32)
    times = [r.randrange(1000) for _ in range(2000)]
    df = spark.createDataFrame([(i * 3, t, i % 5) for i, t in enumerate(times)], "seq long, event_ts_ns long, key long").repartition(9)
    one = canonical.order_violations(df).first()
    assert one["global_regressions"] == sum(a > b for a, b in zip(times, times[1:], strict=False)) and one["duplicate_seq"] == 0
    assert one["key_regressions"] == sum(a > b for a, b in zip(times, times[5:], strict=False))
    assert canonical.within_budget(df, 5).count() == 2000
    with pytest.raises(ValueError):
        canonical.within_budget(df, 4)
    assert sum(p.events for p in workload.scaled(1003)) == 1003


def test_files_by_name(spark, tmp_path):
    (tmp_path / "e.csv").write_text("key,seq,behavior_code,event_ts_ns,item_id,category_id\n7,1,3,10,2,2\n\n7,2,x,11,2,2\n")
    assert [tuple(x) for x in src.read_events_by_name(spark, str(tmp_path / "e.csv")).collect()] == [(1, 10, 7, 2, 2, 3)]
    (tmp_path / "t.csv").write_text("a,b\n1,x y\n2,z\n")
    assert sorted(tuple(x) for x in src.read_table_csv(spark, str(tmp_path / "t.csv"), ["a", "b"]).collect()) == [("1", "x y"), ("2", "z")]
    with pytest.raises(ValueError):
        src.read_table_csv(spark, str(tmp_path / "t.csv"), ["b", "a"])
    for bad in ("1,", '1,"x"', "1,x,2", "1,\u00e9"):
        (tmp_path / "bad.csv").write_text(f"a,b\n{bad}\n")
        with pytest.raises(Exception, match="malformed table row"):
            src.read_table_csv(spark, str(tmp_path / "bad.csv"), ["a", "b"]).collect()
    before = src.inventory(spark, str(tmp_path)).select("path", "sha256", "lines", "header")
    rows = {x["path"].rpartition("/")[2]: x for x in before.collect()}
    assert rows["t.csv"]["lines"] == 3 and rows["t.csv"]["header"] == "a,b"
    held = spark.createDataFrame(before.collect(), before.schema)
    (tmp_path / "t.csv").write_text("a,b\n")
    (tmp_path / "new.txt").write_text("x")
    (tmp_path / "e.csv").unlink()
    changes = {x["path"].rpartition("/")[2]: x["what"] for x in src.changed_files(held, src.inventory(spark, str(tmp_path))).collect()}
    assert changes == {"t.csv": "changed", "new.txt": "added", "e.csv": "removed"}


def test_checked_split(spark):
    cohort = spark.createDataFrame([("a", "test", 1), ("b", "test", 0), ("c", "train", 0)], "sample_id string, split string, label int")
    scores = lambda *ids: spark.createDataFrame([(i, 0.5) for i in ids], "sample_id string, score double")
    assert reconcile.checked_split(cohort, scores("a", "b")).count() == 2
    for ids, error in ((("a",), reconcile.SuppressedMisses), (("a", "b", "z"), reconcile.PhantomSamples), (("a", "a", "b"), reconcile.Mismatch)):
        with pytest.raises(error):
            reconcile.checked_split(cohort, scores(*ids))
    one = cache.size(spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "key long, version_id long")).first()
    assert tuple(one) == (2, 3)


def test_training_finds_the_optimum(spark):
    """At the fitted weights the gradient of mean log loss plus half the penalty times the squared weights is zero; no step lowers it."""
    r = np.random.default_rng(40)
    x = r.normal(0, 1, (500, 7)) * [1, 2, 0.5, 1, 1, 3, 1]
    y = (r.random(500) < 1 / (1 + np.exp(-(x @ [0.5, -0.3, 1, 0, 0.2, 0.1, -1] + 0.4)))).astype(int)
    rows = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "seq long, " + ", ".join(f"{f} double" for f in C.FEATURES))
    cohort = spark.createDataFrame([(i, "train", int(v)) for i, v in enumerate(y)], "seq long, split string, label int")
    model, history = training.fit(training.examples(rows, cohort))
    w = np.array(model.weights)
    off = 1 / (1 + np.exp(-(x @ w + model.bias))) - y
    assert np.abs(x.T @ off / 500 + 1e-4 * w).max() < 1e-5 and abs(off.mean()) < 1e-5
    assert history == sorted(history, reverse=True)


def test_bootstrap_beside_plain_version(spark):
    """Intervals of the distributed draws beside those of other draws made here; clusters of unequal size weigh by their rows."""
    r = np.random.default_rng(41)
    sizes = r.integers(5, 60, 25)
    sums = np.array([r.normal(0.2, 1, k).sum() for k in sizes])
    df = spark.createDataFrame([(i, float(a), int(b)) for i, (a, b) in enumerate(zip(sums, sizes, strict=True))], "group_id long, d_sum double, n long")
    got = inference.bootstrap(df, draws=4000).first()
    picks = r.integers(0, 25, (4000, 25))
    means = sums[picks].sum(axis=1) / sizes[picks].sum(axis=1)
    assert got["mean_difference"] == pytest.approx(sums.sum() / sizes.sum())
    assert (got["low"], got["high"]) == pytest.approx(tuple(np.quantile(means, [0.025, 0.975])), abs=0.02)
    left = (sums.sum() - sums) / (sizes.sum() - sizes)
    assert (got["bca_low"], got["bca_high"]) == pytest.approx(inference.accelerated(means, sums.sum() / sizes.sum(), [left]), abs=0.03)
    assert inference.bootstrap(df.repartition(5), draws=4000).first() == got


def test_staleness_of_queries_with_both_times(spark):
    columns = "events_processed long, writes_emitted long, events_absorbed long, queries_offered long, queries_answered long, mean_staleness_ms double, max_staleness_ms double"
    summary = spark.createDataFrame([(10, 2, 8, 4, 3, 7.5, 9.0)], columns)
    q = spark.createDataFrame([("a", 5_000_000, 1_000_000, 1.0), ("b", 9_000_000, None, 9.0), ("c", None, 1, None)], "query_id string, query_ts_ns long, feature_ts_ns long, latency_ms double")
    one = reconcile.streaming_metrics(summary, q, 5.0).first()
    assert (one["mean_staleness_ms"], one["max_staleness_ms"], one["coverage"]) == (4.0, 4.0, 0.75)
    told = reconcile.streaming_metrics(summary, q.filter("query_id != 'a'"), 5.0).first()
    assert (told["mean_staleness_ms"], told["max_staleness_ms"]) == (7.5, 9.0)
    none = reconcile.streaming_metrics(summary.drop("mean_staleness_ms", "max_staleness_ms"), q.limit(0), 5.0).first()
    assert (none["mean_staleness_ms"], none["deadline_utility"]) == (0.0, 1.0)
    with pytest.raises(Exception, match="queries_offered must be positive"):
        reconcile.streaming_metrics(summary.withColumn("queries_offered", F.lit(0)), q, 5.0).collect()


def test_scores_are_finite(spark):
    rows = spark.createDataFrame([(1, *[1e308] * 7)], "seq long, " + ", ".join(f"{f} double" for f in C.FEATURES))
    assert features.scored(rows, src.LogisticModel(0.0, (1e-308, *[0.0] * 6))).count() == 1
    with pytest.raises(Exception, match="not finite"):
        features.scored(rows, src.LogisticModel(0.0, (10.0,) * 7)).collect()


def test_faults_of_a_source(spark):
    good = [("a", 5, 1, "pv"), ("b", 6, 0, "buy")]
    schema = "source_id string, event_ts_ns long, key long, behavior string"
    assert canonical.checked_source(spark.createDataFrame(good, schema), 10).count() == 2
    bad = [*good, ("a", 7, 1, "pv"), (" c", 7, 1, "pv"), ("", 7, 1, "pv"), (None, 7, 1, "pv"), ("d", 11, 1, "pv"), ("e", -1, -1, "pv"), ("f", None, None, "look")]
    rows = spark.createDataFrame(bad, schema)
    assert canonical.source_faults(rows, 10).first().asDict() == {"bad_ids": 3, "repeated_ids": 1, "bad_times": 3, "bad_keys": 2, "bad_behaviors": 1}
    with pytest.raises(ValueError, match="repeated_ids"):
        canonical.checked_source(rows, 10)


def test_pulled_rows(spark):
    rows = pulled(spark, lambda part: ((part * 10 + i, i, part, 0, 0, 0) for i in range(part)), 4)
    assert sorted(x["seq"] for x in rows.collect()) == [10, 20, 21, 30, 31, 32] and rows.rdd.getNumPartitions() == 4
    assert features.vector(rows).count() == 6


def test_streams_are_accounted(spark, tmp_path):
    """Counts in the progress of a stream beside the same from a batch."""
    rows = [(i, i * 1_000_000_000, i % 3, i, 1, i % 4) for i in range(60)]
    df = spark.createDataFrame(rows, src.EVENT)
    base = tmp_path.as_uri()
    for k in range(2):
        df.filter(F.expr(f"seq div 30 = {k}")).coalesce(1).write.mode("append").parquet(f"{base}/in")
    policy = policies.Policy("fixed_cadence", cadence=4)
    stream = engine.observed(engine.feature_stream(engine.event_stream(spark, f"{base}/in", files_per_batch=1), registry.MODEL, policy=policy))
    query = engine.cache_stream(stream, f"{base}/cache", f"{base}/check")
    query.awaitTermination()
    n = policies.publish(df, policy).filter("published").count()
    assert engine.accounted(query) == {"processed": 60, "published": n, "coalesced": 60 - n}
