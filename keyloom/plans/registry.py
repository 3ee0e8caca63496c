"""The queries over the events, one for each operator or small flow, and the SQL they are compared with."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.functions import columns as C
from keyloom.operators import cache, canonical, comparison, controllers, inference, labels, metrics, policies, reconcile, releases, replay, taxonomy, training, workload
from keyloom.operators import features as feat
from keyloom.plans.sql import SQL
from keyloom.sources import events as src
from keyloom.sources.store import shared_dir, written
from keyloom.sources.versions import VersionStore
from keyloom.streaming import engine, run, windows

# The model of the demonstration queries (its scores spread over the events table, whose gaps are hours), their horizon and end.
MODEL = src.LogisticModel(0.2, (0.4, -0.1, 0.3, 0.2, -0.4, 0.1, 0.000001))
HORIZON_NS, END_NS = 86_400 * C.NS, canonical.CAMPAIGN[1] * C.NS
CADENCE = policies.Policy("fixed_cadence", cadence=4)
# Configurations that are compared, by cadence.
CONFIGS = {"exact_fresh": 1, "tuned_static": 4, "slow_static": 9}
DAY_NS = 86_400 * C.NS


def r6(*names: str) -> list:
    return [C.rounded(F.col(n), 6).alias(n) for n in names]


def r9(*names: str) -> list:
    return [C.rounded(F.col(n), 9).alias(n) for n in names]


def _features(s: SparkSession, d: str) -> DataFrame:
    return feat.vector(src.events(s, d))


def _scored(s: SparkSession, d: str) -> DataFrame:
    return feat.scored(_features(s, d), MODEL).withColumn("score", C.rounded(F.col("score")))


def _labels(s: SparkSession, d: str) -> DataFrame:
    return labels.causal_labels(src.events(s, d), HORIZON_NS, END_NS)


def _cohort(s: SparkSession, d: str) -> DataFrame:
    return labels.assign_splits(_labels(s, d))


def _labelled(s: SparkSession, d: str) -> DataFrame:
    """seq, user_id, event_ts_ns, score, label of every event."""
    return _scored(s, d).select("seq", "event_ts_ns", F.col("key").alias("user_id"), "score").join(_labels(s, d).select("seq", "label"), "seq")


def _examined(s: SparkSession, d: str) -> DataFrame:
    """The labelled rows of the test split."""
    kept = _cohort(s, d).filter("split = 'test' and label is not null").select("seq", "label")
    return _scored(s, d).select("seq", "event_ts_ns", F.col("key").alias("user_id"), "score").join(kept, "seq")


def _cold_score(s: SparkSession) -> float:
    """The rounded score of a key without a published version: all of its features are zero."""
    zero = s.range(1).select(*[F.lit(0.0).alias(x) for x in C.FEATURES])
    return feat.scored(zero, MODEL).select(C.rounded(F.col("score"))).first()[0]


def _compared(s: SparkSession, d: str) -> DataFrame:
    """seq, user_id, config, group_id (the day), label, score: the labelled test rows with what each configuration has public then."""
    public = policies.cached_scores(_scored(s, d), CONFIGS, _cold_score(s))
    kept = _cohort(s, d).filter("split = 'test' and label is not null").select("seq", "label")
    rows = public.join(kept, "seq").withColumn("group_id", F.expr(f"cast(event_ts_ns div {DAY_NS} as string)"))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("config"), F.col(c).alias("score")) for c in CONFIGS]))
    return rows.select("seq", F.col("key").alias("user_id"), "group_id", "label", each.alias("x")).select("seq", "user_id", "group_id", "label", "x.*")


def _published(s: SparkSession, d: str) -> DataFrame:
    return policies.publish(_features(s, d), CADENCE)


def _ranked(s: SparkSession, d: str) -> DataFrame:
    return canonical.dense_index(src.events(s, d), ["seq"], "rank")


def _batches(s: SparkSession, d: str) -> DataFrame:
    """Batches of 100 events with the share of different keys in them as occupancy."""
    rows = written(_ranked(s, d), "ranked")
    share = rows.groupBy(F.expr("rank div 100").alias("generation")).agg((F.count_distinct("key").cast("double") / F.count("*")).alias("occupancy"))
    return controllers.occupancy_ema(controllers.fixed_batches(rows, 100).join(share, "generation"), 0.2)


def _trace(s: SparkSession, d: str) -> tuple[DataFrame, tuple]:
    rows = written(canonical.dense_index(src.events(s, d), ["seq"], "place"), "places")
    phases = workload.scaled(rows.count())
    return workload.schedule(rows, phases), phases


def _phases(s: SparkSession, d: str):
    n = src.raw_events(s, d).count()
    return lambda c: F.expr(f"{c} * 4 div {n}")


def _answers(df: DataFrame) -> DataFrame:
    return df.select("query_id", "key", "query_ts_ns", "cold_start", *cache.META, "event_time_age_ns", "update_staleness", C.rounded(F.col("feature_error"), 3).alias("feature_error"))


def released_events(s, d):
    """The canonical events as they are read from a release, with what its accounting tells of them."""
    path = f"{shared_dir(s)}/events-{uuid.uuid4().hex}"
    told = releases.publish_events(src.raw_events(s, d), path)["ledger"]
    return releases.events_of(s, path).select("*", *[F.lit(told[c]).alias(c) for c in ("raw", "outliers", "duplicates")])


def released_labels(s, d):
    path = f"{shared_dir(s)}/labels-{uuid.uuid4().hex}"
    releases.publish_labels(src.events(s, d), path, HORIZON_NS, END_NS)
    return releases.labels_of(s, path)


def top_users(s, d):
    g = _scored(s, d).groupBy("key").agg(F.count("*").alias("n"), C.rounded(F.avg("score")).alias("mean_score"))
    best = g.orderBy(F.desc("mean_score"), "key").limit(10)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("mean_score"), "key")))  # ten rows


def publish_quota(s, d):
    rows = _ranked(s, d)
    n = rows.count()
    return policies.publish(rows, policies.Policy("quota", quota=n // 5), "rank", n).select("seq", "key", "published", "version_id", "pending")


def publish_adaptive(s, d):
    pressure = F.when(F.expr("seq div 100") % 3 == 1, F.lit(0.85)).otherwise(F.lit(0.10))
    return policies.publish(src.events(s, d).withColumn("pressure", pressure), policies.Policy("adaptive", cadence=1, cadence_max=16)).select("seq", "key", "published", "version_id", "pending")


def _publish(policy: policies.Policy):
    return lambda s, d: policies.publish(src.events(s, d), policy).select("seq", "key", "published", "version_id", "pending")


def _committed(s: SparkSession, d: str) -> VersionStore:
    """A store to which three runs, one after another in seq, have committed what they published; the folder is a new one."""
    rows = written(_published(s, d).filter("published"), "published")
    last = (rows.agg(F.max("seq")).first()[0] or 0) + 1
    store = VersionStore(s, f"{shared_dir(s)}/versions-{uuid.uuid4().hex}", 8)
    for k in range(3):
        store.commit(rows.filter(F.expr(f"seq * 3 div {last} = {k}")))
    return store


def query_committed(s, d):
    found = _committed(s, d).lookup(src.queries(s, d))
    return found.select("query_id", "key", "cold_start", *[F.coalesce(F.col(m), F.lit(0)).alias(m) for m in cache.META], *r6(*C.FEATURES))


def publication_accounting(s, d):
    p = written(_published(s, d), "published")
    return policies.accounting(p, cache.query_final(src.queries(s, d), p))


def query_phase_end(s, d):
    phase = _phases(s, d)
    return _answers(cache.query_phase_end(src.queries(s, d), _published(s, d), phase("query_id"), phase("seq")))


def reconcile_status(s, d):
    """A cohort against predictions that were spoiled in each of the ways that must be found."""
    cohort = _cohort(s, d).filter("split = 'test'").select("seq", "user_id", "label")
    p = cohort.filter("seq % 101 != 0").withColumn("score", F.when(F.expr("seq % 97 = 0"), F.lit(1.5)).otherwise(F.lit(0.5))).withColumn("label", F.when(F.expr("seq % 89 = 0"), 1 - F.col("label")).otherwise(F.col("label")))
    spoiled = p.withColumn("user_id", F.when(F.expr("seq % 83 = 0"), F.col("user_id") + 1).otherwise(F.col("user_id")))
    return reconcile.reconcile(cohort, spoiled.unionByName(p.filter("seq % 103 = 0")).unionByName(p.filter("seq % 107 = 0").withColumn("seq", F.col("seq") + 1_000_000_000)))


def holm(s, d):
    h = src.table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("family"), (((F.col("n_nationkey") * 7) % 25 + 1).cast("double") / 500.0).alias("p"))
    return metrics.holm(h, by=("family",))


def ema_kernel_weights(s, d):
    alpha = F.lit(0.02) + F.lit(0.28) * ((F.col("item_id") % 10).cast("double") / 10.0)
    return feat.kernel_rows(src.events(s, d).select("key", "seq", alpha.alias("alpha"))).select("key", "i", *r9("weight"))


def ema_response(s, d):
    """Each key's response: steps by its number of events, frequencies by its number of purchases."""
    keys = src.events(s, d).groupBy("key").agg(F.count("*").alias("n"), F.count_if(F.col("behavior_code") == 3).alias("bought"))
    grid = keys.select("key", ((F.col("n") % 19 + 1) / 20.0).alias("alpha"), (F.col("bought") % 16 * F.lit(3.141592653589793) / 16.0).alias("omega"))
    r = C.ema_response(F.col("alpha"), F.col("omega"))
    one = grid.select("key", "alpha", "omega", r["real"].alias("re"), r["imag"].alias("im"), r["group_delay"].alias("group_delay"), C.variance_equivalent_span(F.col("alpha")).alias("span"))
    return one.select("key", "alpha", *r6("omega", "re", "im", "group_delay"), "span")


def stream_features(s, d):
    """The stream in two parts, each written by ranges of seq and then read as one micro-batch; features and publications as in batch."""
    base = f"{shared_dir(s)}/stream-{uuid.uuid4().hex}"
    rows = src.events(s, d)
    last = rows.agg(F.max("seq")).first()[0] or 0
    for k in range(2):
        rows.filter(F.expr(f"seq * 2 div {last + 1} = {k}")).repartitionByRange("seq").write.mode("append").parquet(f"{base}/events")
        stream = engine.feature_stream(engine.event_stream(s, f"{base}/events"), MODEL, feat.ALPHA, CADENCE)
        out = engine.replay(stream, f"{base}/out", f"{base}/checkpoint")
    return out.select("seq", "key", *r6(*C.FEATURES), "published", "version_id", "pending")


def stream_run_receipt(s, d):
    """Receipts of two runs over the events, each a range of seq, on one checkpoint."""
    base, rows = f"{shared_dir(s)}/run-{uuid.uuid4().hex}", src.events(s, d)
    last, receipts = rows.agg(F.max("seq")).first()[0] or 0, []
    for k in range(2):
        rows.filter(F.expr(f"seq * 2 div {last + 1} = {k}")).repartitionByRange("seq").write.mode("append").parquet(f"{base}/events")
        told = run.run(engine.event_stream(s, f"{base}/events"), MODEL, f"{base}/out", f"{base}/checkpoint", policy=CADENCE, alpha=feat.ALPHA)
        receipts.append((k, *[told[c] for c in (*run.STAGES, "published", "coalesced", "keys")]))
    return s.createDataFrame(receipts, "part int, read long, extracted long, scored long, written long, published long, coalesced long, keys long")


def stream_hourly_ledger(s, d):
    """Hours of a stream in which every seventh key's events come after all others: closed and open windows, and the rows that came too late."""
    base, rows = f"{shared_dir(s)}/hours-{uuid.uuid4().hex}", src.events(s, d)
    for late in (False, True):
        rows.filter((F.col("key") % 7 == 0) == late).write.mode("append").parquet(f"{base}/events")
        parts = engine.replay(windows.counted(engine.event_stream(s, f"{base}/events")), f"{base}/out", f"{base}/checkpoint")
    open_ = windows.open_windows(s, f"{base}/checkpoint")
    windows.conserved(rows.count(), parts, open_)
    late = windows.late(parts).groupBy("hour_s", "behavior_code").agg(F.sum("n").alias("n"))
    told = {"closed": windows.closed(parts), "open": open_, "late": late}
    return reduce(DataFrame.unionByName, [df.withColumn("kind", F.lit(kind)) for kind, df in told.items()])


def streaming_metrics(s, d):
    raw = src.raw_events(s, d)
    q = raw.filter("behavior is null").select(F.col("event_ts_ns").alias("query_ts_ns"), (F.col("event_ts_ns") - F.col("seq") % 7 * 1_000_000).alias("feature_ts_ns"), (F.col("seq") % 11).cast("double").alias("latency_ms"))
    valid = F.col("behavior").isNotNull()
    summary = raw.agg(F.count_if(valid).alias("events_processed"), F.count_if(valid & (F.col("seq") % 4 == 0)).alias("writes_emitted"), F.count_if(valid & (F.col("seq") % 4 != 0)).alias("events_absorbed"), F.count_if(~valid).alias("queries_offered"), F.count_if(~valid).alias("queries_answered"))
    out = reconcile.streaming_metrics(summary, q, 8.0)
    return out.select("coverage", "write_work_ratio", "conserved", "n_queries", *r9("mean_staleness_ms"), "max_staleness_ms", *r9("deadline_utility"))


def temporal_leaks(s, d):
    q = src.raw_events(s, d).filter("behavior is null")
    return reconcile.leaks(q.select(F.col("seq").cast("string").alias("query_id"), F.col("event_ts_ns").alias("query_ts_ns"), F.when(F.col("seq") % 13 == 0, F.col("event_ts_ns") + 1_000_000).when(F.col("seq") % 5 == 0, F.lit(None)).otherwise(F.col("event_ts_ns") - 5).alias("feature_ts_ns")))


def mean_scores(s, d):
    runs = _scored(s, d).select(F.col("seq").cast("string").alias("sample_id"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda r: F.col("score") * (1 + r * F.lit(0.01)))).alias("score"))
    return src.mean_scores(runs).select("sample_id", *r9("score"), "n_runs")


def pressure_maps(s, d):
    """Of each key, for a pressure that its number of events stands for, within bounds and beyond them."""
    p = src.events(s, d).groupBy("key").agg(F.count("*").alias("n")).select("key", ((F.col("n") % 29 - 4) / 20.0).alias("pressure"))
    return p.select("key", "pressure", C.cadence(F.col("pressure"), 1, 16).alias("cadence"), C.alpha_of(F.col("pressure")).alias("alpha"))


def loss_gap_summary(s, d):
    return metrics.loss_gap(_labelled(s, d).withColumn("base", F.lit(0.3)), "score", "base").select("n", *r6("mean_gap", "p95_gap", "max_gap"))


def phase_telemetry(s, d):
    trace, _ = _trace(s, d)
    rows = policies.publish(trace, policies.Policy("fixed_cadence", cadence=5))
    out = workload.phase_telemetry(rows)
    return out.select("phase", "events", "publications", "coalesced", *r9("mean_staleness"), "max_staleness", *r9("p95_staleness"), "conserved")


def policy_suite(s, d):
    g = workload.suite(_trace(s, d)[0]).groupBy("config", "phase").agg(F.count("*").alias("events"), F.count_if("published").alias("publications"), F.avg("pending").alias("mean_staleness"))
    return g.select("config", "phase", "events", "publications", *r9("mean_staleness"))


def policy_signatures(s, d):
    """What each configuration publishes and leaves pending, and whether that tells it from the others. All share one exchange by key."""
    rows = src.events(s, d).repartition("key")
    of = lambda k: policies.publish(rows, policies.Policy("fixed_cadence", cadence=k)).select(F.lit(k).alias("cadence"), F.col("published").cast("int").alias("publications"), F.col("pending").alias("staleness"))
    return inference.signatures(reduce(DataFrame.unionByName, map(of, CONFIGS.values())), "cadence", ["publications", "staleness"])


def budget_match(s, d):
    """The number a cadence of five publishes, as a quota: publications agree to the event."""
    rows = written(_ranked(s, d), "ranked")
    a = policies.publish(rows, policies.Policy("fixed_cadence", cadence=5))
    n = rows.count()
    quota = a.filter("published").count()
    return workload.budget_match(a, policies.publish(rows, policies.Policy("quota", quota=quota), "rank", n))


def factorial_effects(s, d):
    rows = feat.gaps(src.events(s, d)).select((F.col("seq") % 2).alias("a"), (F.col("item_id") % 2).alias("b"), "gap_s")
    return inference.factorial_effects(rows, "a", "b", "gap_s").select(*r6("m00", "m10", "m01", "m11", "effect_a", "effect_b", "synergy"))


def diagnostic_replay(s, d):
    """Recomputed features against emitted ones of which some were changed: the changed ones are found, and no other."""
    ours = written(_features(s, d).select("seq", *C.FEATURES), "features")
    emitted = ours.withColumn("x0", F.when(F.col("seq") % 211 == 0, F.col("x0") + F.lit(1e-3)).otherwise(F.col("x0")))
    return reconcile.differences(ours, emitted, "seq", list(C.FEATURES)).select("seq", "column", *r6("a", "b"))


def engine_replay(s, d):
    """Predictions with a step that changes from event to event, of which some were lost, doubled, invented or changed, against the events."""
    p = (F.col("seq") % 29 - 4) / 20.0
    made = feat.scored(feat.vector(src.events(s, d), C.alpha_of(p)), MODEL).withColumnRenamed("alpha", "alpha_used")
    told = written(replay.emitted(made, p, F.col("event_ts_ns")).filter("seq % 307 != 0"), "told")
    every = lambda n: F.col("seq") % n == 0
    changed = replay.spoiled(told, {
        "alpha_used": (every(401), F.lit(1.5)), "x0": (every(211), F.col("x0") + 1e-3), "x1": (every(199), F.col("x1") + 1e-3), "item_id": (every(193), F.col("item_id") + 1),
        "latency_ns": (every(223), F.lit(1_000_005)), "pressure_sampled_ns": (every(197), F.col("pressure_loaded_ns") + 1),
    })
    all_ = changed.unionByName(changed.filter(every(229))).unionByName(told.filter(every(233)).withColumn("seq", F.col("seq") + 1_000_000_000))
    found = replay.faults(src.events(s, d), all_, MODEL)
    seconds = lambda c: F.when(F.col("rule") == "pressure_sampled_ns", F.col(c) / 1e9).otherwise(F.col(c)).alias(c)
    return found.select("seq", "rule", seconds("told"), seconds("due")).select("seq", "rule", *r6("told", "due"))


def paired_sign_flip(s, d):
    """Losses of a slow cadence less those of fresh features, by day of the test."""
    pairs = comparison.paired(_compared(s, d), "slow_static", "exact_fresh")
    return inference.sign_flip(inference.group_sums(pairs)).select("n_clusters", *r9("mean_difference"), "p_value", "exact")


def paired_groups(s, d):
    """The same by swapping the two within the days, by sums and by ranks."""
    pairs = written(comparison.paired(_compared(s, d), "slow_static", "exact_fresh"), "pairs")
    found = [inference.paired_groups(pairs, m, draws=200) for m in ("log_loss", "brier", "f1", "auroc", "average_precision")]
    out = reduce(DataFrame.unionByName, found)
    return out.select("metric", *r9("effect"), "p_value", "n_clusters", "exact", "stratified")


def student_intervals(s, d):
    scores = written(_compared(s, d), "compared")
    found = [inference.student_interval(comparison.paired(scores, c, "exact_fresh"), "d").withColumn("config", F.lit(c)) for c in CONFIGS if c != "exact_fresh"]
    return found[0].unionByName(found[1]).select("config", "n", *r9("effect", "low", "high", "dz"))


def config_metrics(s, d):
    """Ranking and proper scores of each configuration, and its loss gaps against fresh features."""
    scores = written(_compared(s, d), "compared")
    ranked = metrics.ranking(scores, by=("config",))
    gaps = comparison.loss_gaps(scores, "exact_fresh").drop("n")
    return ranked.join(gaps, "config").select("config", "n", *r9("auroc", "ap", "mean_gap", "p95_gap", "max_gap"))


def comparative_suite(s, d):
    found = comparison.suite(written(_compared(s, d), "compared"), list(CONFIGS), "exact_fresh", "tuned_static", draws=200)
    return found.select("candidate", "base", "n", *r9("effect", "p_rows", "adjusted_rows"), "significant_rows", "n_clusters", *r9("p_clusters", "adjusted_clusters"), "significant_clusters")


def evaluated_with_default(s, d):
    """The test cohort with the scores of an engine that answered only even numbers: the rest get the default."""
    cohort = _cohort(s, d).filter("split = 'test'").select("seq", "user_id", "label")
    return src.with_default_score(cohort, _scored(s, d).filter("seq % 2 = 0"))


def validation_events(s, d):
    """The first thousand events of the validation split inside its window."""
    spec = labels.MONTH
    return src.window_events(src.events(s, d), spec.embargo1_end + 1, spec.validation_end, spec.embargo2_end + 1, 1000, _cohort(s, d)).select("seq", "key", "event_ts_ns")


def tune_static_cadence(s, d):
    """Cadences by what they cost on the labelled validation rows."""
    rows = _cohort(s, d).filter("split = 'validation' and label is not null").select("seq", "label")
    return policies.tune_cadence(_scored(s, d).select("seq", "key", "score"), rows, _cold_score(s)).select("cadence", "publications", *r9("work_ratio", "mean_gap", "objective"), "chosen")


def cluster_bootstrap(s, d):
    pairs = _labelled(s, d).filter("label is not null").select((F.col("seq") % 29).alias("group_id"), ((F.col("score") - F.col("label")) * (F.col("score") - F.col("label"))).alias("d"))
    return inference.bootstrap(inference.group_sums(pairs))


def train_logistic(s, d):
    """Weights fitted on the train split, beside those that know only the prior or x0, with the objective of each."""
    cohort, features = written(_cohort(s, d), "cohort"), written(_features(s, d), "features")
    rows = written(training.examples(features, cohort), "examples")
    narrow = rows.select("seq", "label", "x0")
    models = {"logistic": (rows, training.fit(rows)[0]), "x0_only": (narrow, training.fit(narrow)[0]), "prior": (rows, training.prior(rows))}
    found = []
    for name, (of, model) in models.items():
        weights = [F.lit(w).alias(f"w{i}") for i, w in enumerate((*model.weights, *(0.0,) * (7 - len(model.weights))))]
        found.append(training.loss_and_gradient(of, model).select(F.lit(name).alias("model"), "n", "objective", F.lit(model.bias).alias("bias"), *weights))
    return reduce(DataFrame.unionByName, found).select("model", "n", *r6("objective", "bias", *[f"w{i}" for i in range(7)]))


def workload_queries(s, d):
    trace, phases = _trace(s, d)
    return workload.phase_queries(trace, phases)


def cyclic_padding(s, d):
    rows = written(_ranked(s, d), "ranked")
    return workload.cyclic(rows, rows.count() * 5 // 2).select("place", "seq", "key")


def failure_taxonomy(s, d):
    """Failures of the test split; what happened before is told from the rows of all splits."""
    recent = taxonomy.recency(_cohort(s, d)).filter("label is not null")
    rows = written(recent.join(_scored(s, d).select("seq", "score"), "seq"), "examined")
    return taxonomy.prevalence(taxonomy.classify(rows)).select("category", "severity", "n", *r6("share"))


def activity_terciles(s, d):
    return taxonomy.by_tier(written(_compared(s, d), "compared"), ("config",)).select("tier", "config", "n", *r9("auroc", "ap"))


QUERIES = {
    "canonical_events": lambda s, d: canonical.canonical(src.raw_events(s, d)),
    "exclusion_ledger": lambda s, d: canonical.ledger(src.raw_events(s, d)),
    "behavior_profile": lambda s, d: canonical.behaviour_profile(src.events(s, d)),
    "data_profile": lambda s, d: canonical.data_profile(src.raw_events(s, d)),
    "event_order_violations": lambda s, d: canonical.order_violations(src.events(s, d)),
    "key_budget": lambda s, d: canonical.key_budget(src.events(s, d), 1_000_000),
    "keyed_counts": lambda s, d: feat.counts(src.events(s, d)).select("seq", "key", "pv", "cart_fav", "buy", "n"),
    "gap_feature": lambda s, d: feat.gaps(src.events(s, d)).select("seq", "key", "gap_s"),
    "engagement_ema": lambda s, d: _features(s, d).select("seq", "key", F.col("x0").alias("engagement_ema")),
    "gap_ema": lambda s, d: _features(s, d).select("seq", "key", F.col("x6").alias("gap_ema")),
    "feature_vector": lambda s, d: _features(s, d).select("seq", "key", *r6(*C.FEATURES)),
    "logistic_score": lambda s, d: _scored(s, d).select("seq", "key", "score"),
    "top_users": top_users,
    "causal_labels": _labels,
    "released_events": released_events,
    "released_labels": released_labels,
    "label_manifest": lambda s, d: labels.manifest(_labels(s, d)),
    "cohort_splits": _cohort,
    "evaluated_cohort": lambda s, d: labels.evaluated_only(_cohort(s, d)).select("seq", "split", "group_id", "label"),
    "split_summary": lambda s, d: labels.split_summary(_cohort(s, d)),
    "test_groups": lambda s, d: labels.group_counts(_cohort(s, d)),
    "ood_users": lambda s, d: _cohort(s, d).filter("split = 'ood'").groupBy("user_id").agg(F.count("*").alias("n")),
    "fit_users": lambda s, d: labels.fit_users(_cohort(s, d)),
    "ood_overlaps": lambda s, d: labels.overlaps(_cohort(s, d)),
    "publish_exact_fresh": _publish(policies.Policy("exact_fresh")),
    "publish_cadence": _publish(CADENCE),
    "publish_elapsed": _publish(policies.Policy("elapsed", elapsed_ns=HORIZON_NS)),
    "publish_adaptive": publish_adaptive,
    "publish_quota": publish_quota,
    "cache_versions": lambda s, d: cache.versions(_published(s, d)).select("key", *cache.META, *r6(*C.FEATURES)),
    "cache_latest": lambda s, d: cache.latest(cache.versions(_published(s, d))).select("key", *cache.META, *r6(*C.FEATURES)),
    "cache_committed": lambda s, d: _committed(s, d).latest().select("key", *cache.META, *r6(*C.FEATURES)),
    "query_committed": query_committed,
    "query_final_state": lambda s, d: _answers(cache.query_final(src.queries(s, d), _published(s, d))),
    "query_asof_before": lambda s, d: _answers(cache.query_asof(src.queries(s, d), _published(s, d))),
    "query_phase_end": query_phase_end,
    "publication_accounting": publication_accounting,
    "auroc_ap": lambda s, d: metrics.ranking(_labelled(s, d)).select("n", *r9("auroc", "ap")),
    "ap_untied": lambda s, d: metrics.ap_untied(_labelled(s, d), "seq").select(*r9("ap")),
    "proper_scores": lambda s, d: metrics.proper_scores(_labelled(s, d), 0.8).select("n", *r9("accuracy", "f1", "brier", "log_loss")),
    "reliability_curve": lambda s, d: metrics.reliability(_labelled(s, d)).select("bin", "n", *r9("mean_score", "observed")),
    "loss_gap_summary": loss_gap_summary,
    "metric_summary": lambda s, d: metrics.summary(feat.gaps(src.events(s, d)), "gap_s", ("behavior_code",)).select("behavior_code", "n", *r6("mean", "std", "min", "max", "p50", "p95", "p99", "cv")),
    "upper_medians": lambda s, d: metrics.upper_median(feat.gaps(src.events(s, d)), "gap_s", ("behavior_code",)),
    "line_fit": lambda s, d: metrics.line_fit(feat.gaps(src.events(s, d)).groupBy("key").agg(F.count("*").alias("k"), F.sum("gap_s").alias("total")), "k", "total").select(*r6("slope", "intercept"), "n"),
    "holm": holm,
    "ema_kernel_weights": ema_kernel_weights,
    "ema_response": ema_response,
    "reconcile_status": reconcile_status,
    "dispositions": lambda s, d: reconcile.dispositions(src.raw_events(s, d), "behavior"),
    "diagnostic_replay": diagnostic_replay,
    "engine_replay": engine_replay,
    "streaming_metrics": streaming_metrics,
    "temporal_leaks": temporal_leaks,
    "mean_scores": mean_scores,
    "burst_count": lambda s, d: taxonomy.recency(_cohort(s, d)).select("seq", "user_id", "burst", "prior", "gap_s"),
    "failure_taxonomy": failure_taxonomy,
    "activity_terciles": activity_terciles,
    "config_metrics": config_metrics,
    "paired_groups": paired_groups,
    "student_intervals": student_intervals,
    "comparative_suite": comparative_suite,
    "evaluated_with_default": evaluated_with_default,
    "validation_events": validation_events,
    "fixed_batches": lambda s, d: controllers.fixed_batches(_ranked(s, d), 100),
    "occupancy_ema": lambda s, d: _batches(s, d).select("generation", "occupancy", "occupancy_ema"),
    "alpha_slew": lambda s, d: controllers.alpha_slew(_batches(s, d), pressure="occupancy_ema").select("generation", *r9("alpha")),
    "mimd_batches": lambda s, d: controllers.batch_sizes(_batches(s, d), pressure="occupancy_ema").select("generation", "batch_target"),
    "controller_actions": lambda s, d: controllers.controller_actions(src.events(s, d), "behavior_code", "seq", ("key",)),
    "pressure_maps": pressure_maps,
    "tune_static_cadence": tune_static_cadence,
    "actuator_grid": lambda s, d: workload.grid(src.events(s, d)),
    "workload_trace": lambda s, d: _trace(s, d)[0].select("place", "seq", "key", "phase", "phase_idx", "t_sched_ns"),
    "workload_queries": workload_queries,
    "phase_telemetry": phase_telemetry,
    "policy_suite": policy_suite,
    "policy_signatures": policy_signatures,
    "budget_match": budget_match,
    "cyclic_padding": cyclic_padding,
    "factorial_effects": factorial_effects,
    "paired_sign_flip": paired_sign_flip,
    "cluster_bootstrap": cluster_bootstrap,
    "train_logistic": train_logistic,
    "hourly_counts": lambda s, d: engine.hourly(src.events(s, d)),
    "stream_features_batch_parity": stream_features,
    "stream_run_receipt": stream_run_receipt,
    "stream_hourly_ledger": stream_hourly_ledger,
}

ORACLE_SQL = {k: v for k, v in SQL.items() if k in QUERIES}
