"""Reconciling predictions with a cohort, and telemetry with its own rules. Every check can fail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


STALENESS = ("mean_staleness_ms", "max_staleness_ms")


class Mismatch(ValueError):
    """What did not reconcile, by status."""


def reconcile(cohort: DataFrame, predictions: DataFrame) -> DataFrame:
    """seq and status of every row of either side. Cohort: seq, user_id, label; predictions: seq, user_id, score, label (optional)."""
    if "label" not in predictions.columns:
        predictions = predictions.withColumn("label", F.lit(None).cast("int"))
    per = predictions.groupBy("seq").agg(F.count("*").alias("copies"), F.min("user_id").alias("p_user"), F.min("score").alias("score"), F.min("label").alias("p_label"))
    both = cohort.select("seq", F.col("user_id").alias("c_user"), F.col("label").alias("c_label"), F.lit(1).alias("there")).join(per, "seq", "full_outer")
    sound = F.col("score").isNotNull() & ~F.isnan("score") & F.col("score").between(0, 1)
    status = (
        F.when(F.col("there").isNull(), "phantom").when(F.col("copies").isNull(), "missing").when(F.col("copies") > 1, "duplicate").when(~F.col("p_user").eqNullSafe(F.col("c_user")), "key_mismatch")
        .when(F.col("p_label").isNotNull() & ~F.col("p_label").eqNullSafe(F.col("c_label")), "label_tampered").when(~sound, "bad_score").otherwise("ok")
    )
    return both.select("seq", status.alias("status"))


def checked(statuses: DataFrame) -> dict[str, int]:
    """Counts by status; raises unless all are ok and there are some."""
    found = {r["status"]: r["n"] for r in statuses.groupBy("status").agg(F.count("*").alias("n")).collect()}
    if set(found) != {"ok"}:
        raise Mismatch(str(found or "nothing to reconcile"))
    return found


class SuppressedMisses(Mismatch):
    """Rows of the evaluated split without a prediction."""


class PhantomSamples(Mismatch):
    """Predictions for rows that are in no split."""


def checked_split(cohort: DataFrame, predictions: DataFrame, split: str = "test", key: str = "sample_id") -> DataFrame:
    """Rows of ``split`` with their score; raises where a prediction is there twice, is for no row of the cohort, or is missing for a row of
    the split. Rows of other splits may go without."""
    per = predictions.groupBy(key).agg(F.count("*").alias("copies"), F.min("score").alias("score"))
    both = cohort.select(key, "split", "label").join(per, key, "full_outer")
    found = both.agg(F.count_if(F.col("copies") > 1).alias("twice"), F.count_if(F.col("split").isNull()).alias("phantom"), F.count_if((F.col("split") == split) & F.col("copies").isNull()).alias("missing")).first()
    for error, n in ((Mismatch, found["twice"]), (PhantomSamples, found["phantom"]), (SuppressedMisses, found["missing"])):
        if n:
            raise error(f"{n} rows")
    return both.filter(F.col("split") == split).select(key, "label", "score")


def dispositions(predictions: DataFrame, column: str = "disposition") -> DataFrame:
    return predictions.groupBy(F.coalesce(F.col(column), F.lit("served")).alias("disposition")).agg(F.count("*").alias("n"))


def leaks(queries: DataFrame) -> DataFrame:
    """Queries that a later feature answered, with the lead in ns; rows without either time say nothing."""
    return queries.filter(F.col("feature_ts_ns") > F.col("query_ts_ns")).select("query_id", (F.col("feature_ts_ns") - F.col("query_ts_ns")).alias("leak_ns"))


def streaming_metrics(summary: DataFrame, queries: DataFrame, sla_ms: float) -> DataFrame:
    """One row: coverage, write-work ratio, conservation, mean and max staleness, share of queries within the deadline
    (a missing latency counts as met; without queries 1). Staleness is that of the queries with both times; where there are none it is
    what the summary itself says, or 0. Fails when read if no queries were offered."""
    stale = F.when(F.col("query_ts_ns").isNotNull() & F.col("feature_ts_ns").isNotNull(), F.greatest(F.lit(0), F.col("query_ts_ns") - F.col("feature_ts_ns")) / 1e6)
    none_offered = F.raise_error(F.lit("queries_offered must be positive")).cast("double")
    met = (F.coalesce("latency_ms", F.lit(0.0)) <= sla_ms).cast("int")
    q = queries.agg(F.count("*").alias("n_queries"), F.avg(stale).alias("mean_staleness_ms"), F.max(stale).alias("max_staleness_ms"), F.coalesce(F.avg(met), F.lit(1.0)).alias("deadline_utility"))
    s = summary.select(
        F.when(F.col("queries_offered") > 0, F.col("queries_answered") / F.col("queries_offered")).otherwise(none_offered).alias("coverage"), (F.col("writes_emitted") / F.greatest(F.lit(1), F.col("events_processed"))).alias("write_work_ratio"),
        (F.col("events_processed") == F.col("writes_emitted") + F.col("events_absorbed")).alias("conserved"),
        *[(F.col(c) if c in summary.columns else F.lit(None).cast("double")).alias(f"told_{c}") for c in STALENESS],
    )
    both = s.crossJoin(q)  # one row each
    return both.withColumns({c: F.coalesce(c, f"told_{c}", F.lit(0.0)) for c in STALENESS}).drop(*[f"told_{c}" for c in STALENESS])


def differences(ours: DataFrame, theirs: DataFrame, key: str, columns: list[str], rel: float = 2e-12, abs_: float = 2e-14) -> DataFrame:
    """Rows of either side that the other lacks or that differ by more than the tolerance: key, column, both values."""
    a = ours.select(key, *[F.col(c).cast("double").alias(f"a_{c}") for c in columns], F.lit(True).alias("in_a"))
    b = theirs.select(key, *[F.col(c).cast("double").alias(f"b_{c}") for c in columns], F.lit(True).alias("in_b"))
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"a_{c}").alias("a"), F.col(f"b_{c}").alias("b")) for c in columns])).alias("x")
    rows = a.join(b, key, "full_outer").select(key, (F.col("in_a").isNull() | F.col("in_b").isNull()).alias("lone"), cells).select(key, "lone", "x.*")
    close = (F.col("a") == F.col("b")) | (F.abs(F.col("a") - F.col("b")) <= F.greatest(F.lit(abs_), F.lit(rel) * F.greatest(F.abs("a"), F.abs("b"))))
    return rows.filter(F.col("lone") | ~F.coalesce(close, F.col("a").isNull() & F.col("b").isNull())).select(key, "column", "a", "b")
