"""Why predictions fail: bursts, dormant keys, cold keys, narrow margins; and metrics by activity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.columns import NS
from keyloom.operators.metrics import ranking, upper_median


def recency(rows: DataFrame, window_s: int = 3600, split: str = "test") -> DataFrame:
    """Rows of ``split`` with burst (earlier rows of the key within the window, ends included), gap_s (since the key's last row, null for
    its first) and prior (earlier rows of the key in the split). Burst and gap look at the rows of all splits.
    Rows of one time stand in the order of seq: burst is a row's place less the rows older than the window."""
    w = Window.partitionBy("user_id").orderBy("event_ts_ns", "seq")
    older = F.count("*").over(Window.partitionBy("user_id").orderBy("event_ts_ns").rangeBetween(Window.unboundedPreceding, -window_s * NS - 1))
    inside = F.coalesce(F.count_if(F.col("split") == split).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    gap = (F.col("event_ts_ns") - F.lag("event_ts_ns").over(w)) / F.lit(float(NS))
    return rows.withColumns({"prior": inside, "burst": F.row_number().over(w) - 1 - older, "gap_s": gap}).filter(F.col("split") == split)


# The categories of failures, how severe they are, and the margin of the last.
CATEGORIES = {"stale_feature_lag_fn": "SEV-2", "inter_arrival_decay_obsolescence": "SEV-2", "cold_start_miscalibration_fp": "SEV-3", "marginal_decision_ambiguity": "SEV-4"}
MARGIN = 0.002


def classify(rows: DataFrame, margin: float = MARGIN, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``threshold`` (the upper median of the scores, of each group ``by``) and ``category`` to rows with label, score, burst,
    gap_s, prior: the first that fits. A miss with two or more rows within the hour before; a miss after more than an hour of silence or
    with nothing before; a false call with at most two earlier rows; a failure whose score is near the threshold. Else "other", and
    "none" for what is right or has no label."""
    tau = upper_median(rows, "score", by).withColumnRenamed("upper_median", "threshold")
    rows = rows.join(tau, list(by)) if by else rows.crossJoin(F.broadcast(tau))  # one row
    miss = (F.col("label") == 1) & (F.col("score") < F.col("threshold"))
    false = (F.col("label") == 0) & (F.col("score") >= F.col("threshold"))
    silent = F.coalesce(F.col("gap_s") > 3600, F.lit(True))
    lag, decay, cold, close = CATEGORIES
    category = F.when(miss & (F.col("burst") >= 2), lag).when(miss & silent, decay).when(false & (F.col("prior") <= 2), cold)
    category = category.when((miss | false) & (F.abs(F.col("score") - F.col("threshold")) < margin), close)
    return rows.withColumn("category", category.when(miss | false, "other").otherwise("none"))


def prevalence(classified: DataFrame) -> DataFrame:
    """category, severity, n and share of all rows; the four categories always, others where they occur."""
    g = classified.groupBy("category").agg(F.count("*").alias("n"))
    named = classified.sparkSession.createDataFrame(list(CATEGORIES.items()), "category string, severity string")
    both = named.join(g, "category", "full_outer").withColumn("n", F.coalesce("n", F.lit(0)))  # six rows at most
    return both.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))


def activity(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``tier`` by the key's rows: low to 3, med to 15, high beyond."""
    n = F.count("*").over(Window.partitionBy("user_id", *by))
    return rows.withColumn("tier", F.when(n <= 3, "low").when(n <= 15, "med").otherwise("high"))


def by_tier(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """AUROC and AP of each tier, and of each group ``by`` (such as a policy) in it; a key's rows are counted once for each group."""
    return ranking(activity(rows, by), by=("tier", *by))
