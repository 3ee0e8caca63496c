"""Metrics of scores against labels. With one class only, AUROC and AP are null.

Ranking metrics and quantiles first count rows of equal scores or values; running sums over these
are taken in ranges (functions/running.py), so no task orders them all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.columns import log_loss
from keyloom.functions.running import before, joined


def _with_totals(g: DataFrame, by: tuple[str, ...], **totals) -> DataFrame:
    """``g`` with sums over each of the groups ``by``, or over all rows."""
    sums = g.groupBy(*by).agg(*[F.sum(v).alias(k) for k, v in totals.items()])
    return joined(g, sums, by) if by else g.crossJoin(F.broadcast(sums))  # one row


def ranking(df: DataFrame, label: str = "label", score: str = "score", by: tuple[str, ...] = (), weight: str | None = None) -> DataFrame:
    """auroc (ties count half) and ap (at change points of the score), by the columns ``by``; with ``weight`` a row counts so often."""
    w = F.lit(1) if weight is None else F.col(weight)
    rows = df.filter(F.col(label).isNotNull()).groupBy(*by, F.col(score).alias("s"))
    g = before(rows.agg(F.sum(F.col(label) * w).cast("long").alias("pos"), F.sum(w).cast("long").alias("n")), ["s"], ["pos", "n"], by)
    g = _with_totals(g, by, p="pos", all="n")
    below, tp, seen = F.col("n_before") - F.col("pos_before"), F.col("p") - F.col("pos_before"), F.col("all") - F.col("n_before")
    g = g.withColumns({"u2": F.col("pos") * (2 * below + F.col("n") - F.col("pos")), "a": F.col("pos") * tp / seen})
    one = g.groupBy(*by).agg(F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"), F.sum("u2").alias("u2"), F.sum("a").alias("a"), F.sum("n").alias("n"))
    two = (F.col("p") > 0) & (F.col("q") > 0)
    auroc = F.when(two, F.col("u2") / (2.0 * F.col("p") * F.col("q")))
    return one.select(*by, "n", auroc.alias("auroc"), F.when(two, F.col("a") / F.col("p")).alias("ap"))


def ap_untied(df: DataFrame, order: str, label: str = "label", score: str = "score") -> DataFrame:
    """Average precision row by row; equal scores stand in the order of ``order``, which must be unique."""
    rows = df.filter(F.col(label).isNotNull()).select(F.col(score).alias("s"), F.col(label).alias("y"), F.col(order).alias("o"), F.lit(1).alias("k"))
    placed = before(rows, [F.col("s").desc(), F.col("o")], ["y", "k"])
    precision = (F.col("y_before") + F.col("y")) / (F.col("k_before") + 1)
    return placed.agg((F.sum(F.when(F.col("y") == 1, precision)) / F.sum("y")).alias("ap"))


def proper_scores(df: DataFrame, threshold: float = 0.5, label: str = "label", score: str = "score") -> DataFrame:
    y, p = F.col(label), F.col(score)
    hit = (p >= threshold).cast("int")
    one = df.filter(y.isNotNull()).agg(
        F.count("*").alias("n"), F.avg((hit == y).cast("int")).alias("accuracy"), F.sum(hit * y).alias("tp"), F.sum(hit).alias("called"), F.sum(y).alias("true"), F.avg((p - y) * (p - y)).alias("brier"), F.avg(log_loss(y, p)).alias("log_loss"))
    return one.select("n", "accuracy", F.when(F.col("called") + F.col("true") > 0, 2.0 * F.col("tp") / (F.col("called") + F.col("true"))).otherwise(F.lit(0.0)).alias("f1"), "brier", "log_loss")


def reliability(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Ten bins of the score, the last closed: rows, mean score (midpoint if empty), share of positives (0 if empty)."""
    spark = df.sparkSession
    b = df.filter(F.col(label).isNotNull()).groupBy(F.least(F.floor(F.col(score) * 10), F.lit(9)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(label).alias("observed"))
    bins = spark.range(10).select(F.col("id").cast("int").alias("bin"))
    return bins.join(b, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("mean_score", (F.col("bin") + 0.5) / 10).alias("mean_score"), F.coalesce("observed", F.lit(0.0)).alias("observed"))


def _counted(df: DataFrame, value: str, by: tuple[str, ...]) -> DataFrame:
    """Different values ``v`` with their number ``c``, how many stand before (``c_before``) and are in the group (``all``)."""
    g = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    return _with_totals(before(g, ["v"], ["c"], by), by, all="c")


def quantiles(df: DataFrame, value: str, shares: dict[str, float], by: tuple[str, ...] = ()) -> DataFrame:
    """Interpolated quantiles, named as in ``shares``: between the elements that stand around share x (n - 1) in order. The element
    at a place is the greatest value with no more than so many before it, so no group is sorted in one task."""
    g = _counted(df, value, by)
    columns = []
    for name, q in shares.items():
        place = F.lit(float(q)) * (F.col("all") - 1)
        at = lambda i: F.max(F.when(F.col("c_before") <= i, F.col("v")))  # noqa: B023, E731
        columns += [at(F.floor(place)).alias(f"__low_{name}"), at(F.ceil(place)).alias(f"__high_{name}"), F.first(place - F.floor(place)).alias(f"__part_{name}")]
    one = g.groupBy(*by).agg(*columns)
    between = lambda n: F.col(f"__low_{n}") + (F.col(f"__high_{n}") - F.col(f"__low_{n}")) * F.col(f"__part_{n}")
    return one.select(*by, *[between(n).alias(n) for n in shares])


def summary(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """n, mean, sample deviation (0 for one row), min, max, interpolated p50, p95 and p99, and cv (0 unless the mean is positive)."""
    sums = [F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.min(value).alias("min"), F.max(value).alias("max")]
    one = df.groupBy(*by).agg(*sums)
    found = quantiles(df, value, {"p50": 0.5, "p95": 0.95, "p99": 0.99}, by)
    one = joined(one, found, by, "left") if by else one.join(F.broadcast(found), how="left")
    return one.withColumn("cv", F.when(F.col("mean") > 0, F.col("std") / F.col("mean")).otherwise(F.lit(0.0)))


def upper_median(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The element n div 2 (from 0) of the sorted values; nulls do not count."""
    return _counted(df, value, by).groupBy(*by).agg(F.max(F.when(F.col("c_before") <= F.expr("all div 2"), F.col("v"))).alias("upper_median"))


def loss_gap(df: DataFrame, a: str, b: str, label: str = "label", by: tuple[str, ...] = ()) -> DataFrame:
    """Mean, p95 and max of the signed difference of log losses."""
    gaps = df.filter(F.col(label).isNotNull()).select(*by, (log_loss(F.col(label), F.col(a)) - log_loss(F.col(label), F.col(b))).alias("__gap"))
    one = gaps.groupBy(*by).agg(F.count("*").alias("n"), F.avg("__gap").alias("mean_gap"), F.max("__gap").alias("max_gap"))
    found = quantiles(gaps, "__gap", {"p95_gap": 0.95}, by)
    one = joined(one, found, by, "left") if by else one.join(F.broadcast(found), how="left")
    return one.select(*by, "n", "mean_gap", "p95_gap", "max_gap")


def line_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_count(y, x).alias("n"))


def holm(df: DataFrame, p: str = "p", order: str = "id", by: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``adjusted``: Holm's step-down p-values. Hypotheses are few by nature."""
    part = Window.partitionBy(*by)
    w = part.orderBy(p, order)
    raw = F.least(F.lit(1.0), F.col(p) * (F.count("*").over(part) - F.row_number().over(w) + 1))
    return df.withColumn("__raw", raw).withColumn("adjusted", F.max("__raw").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__raw")
