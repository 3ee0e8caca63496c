"""Configurations against a reference and a control: losses paired by row, tests in two tiers, Holm's correction in each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.functions.columns import log_loss
from keyloom.operators import inference, metrics


def paired(scores: DataFrame, candidate: str, base: str, key: str = "seq") -> DataFrame:
    """Rows that both configurations of ``scores`` (key, config, group_id, label, score) have a score for, joined by key: group_id,
    label, a and b, and d, the difference of their log losses."""
    a = scores.filter((F.col("config") == candidate) & F.col("label").isNotNull()).select(key, "group_id", "label", F.col("score").alias("a"))
    b = scores.filter(F.col("config") == base).select(key, F.col("score").alias("b"))
    return a.join(b, key).withColumn("d", log_loss(F.col("label"), F.col("a")) - log_loss(F.col("label"), F.col("b")))


def contrasts(configs: list[str], reference: str, control: str | None) -> list[tuple[str, str]]:
    """Every configuration against the reference, and every other one against the control."""
    if reference not in configs:
        raise ValueError(f"no configuration {reference!r}")
    first = [(c, reference) for c in configs if c != reference]
    return first + [(c, control) for c in configs if control in configs and c not in (reference, control)]


def loss_gaps(scores: DataFrame, reference: str, key: str = "seq") -> DataFrame:
    """config, n, mean, p95 and max of its losses less the reference's."""
    base = scores.filter(F.col("config") == reference).select(key, F.col("score").alias("__base"))
    return metrics.loss_gap(scores.join(base, key), "score", "__base", by=("config",))


def suite(scores: DataFrame, configs: list[str], reference: str, control: str | None = None, draws: int = 2000, seed: int = 13, level: float = 0.95, rows: bool = True) -> DataFrame:
    """One row for each contrast: effect and Student's interval over rows, p-values of flipping rows (tier 1, left out without ``rows``)
    and of swapping clusters (tier 2), both also by Holm over the tier, and whether they are below 1 - level."""
    spark, table = scores.sparkSession, []
    for k, (candidate, base) in enumerate(contrasts(configs, reference, control)):
        pairs = paired(scores, candidate, base)
        t = inference.student_interval(pairs, "d", level).first()
        p1 = inference.row_sign_flip(pairs, "d", "seq", draws, seed) if rows else None
        g = inference.paired_groups(pairs, "log_loss", draws, seed, level).first()
        table.append((k, candidate, base, t["n"], t["effect"], t["low"], t["high"], p1, g["p_value"], g["n_clusters"]))
    found = spark.createDataFrame(table, "id int, candidate string, base string, n long, effect double, low double, high double, p_rows double, p_clusters double, n_clusters int")
    for tier in ("rows", "clusters"):
        holm = metrics.holm(found.filter(F.col(f"p_{tier}").isNotNull()).select("id", F.col(f"p_{tier}").alias("p"))).select("id", F.col("adjusted").alias(f"adjusted_{tier}"))
        found = found.join(holm, "id", "left").withColumn(f"significant_{tier}", F.col(f"adjusted_{tier}") <= 1 - level)
    return found.drop("id")
