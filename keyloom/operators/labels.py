"""Strict-future labels with censoring, temporal splits with embargoes, and held-out keys."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.columns import NS, first_hash_word

BUY = 3


def causal_labels(events: DataFrame, horizon_ns: int, end_ns: int) -> DataFrame:
    """label 1 if the key buys in (t, t + horizon], 0 if not, null where the horizon runs past ``end_ns``; witness is the
    first such buy. Found by one growing window backwards in time, so a key's events are read once."""
    later = Window.partitionBy("key").orderBy(F.col("event_ts_ns").desc()).rangeBetween(Window.unboundedPreceding, -1)
    buy = F.min(F.when(F.col("behavior_code") == BUY, F.struct("event_ts_ns", "seq"))).over(later)
    censored = F.col("event_ts_ns") > end_ns - horizon_ns
    hit = F.coalesce(F.col("next_buy.event_ts_ns") <= F.col("event_ts_ns") + horizon_ns, F.lit(False))
    return events.withColumn("next_buy", buy).select(
        "seq", "event_ts_ns", F.col("key").alias("user_id"), F.when(~censored, hit.cast("int")).alias("label"), (~censored).cast("int").alias("label_valid"), censored.cast("int").alias("censored"),
        F.when(~censored & hit, F.col("next_buy.seq")).alias("positive_witness_seq"),
    )


def manifest(labels: DataFrame) -> DataFrame:
    one = labels.agg(F.count("*").alias("total"), F.count("label").alias("evaluated"), F.coalesce(F.sum("censored"), F.lit(0)).alias("censored"), F.count_if(F.col("label") == 1).alias("positive"), F.count_if(F.col("label") == 0).alias("negative"), F.count("positive_witness_seq").alias("witnesses"))
    return one.withColumn("positive_rate", F.when(F.col("evaluated") > 0, F.col("positive") / F.col("evaluated")))


@dataclass(frozen=True)
class SplitSpec:
    """First second of the whole, last seconds of the five parts and of the whole, and one key in ``ood_modulus`` held out."""

    start: int
    train_end: int
    embargo1_end: int
    validation_end: int
    embargo2_end: int
    test_end: int
    campaign_end: int
    ood_modulus: int = 10

    def __post_init__(self) -> None:
        ends = (self.start, self.train_end, self.embargo1_end, self.validation_end, self.embargo2_end, self.test_end, self.campaign_end)
        if list(ends) != sorted(ends) or self.ood_modulus < 1:
            raise ValueError("splits out of order")

    def holds(self, horizon_s: int) -> bool:
        """Whether no label of one part looks into the next."""
        return self.embargo1_end - self.train_end >= horizon_s and self.embargo2_end - self.validation_end >= horizon_s


# Splits of the events table's thirty days, with two days of embargo.
MONTH = SplitSpec(1_704_067_200, 1_705_276_799, 1_705_449_599, 1_705_881_599, 1_706_054_399, 1_706_572_799, 1_706_659_199)


def _hour(ts_s: Column, start: int, end: int) -> Column:
    return F.least(F.greatest(F.floor((ts_s - start) / 3600), F.lit(0)), F.lit((end - start) // 3600)).cast("long")


def _padded(hour: Column, width: int) -> Column:
    text = hour.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


# Names of the parts in time, the beginnings of their groups' names, and the digits of the hour.
PARTS = (("train", "train_hour_", 3), ("train_embargo", "embargo_1_hour_", 2), ("validation", "val_hour_", 2), ("val_embargo", "embargo_2_hour_", 2), ("test", "test_hour_", 2), ("tail_censored", "tail_hour_", 2))


def assign_splits(labels: DataFrame, spec: SplitSpec = MONTH) -> DataFrame:
    """seq, user_id, event_ts_ns, split, group_id, label, censored. Held-out keys come first; then by time. Groups are hours of their
    part; what is after the test is tail, whose label is blank."""
    s = F.expr(f"event_ts_ns div {NS}")
    ood = first_hash_word(F.col("user_id")) % spec.ood_modulus == 0
    ends = (spec.train_end, spec.embargo1_end, spec.validation_end, spec.embargo2_end, spec.test_end, spec.campaign_end)
    starts = (spec.start, *(e + 1 for e in ends[:-1]))
    hour = lambda prefix, a, b, width: F.concat(F.lit(prefix), _padded(_hour(s, a, b), width))
    split = group = None
    for (part, prefix, width), a, b in reversed(list(zip(PARTS, starts, ends, strict=True))):
        name = hour(prefix, a, b, width)
        split = F.lit(part) if split is None else F.when(s <= b, part).otherwise(split)
        group = name if group is None else F.when(s <= b, name).otherwise(group)
    tail = s > spec.test_end
    return labels.select(
        "seq", "user_id", "event_ts_ns", F.when(ood, "ood").otherwise(split).alias("split"),
        F.when(ood, hour("ood_hour_", spec.start, spec.campaign_end, 3)).otherwise(group).alias("group_id"),
        F.when(~tail, F.col("label")).alias("label"), F.when(tail, 1).otherwise(F.col("censored")).alias("censored"),
    )


def evaluated_only(cohort: DataFrame) -> DataFrame:
    return cohort.filter(~F.col("split").isin("train_embargo", "val_embargo", "tail_censored"))


def split_summary(cohort: DataFrame) -> DataFrame:
    return cohort.groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_users"), F.count_if(F.col("label") == 1).alias("positive"), F.count_if(F.col("label") == 0).alias("negative"), F.sum("censored").alias("censored"))


def group_counts(cohort: DataFrame, split: str = "test", floor: int = 30) -> DataFrame:
    """Rows of each group of a split by label, and whether there are at least ``floor``."""
    g = cohort.filter(F.col("split") == split).groupBy("group_id").agg(F.count_if(F.col("label") == 1).alias("positive"), F.count_if(F.col("label") == 0).alias("negative"))
    return g.withColumn("enough", F.col("positive") + F.col("negative") >= floor)


def overlaps(cohort: DataFrame) -> DataFrame:
    """Keys that held-out rows share with other splits: all must be 0."""
    per = cohort.groupBy("user_id").agg(F.max((F.col("split") == "ood").cast("int")).alias("ood"), *[F.max((F.col("split") == p).cast("int")).alias(p) for p in ("train", "validation", "test")])
    return per.agg(*[F.coalesce(F.sum(F.col("ood") * F.col(p)), F.lit(0)).alias(f"ood_{p}") for p in ("train", "validation", "test")])


def fit_users(cohort: DataFrame) -> DataFrame:
    """user_id and n (rows) of every key that training or validation has seen."""
    return cohort.filter(F.col("split").isin("train", "validation")).groupBy("user_id").agg(F.count("*").alias("n"))
