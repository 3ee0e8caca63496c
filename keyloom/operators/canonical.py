"""Canonical events: exclusion ledger, exact deduplication, dense sequence numbers, order and budget checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.columns import NS, behaviour_code, tie_order
from keyloom.sources.store import written

# The campaign of the events table, in seconds.
CAMPAIGN = (1_704_067_200, 1_706_659_199)
FIVE = ["event_ts_ns", "key", "item_id", "category_id", "behavior"]


def with_reason(raw: DataFrame, campaign: tuple[int, int] = CAMPAIGN) -> DataFrame:
    """Adds ``reason``, null for events inside the campaign and the domain; bounds are inclusive."""
    t = F.col("event_ts_ns")  # compared as whole nanoseconds: doubles cannot tell neighbours apart
    reason = F.when(F.col("behavior").isNull(), "domain").when(t < 0, "negative").when(t < campaign[0] * NS, "before").when(t > campaign[1] * NS, "after")
    return raw.withColumn("reason", reason)


def ledger(raw: DataFrame, campaign: tuple[int, int] = CAMPAIGN) -> DataFrame:
    """One row: what was read, left out by reason, repeated and emitted, and whether it adds up."""
    valid = F.col("reason").isNull()
    per = with_reason(raw, campaign).groupBy("reason", *FIVE).agg(F.count("*").alias("n"))
    one = per.agg(
        F.sum("n").alias("raw"), *[F.coalesce(F.sum(F.when(F.col("reason") == r, F.col("n"))), F.lit(0)).alias(f"n_{r}") for r in ("domain", "negative", "before", "after")],
        F.coalesce(F.sum(F.when(valid, F.col("n"))), F.lit(0)).alias("in_window"), F.count_if(valid).alias("emitted"),
    ).withColumn("raw", F.coalesce("raw", F.lit(0)))
    one = one.withColumn("duplicates", F.col("in_window") - F.col("emitted")).withColumn("outliers", F.col("n_negative") + F.col("n_before") + F.col("n_after"))
    return one.withColumn("conserved", F.col("raw") == F.col("emitted") + F.col("outliers") + F.col("n_domain") + F.col("duplicates"))


def dense_index(df: DataFrame, order: list, name: str, start: int = 0) -> DataFrame:
    """Adds ``name``: the row's place in the global order, without a global sort in one task. Rows are range-partitioned and
    written in order with an id that counts within partitions; the partitions' sizes give the offsets."""
    pid, at = "__pid", "__at"
    placed = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), "dense")
    placed = placed.withColumn(pid, F.shiftright(at, 33))
    sizes = placed.groupBy(pid).agg(F.count("*").alias("__n"))  # as many rows as partitions
    before = Window.orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(pid, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    place = F.col("__offset") + F.col(at).bitwiseAND(F.lit((1 << 33) - 1)) + start
    return placed.join(F.broadcast(offsets), pid).withColumn(name, place).drop(pid, at, "__offset")


def canonical(raw: DataFrame, campaign: tuple[int, int] = CAMPAIGN) -> DataFrame:
    """Canonical events: in the campaign, each five-tuple once, numbered from 0 by time, key, item, category and behaviour."""
    kept = with_reason(raw, campaign).filter("reason is null").select(*FIVE).dropDuplicates(FIVE)
    kept = kept.withColumn("tie", tie_order(F.col("behavior")))
    numbered = dense_index(kept, ["event_ts_ns", "key", "item_id", "category_id", "tie"], "seq")
    return numbered.select("seq", "event_ts_ns", "key", "item_id", "category_id", behaviour_code(F.col("behavior")).alias("behavior_code"))


def order_violations(events: DataFrame) -> DataFrame:
    """One row: repeated sequence numbers, and pairs of successive events whose time runs back, of a key and of all.

    The global check deals events by ranges of seq: each is compared with the one before it in its range, the first of a range with the
    last of the range before."""
    per_key = Window.partitionBy("key").orderBy("seq")
    back = events.select((F.lag("event_ts_ns").over(per_key) > F.col("event_ts_ns")).alias("back")).agg(F.count_if("back").alias("key_regressions"))
    ranged = written(events.select("seq", "event_ts_ns").repartitionByRange("seq").withColumn("range", F.spark_partition_id()), "seq-ranges")
    tops = ranged.groupBy("range").agg(F.max_by("event_ts_ns", "seq").alias("last"))  # as many rows as ranges
    tops = tops.select("range", F.lag("last").over(Window.orderBy("range")).alias("carried"))
    within = F.lag("event_ts_ns").over(Window.partitionBy("range").orderBy("seq"))
    globally = ranged.withColumn("before", within).join(F.broadcast(tops), "range").agg(F.count_if(F.coalesce("before", "carried") > F.col("event_ts_ns")).alias("global_regressions"))
    seqs = events.groupBy("seq").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_seq"))
    return seqs.crossJoin(back).crossJoin(globally)  # one row each


def checked_order(events: DataFrame) -> DataFrame:
    """``events``, failing when read if a key's time runs back or a number repeats."""
    w = Window.partitionBy("key").orderBy("seq")
    ok = F.coalesce((F.lag("event_ts_ns").over(w) <= F.col("event_ts_ns")) & (F.lag("seq").over(w) < F.col("seq")), F.lit(True))
    return events.withColumn("__ok", F.when(ok, True).otherwise(F.raise_error(F.lit("events out of order")).cast("boolean"))).filter("__ok").drop("__ok")


def source_faults(raw: DataFrame, end_ns: int, id_col: str = "source_id") -> DataFrame:
    """One row of counts: ids that are missing, blank, padded or repeated, times outside 0 to ``end_ns``, keys that are missing or
    negative, and behaviours outside the domain."""
    per = raw.groupBy(id_col).agg(
        F.count("*").alias("n"), F.count_if(~F.coalesce(F.col("event_ts_ns").between(0, end_ns), F.lit(False))).alias("times"), F.count_if(~F.coalesce(F.col("key") >= 0, F.lit(False))).alias("keys"),
        F.count_if(behaviour_code(F.col("behavior")).isNull()).alias("behaviors"),
    )
    bad_id = F.col(id_col).isNull() | (F.col(id_col) == "") | F.col(id_col).rlike(r"^\s|\s$")
    total = {"bad_ids": F.when(bad_id, F.col("n")), "repeated_ids": F.when(~bad_id, F.col("n") - 1), "bad_times": F.col("times"), "bad_keys": F.col("keys"), "bad_behaviors": F.col("behaviors")}
    return per.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(name) for name, c in total.items()])


def checked_source(raw: DataFrame, end_ns: int, id_col: str = "source_id") -> DataFrame:
    """``raw``, or an error with what is wrong with it. One aggregation counts all of it."""
    if wrong := {k: v for k, v in source_faults(raw, end_ns, id_col).first().asDict().items() if v}:
        raise ValueError(f"faults of the source: {wrong}")
    return raw


def key_budget(events: DataFrame, max_keys: int) -> DataFrame:
    return events.agg(F.count_distinct("key").alias("n_keys")).withColumn("within_budget", F.col("n_keys") <= max_keys)


def within_budget(events: DataFrame, max_keys: int) -> DataFrame:
    """``events``, or an error if they have more keys than the budget."""
    n = key_budget(events, max_keys).first()["n_keys"]
    if n > max_keys:
        raise ValueError(f"{n} keys, {max_keys} at most")
    return events


def behaviour_profile(events: DataFrame) -> DataFrame:
    return events.groupBy("behavior_code").agg(F.count("*").alias("n"), F.count_distinct("key").alias("n_keys"), F.min("event_ts_ns").alias("first_ns"), F.max("event_ts_ns").alias("last_ns"), F.max("category_id").alias("max_category"))


def data_profile(raw: DataFrame) -> DataFrame:
    """One row: rows, keys, time span, largest category, values outside their domain, repeated numbers."""
    return raw.agg(
        F.count("*").alias("n_rows"), F.count_distinct("key").alias("n_keys"), F.min("event_ts_ns").alias("first_ns"), F.max("event_ts_ns").alias("last_ns"), F.max("category_id").alias("max_category"),
        F.count_if(F.col("behavior").isNull()).alias("n_invalid"), (F.count("seq") - F.count_distinct("seq")).alias("n_duplicate_seq"),
    )
