"""An engine's predictions against the events that they were made of, worked out again with the steps that it says it used.

A prediction names its event, the step of the averages, the seven features, the score, and what the engine's clock said on the way. All of it
but the choice of the step follows from the events and from the steps, so it is worked out anew and compared row by row. What a
controller should have chosen is not looked at: the step is taken as told, if it is one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.columns import FEATURES, dot, logistic
from keyloom.operators.features import vector
from keyloom.operators.reconcile import Mismatch
from keyloom.sources.events import LogisticModel
from keyloom.sources.store import written

IDENTITY = ("event_ts_ns", "key", "item_id", "category_id", "behavior_code")
#: Features that depend on all steps of the key so far, and those that do not.
STEPPED, COUNTED = ("x0", "x6"), ("x1", "x2", "x3", "x4", "x5")
CLOCK = ("source_created_ns", "pressure_loaded_ns", "scored_ns", "latency_ns")
PRESSURE = ("pressure_available", "pressure_generation_used", "pressure_sampled_ns", "pressure_used", "batch_pressure_generation")
TOLD = (*IDENTITY, "alpha_used", "score", *FEATURES, *CLOCK, *PRESSURE)
#: What must not fall from one prediction to the next.
RISING = ("source_created_ns", "scored_ns", "pressure_generation_used")


def _close(a: Column, b: Column, rel: float, abs_: float) -> Column:
    return F.coalesce((a == b) | (F.abs(a - b) <= F.greatest(F.lit(abs_), F.lit(rel) * F.greatest(F.abs(a), F.abs(b)))), F.lit(False))


def _t(name: str) -> Column:
    return F.col(f"t_{name}")


def faults(events: DataFrame, emitted: DataFrame, model: LogisticModel, rel: float = 2e-12, abs_: float = 2e-14, hot_rows: int | None = None) -> DataFrame:
    """seq, rule, told, due: a row for each rule that a prediction breaks; none if all is as it has to be.

    ``missing``, ``phantom`` and ``twice`` are events without a prediction, predictions without an event, and events with several (of which the least
    is compared). Else a rule is the column that is not what is due: identity, counted features, averages and score within the tolerance,
    latency, ``alpha_used`` outside (0, 1], a time before the one it follows (due is that one), and for the pressure: a flag that is
    not 0 or 1, values where none was available, a sample loaded before it was taken, a generation after the batch's own. A null
    where a value belongs breaks its rule.

    After an event whose step is not known (missing or outside its bounds) the key's averages and scores cannot be told, and are not compared; all
    else is. Numbers of ``events`` are taken to be there once. A key of more than ``hot_rows`` events is cut into ranges, see ``vector``.
    Other columns of both tables are not looked at. Two empty tables have no faults."""
    there = events.select("seq", *IDENTITY)
    per = emitted.groupBy("seq").agg(F.count("*").alias("copies"), F.min(F.struct(*TOLD)).alias("told"))
    both = there.withColumn("there", F.lit(True)).join(per, "seq", "full_outer")
    both = written(both.select("seq", *IDENTITY, "there", "copies", *[F.col(f"told.{c}").alias(f"t_{c}") for c in TOLD]), "replayed")
    step = F.coalesce((_t("alpha_used") > 0) & (_t("alpha_used") <= 1), F.lit(False))
    unknown = both.filter(F.col("there") & ~step).groupBy("key").agg(F.min("seq").alias("since"))
    # A key has to be taken as it is, null or not.
    rows = both.filter("there").join(unknown.withColumnRenamed("key", "__key"), F.col("key").eqNullSafe(F.col("__key")), "left").drop("__key")
    again = vector(rows.withColumn("step", F.when(step, _t("alpha_used")).otherwise(1.0)), F.col("step"), hot_rows)
    due_score = logistic(dot(model.bias, model.weights, [F.col(x) for x in FEATURES]))

    def broken(rule: str, told: Column, due: Column, sound: Column) -> Column:
        return F.when(~F.coalesce(sound, F.lit(False)), F.struct(F.lit(rule).alias("rule"), told.cast("double").alias("told"), due.cast("double").alias("due")))

    served, known = F.col("copies").isNotNull(), F.col("since").isNull() | (F.col("seq") < F.col("since"))
    none = F.lit(None).cast("double")
    compared = [broken(c, _t(c), F.col(c), _t(c).eqNullSafe(F.col(c))) for c in IDENTITY]
    compared += [broken("alpha_used", _t("alpha_used"), none, step)]
    compared += [broken(c, _t(c), F.col(c), _close(_t(c), F.col(c), rel, abs_)) for c in COUNTED]
    compared += [broken(c, _t(c), F.col(c), ~known | _close(_t(c), F.col(c), rel, abs_)) for c in STEPPED]
    compared += [broken("score", _t("score"), due_score, ~known | _close(_t("score"), due_score, rel, abs_))]
    latency = _t("scored_ns") - _t("source_created_ns")
    compared += [broken("latency_ns", _t("latency_ns"), latency, _t("latency_ns") == latency)]
    for later, earlier in (("pressure_loaded_ns", "source_created_ns"), ("scored_ns", "pressure_loaded_ns")):
        compared += [broken(later, _t(later), _t(earlier), _t(later) >= _t(earlier))]
    compared += [broken("pressure_available", _t("pressure_available"), none, _t("pressure_available").isin(0, 1))]
    off, on = F.coalesce(_t("pressure_available") == 0, F.lit(False)), F.coalesce(_t("pressure_available") == 1, F.lit(False))
    for c in ("pressure_generation_used", "pressure_sampled_ns", "pressure_used"):
        compared += [broken(c, _t(c), F.lit(0.0), ~off | (_t(c) == 0))]
    compared += [broken("pressure_sampled_ns", _t("pressure_sampled_ns"), _t("pressure_loaded_ns"), ~on | (_t("pressure_sampled_ns") <= _t("pressure_loaded_ns")))]
    compared += [broken("pressure_generation_used", _t("pressure_generation_used"), _t("batch_pressure_generation"), ~on | (_t("pressure_generation_used") <= _t("batch_pressure_generation")))]
    twice = broken("twice", F.col("copies"), F.lit(1), F.col("copies") == 1)
    found = F.when(served, F.array(twice, *compared)).otherwise(F.array(broken("missing", none, none, F.lit(False))))
    of_events = again.select("seq", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select("seq", "x.*")
    phantoms = both.filter("there is null").select("seq", F.lit("phantom").alias("rule"), none.alias("told"), none.alias("due"))
    return of_events.unionByName(phantoms)


def falls(rows: DataFrame, columns: tuple[str, ...] = RISING, order: str = "seq") -> DataFrame:
    """One row: for each column how often it is less than the last value before it in the order of ``order``. Rows are dealt by ranges of the
    order; the first of a range is compared with what the ranges before it end with. Nulls are passed over."""
    ranged = written(rows.select(order, *columns).repartitionByRange(order).withColumn("range", F.spark_partition_id()), "falls")
    inside = Window.partitionBy("range").orderBy(order)
    ends = ranged.groupBy("range").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])  # as many rows as ranges
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("range", *[F.last(c, ignorenulls=True).over(before).alias(f"c_{c}") for c in columns])
    last = inside.rowsBetween(Window.unboundedPreceding, -1)
    fell = [F.count_if(F.coalesce(F.col(f"w_{c}"), F.col(f"c_{c}")) > F.col(c)).alias(c) for c in columns]
    return ranged.withColumns({f"w_{c}": F.last(c, ignorenulls=True).over(last) for c in columns}).join(F.broadcast(ends), "range").agg(*fell)


def replay(events: DataFrame, emitted: DataFrame, model: LogisticModel, receipt: dict | None = None, **bounds) -> int:
    """The number of predictions, if they are what the events, the steps and the clock make them and ``receipt`` (stages and their counts) tells the same number for
    every stage. Raises ``Mismatch`` with the count of each broken rule."""
    n = emitted.count()
    wrong = {r["rule"]: r["n"] for r in faults(events, emitted, model, **bounds).groupBy("rule").agg(F.count("*").alias("n")).collect()}
    wrong |= {f"{c} falls": v for c, v in falls(emitted).first().asDict().items() if v}
    wrong |= {f"stage {k}": v for k, v in (receipt or {}).items() if v != n}
    if wrong:
        raise Mismatch(str(dict(sorted(wrong.items()))))
    return n


def emitted(scored: DataFrame, pressure: Column, start_ns: Column) -> DataFrame:
    """Predictions as an engine tells them, of features worked out with the step in ``alpha_used``: a tenth of the way to be loaded, and scored after a
    millisecond. For replaying what was made by a batch."""
    times = {"source_created_ns": start_ns, "pressure_loaded_ns": start_ns + 100_000, "scored_ns": start_ns + 1_000_000, "latency_ns": F.lit(1_000_000).cast("long")}
    told = {"pressure_available": F.lit(1), "pressure_generation_used": F.lit(1).cast("long"), "pressure_sampled_ns": start_ns, "pressure_used": pressure, "batch_pressure_generation": F.lit(1).cast("long")}
    return scored.withColumns(times | told).select("seq", *TOLD)


def spoiled(rows: DataFrame, changes: dict[str, tuple[Column, Column]]) -> DataFrame:
    """``rows`` with columns changed where a condition holds: name to (condition, value)."""
    return reduce(lambda df, c: df.withColumn(c[0], F.when(c[1][0], c[1][1]).otherwise(F.col(c[0]))), changes.items(), rows)
