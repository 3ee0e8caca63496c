"""Scheduled traces in phases, policy suites over them, and their telemetry."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.functions.columns import NS, behaviour_code, cadence
from keyloom.operators import canonical
from keyloom.operators.features import w_key
from keyloom.sources import events as src
from keyloom.sources.store import written


@dataclass(frozen=True)
class Phase:
    name: str
    events: int
    queries: int
    rate: int  # events a second


# Phases of the open-loop workload.
PHASES = (Phase("warmup", 2_000, 0, 1_000), Phase("steady", 5_000, 1_000, 1_000), Phase("stress", 15_000, 3_000, 5_000), Phase("recovery", 5_000, 1_000, 1_000))


def scaled(n: int, phases: tuple[Phase, ...] = PHASES) -> tuple[Phase, ...]:
    """The same phases for n events in all; the last takes what rounding leaves."""
    total = sum(p.events for p in phases)
    out = [Phase(p.name, p.events * n // total, p.queries * n // total, p.rate) for p in phases]
    last = out[-1]
    return (*out[:-1], Phase(last.name, n - sum(p.events for p in out[:-1]), last.queries, last.rate))


def cyclic(events: DataFrame, n: int, order: str = "rank") -> DataFrame:
    """n rows: those ranked 0 .. m-1, over and over; ``place`` numbers them. Fails without a row."""
    m = events.count()
    if not m:
        raise ValueError("no events to repeat")
    places = events.sparkSession.range(n).select(F.col("id").alias("place"), (F.col("id") % m).alias(order))
    return places.join(events, order)


def validation_load(spark: SparkSession, path: str, first_s: int, last_s: int, test_start_s: int, n: int, cohort: DataFrame | None = None) -> DataFrame:
    """``place`` (0 .. n-1) and the first n events of a window of time in a file, over and over where it has fewer; an error where it has none.

    The file's first line tells whether it is raw or canonical: a canonical one begins with the names of its columns. Events of a raw file
    are numbered as they arrive, and ``cohort`` (whose validation rows alone are taken) does not know these numbers, so it is
    looked at for canonical files only."""
    head = spark.read.text(path).take(1)
    if head and "seq" in head[0]["value"].split(","):
        rows = src.read_events_csv(spark, path)
    else:
        raw, cohort = src.read_raw_csv(spark, path, placed=True), None
        raw = canonical.dense_index(raw, ["file", "block", "line"], "seq")
        rows = raw.select("seq", (F.col("timestamp_s") * NS).alias("event_ts_ns"), F.col("user_id").alias("key"), "item_id", "category_id", behaviour_code(F.col("behavior")).alias("behavior_code"))
    found = written(src.window_events(rows, first_s, last_s, test_start_s, n, cohort), "load")
    return cyclic(canonical.dense_index(found, ["seq"], "rank"), n).drop("rank")


def schedule(events: DataFrame, phases: tuple[Phase, ...] = PHASES) -> DataFrame:
    """phase, phase_idx, t_sched_ns of events numbered by ``place``; events beyond the phases are left out."""
    name, idx, at, first, t0 = F.lit(None), F.lit(None), F.lit(None), 0, 0
    for i, p in enumerate(phases):
        here = (F.col("place") >= first) & (F.col("place") < first + p.events)
        step = 1_000_000_000 // p.rate
        name, idx = F.when(here, p.name).otherwise(name), F.when(here, i).otherwise(idx)
        at = F.when(here, (F.col("place") - first) * step + t0).otherwise(at)
        first, t0 = first + p.events, t0 + p.events * step
    return events.select("*", name.alias("phase"), idx.cast("int").alias("phase_idx"), at.cast("long").alias("t_sched_ns")).filter("phase is not null")


def phase_queries(scheduled: DataFrame, phases: tuple[Phase, ...] = PHASES, cold_every: int = 10) -> DataFrame:
    """Queries spread over each phase's events: every so many-th event's key is asked for, every ``cold_every``-th query
    for a key that has no event."""
    every = F.lit(None)
    for i, p in enumerate(phases):
        every = F.when(F.col("phase_idx") == i, max(1, p.events // p.queries) if p.queries else 0).otherwise(every)
    q = scheduled.withColumn("every", every).filter("every > 0").filter(F.expr("place % every = 0"))
    key = F.when(F.expr(f"(place div every) % {cold_every} = 0"), F.col("key") + 1_000_000_000).otherwise(F.col("key"))
    return q.select("phase", "phase_idx", F.col("place").alias("query_id"), F.col("t_sched_ns").alias("query_ts_ns"), key.alias("key"))


def pressure_of(phase: Column) -> Column:
    return F.when(phase == "stress", F.lit(0.85)).otherwise(F.lit(0.10))


#: name: (least cadence, greatest cadence); equal for static ones.
CONFIGS = {"exact_fresh": (1, 1), "static_5": (5, 5), "static_20": (20, 20), "adaptive_16": (1, 16), "adaptive_20": (1, 20)}


def suite(scheduled: DataFrame, configs: dict[str, tuple[int, int]] = CONFIGS) -> DataFrame:
    """One row for each event and configuration: published and pending. Cadences follow the phase's pressure. A key's
    phases are runs of constant cadence, yet pending carries over, so the few configurations are folded together."""
    from keyloom.functions.fold import ordered_fold

    bounds = list(configs.values())

    def step(state, pressure):
        out = []
        for i, (low, high) in enumerate(bounds):
            k = min(max(low + int(min(max(pressure, 0.0), 1.0) * (high - low)), low), high)
            state[i] = 0 if state[i] + 1 >= k else state[i] + 1
            out.append(state[i])
        return state, *out

    names = [f"pending_{i}" for i in range(len(bounds))]
    folded = ordered_fold(scheduled.withColumn("pressure", pressure_of(F.col("phase"))), ["key"], ["place"], ["pressure"], lambda: [0] * len(bounds), step, ", ".join(f"{n} long" for n in names))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("config"), F.col(n).alias("pending")) for c, n in zip(configs, names, strict=True)])).alias("x")
    return folded.select("phase", "phase_idx", "place", "key", each).select("phase", "phase_idx", "place", "key", "x.*").withColumn("published", F.col("pending") == 0)


def phase_telemetry(rows: DataFrame, by: tuple[str, ...] = ("phase",)) -> DataFrame:
    """events, publications, coalesced and staleness by phase and in total (null), from published and pending."""
    out = rows.rollup(*by).agg(F.count("*").alias("events"), F.count_if("published").alias("publications"), F.count_if(~F.col("published")).alias("coalesced"), F.avg("pending").alias("mean_staleness"), F.max("pending").alias("max_staleness"), F.percentile("pending", 0.95).alias("p95_staleness"))
    return out.withColumn("conserved", F.col("events") == F.col("publications") + F.col("coalesced"))


def budget_match(a: DataFrame, b: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Publications of two runs, their difference, and whether it is within the tolerance."""
    one = a.agg(F.count_if("published").alias("a")).crossJoin(b.agg(F.count_if("published").alias("b")))  # one row each
    rel = F.abs(F.col("a") - F.col("b")) / F.greatest(F.lit(1), "a")
    return one.select("a", "b", F.abs(F.col("a") - F.col("b")).alias("difference"), rel.alias("relative"), (rel <= tolerance).alias("matched"))


def grid(events: DataFrame, cadences: tuple[int, ...] = (1, 5, 20), sizes: tuple[int, ...] = (8, 32, 128)) -> DataFrame:
    """Publications and batches of every pair of cadence and batch size, and whether publications fall as cadence rises."""
    rn = events.select(F.row_number().over(w_key()).alias("rn"))
    per = rn.select("rn", F.explode(F.array(*map(F.lit, cadences))).alias("cadence")).groupBy("cadence").agg(F.count_if(F.col("rn") % F.col("cadence") == 0).alias("publications"), F.count("*").alias("n"))
    cells = per.select("*", F.explode(F.array(*map(F.lit, sizes))).alias("batch_size")).withColumn("batches", F.ceil(F.col("n") / F.col("batch_size")).cast("long"))
    falls = F.coalesce(F.col("publications") <= F.lag("publications").over(Window.partitionBy("batch_size").orderBy("cadence")), F.lit(True))
    return cells.select("cadence", "batch_size", "publications", "batches", falls.alias("falls"))
