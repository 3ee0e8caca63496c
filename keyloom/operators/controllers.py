"""Controllers over an explicit pressure: step slewing, batch sizing, batching. Pressure is data, never invented here."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.fold import ordered_fold


@dataclass(frozen=True)
class AlphaSlew:
    """alpha follows low + (high - low) x pressure, at most ``step`` at a time; it holds ``start`` until there is a pressure."""

    low: float = 0.02
    high: float = 0.3
    start: float = 0.01
    step: float = 0.1

    def __post_init__(self) -> None:
        if not 0 < self.low <= self.high <= 1 or not 0 < self.start <= 1 or self.step <= 0:
            raise ValueError("alpha bounds")


@dataclass(frozen=True)
class BatchSize:
    """Multiplicative shrinking above ``above``, growing (by one at least) below ``below``, both strict."""

    least: int = 8
    most: int = 256
    below: float = 0.3
    above: float = 0.7
    shrink: float = 0.7
    grow: float = 1.25
    start: int = 8

    def __post_init__(self) -> None:
        if not 1 <= self.least <= self.start <= self.most or not 0 <= self.below <= self.above <= 1 or not 0 < self.shrink < 1 < self.grow:
            raise ValueError("batch bounds")


def occupancy_ema(batches: DataFrame, gain: float, order: str = "generation", raw: str = "occupancy", keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``occupancy_ema``: v += gain * (raw - v) from 0."""

    def step(v, x):
        v += gain * (x - v)
        return v, v

    return ordered_fold(batches, list(keys), [order], [raw], lambda: 0.0, step, "occupancy_ema double")


def alpha_slew(rows: DataFrame, config: AlphaSlew = AlphaSlew(), order: str = "generation", pressure: str = "pressure", keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``alpha``; a null pressure is one not yet sampled."""

    def step(a, p):
        if p is not None:
            target = config.low + (config.high - config.low) * min(max(p, 0.0), 1.0)
            a = min(max(a + min(max(target - a, -config.step), config.step), config.low), config.high)
        return a, a

    return ordered_fold(rows, list(keys), [order], [pressure], lambda: config.start, step, "alpha double")


def batch_sizes(rows: DataFrame, config: BatchSize = BatchSize(), order: str = "generation", pressure: str = "pressure", keys: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``batch_target``."""

    def step(n, p):
        if p > config.above and n > config.least:
            n = max(config.least, int(n * config.shrink))
        elif p < config.below and n < config.most:
            n = min(config.most, max(n + 1, int(n * config.grow)))
        return n, n

    return ordered_fold(rows, list(keys), [order], [pressure], lambda: config.start, step, "batch_target int")


def controller_actions(trace: DataFrame, value: str, order: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """By key: how often the value rose, fell, and turned round."""
    w = Window.partitionBy(*keys).orderBy(order)
    d = trace.withColumn("__d", F.signum(F.col(value) - F.lag(value).over(w))).filter("__d != 0")
    d = d.withColumn("__turn", F.col("__d") != F.lag("__d").over(w))
    return d.groupBy(*keys).agg(F.count_if(F.col("__d") > 0).alias("increases"), F.count_if(F.col("__d") < 0).alias("decreases"), F.count_if("__turn").alias("turns"))


def fixed_batches(events: DataFrame, size: int, rank: str = "rank") -> DataFrame:
    """Batches of ``size`` by the dense rank from 0: generation, first, last, count, and whether it is the partial tail."""
    g = events.groupBy(F.expr(f"{rank} div {size}").alias("generation")).agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("actual_count"))
    return g.withColumn("is_tail", F.col("actual_count") < size)
