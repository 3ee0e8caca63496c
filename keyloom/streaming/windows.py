"""Event-time windows on a stream, with a ledger of what came too late.

A window is closed when the watermark has passed its end; its counts then go out once and its state goes. Rows of a window that is
closed are not dropped in silence: they go out as counts of late rows, so that each row that was read is in a closed window, in an
open one, or in the ledger (``conserved``). Rows are dealt by window, behaviour and a hash of their number, so a window that holds a
third of all rows is counted in SALTS tasks; its parts close together and are added when they are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Parts of a window.
SALTS = 16
OUT = "kind string, hour_s long, behavior_code int, salt int, n long, watermark_s long"


class Counted(StatefulProcessor):
    """Rows of one part of a window. A row is late if its window's end is not after the watermark of the micro-batch."""

    def __init__(self, length_s: int):
        self.length_s = length_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.n = handle, handle.getValueState("n", "n long")

    def _row(self, kind: str, key, n: int, timers) -> pd.DataFrame:
        return pd.DataFrame([(kind, int(key[0]), int(key[1]), int(key[2]), n, timers.getCurrentWatermarkInMs() // 1000)], columns=["kind", "hour_s", "behavior_code", "salt", "n", "watermark_s"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, end_ms = sum(len(x) for x in rows), (int(key[0]) + self.length_s) * 1000
        if end_ms <= timerValues.getCurrentWatermarkInMs():
            yield self._row("late", key, n, timerValues)
            return
        if not self.n.exists():
            self.handle.registerTimer(end_ms)
        self.n.update(((self.n.get()[0] if self.n.exists() else 0) + n,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n = self.n.get()[0]
        self.n.clear()
        yield self._row("closed", key, n, timerValues)

    def close(self) -> None:
        pass


def counted(events: DataFrame, delay: str = "1 hour", length_s: int = 3600) -> DataFrame:
    """A stream of canonical events to parts of closed windows and counts of late rows; the watermark is ``delay`` behind the latest time."""
    timed = events.withColumn("at", F.timestamp_micros(F.expr("event_ts_ns div 1000"))).withWatermark("at", delay)
    # The time itself goes no further: the operator would drop late rows by it before they can be counted.
    start = F.floor(F.col("event_ts_ns") / F.lit(1_000_000_000) / length_s).cast("long") * length_s
    rows = timed.select(start.alias("hour_s"), "behavior_code", F.pmod(F.xxhash64("seq"), F.lit(SALTS)).cast("int").alias("salt"))
    return rows.groupBy("hour_s", "behavior_code", "salt").transformWithStateInPandas(Counted(length_s), OUT, "Append", "EventTime")


def closed(parts: DataFrame) -> DataFrame:
    """hour_s, behavior_code, n of the closed windows."""
    return parts.filter("kind = 'closed'").groupBy("hour_s", "behavior_code").agg(F.sum("n").alias("n"))


def late(parts: DataFrame) -> DataFrame:
    """The ledger: rows that came too late, by window and by the watermark they met."""
    return parts.filter("kind = 'late'").groupBy("hour_s", "behavior_code", "watermark_s").agg(F.sum("n").alias("n"))


def open_windows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """hour_s, behavior_code, n of the windows that are still open, out of the state of the last micro-batch."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "n").load()
    return state.groupBy(F.col("key.hour_s").alias("hour_s"), F.col("key.behavior_code").alias("behavior_code")).agg(F.sum("value.n").alias("n"))


def conserved(n_read: int, parts: DataFrame, open_: DataFrame) -> dict[str, int]:
    """read, closed, open and late rows; raises unless the last three make the first."""
    told = {r["kind"]: r["n"] for r in parts.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    total = {"read": n_read, "closed": told.get("closed", 0), "open": open_.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], "late": told.get("late", 0)}
    if total["read"] != total["closed"] + total["open"] + total["late"]:
        raise ValueError(f"rows are not conserved: {total}")
    return total
