"""The same features and publications on streams: keyed state between micro-batches, strict order."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from keyloom.functions.columns import FEATURES, WEIGHTS
from keyloom.operators.cache import latest, versions
from keyloom.operators.policies import Policy
from keyloom.sources.events import EVENT, LogisticModel

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "seq long, event_ts_ns long, key long, behavior_code int, " + ", ".join(f"{x} double" for x in FEATURES) + ", score double, published boolean, version_id long, pending long, n long"
HELD = "engagement double, gap double, pv long, cart_fav long, buy long, n long, last_seq long, last_ns long, version long, pending long, public_ns long"
#: Keys are held in so many buckets by hash, each with one array a field. A checkpoint is of this number, so it is fixed.
BUCKETS = 1024
STATE = ", ".join(f"{name} array<{kind}>" for name, kind in (field.split() for field in f"key long, {HELD}".split(", ")))
#: Rows that a bucket gives at a time.
ROWS = 1 << 16
EMPTY = (0.0, 0.0, 0, 0, 0, 0, -1, 0, 0, 0, 0)


def decide(policy: Policy, version: int, pending: int, since_ns: int, pressure: float | None) -> bool:
    """Whether an event of a key is published, from what has been so far; a quota needs all events' order and is for batches."""
    if policy.kind == "exact_fresh":
        return True
    if policy.kind == "fixed_cadence":
        return pending + 1 >= policy.cadence
    if policy.kind == "elapsed":
        return version == 0 or since_ns >= policy.elapsed_ns
    p = min(max(pressure, 0.0), 1.0)
    return pending + 1 >= min(max(policy.cadence + int(p * (policy.cadence_max - policy.cadence)), policy.cadence), policy.cadence_max)


class KeyedFeatures(StatefulProcessor):
    """State of the keys of one bucket, so that what a call costs is shared by many keys. Rows of a micro-batch are put in order of seq
    first (a bucket's share of one micro-batch and the states of its keys are in memory; the number of files a micro-batch takes bounds the
    first); a row that is not after the last one seen of its key fails the query: there is no late data, only disorder."""

    def __init__(self, alpha: float, model: LogisticModel, policy: Policy):
        self.alpha, self.model, self.policy = alpha, model, policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", STATE)

    def handleInputRows(self, bucket, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("seq")
        if new["key"].isna().any():
            raise ValueError("phase features: an event without a key")
        held = self.state.get()
        states = {} if held is None else dict(zip(held[0], zip(*held[1:], strict=True), strict=True))
        out = []
        pressures = new["pressure"].tolist() if "pressure" in new else [None] * len(new)
        for key, seq, ns, code, pressure in zip(new["key"].tolist(), new["seq"].tolist(), new["event_ts_ns"].tolist(), new["behavior_code"].tolist(), pressures, strict=True):
            s, g, pv, cf, buy, n, seq0, ns0, version, pending, public = states.get(key, EMPTY)
            if n and (seq <= seq0 or ns < ns0):
                raise ValueError(f"phase features: event {seq} of key {key} is out of order")
            gap = (ns - ns0) / 1e9 if n else 0.0
            s += self.alpha * (WEIGHTS[code] - s)
            g += self.alpha * (gap - g)
            pv, cf, buy, n = pv + (code == 0), cf + (code in (1, 2)), buy + (code == 3), n + 1
            x = (s, math.log1p(pv), math.log1p(cf), min(gap, 3600.0) / 3600.0, buy / n, math.log1p(buy), g)
            z = self.model.bias
            for w, v in zip(self.model.weights, x, strict=True):
                z += w * v
            if not math.isfinite(z):
                raise ValueError(f"phase score: the score of event {seq} is not finite")
            score = 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))
            hit = decide(self.policy, version, pending, ns - public, pressure)
            version, pending, public = (version + 1, 0, ns) if hit else (version, pending + 1, public)
            out.append((seq, ns, key, code, *x, score, hit, version, pending, n))
            states[key] = s, g, pv, cf, buy, n, seq, ns, version, pending, public
            if len(out) == ROWS:
                yield _given(out)
                out = []
        if out:
            yield _given(out)
        self.state.update((list(states), *map(list, zip(*states.values(), strict=True))))

    def close(self) -> None:
        pass


def _given(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["seq", "event_ts_ns", "key", "behavior_code", *FEATURES, "score", "published", "version_id", "pending", "n"])


def feature_stream(events: DataFrame, model: LogisticModel, alpha: float = 0.1, policy: Policy | None = None) -> DataFrame:
    """A stream of canonical events (for the adaptive policy with ``pressure``) to a stream of features, scores and publications."""
    policy = policy or Policy("exact_fresh")
    if policy.kind == "quota" or policy.kind == "adaptive" and "pressure" not in events.columns:
        raise ValueError("a stream has no quota, and an adaptive one needs a pressure")
    read = ["key", "seq", "event_ts_ns", "behavior_code", *(["pressure"] if policy.kind == "adaptive" else [])]
    dealt = events.select(F.pmod(F.hash("key"), F.lit(BUCKETS)).alias("bucket"), *read)
    return dealt.groupBy("bucket").transformWithStateInPandas(KeyedFeatures(alpha, model, policy), OUT, "Append", "None")


def observed(stream: DataFrame) -> DataFrame:
    """A feature stream whose progress tells of each micro-batch how many events it had, and how many were published and coalesced."""
    published = F.col("published")
    return stream.observe("accounting", F.count("*").alias("processed"), F.count_if(published).alias("published"), F.count_if(~published).alias("coalesced"))


def accounted(query) -> dict[str, int]:
    """Sums of what ``observed`` told over the micro-batches that the query remembers (spark.sql.streaming.numRecentProgressUpdates
    of them); raises if they do not add up."""
    total = {"processed": 0, "published": 0, "coalesced": 0}
    for progress in query.recentProgress:
        told = progress.observedMetrics.get("accounting")
        for name in total:
            total[name] += told[name] if told is not None else 0
    if total["processed"] != total["published"] + total["coalesced"]:
        raise ValueError(f"events are not conserved: {total}")
    return total


def cache_stream(stream: DataFrame, path: str, checkpoint: str):
    """Starts writing the published versions of a feature stream below ``path``, one folder for each micro-batch, so that one that is
    run again replaces its own. ``latest_versions`` reads what is public."""
    def put(batch: DataFrame, number: int) -> None:
        versions(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()


def latest_versions(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of each key that ``cache_stream`` has written: an upsert by reading, as versions are only ever added."""
    return latest(spark.read.parquet(path).drop("batch"))


def event_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Canonical events from Parquet files as they come; all new files are a micro-batch, or at most so many (the oldest first)."""
    reader = spark.readStream.schema(EVENT)
    return (reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)).parquet(path)


def replay(stream: DataFrame, path: str, checkpoint: str, timeout_s: float | None = None) -> DataFrame:
    """Runs a bounded stream to its end into Parquet at ``path`` and reads it back. A query that fails raises, and so does one that takes
    longer than ``timeout_s``, if that is given."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
    if timeout_s is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout_s):
        query.stop()
        raise TimeoutError(f"the stream took more than {timeout_s} s")
    return spark.read.parquet(path)


def hourly(events: DataFrame) -> DataFrame:
    """Tumbling hours of event time by key's behaviour, batch or stream; on streams with a watermark of an hour."""
    timed = events.withColumn("at", F.timestamp_micros(F.expr("event_ts_ns div 1000")))
    if events.isStreaming:
        timed = timed.withWatermark("at", "1 hour")
    return timed.groupBy(F.window("at", "1 hour").alias("hour"), "behavior_code").agg(F.count("*").alias("n")).select(F.unix_seconds("hour.start").alias("hour_s"), "behavior_code", "n")
