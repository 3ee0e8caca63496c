"""A bounded run of the feature stream that ends in a receipt, or in a report of the phase that failed.

Every stage is counted as it runs: rows read, features extracted, scores given, rows written. A micro-batch writes its rows to a folder
of its own, reads back how many there are, and becomes public by its line in a ledger, which also carries the number of keys seen; a
micro-batch that is run again replaces what it wrote. A key beyond the budget makes the run fail before its micro-batch is public.
"""

from __future__ import annotations

import re
import threading
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from keyloom.operators.policies import Policy
from keyloom.sources.events import LogisticModel
from keyloom.sources.sinks import failure_report, write_report
from keyloom.streaming.engine import OUT, ROCKS, feature_stream

PHASES = ("source", "features", "score", "sink", "deadline")
STAGES = ("read", "extracted", "scored", "written")
LEDGER = "written long, new_keys long, keys long, published long, batch long"
#: How an error tells its phase. The text of a plan, which errors may quote, has no brace there.
_MARKED = re.compile(r"phase (features|score|sink): |phase (source): no event: \{")
_UNREADABLE = re.compile(r"FAILED_READ_FILE|CANNOT_READ|MALFORMED|PATH_NOT_FOUND")


class RunFailed(RuntimeError):
    """A run did not end; ``phase`` is one of PHASES."""

    def __init__(self, phase: str, message: str):
        super().__init__(message)
        self.phase = phase


class _Told(StreamingQueryListener):
    """Sums of what one query's progress tells of its stages, and which micro-batches it told of; in memory that does not grow with the run."""

    def __init__(self, name: str):
        self.name, self.run, self.over = name, None, threading.Event()
        self.sums, self.first, self.last = dict.fromkeys(STAGES[:3], 0), None, None

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self.run = event.runId

    def onQueryProgress(self, event) -> None:
        told = event.progress
        if told.name != self.name:
            return
        for stage in self.sums:
            row = told.observedMetrics.get(stage)
            self.sums[stage] += row["n"] if row is not None else 0
        self.first = told.batchId if self.first is None else self.first
        self.last = told.batchId

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.runId == self.run:
            self.over.set()


def _in_domain(events: DataFrame) -> DataFrame:
    """``events``, failing at a row that is no event."""
    ok = F.coalesce((F.col("seq") >= 0) & (F.col("event_ts_ns") >= 0) & (F.col("key") >= 0) & F.col("behavior_code").between(0, 3), F.lit(False))
    return events.withColumn("behavior_code", F.when(ok, F.col("behavior_code")).otherwise(F.raise_error(F.concat(F.lit("phase source: no event: "), F.to_json(F.struct(*events.columns)))).cast("int")))


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """One row for each public micro-batch."""
    return spark.read.schema(LEDGER).parquet(f"{path}/ledger")


def public(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all public micro-batches."""
    rows = spark.read.schema(OUT + ", batch long").parquet(f"{path}/rows")
    return rows.join(F.broadcast(ledger(spark, path).select("batch")), "batch", "left_semi")  # one row a micro-batch


def key_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """key and the state that the stream keeps of it after its last micro-batch."""
    buckets = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "state").load().select("value.*")
    return buckets.select(F.inline(F.arrays_zip(*buckets.columns)))


def _put(path: str, max_keys: int | None):
    def put(batch: DataFrame, number: int) -> None:
        spark, at = batch.sparkSession, f"{path}/rows/batch={number}"
        batch.write.mode("overwrite").parquet(at)
        try:
            mine = spark.read.schema(OUT).parquet(at).agg(F.count("*").alias("written"), F.count_if(F.col("n") == 1).alias("new"), F.count_if("published").alias("published")).first()
            # The line of the micro-batch before tells how many keys there were.
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/ledger/batch={number - 1}")
            known = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
            before = spark.read.parquet(folder.toString()).first()["keys"] if known else 0
        except Exception as error:
            raise RuntimeError(f"phase sink: {error}") from error
        keys = before + mine["new"]
        if max_keys is not None and keys > max_keys:
            raise ValueError(f"phase features: {keys} keys, {max_keys} at most")
        line = spark.createDataFrame([(mine["written"], mine["new"], keys, mine["published"])], "written long, new_keys long, keys long, published long")
        line.coalesce(1).write.mode("overwrite").parquet(f"{path}/ledger/batch={number}")

    return put


def _phase(error: Exception) -> str:
    text = str(error)
    marked = _MARKED.search(text)
    return marked[1] or marked[2] if marked else "source" if _UNREADABLE.search(text) else "sink"


def run(events: DataFrame, model: LogisticModel, path: str, checkpoint: str, report: str | None = None, policy: Policy | None = None, alpha: float = 0.1, max_keys: int | None = None, timeout_s: float | None = None) -> dict:
    """Runs a stream of canonical events to its end below ``path`` and returns its receipt: rows read, extracted, scored and written by this
    run, which have to be equal, how many of them were published and coalesced, the keys seen by all runs on ``checkpoint``, and
    the micro-batches. The receipt, or what failed in which phase, is left at ``report``. Raises RunFailed; nothing of the micro-batch
    that failed is public, and another run goes on from the last one that is."""
    spark, name = events.sparkSession, f"run-{uuid.uuid4().hex}"
    n = F.count("*").alias("n")
    features = feature_stream(_in_domain(events.observe("read", n)), model, alpha, policy).observe("extracted", n)
    scored = features.observe("scored", F.count_if(F.col("score").between(0, 1)).alias("n"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    told = _Told(name)
    spark.streams.addListener(told)
    try:
        query = scored.writeStream.queryName(name).foreachBatch(_put(path, max_keys)).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
        try:
            ended = query.awaitTermination() if timeout_s is None else query.awaitTermination(timeout_s)
        except PySparkException as error:
            return _failed(report, _phase(error), error)
        if timeout_s is not None and not ended:
            query.stop()
            return _failed(report, "deadline", TimeoutError(f"the run took more than {timeout_s} s"))
        told.over.wait(60)
    finally:
        spark.streams.removeListener(told)
    lines = {"written": 0, "published": 0, "keys": 0}
    if told.first is not None:
        mine = ledger(spark, path).agg(*[F.coalesce(F.sum(F.when(F.col("batch").between(told.first, told.last), F.col(c))), F.lit(0)).alias(c) for c in ("written", "published")], F.coalesce(F.max("keys"), F.lit(0)).alias("keys"))
        lines = mine.first().asDict()
    receipt = {"status": "complete", **told.sums, **lines, "coalesced": told.sums["extracted"] - lines["published"], "first_batch": told.first, "last_batch": told.last}
    if len({receipt[s] for s in STAGES}) != 1:
        return _failed(report, "sink", ValueError(f"rows are not conserved: {receipt}"))
    if report is not None:
        kinds = ", ".join(f"{k} {'string' if k == 'status' else 'long'}" for k in receipt)
        write_report(spark.createDataFrame([tuple(receipt.values())], kinds), report)
    return receipt


def _failed(report: str | None, phase: str, error: Exception) -> dict:
    failure = RunFailed(phase, str(error))
    if report is None:
        raise failure from error
    with failure_report(report, phase):
        raise failure from error
