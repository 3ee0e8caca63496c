"""Results that leave the library as a folder: its tables, and last of all an accounting that has to agree with what was written.

The accounting (``release.json``) is moved into place when the tables are there and its numbers agree with theirs; a folder without it is no
release and is not read as one. Folders may lie wherever Spark can write. Nothing is ever written over.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.operators import canonical, labels, reconcile
from keyloom.sources.events import EVENT
from keyloom.sources.sinks import write_csv, write_layout

ACCOUNTING = "release.json"
LABELS = "seq long, event_ts_ns long, user_id long, label int, label_valid int, censored int, positive_witness_seq long"
#: A table that goes into an accounting as it is may have so many rows; more is an error.
MOST_ROWS = 10_000


class NotConserved(ValueError):
    """What was written is not what the accounting tells."""


def _file(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _settle(spark: SparkSession, path: str, told: dict, counts: dict[str, int]) -> dict:
    """Leaves ``told`` and ``counts`` (rows by table, read back) at ``path``."""
    told = told | {"rows": counts}
    to, fs = _file(spark, f"{path}/{ACCOUNTING}")
    pending, _ = _file(spark, f"{path}/.{ACCOUNTING}.pending")
    if fs.exists(to):
        raise FileExistsError(f"{path} is a release already")
    stream = fs.create(pending, True)
    try:
        stream.write(bytearray((json.dumps(told, indent=1, sort_keys=True, allow_nan=False) + "\n").encode()))
    finally:
        stream.close()
    if not fs.rename(pending, to):
        raise FileExistsError(f"{path} is a release already")
    return told


def accounting(spark: SparkSession, path: str) -> dict:
    """What a release tells of itself; FileNotFoundError where there is none."""
    at, fs = _file(spark, f"{path}/{ACCOUNTING}")
    if not fs.exists(at):
        raise FileNotFoundError(f"{path} is no release")
    stream = fs.open(at)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def read_release(spark: SparkSession, path: str, name: str, schema: str | None = None) -> DataFrame:
    """A table of a release. Raises where the release is not complete, has no such table, or has another number of rows than it tells."""
    told = accounting(spark, path)["rows"]
    if name not in told:
        raise KeyError(f"{path} has no table {name}")
    reader = spark.read.option("header", True).option("enforceSchema", False).option("mode", "FAILFAST")
    rows = (reader.schema(schema) if schema else reader).csv(f"{path}/{name}")
    if (n := rows.count()) != told[name]:
        raise NotConserved(f"{name}: {n} rows, {told[name]} told")
    return rows


def _rows(spark: SparkSession, path: str) -> int:
    return spark.read.option("header", True).schema("first string").csv(path).count()


def publish_events(raw: DataFrame, path: str, campaign: tuple[int, int] = canonical.CAMPAIGN) -> dict:
    """The canonical events of ``raw`` as table ``events``, and what was left out and why. Raises NotConserved unless raw rows are
    emitted, left out or repeated, and as many were written as emitted. A source without events makes an empty table."""
    told = canonical.ledger(raw, campaign).first().asDict()
    if not told["conserved"]:
        raise NotConserved(str(told))
    write_csv(canonical.canonical(raw, campaign), f"{path}/events")
    n = _rows(raw.sparkSession, f"{path}/events")
    if n != told["emitted"]:
        raise NotConserved(f"{n} events written, {told['emitted']} emitted")
    return _settle(raw.sparkSession, path, {"campaign": list(campaign), "ledger": told}, {"events": n})


def publish_labels(events: DataFrame, path: str, horizon_ns: int, end_ns: int) -> dict:
    """Labels of ``events`` as table ``labels``, and their manifest, which is counted from what was written. Raises NotConserved unless every
    event has one row, labelled or censored, and every positive has its witness."""
    spark = events.sparkSession
    write_csv(labels.causal_labels(events, horizon_ns, end_ns), f"{path}/labels")
    told = labels.manifest(spark.read.schema(LABELS).option("header", True).csv(f"{path}/labels")).first().asDict()
    n = events.count()
    sound = n == told["total"] == told["evaluated"] + told["censored"] and told["evaluated"] == told["positive"] + told["negative"] and told["positive"] == told["witnesses"]
    if not sound:
        raise NotConserved(f"{n} events, labels {told}")
    return _settle(spark, path, {"horizon_ns": horizon_ns, "end_ns": end_ns, "manifest": told}, {"labels": n})


def publish_run(predictions: DataFrame, queries: DataFrame, path: str, columns: list[str], sla_ms: float) -> dict:
    """Predictions (in the layout ``columns``) and answered queries of a run as tables, and its result: coverage, work of writing, staleness
    and deadlines, worked out from the tables. ``predictions`` tell by ``published`` what became public; a query without ``feature_ts_ns``
    was offered and not answered. Raises NotConserved where writes are not conserved, and where a query was answered by a later feature."""
    spark = predictions.sparkSession
    write_layout(predictions, f"{path}/predictions", columns)
    write_layout(queries, f"{path}/queries", ["query_id", "query_ts_ns", "feature_ts_ns", "latency_ms"])
    asked = spark.read.option("header", True).schema("query_id string, query_ts_ns long, feature_ts_ns long, latency_ms double").csv(f"{path}/queries")
    if late := reconcile.leaks(asked).count():
        raise NotConserved(f"{late} queries answered by a later feature")
    written = F.count_if("published")
    made = predictions.agg(F.count("*").alias("events_processed"), written.alias("writes_emitted"), F.count_if(~F.col("published")).alias("events_absorbed"))
    summary = made.crossJoin(asked.agg(F.count("*").alias("queries_offered"), F.count("feature_ts_ns").alias("queries_answered")))  # one row each
    told, result = summary.first().asDict(), reconcile.streaming_metrics(summary, asked, sla_ms).first().asDict()
    counts = {"predictions": _rows(spark, f"{path}/predictions"), "queries": told["queries_offered"]}
    if not result["conserved"] or counts["predictions"] != told["events_processed"]:
        raise NotConserved(f"{told}, rows {counts}")
    return _settle(spark, path, {"telemetry": told, "result": result}, counts)


def publish_tables(spark: SparkSession, path: str, tables: dict[str, DataFrame]) -> dict:
    """Small tables of an analysis, each whole in the accounting, in the order of their first columns; MOST_ROWS each at most, more is an error."""
    told = {}
    for name, df in tables.items():
        rows = df.orderBy(*df.columns[:2]).take(MOST_ROWS + 1)
        if len(rows) > MOST_ROWS:
            raise ValueError(f"{name} has more than {MOST_ROWS} rows")
        told[name] = [r.asDict(recursive=True) for r in rows]
    return _settle(spark, path, {"tables": told}, {name: len(rows) for name, rows in told.items()})


def events_of(spark: SparkSession, path: str) -> DataFrame:
    return read_release(spark, path, "events", EVENT)


def labels_of(spark: SparkSession, path: str) -> DataFrame:
    return read_release(spark, path, "labels", LABELS)
