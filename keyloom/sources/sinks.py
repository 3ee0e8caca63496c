"""Sinks: tables and small reports, each published whole or not at all, and never over another."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; booleans as 0 and 1, doubles so that they read back to the same bits."""
    flags = [c for c, kind in df.dtypes if kind == "boolean"]
    df.withColumns({c: df[c].cast("int") for c in flags}).write.mode("errorifexists").option("header", True).csv(path)


def write_table(df: DataFrame, path: str, *partition_by: str) -> None:
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def append_versions(versions: DataFrame, path: str) -> None:
    """Published versions are only ever added; the latest of a key is found by reading (see cache.latest)."""
    versions.write.mode("append").parquet(path)


def write_report(df: DataFrame, path: str) -> dict:
    """The one row of an accounting DataFrame as JSON, moved into place when complete."""
    rows = df.take(2)
    if len(rows) != 1:
        raise ValueError("a report is one row")
    return _publish(rows[0].asDict(recursive=True), path)


def new_attempt(root: str) -> Path:
    """The next unused folder attemptNNNN below ``root``."""
    n = 1 + max((int(p.name[7:]) for p in Path(root).glob("attempt[0-9][0-9][0-9][0-9]")), default=0)
    while True:
        path = Path(root) / f"attempt{n:04d}"
        try:
            path.mkdir(parents=True)
            return path
        except FileExistsError:  # another driver took it
            n += 1


def _publish(report: dict, path: str) -> dict:
    pending = Path(f"{path}.pending")
    pending.write_text(json.dumps(report, indent=1, sort_keys=True, allow_nan=False, default=str) + "\n")
    pending.rename(path)
    return report


@contextmanager
def failure_report(path: str, phase: str) -> Iterator[None]:
    """Leaves a report with the phase and the error at ``path`` if the block fails, and raises what it raised, even if no report could be
    written."""
    try:
        yield
    except Exception as error:
        try:
            _publish({"status": "failed", "phase": phase, "kind": type(error).__name__, "error": str(error)}, path)
        except OSError:
            pass
        raise


def model_manifest(model, history: list[float], rows: DataFrame, path: str) -> dict:
    """What a trained model is and was trained on: its values to the last bit and their SHA-256, how the objective fell, rows by label."""
    by_label = {str(r["label"]): r["n"] for r in rows.groupBy(F.col("label").cast("int").alias("label")).agg(F.count("*").alias("n")).collect()}
    values = {"bias": f"{model.bias:.17g}", **{f"w{i}": f"{w:.17g}" for i, w in enumerate(model.weights)}}
    digest = hashlib.sha256("".join(f"{k}={v}\n" for k, v in values.items()).encode()).hexdigest()
    return _publish({"schema": model.SCHEMA, "values": values, "sha256": digest, "iterations": len(history), "first_objective": history[0] if history else None, "last_objective": history[-1] if history else None, "rows_by_label": by_label}, path)


# Columns of the engine's predictions and of the answers to queries, in their order.
PREDICTION_COLUMNS = (
    "seq event_ts_ns key score alpha_used pressure_used pressure_generation_used pressure_available source_created_ns scored_ns latency_ns batch_size"
    " batch_pressure batch_pressure_generation x0 x1 x2 x3 x4 x5 x6 item_id category_id behavior_code pressure_sampled_ns pressure_loaded_ns"
).split()
ANSWER_COLUMNS = (
    "query_id key query_ts_ns cold_start version_id latest_included_seq latest_event_ts_ns event_time_age_ns update_staleness feature_error"
    " cached_x0 cached_x1 cached_x2 cached_x3 cached_x4 cached_x5 cached_x6 fresh_x0 fresh_x1 fresh_x2 fresh_x3 fresh_x4 fresh_x5 fresh_x6"
).split()


def write_layout(df: DataFrame, path: str, columns: list[str]) -> None:
    """CSV in a fixed layout: exactly these columns in this order, doubles so that they read back to the same bits. What ``df`` lacks is
    an error; what a batch job has no values for (such as times of the engine's clock) has to be given as columns too."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    write_csv(df.select(*columns), path)
