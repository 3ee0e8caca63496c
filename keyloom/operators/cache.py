"""The versioned feature cache and its three ways to answer a query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.columns import FEATURES, l2

META = ("version_id", "latest_included_seq", "latest_event_ts_ns")


def versions(published: DataFrame) -> DataFrame:
    """All published versions: key, version_id, latest_included_seq, latest_event_ts_ns, features."""
    return published.filter("published").select("key", "version_id", F.col("seq").alias("latest_included_seq"), F.col("event_ts_ns").alias("latest_event_ts_ns"), *FEATURES)


def latest(all_versions: DataFrame) -> DataFrame:
    """The newest version of each key."""
    row = F.struct(*META[1:], *FEATURES)
    return all_versions.groupBy("key").agg(F.max("version_id").alias("version_id"), F.max_by(row, "version_id").alias("v")).select("key", "version_id", "v.*")


def size(all_versions: DataFrame) -> DataFrame:
    """One row: keys that have a version, and publications in all."""
    return all_versions.agg(F.count_distinct("key").alias("size"), F.count("*").alias("total_publications"))


def fresh(features: DataFrame) -> DataFrame:
    """Each key's features after its last event, and its pending updates."""
    return features.groupBy("key").agg(F.max_by(F.struct("pending", *FEATURES), "seq").alias("f")).select("key", F.col("f.pending").alias("update_staleness"), *[F.col(f"f.{x}").alias(f"fresh_{x}") for x in FEATURES])


def _answered(joined: DataFrame) -> DataFrame:
    """Defaults of a cold start, age, staleness and feature error."""
    cold = F.col("version_id").isNull()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    age = F.when(cold, F.col("query_ts_ns")).otherwise(F.greatest(F.lit(0), F.col("query_ts_ns") - F.col("latest_event_ts_ns")))
    return joined.select(
        "query_id", "key", "query_ts_ns", cold.alias("cold_start"), *[F.coalesce(F.col(m), F.lit(0)).alias(m) for m in META], age.alias("event_time_age_ns"), F.coalesce("update_staleness", F.lit(0)).alias("update_staleness"),
        l2([zero(x) for x in FEATURES], [zero(f"fresh_{x}") for x in FEATURES]).alias("feature_error"), *[zero(x).alias(f"cached_{x}") for x in FEATURES], *[zero(f"fresh_{x}").alias(f"fresh_{x}") for x in FEATURES],
    )


def query_final(queries: DataFrame, published: DataFrame) -> DataFrame:
    """Answers after all events: the newest version of the key, whatever the time of the query."""
    return _answered(queries.join(latest(versions(published)), "key", "left").join(fresh(published), "key", "left"))


def _timeline(queries: DataFrame, published: DataFrame, order: list[Column], place_of_query: Column, place_of_event: Column) -> DataFrame:
    """As-of answers: events and queries of a key in one order; a query sees the last version and state before it."""
    version = F.struct(*[F.col(c) for c in ("version_id",)], F.col("seq").alias("latest_included_seq"), F.col("event_ts_ns").alias("latest_event_ts_ns"), *FEATURES)
    state = F.struct(F.col("pending").alias("update_staleness"), *[F.col(x).alias(f"fresh_{x}") for x in FEATURES])
    e = published.select("key", place_of_event.alias("place"), F.lit(0).alias("is_query"), F.col("seq").alias("at"), F.when(F.col("published"), version).alias("v"), state.alias("s"))
    q = queries.select("key", place_of_query.alias("place"), F.lit(1).alias("is_query"), F.col("query_id").alias("at"), "query_id", "query_ts_ns")
    both = e.unionByName(q, allowMissingColumns=True)
    w = Window.partitionBy("key").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    seen = both.withColumn("v", F.last("v", True).over(w)).withColumn("s", F.last("s", True).over(w)).filter("is_query = 1")
    return _answered(seen.select("query_id", "key", "query_ts_ns", "v.*", "s.*"))


def query_asof(queries: DataFrame, published: DataFrame) -> DataFrame:
    """Answers from the events before the query in the common order of ids; an event of the same place comes after it."""
    return _timeline(queries, published, [F.col("place"), F.col("is_query").desc(), F.col("at")], F.col("query_id"), F.col("seq"))


def query_phase_end(queries: DataFrame, published: DataFrame, phase_of_query: Column, phase_of_event: Column) -> DataFrame:
    """Answers at the end of the query's phase: all events of phases up to it are in, its own included."""
    return _timeline(queries, published, [F.col("place"), F.col("is_query"), F.col("at")], phase_of_query, phase_of_event)
