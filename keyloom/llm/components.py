"""Connected components by alternating stars: every pass is two joins over edges, and the graph
shrinks to stars around each component's smallest vertex. Nothing is gathered on the driver.

The hub of a star would meet all its neighbours in a join. Vertices with more than one in HOTS of all edges are
few whatever the data, so what is to be known of them is broadcast, and their edges stay where they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.shares import HOTS
from keyloom.llm.store import cut, drop_written, n_written


def _joined(e: DataFrame, by: str, low: DataFrame, how: str, total: int) -> DataFrame:
    """Edges (a, b), ``total`` in all, with ``m`` of the vertex in column ``by``, from ``low`` (v, m)."""
    e = e.withColumn("v", F.col(by))
    hubs = e.groupBy("v").agg(F.count("*").alias("n")).filter(F.col("n") * F.lit(HOTS) > F.lit(total)).select("v")
    few = F.broadcast(hubs.join(low.hint("merge"), "v", how))
    rest = e.join(F.broadcast(hubs), "v", "left_anti").join(low.hint("merge"), "v", how)
    return e.join(few, "v").unionByName(rest)


def _large_star(e: DataFrame, total: int) -> DataFrame:
    """Edges a > b: every larger neighbour of b moves to the smallest neighbour of b, or stays with b if there is no smaller one."""
    low = e.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m"))
    return _joined(e, "b", low, "left", total).select("a", F.coalesce("m", "b").alias("b")).distinct()


def _small_star(e: DataFrame, total: int) -> DataFrame:
    """Edges a > b: a and its smaller neighbours all move to the smallest of these."""
    low = e.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m"), F.max("b").alias("most"))
    several = low.filter("m < most").select("v", "m")
    moved = _joined(e, "a", several, "inner", total).filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select(F.col("v").alias("a"), F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every vertex with an edge; component is the smallest id that can be reached.

    Edges with a null end and loops say nothing and are passed over; no edges give no rows. The result is a written table's."""
    e = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a is not null and b is not null and a != b")
    at = n_written()
    e = cut(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    spark, seen, total = e.sparkSession, None, e.count()
    while True:
        large = cut(_large_star(e, total), "large-stars")
        e = cut(_small_star(large, total), "stars")  # a star has no more edges than what it is made of
        drop_written(spark, at, keep_last=True)  # a pass reads the one before alone
        state = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == seen:
            break
        seen, total = state, state[0]
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
