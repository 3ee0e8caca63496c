"""AUROC and average precision of two models over many draws of clusters, without ranking a draw.

A draw weighs each cluster by a whole number and may swap the two models in it. Rows are counted once, by score, cluster, label and
model, and these cells are laid out in ranges of falling score. Each range works out all draws where it lies, in blocks of bounded
size: first what it weighs in each draw, then, with the weight of the ranges above it, its share of the metric; shares add up.
Cells times draws exist only within a block in a task; what is shuffled is ranges times draws. Where there are fewer ranges
than tasks, the draws of a range are dealt to several tasks. Equal scores are one step: they lie in one range, whose
cells of one score are no more than four a cluster.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.sources.store import written

#: Cells of a range, as sampled bounds cut them, and numbers in a block of draws.
RANGE, BLOCK = 2**17, 2**21
Dealt = Callable[[np.ndarray], np.ndarray]


def cells(rows: DataFrame, names: list[str]) -> DataFrame:
    """Table of part, score, c, label, side, n from rows (group_id, label, a, b): c is the place of a group in ``names``, side 0 is
    the score of a and 1 that of b, and n how often all of these occur. Scores of a part are below all scores of the parts before it."""
    places = rows.sparkSession.createDataFrame(list(enumerate(names)), "c int, group_id string")
    side = lambda k, name: F.struct(F.lit(k).alias("side"), F.col(name).alias("score"))
    both = rows.join(F.broadcast(places), "group_id").select("c", "label", F.explode(F.array(side(0, "a"), side(1, "b"))).alias("x"))
    counted = written(both.groupBy("x.score", "c", "label", "x.side").agg(F.count("*").alias("n")), "cells")
    parts = max(1, math.ceil(counted.count() / RANGE))
    laid = counted.repartitionByRange(parts, F.col("score").desc()).withColumn("part", F.spark_partition_id())
    return written(laid, "ranked-cells")


class _Range:
    """The cells of one range and the draws dealt to a task."""

    def __init__(self, frame: pd.DataFrame, draws: int, chunks: int, chunk: int, n: int, weights: Dealt, swaps: Dealt):
        frame = frame.sort_values("score", ascending=False, kind="stable")
        score = frame["score"].to_numpy()
        self.steps = np.append(0, np.flatnonzero(np.diff(score)) + 1)
        self.c, self.side, self.count = (frame[x].to_numpy() for x in ("c", "side", "n"))
        self.positive = frame["label"].to_numpy() == 1
        self.ids = np.arange(chunk, draws, chunks)
        self.block, self.weights, self.swaps = max(1, BLOCK // max(n, len(frame))), weights, swaps

    def blocks(self):
        """Ids, and for each of the two models the cells' weights (draws x cells)."""
        for k in range(0, len(self.ids), self.block):
            ids = self.ids[k : k + self.block]
            w = self.weights(ids)[:, self.c] * self.count
            mine = (self.swaps(ids)[:, self.c] == 1) == (self.side == 1)  # the cell counts for the first model
            yield k, ids, (w * mine, w * ~mine)


def _grouped(table: DataFrame, chunks: int) -> DataFrame:
    return table.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))


def differences(table: DataFrame, metric: str, draws: int, n: int, weights: Dealt, swaps: Dealt) -> np.ndarray:
    """The metric of the first model less that of the second for each draw 0 .. draws-1, nan where a class has no weight. ``weights`` and
    ``swaps`` give draws x clusters for an array of draws; ``table`` is of ``cells``, and ``n`` the number of clusters."""
    spark = table.sparkSession
    parts = table.agg(F.count_distinct("part")).first()[0]
    chunks = max(1, min(math.ceil(draws / 16), math.ceil(2 * spark.sparkContext.defaultParallelism / max(parts, 1))))

    def weigh(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        r = _Range(frame, draws, chunks, int(key[1]), n, weights, swaps)
        out = np.zeros((len(r.ids), 4))
        for k, ids, arms in r.blocks():
            for arm, w in enumerate(arms):
                out[k : k + len(ids), 2 * arm] = w[:, r.positive].sum(axis=1)
                out[k : k + len(ids), 2 * arm + 1] = w[:, ~r.positive].sum(axis=1)
        return pd.DataFrame({"id": r.ids, "part": key[0], **{name: out[:, j] for j, name in enumerate(sums)}})

    def share(key: tuple, frame: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        r = _Range(frame, draws, chunks, int(key[1]), n, weights, swaps)
        over = above.sort_values("id")[list(sums)].to_numpy()
        out = np.zeros((len(r.ids), 2))
        for k, ids, arms in r.blocks():
            for arm, w in enumerate(arms):
                p0, q0 = over[k : k + len(ids), 2 * arm, None], over[k : k + len(ids), 2 * arm + 1, None]
                p, q = np.add.reduceat(w * r.positive, r.steps, axis=1), np.add.reduceat(w * ~r.positive, r.steps, axis=1)
                p_to, q_to = p0 + np.cumsum(p, axis=1), q0 + np.cumsum(q, axis=1)
                each = p * (q_to - q / 2) if metric == "auroc" else p * p_to / np.maximum(p_to + q_to, 1)
                out[k : k + len(ids), arm] = each.sum(axis=1)
        return pd.DataFrame({"id": r.ids, "part": key[0], "a": out[:, 0], "b": out[:, 1]})

    sums = ("pa", "qa", "pb", "qb")
    dealt = _grouped(table, chunks)
    weighed = written(dealt.groupBy("part", "chunk").applyInPandas(weigh, "id long, part int, " + ", ".join(f"{s} double" for s in sums)), "range-weights")
    before = Window.partitionBy("id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    above = weighed.select("id", "part", (F.col("id") % chunks).cast("int").alias("chunk"), *[F.coalesce(F.sum(s).over(before), F.lit(0.0)).alias(s) for s in sums])
    shares = dealt.groupBy("part", "chunk").cogroup(above.groupBy("part", "chunk")).applyInPandas(share, "id long, part int, a double, b double")
    # The parts of a draw are added in their order, so that reruns agree to the last bit.
    listed = shares.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("part", "a", "b"))).alias("x"))
    added = lambda name: F.aggregate("x", F.lit(0.0), lambda s, x: s + x[name])
    total = weighed.groupBy("id").agg(F.sum("pa").alias("p"), F.sum("qa").alias("q"))
    found = listed.select("id", added("a").alias("a"), added("b").alias("b")).join(total, "id").orderBy("id").collect()
    a, b, p, q = (np.array([r[x] for r in found], float) for x in "abpq")
    with np.errstate(invalid="ignore", divide="ignore"):
        out = (b - a) / (p * q) if metric == "auroc" else (a - b) / p
    return np.where((p > 0) & (q > 0), out, np.nan)
