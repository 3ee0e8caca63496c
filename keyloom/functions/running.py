"""Running sums over an order of all rows, without a window that holds them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.sources.store import written


def joined(a: DataFrame, b: DataFrame, on: list[str] | tuple[str, ...], how: str = "inner") -> DataFrame:
    """Joined by the columns ``on``, where null is a value like any other."""
    names = {c: f"__on_{i}" for i, c in enumerate(on)}
    same = [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]
    return a.join(b.withColumnsRenamed(names), same, how).drop(*names.values())


def before(df: DataFrame, order: list, values: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``<value>_before`` for each of ``values``: its sum over the rows that stand before, in ``order`` and within ``by``.

    Rows are dealt by ranges of (by, order) and summed in each range; what stands before a range is a sum over the ranges'
    totals, of which there are as many as ranges and groups."""
    pid = "__range"
    rows = written(df, "rows")  # bounds of ranges are sampled from it: what it is made of is not worked out twice
    placed = written(rows.repartitionByRange(*by, *order).withColumn(pid, F.spark_partition_id()), "ranges")
    totals = placed.groupBy(pid, *by).agg(*[F.sum(v).alias(f"__{v}") for v in values])
    earlier = Window.partitionBy(*by).orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(pid, *by, *[F.coalesce(F.sum(f"__{v}").over(earlier), F.lit(0)).alias(f"__{v}") for v in values])
    inside = Window.partitionBy(pid, *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.withColumns({f"{v}_before": F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values})
    found = joined(sums, offsets, [pid, *by]) if by else sums.join(offsets, [pid])
    return found.withColumns({f"{v}_before": F.col(f"{v}_before") + F.col(f"__{v}") for v in values}).drop(pid, *[f"__{v}" for v in values])


def first(df: DataFrame, order: list, n: int) -> DataFrame:
    """The first ``n`` rows in ``order``, which tells all rows apart. Rows are dealt by ranges and counted; ranges that lie before the n-th row
    are whole, and only the one that holds it is put in order, so that no task has more than a range."""
    pid, at = "__range", "__place"
    placed = written(df.repartitionByRange(*order).withColumn(pid, F.spark_partition_id()), "first")
    whole, left = -1, n
    for r in placed.groupBy(pid).agg(F.count("*").alias("n")).orderBy(pid).collect():  # as many rows as ranges
        if r["n"] > left:
            cut = placed.filter(F.col(pid) == r[pid]).withColumn(at, F.row_number().over(Window.partitionBy(pid).orderBy(*order)))
            return placed.filter(F.col(pid) <= whole).unionByName(cut.filter(F.col(at) <= left).drop(at)).drop(pid)
        whole, left = r[pid], left - r["n"]
    return placed.drop(pid)
