"""Bounded groups: rows that share a key, cut into blocks of limited size and worked on by numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Members of a block's side; a larger group is cut into pairs of such sides.
SIDE = 2048


def in_blocks(members: DataFrame, key: str, size: str, member: Column, side: int = SIDE) -> DataFrame:
    """Deals each member of a group of ``size`` rows to every block that must hold it: the group is cut by the
    member's hash into ceil(size/side) parts, and a block is a pair of parts. Adds ``part``, ``low`` and ``high``;
    every pair of members meets in exactly one block, and no block grows with the group."""
    parts = F.greatest(F.lit(1), F.ceil(F.col(size) / F.lit(side))).cast("int")
    out = members.withColumn("part", F.pmod(F.xxhash64(member, F.lit("part")), parts).cast("int"))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    return out.withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other")).drop("other")


def map_groups(df: DataFrame, keys: list[str], work: Callable[[pa.Table], dict | None], schema: str) -> DataFrame:
    """``work`` on the rows of each key, which are bounded (see in_blocks). Rows are shuffled and sorted by key, and
    a task reads its groups one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def flush(done: pa.Table) -> Iterator[pa.RecordBatch]:
            edges = starts(done)
            outs = [out for a, b in zip(edges, edges[1:], strict=False) if (out := work(done.slice(a, b - a))) is not None]
            if outs:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(o[k]) for o in outs]) for k in outs[0]], list(outs[0]))

        def starts(t: pa.Table) -> list[int]:
            change = np.zeros(t.num_rows, bool)
            change[:1] = True
            for k in keys:
                x = t.column(k).to_numpy()
                change[1:] |= x[1:] != x[:-1]
            return [*np.flatnonzero(change).tolist(), t.num_rows]

        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now]).combine_chunks()
            edges = starts(held)
            if len(edges) > 2:
                yield from flush(held.slice(0, edges[-2]))
                held = held.slice(edges[-2])
        if held is not None and held.num_rows:
            yield from flush(held.combine_chunks())

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
