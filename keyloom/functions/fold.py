"""Ordered folds: state that each row of a key changes in turn, where no window can express it.

Rows are dealt by key and sorted within partitions, and a task walks through them with the
state of one key at a time. A key of any length needs the memory of one Arrow batch.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], inputs: list[str], start: Callable[[], Any], step: Callable[..., tuple], out: str) -> DataFrame:
    """Every row with the columns of ``out`` (DDL) added: (state, *values) = step(state, *inputs), from start() at each new key.

    With ``keys`` empty the whole table is one sequence; that is for sequences that are small by nature, such as batches."""
    added = T._parse_datatype_string(out)
    names = [f.name for f in added]
    schema = T.StructType([f for f in df.schema if f.name not in names] + list(added))
    kept = [f.name for f in df.schema if f.name not in names]
    dealt = df.repartition(*keys).sortWithinPartitions(*keys, *order) if keys else df.coalesce(1).sortWithinPartitions(*order)

    def run(batches):
        last, state = None, start()
        for b in batches:
            at = {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names) if n in inputs or n in keys}
            key_rows = list(zip(*(at[k] for k in keys), strict=True)) if keys else [()] * b.num_rows
            columns: list[list] = [[] for _ in names]
            for key, row in zip(key_rows, zip(*(at[i] for i in inputs), strict=True), strict=True):
                if key != last:
                    last, state = key, start()
                state, *values = step(state, *row)
                for c, v in zip(columns, values, strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(n)) for n in kept] + [pa.array(c, _arrow(f.dataType)) for c, f in zip(columns, added, strict=True)], kept + names)

    return dealt.mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}[kind.simpleString()]
