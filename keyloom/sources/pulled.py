"""Rows that a function yields, as a Spark data source."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from keyloom.sources.events import EVENT


def pulled(spark: SparkSession, pull: Callable[[int], Iterable[tuple]], parts: int, columns: str = EVENT) -> DataFrame:
    """What ``pull(0)`` to ``pull(parts - 1)`` yield, as rows of ``columns``. Each part is read by a task of its own, row by row, and
    again if its executor is lost or the DataFrame is used twice, so ``pull`` has to yield the same for the same part."""
    if parts < 1:
        raise ValueError("at least one part")
    called = f"pulled_{uuid.uuid4().hex}"

    class Reader(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            return [InputPartition(k) for k in range(parts)]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            yield from pull(partition.value)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return called

        def schema(self) -> str:
            return columns

        def reader(self, schema) -> DataSourceReader:
            return Reader()

    spark.dataSource.register(Source)
    return spark.read.format(called).load()
