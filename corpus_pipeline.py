"""The corpus pipeline: documents through toxicity, near duplicates, benchmark leaks, mixing and shards.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's ``docs``. All but the last return the columns of
``documents`` as they came, extra columns included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keyloom.llm import decontaminate, minhash, mixing, sharding, toxicity
from keyloom.llm.store import cut, drop_written, n_written, table

N_SHARDS = 16


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that a model learned from ``labels`` rejects."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, the one of the smallest id. Rows are told apart by id and text, so an id that
    stands on different texts loses none of them; rows without an id take part and are taken last. Rows without words all stay."""
    return minhash.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a window of the benchmark."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it: not at all, once, or once for each epoch."""
    return mixing.repeated(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with ``virtual_slot``, ``shard`` and ``map_version``; the tables' stored slot map is kept and edited."""
    return sharding.sharded(docs, N_SHARDS, map_path=sharding.map_path(spark, "pipeline", sf_dir))


#: (name, function of (spark, docs, sf_dir)); each result is written and read again as the next one's docs.
STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", shard),
]
#: The first stage learns and others hash in ways SQL has no functions for; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; a stage's result is written before the next one reads it, and what came before it is dropped."""
    docs, at = table(spark, sf_dir, "documents"), n_written()
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, f"stage-{name}")
            drop_written(spark, at, keep_last=True)
    return docs
