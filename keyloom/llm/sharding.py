"""Sharding by fixed virtual slots.

A record is hashed into one of a fixed number of slots (thousands). Bytes are summed
per slot, and a small versioned map says which shard holds which slot. The map is stored: a later
run loads the newest version, and where fresh sums are no longer near equal it moves whole slots and
stores the next version; every record of an unmoved slot stays where it is. A version is never
overwritten, and one that is not whole (a driver lost while it wrote) is passed over.

A record's key is its id, the crc of its text, and which of its equals it is, so rows that share an
id or are equal in all are spread like others. ``records`` numbers equal rows, which is the same on every
rerun. ``sharded`` keeps whole rows and does not shuffle them: only where a slot is heavy, as one that many equal
rows share, are its rows dealt over all slots by their place in the input.

Null ids are spread by the crc of their text; null text has size 1 and the crc of no bytes; a text
of any length is one record. An empty table gives an empty result and an even map. Columns named like those
that are added are replaced.
"""

from __future__ import annotations

import heapq
import zlib
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.llm.store import cut, exists, shared_dir, table

SLOTS = 4096
#: Equal rows made by a task at once.
COPIES = 1024
#: A slot is heavy if it holds more than one in so many of a shard's bytes; so there are at most shards x HEAVY of them.
HEAVY = 20


def slot_column(id_col: Column, crc: Column, nth: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(id_col.isNull(), id_col.cast("string"), crc, nth), F.lit(slots)).cast("int")


def _sizes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes + 1), text_crc32, nth (which of its equals) and virtual_slot of every row. Equal rows are
    counted with partial aggregates and made again in pieces of COPIES, so no task holds all of many."""
    groups = cut(_sizes(docs, id_col, text_col).groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n")), "slot-groups")
    few = groups.filter(F.col("n") <= COPIES).withColumn("from", F.lit(0).cast("long"))
    many = groups.filter(F.col("n") > COPIES).withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long"))))
    parts = few.unionByName(many.repartition("doc_id", "size", "text_crc32", "from"))
    each = parts.withColumn("nth", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + COPIES, F.col("n")) - 1)))
    return each.select("doc_id", "size", "text_crc32", "nth", slot_column(F.col("doc_id"), F.col("text_crc32"), F.col("nth"), slots).alias("virtual_slot"))


def slot_stats(recs: DataFrame) -> DataFrame:
    """Rows and bytes of each slot that has any; never more rows than slots."""
    return recs.groupBy("virtual_slot").agg(F.count("*").alias("n_rows"), F.sum("size").alias("n_bytes"))


def _bytes(recs: DataFrame) -> dict[int, int]:
    return {r["virtual_slot"]: r["n_bytes"] for r in slot_stats(recs).collect()}


@dataclass(frozen=True)
class SlotMap:
    """shards[s] is the shard of slot s."""

    version: int
    n_shards: int
    shards: tuple[int, ...]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.version, self.n_shards, s, x) for s, x in enumerate(self.shards)], "version int, n_shards int, virtual_slot int, shard int")

    def save(self, spark: SparkSession, path: str) -> None:
        """Adds this version below ``path``; a version is never overwritten."""
        self.frame(spark).coalesce(1).drop("version").write.mode("errorifexists").parquet(f"{path}/version={self.version}")

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """The newest whole version, or the one asked for."""
        rows = spark.read.schema("n_shards int, virtual_slot int, shard int, version int").parquet(path)
        whole = rows.groupBy("version").agg(F.count("*").alias("n"), F.max("virtual_slot").alias("last"), F.count_distinct("n_shards").alias("k")).filter("n = last + 1 and k = 1")
        version = whole.agg(F.max("version")).first()[0] if version is None else version
        got = rows.filter(F.col("version") == version).orderBy("virtual_slot").collect() if version is not None else []
        if not got:
            raise ValueError(f"no slot map version {version} in {path}")
        return SlotMap(version, got[0]["n_shards"], tuple(r["shard"] for r in got))


def build_map(stats: dict[int, int], n_shards: int, slots: int = SLOTS, version: int = 1) -> SlotMap:
    """Slots by falling bytes, each to the lightest shard so far; empty slots go to the shard with the fewest."""
    if n_shards < 1:
        raise ValueError("at least one shard")
    heap = [(0, 0, k) for k in range(n_shards)]
    out = [0] * slots
    for s in sorted(range(slots), key=lambda s: (-stats.get(s, 0), s)):
        load, held, k = heapq.heappop(heap)
        out[s] = k
        heapq.heappush(heap, (load + stats.get(s, 0), held + 1, k))
    return SlotMap(version, n_shards, tuple(out))


def rebalance(old: SlotMap, stats: dict[int, int], n_shards: int | None = None, tolerance: float = 0.01) -> SlotMap:
    """The next version of ``old``. Slots of shards that are gone go to the lightest ones; then, while a shard is off the mean
    by more than ``tolerance``, the heaviest gives the lightest the slot that evens them best. Nothing else moves."""
    n = n_shards or old.n_shards
    held, load, out = [set() for _ in range(n)], [0] * n, list(old.shards)
    size = lambda s: stats.get(s, 0)

    def give(s: int, k: int) -> None:
        if out[s] < n and s in held[out[s]]:
            held[out[s]].discard(s)
            load[out[s]] -= size(s)
        out[s] = k
        held[k].add(s)
        load[k] += size(s)

    loose = []
    for s, k in enumerate(old.shards):
        if k < n:
            give(s, k)
        else:
            loose.append(s)
    for s in sorted(loose, key=lambda s: (-size(s), s)):
        give(s, min(range(n), key=lambda k: (load[k], len(held[k]), k)))
    mean = sum(stats.values()) / n
    while True:
        heavy, light = max(range(n), key=lambda k: (load[k], -k)), min(range(n), key=lambda k: (load[k], k))
        if load[heavy] <= mean * (1 + tolerance) and load[light] >= mean * (1 - tolerance):
            break
        gap = load[heavy] - load[light]
        able = [s for s in held[heavy] if 0 < size(s) < gap]
        if not able:
            break  # single slots are larger than what is uneven
        give(min(able, key=lambda s: (abs(2 * size(s) - gap), s)), light)
    return SlotMap(old.version + 1, n, tuple(out))


def map_path(spark: SparkSession, name: str, sf_dir: str) -> str:
    """Where the slot map of a folder of tables is kept."""
    return f"{shared_dir(spark)}/slot-maps/{name}-{zlib.crc32(sf_dir.rstrip('/').encode()):08x}"


def current_map(spark: SparkSession, path: str, stats: dict[int, int], n_shards: int, slots: int = SLOTS) -> SlotMap:
    """The stored map if it is still even, else its edited next version, which is stored; the first version where there is none."""
    for attempt in range(8):
        old = SlotMap.load(spark, path) if exists(spark, path) else None
        if old is not None and len(old.shards) != slots:
            raise ValueError(f"the slot map in {path} has {len(old.shards)} slots")
        new = build_map(stats, n_shards, slots) if old is None else rebalance(old, stats, n_shards)
        if old is not None and (new.shards, new.n_shards) == (old.shards, old.n_shards):
            return old
        new = replace(new, version=new.version + attempt)
        try:
            new.save(spark, path)
        except AnalysisException:  # another driver was first, or was lost while it wrote
            continue
        return new
    raise RuntimeError(f"no slot map could be stored in {path}")


def assign(recs: DataFrame, slot_map: SlotMap) -> DataFrame:
    """Adds ``shard``. The map is broadcast: it has as many rows as there are slots, whatever the data."""
    return recs.join(F.broadcast(slot_map.frame(recs.sparkSession).select("virtual_slot", "shard")), "virtual_slot")


def fit_map(recs: DataFrame, n_shards: int, slots: int = SLOTS) -> SlotMap:
    return build_map(_bytes(recs), n_shards, slots)


def numbered(sharded_: DataFrame) -> DataFrame:
    """Adds ``slot``: the row's place in its shard, from 0 without gaps. Rows are numbered within their virtual slot, none of which
    equal rows can fill; the slots' offsets are a table of at most SLOTS rows."""
    counts = sharded_.groupBy("shard", "virtual_slot").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("virtual_slot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size", "nth")
    return sharded_.withColumn("place", F.row_number().over(within)).join(F.broadcast(offsets), "virtual_slot").withColumn("slot", F.col("offset") + F.col("place") - 1)


def sharded(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """Every row with all its columns, and virtual_slot, shard and map_version. Only slot sums are shuffled; the map of fixed
    size is broadcast to the rows. With ``map_path`` the map stored there is kept and edited, else a new one is made."""
    spark = docs.sparkSession
    out = docs.drop("virtual_slot", "shard", "map_version")
    names = out.columns
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = out.withColumn("__crc", F.crc32(text)).withColumn("__bytes", (F.octet_length(text) + 1).cast("long"))
    out = out.withColumn("virtual_slot", slot_column(F.col(id_col), F.col("__crc"), F.lit(0).cast("long"), slots))
    sums = _bytes(out.select("virtual_slot", F.col("__bytes").alias("size")))
    heavy = [s for s, b in sums.items() if b * n_shards * HEAVY > sum(sums.values())]
    if heavy:
        again = slot_column(F.col(id_col), F.col("__crc"), 1 + F.monotonically_increasing_id(), slots)
        out = out.withColumn("virtual_slot", F.when(F.col("virtual_slot").isin(heavy), again).otherwise(F.col("virtual_slot")))
        sums = _bytes(out.select("virtual_slot", F.col("__bytes").alias("size")))
    slot_map = current_map(spark, map_path, sums, n_shards, slots) if map_path else build_map(sums, n_shards, slots)
    return assign(out, slot_map).select(*names, "virtual_slot", "shard", F.lit(slot_map.version).alias("map_version"))


def op6_virtual_slots(spark: SparkSession, sf_dir: str, n_shards: int = 16) -> DataFrame:
    """All documents in shards 0 to 15 of near equal bytes; ``slot`` is the place in the shard."""
    recs = cut(records(table(spark, sf_dir, "documents")), "slot-records")
    slot_map = current_map(spark, map_path(spark, "op6", sf_dir), _bytes(recs), n_shards)
    return numbered(assign(recs, slot_map)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(slot_map.version).alias("map_version")
    )
