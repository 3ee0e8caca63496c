"""Near-duplicate embeddings: random-hyperplane sign hashing in several tables, exact cosine
in double precision, and distributed connected components.

A table's key is the signs of a vector against ``bits`` hyperplanes. Bits and tables follow
from the number of vectors: buckets of about BUCKET vectors, and as many tables as it takes
to find a pair at the threshold itself with probability RECALL (pairs above it more surely).
The signs of all tables, SIGNS at least, are a vector's signature. What is dealt to the
buckets is signatures: in blocks of bounded size, pairs whose signs differ too much for the
threshold (by REACH standard deviations) are passed over, and so are pairs that have met in
an earlier table. Only vectors that have a partner left are sent after, and compared exactly.
Equal vectors are collapsed first and counted. A pair counts in the first table where it
meets, so links are counted without being listed, and each block passes on only a spanning
forest of its links.

Null, empty, zero and non-finite vectors (or with null components) link with nothing; vectors
of different lengths link with nothing of another length. Rows without an id link like all others: their component is the
smallest id in it, and they are kept only where it has none. Rows that repeat an id are vectors of their own, and each counts the others. An empty table gives an empty result. Vectors
of single precision are sent as such; all arithmetic is in double precision.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.components import components
from keyloom.llm.groups import in_blocks, map_groups
from keyloom.llm.shares import with_facts
from keyloom.llm.store import cut, drop_written, n_written, table

THRESHOLD, RECALL, BUCKET, SEED = 0.9, 0.995, 512, 17
#: Signs that tell whether a pair can be close, and by how many standard deviations they may be off.
SIGNS, REACH = 256, 4.5
#: Vectors of a block's side.
SIDE = 512
BLOCK = ["bucket", "low", "high"]


def plan(n: int, threshold: float = THRESHOLD, recall: float = RECALL, bucket: int = BUCKET) -> tuple[int, int]:
    """(bits, tables) for ``n`` vectors."""
    bits = max(1, round(math.log2(max(2, n) / bucket)))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - same)))


def signs_of(x: np.ndarray, bits: int, tables: int, seed: int = SEED) -> np.ndarray:
    """Signs of each vector, those of the tables first; the planes depend on the vectors' length, bits, tables and seed alone."""
    n = -(-max(SIGNS, bits * tables) // 8) * 8
    planes = np.random.default_rng([seed, x.shape[1], bits]).standard_normal((x.shape[1], n))
    return x @ planes > 0


def keys_from(signs: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Key of each vector in each table."""
    return (signs[:, : bits * tables].reshape(len(signs), tables, bits) * (np.int64(1) << np.arange(bits, dtype=np.int64))).sum(axis=2)


def keys_of(x: np.ndarray, bits: int, tables: int, seed: int = SEED) -> np.ndarray:
    return keys_from(signs_of(x, bits, tables, seed), bits, tables)


def most_differing(threshold: float) -> float:
    """Signs of SIGNS in which a pair at the threshold differs, at most."""
    p = math.acos(threshold) / math.pi
    return SIGNS * p + REACH * math.sqrt(SIGNS * p * (1 - p))


def named(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, the vector (floats as they are, other numbers as doubles), and whether it can link at all."""
    kind = vectors.schema[vector_col].dataType.simpleString()
    v = F.col(vector_col) if kind == "array<float>" else F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    sound = v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.coalesce(sound, F.lit(False)).alias("sound"), v.alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _keys(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    """rep, copies, v, the packed signs, the keys of all tables and the length."""

    def run(batches):
        for b in batches:
            length = pc.list_value_length(b.column(2)).to_numpy()
            keys, packed = np.zeros((b.num_rows, tables), np.int64), np.zeros(b.num_rows, object)
            for n in np.unique(length):
                rows = np.flatnonzero(length == n)
                signs = signs_of(_units(_matrix(b.column(2).take(pa.array(rows)))), bits, tables)
                keys[rows] = keys_from(signs, bits, tables)
                for i, p in zip(rows.tolist(), np.packbits(signs, axis=1), strict=True):
                    packed[i] = p.tobytes()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, tables, dtype=np.int32)), pa.array(keys.ravel()))
            columns = [*b.columns[:3], pa.array(packed.tolist(), pa.binary()), lists, pa.array(length.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["rep", "copies", "v", "signs", "keys", "dim"])

    kind = classes.schema["v"].dataType.simpleString()
    return classes.select("rep", "copies", "v").mapInArrow(run, f"rep long, copies long, v {kind}, signs binary, keys array<long>, dim int")


def _signs(t: pa.Table) -> np.ndarray:
    packed = t.column("signs").to_pylist()
    return np.unpackbits(np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -1), axis=1)


def _new_pairs(close: np.ndarray, t: pa.Table, signs: np.ndarray, bits: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) marked in ``close`` that this block has to judge: of different sides, and not met in an earlier table."""
    low, high, tab = (t.column(c)[0].as_py() for c in ("low", "high", "tab"))
    if low != high:
        part = t.column("part").to_numpy()
        close &= part[:, None] != part[None, :]
    i, j = np.nonzero(np.triu(close, 1))
    if tab and len(i):
        keys = keys_from(signs, bits, tables)
        new = np.ones(len(i), bool)
        for k in range(tab):
            new &= keys[i, k] != keys[j, k]
        i, j = i[new], j[new]
    return i, j


def in_reach(blocks: DataFrame, threshold: float, bits: int, tables: int) -> DataFrame:
    """The members of each block that have a partner in it whose signs are in reach of the threshold, and which it is first to meet."""
    most = most_differing(threshold)

    def work(t: pa.Table):
        signs = _signs(t)
        s = signs[:, :SIGNS].astype(np.float32) * 2 - 1
        i, j = _new_pairs((SIGNS - s @ s.T) / 2 <= most, t, signs, bits, tables)
        keep = np.unique(np.concatenate([i, j]))
        return {c: t.column(c).combine_chunks().take(pa.array(keep)) for c in t.column_names if c != "signs"} if len(keep) else None

    return map_groups(blocks, BLOCK, work, "bucket long, low int, high int, part int, tab int, rep long")


def links(blocks: DataFrame, threshold: float, bits: int, tables: int) -> DataFrame:
    """From blocks with vectors to (a, b, n): n links of a, and if b is not null an edge of the block's spanning forest."""

    def work(t: pa.Table):
        t = t.combine_chunks()
        ids, copies = t.column("rep").to_numpy(), t.column("copies").to_numpy()
        u, n = _units(_matrix(t.column("v").chunk(0))), t.num_rows
        close = (u @ u.T) >= threshold
        close &= close.T
        i, j = _new_pairs(close, t, _signs(t), bits, tables)
        if not len(i):
            return None
        count = np.bincount(i, copies[j], n) + np.bincount(j, copies[i], n)
        close[:] = False
        close[i, j] = close[j, i] = True
        left, a, b = np.ones(n, bool), [], []
        for root in range(n):
            if not left[root]:
                continue
            left[root] = False
            queue = [root]
            while queue:
                x = queue.pop()
                near = np.flatnonzero(close[x] & left)
                left[near] = False
                queue += near.tolist()
                a.append(np.full(len(near), x))
                b.append(near)
        a, b = np.concatenate(a), np.concatenate(b)
        some = np.flatnonzero(count)
        return {
            "a": np.concatenate([ids[some], ids[a]]),
            "b": pa.array(np.concatenate([ids[some], ids[b]]), mask=np.arange(len(some) + len(a)) < len(some)),
            "n": np.concatenate([count[some].astype(np.int64), np.zeros(len(a), np.int64)]),
        }

    return map_groups(blocks, BLOCK, work, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    rows = cut(named(vectors, id_col, vector_col), "vectors")
    sound, at = rows.filter("sound"), n_written()
    classes = cut(sound.groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies")).withColumn("rep", F.monotonically_increasing_id()), "vector-classes")
    n, total = classes.agg(F.count("*"), F.coalesce(F.sum("copies"), F.lit(0))).first()
    bits, tables = plan(n, threshold, recall)
    keyed = cut(_keys(classes, bits, tables), "vector-keys")
    dealt = keyed.select("rep", F.posexplode("keys").alias("tab", "key"), "dim").select("rep", "tab", F.xxhash64("tab", "key", "dim").alias("bucket"))
    buckets = cut(dealt.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1"), "vector-buckets")
    members = with_facts(dealt, buckets, ["bucket"], "members", n * tables).join(keyed.select("rep", "signs").hint("merge"), "rep")
    blocks = in_blocks(members, "bucket", "members", F.col("rep"), SIDE).select(*BLOCK, "part", "tab", "rep", "signs")
    near = cut(in_reach(blocks, threshold, bits, tables), "vectors-in-reach")
    found = cut(links(near.join(keyed.select("rep", "copies", "v", "signs").hint("merge"), "rep"), threshold, bits, tables), "vector-links")
    per = found.groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "rep")
    comp = components(found.filter("b is not null")).withColumnRenamed("id", "rep")
    info = classes.join(per.hint("merge"), "rep", "left").join(comp.hint("merge"), "rep", "left")
    info = cut(info.select("v", "copies", "least", "component", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "vector-components")
    # A component is named by the least id in it.
    linked_ = info.filter("component is not null")
    firsts = cut(linked_.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("k")), "vector-firsts")
    met = with_facts(linked_, firsts, ["component"], "k", firsts.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]).select("v", "copies", "n_links", "component_id")
    info = cut(met.unionByName(info.filter("component is null").select("v", "copies", "n_links", F.col("least").alias("component_id"))), "vector-info")
    drop_written(vectors.sparkSession, at, keep_last=True)
    linked = with_facts(sound.select("vec_id", "v"), info, ["v"], "copies", total).select("vec_id", "n_links", "component_id")
    alone = rows.filter("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))


def op2_hyperplanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.9 or more among all embeddings."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP2_SQL = """
WITH RECURSIVE e AS (
  SELECT row_number() OVER () AS rid, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
n AS (SELECT rid, v, sqrt(list_inner_product(v, v)) AS len FROM e
      WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (SELECT a.rid AS a, b.rid AS b FROM n a JOIN n b ON a.rid <> b.rid AND len(a.v) = len(b.v)
      WHERE list_inner_product(a.v, b.v) / (a.len * b.len) >= 0.9),
r AS (SELECT rid AS id, rid AS low FROM e UNION SELECT l.b, r.low FROM r JOIN l ON l.a = r.id WHERE r.low < l.b),
m AS (SELECT id, min(low) AS low FROM r GROUP BY id),
c AS (SELECT low, min(vec_id) AS component_id FROM m JOIN e ON e.rid = m.id GROUP BY low)
SELECT e.vec_id, coalesce(k.n_links, 0) AS n_links, component_id, coalesce(component_id = e.vec_id, component_id IS NULL) AS kept
FROM e JOIN m ON m.id = e.rid JOIN c USING (low) LEFT JOIN (SELECT a, count(*) AS n_links FROM l GROUP BY a) k ON k.a = e.rid
"""
