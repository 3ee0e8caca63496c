"""Near-duplicate texts by b-bit MinHash.

Each text becomes its set of distinct word shingles, 64-bit hashed. 128 minima are taken;
hashes of 4 minima each are 32 band keys, and of every minimum the low 4 bits are packed
into a 64-byte signature. Texts that share a band key are candidates; within a bucket the
share of equal nibbles, corrected for chance, estimates the similarity. Candidates within
reach of the threshold are confirmed on the full shingle sets of the whole texts.

Equal sets are one class, so copies cost one row. A large bucket is dealt into parts of bounded
size, and a few members of it, chosen by hash, stand in all of its parts: near copies of one text
find each other through these leaders, each member in one part of its bucket, and of the links a
part confirms it passes on a spanning forest. Then connected components are taken. Only where a
dealt bucket holds members of more than one component is anything left to compare: each member
outside the bucket's largest component with all others of other components, in bounded blocks.
So no link between different texts is lost to a cap, and a bucket of any number of near copies
costs its members once.

Rows are known by 128 bits of hash of their id and text, so ids may be null or repeat.
Rows without an id take part; such a row's component is the smallest id of its group, and it is kept only
where the group has no id at all. Rows that share an id but not their text are compared each by its own text.
``one_of_each`` is for whole rows, and keeps one of each group, with an id or without. Null, empty and wordless texts have no shingles and link with nothing. Texts of
any length are taken whole; a part holds fewer members where they are long. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.components import components
from keyloom.llm.groups import map_groups
from keyloom.llm.shares import maybe_among, with_facts
from keyloom.llm.store import cut, drop_written, n_written, table
from keyloom.llm.words import SPACED, mix, shingles, slices, split, text_buffers

SHINGLE_WORDS, PERCENT = 5, 75
ROWS, BANDS, BITS = 4, 32, 4
MINIMA = ROWS * BANDS
#: Standard deviations below the threshold at which an estimate is still confirmed.
REACH = 4.5
#: Members of a part, and shingles of their texts, about.
SIDE, SIDE_SHINGLES = 512, 1_000_000
#: Members of a part at least, however long their texts.
LEAST_MEMBERS = 8
#: Members that stand in all parts of their bucket, in expectation.
LEADERS = 32
BLOCK = ["key", "part", "other"]

_ODD = np.random.default_rng(5).integers(1, 2**63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = np.uint64(32)


def sets_of(column, words: int = SHINGLE_WORDS):
    """Yields (first row, bounds, hashes): row first+i has the distinct sorted hashes[bounds[i]:bounds[i+1]]."""
    offsets, data = text_buffers(column)
    for a, b in slices(offsets):
        h, text = shingles(split(data, offsets[a : b + 1], SPACED), words)
        order = np.lexsort((h, text))
        h, text = h[order], text[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
        h, text = h[new], text[new]
        yield a, np.searchsorted(text, np.arange(b - a + 1)), h


def _features(column, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(column)
    count, hi, lo = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    minima = np.zeros((MINIMA, n), np.uint64)
    for first, bounds, h in sets_of(column, words):
        sizes = np.diff(bounds)
        full = np.flatnonzero(sizes)
        count[first : first + len(sizes)] = sizes
        if not len(full):
            continue
        at = bounds[:-1][full]
        hi[first + full] = np.add.reduceat(h, at)
        lo[first + full] = np.bitwise_xor.reduceat(mix(h + np.uint64(77)), at)
        for k in range(MINIMA):
            minima[k, first + full] = np.minimum.reduceat((h * _ODD[k]) >> _SHIFT, at)
    bands = np.zeros((n, BANDS), np.uint64)
    for b in range(BANDS):
        acc = np.full(n, b + 1, np.uint64)
        for k in range(ROWS):
            acc = mix(acc * np.uint64(0xD6E8FEB86659FD93) + minima[b * ROWS + k])
        bands[:, b] = acc
    low = (minima.T & np.uint64(2**BITS - 1)).astype(np.uint8)
    packed = (low[:, 0::2] << 4 | low[:, 1::2]).astype(np.uint8)
    return count, hi, lo, bands.view(np.int64), packed


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, the row's name (r1, r2), n_shingles, a 128-bit name of the set (hi, lo), band keys and the packed signature of every row."""

    def run(batches):
        for b in batches:
            count, hi, lo, bands, packed = _features(b.column(3), words)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, len(count) * BANDS + 1, BANDS, dtype=np.int32)), pa.array(bands.ravel()))
            size = packed.shape[1]
            packed = pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(np.arange(0, len(count) * size + 1, size, dtype=np.int32)), pa.py_buffer(packed.tobytes())])
            columns = [*b.columns[:3], pa.array(count), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), bands, packed]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "r1", "r2", "n_shingles", "hi", "lo", "bands", "packed"])

    rows = named(docs, id_col, text_col)
    return rows.mapInArrow(run, "doc_id long, r1 long, r2 long, n_shingles long, hi long, lo long, bands array<long>, packed binary")


def row_names(id_col: str, text_col: str) -> list:
    """r1 and r2: 128 bits of hash of a row's id and text."""
    i, t = F.col(id_col).cast("long"), F.col(text_col)
    return [F.xxhash64(i.isNull(), i, t).alias("r1"), F.xxhash64(t, i.isNull(), i).alias("r2")]


def named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), *row_names(id_col, text_col), F.col(text_col).alias("text"))


def estimate(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Estimated similarity of one signature to many: equal nibbles by bit counts, corrected for chance."""
    x = many ^ one
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    differ = np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(axis=1)
    chance = 2.0**-BITS
    return (1 - differ / MINIMA - chance) / (1 - chance)


def least_estimate(percent: int) -> float:
    chance = 2.0**-BITS
    equal = chance + (1 - chance) * percent / 100
    return percent / 100 - REACH * (equal * (1 - equal) / MINIMA) ** 0.5 / (1 - chance)


def _in_reach(blocks: DataFrame, percent: int) -> DataFrame:
    """The members of each block that have a partner in it whose estimate is in reach of the threshold."""
    least = least_estimate(percent)

    def work(t: pa.Table):
        near = _nearness(t)
        keep = np.array([(near(i) >= least).any() for i in range(t.num_rows)])
        return {c: t.column(c).combine_chunks().filter(pa.array(keep)) for c in t.column_names} if keep.any() else None

    return map_groups(blocks, BLOCK, work, "key long, part int, other int, rep long, side int, comp long, packed binary")


def _nearness(t: pa.Table):
    """A function of i: the estimated similarity of member i of a block to all; -1 to itself, and if the block has two sides (0 and 1,
    not -1) also to its own side and component."""
    side, comp = t.column("side").to_numpy(), t.column("comp").to_numpy()
    sig = np.frombuffer(b"".join(t.column("packed").to_pylist()), np.uint64).reshape(len(side), -1)
    two = side[0] >= 0

    def near(i: int) -> np.ndarray:
        s = estimate(sig[i], sig)
        s[i] = -1
        if two:
            s[(side == side[i]) | (comp == comp[i])] = -1
        return s

    return near


def _links(rows: DataFrame, percent: int, words: int) -> DataFrame:
    """Links (a, b) confirmed on full sets: of each block a spanning forest of all its links. A member is compared with
    those no link has reached yet, so what is left apart has been compared in full."""
    least = least_estimate(percent)

    def work(t: pa.Table):
        near, ids = _nearness(t), t.column("rep").to_numpy()
        sets = [h[s:e] for _, bounds, h in sets_of(t.column("text"), words) for s, e in zip(bounds, bounds[1:], strict=False)]
        size, left, a, b = np.array([len(x) for x in sets]), np.ones(len(ids), bool), [], []
        for root in range(len(ids)):
            if not left[root]:
                continue
            left[root], queue = False, [root]
            while queue:
                i = queue.pop()
                n = size[i]
                them = np.flatnonzero(left & (100 * np.minimum(n, size) >= percent * np.maximum(n, size)) & (near(i) >= least))
                if not len(them):
                    continue
                every = np.concatenate([sets[j] for j in them])
                found = sets[i][np.minimum(np.searchsorted(sets[i], every), n - 1)] == every
                both = np.add.reduceat(found.astype(np.int64), np.cumsum(size[them]) - size[them])
                them = them[100 * both >= percent * (n + size[them] - both)]
                left[them] = False
                queue += them.tolist()
                a.append(np.full(len(them), ids[i]))
                b.append(ids[them])
        return {"a": np.concatenate(a), "b": np.concatenate(b)} if a else None

    return map_groups(rows, BLOCK, work, "a long, b long")


def _confirmed(near: DataFrame, classes: DataFrame, texts: DataFrame, percent: int, words: int) -> DataFrame:
    """Links among the members in reach. Blocks with the same members count once, and only their texts are shuffled."""
    held = near.groupBy(*BLOCK).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("rep", "side")).alias("who"))
    held = held.groupBy("n", "who").agg(F.min(F.struct(*BLOCK)).alias("block")).select("block.*")
    near = near.join(held.hint("merge"), BLOCK, "left_semi")
    wanted = cut(near.select("rep").distinct().join(classes.select("rep", "r1", "r2").hint("merge"), "rep"), "wanted")
    some = maybe_among(texts, wanted, ["r1", "r2"], wanted.count()).filter("__maybe")
    # Equal rows meet as one: partial aggregates, before they are shuffled.
    some = some.groupBy("r1", "r2").agg(F.min("text").alias("text")).join(wanted.hint("merge"), ["r1", "r2"]).select("rep", "text")
    return _links(near.join(some.hint("merge"), "rep"), percent, words)


def _members(dealt: DataFrame, buckets: DataFrame, total: int, classes: DataFrame) -> DataFrame:
    """key, parts, few, rep and packed of the members of ``buckets``."""
    met = with_facts(dealt, buckets, ["key"], "members", total)
    return met.select("key", "parts", "few", "rep").join(classes.select("rep", "packed").hint("merge"), "rep")


def _part(parts: str, salt: str):
    return F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(parts)).cast("int")


def linked(classes: DataFrame, texts: DataFrame, percent: int = PERCENT, words: int = SHINGLE_WORDS) -> DataFrame:
    """(id, component) of the classes (rep, n, bands, packed, and r1, r2 of a row of each in ``texts``) that have links."""
    dealt = classes.select("rep", "n", F.explode("bands").alias("key"))
    grouped = dealt.groupBy("key").agg(F.count("*").alias("members"), F.sum("n").alias("total"), F.bit_xor(F.xxhash64("rep")).alias("who")).filter("members > 1")
    # Buckets of the same members count once.
    grouped = grouped.groupBy("members", "total", "who").agg(F.min("key").alias("key"))
    load = F.greatest(F.col("members"), F.ceil(F.col("total") * F.lit(SIDE / SIDE_SHINGLES)))
    parts = F.least(F.ceil(F.col("members") / LEAST_MEMBERS), F.ceil(load / SIDE)).cast("int")
    few = F.greatest(F.lit(1), F.least(F.lit(LEADERS), F.expr("members div (4 * parts)"))).cast("int")
    buckets = cut(grouped.withColumn("parts", parts).withColumn("few", few).select("key", "members", "parts", "few"), "buckets")
    total = classes.count() * BANDS
    dealt = dealt.select("rep", "key")
    members = _members(dealt, buckets.select("key", "members", "parts", F.when(F.col("parts") > 1, F.col("few") / F.col("members")).otherwise(0.0).alias("few")), total, classes)
    leads = F.pmod(F.xxhash64("rep", F.lit("leader")), F.lit(1 << 30)) < F.col("few") * F.lit(float(1 << 30))
    dealt_to = F.when(leads, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(_part("parts", "part")))
    blocks = members.withColumn("part", F.explode(dealt_to)).select("key", "part", F.lit(0).alias("other"), "rep", F.lit(-1).alias("side"), F.lit(0).cast("long").alias("comp"), "packed")
    near = cut(_in_reach(blocks, percent), "in-reach")
    found = components(_confirmed(near, classes, texts, percent, words))
    many = buckets.filter("parts > 1")
    if many.isEmpty():
        return found
    # What leaders did not bring together: members outside their bucket's largest component against all of other components.
    met = _members(dealt, many, total, classes).join(found.withColumnRenamed("id", "rep").hint("merge"), "rep", "left")
    met = cut(met.select("key", "parts", "rep", "packed", F.coalesce("component", "rep").alias("comp")), "dealt-members")
    by_comp = met.groupBy("key", "comp").agg(F.count("*").alias("k"))
    mixed = by_comp.groupBy("key").agg(F.max_by("comp", "k").alias("most"), (F.sum("k") - F.max("k")).alias("rest"), F.sum("k").alias("members")).filter("rest > 0")
    mixed = cut(mixed.join(many.select("key", "parts").hint("merge"), "key").withColumn("lots", F.least(F.col("rest"), F.ceil(F.col("rest") * F.col("parts") / F.col("members"))).cast("int")), "mixed-buckets")
    if mixed.isEmpty():
        return found
    met = with_facts(met.drop("parts"), mixed, ["key"], "members", total)
    row = ["key", "rep", "comp", "packed"]
    all_ = met.select(*row, F.lit(0).alias("side"), _part("parts", "part").alias("part"), F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("other"))
    rest = met.filter("comp != most").select(*row, F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), _part("lots", "lot").alias("other"))
    blocks = all_.unionByName(rest).select(*BLOCK, "rep", "side", "comp", "packed")
    near = cut(_in_reach(blocks, percent), "in-reach")
    if near.isEmpty():
        return found
    more = _confirmed(near, classes, texts, percent, words)
    return components(more.unionByName(found.select(F.col("id").alias("a"), F.col("component").alias("b"))))


def _labelled(rows: DataFrame, texts: DataFrame, percent: int, words: int) -> tuple[DataFrame, int]:
    """(for each set, by hi and lo, its ``copies`` and ``best``, the first row of its component: the smallest id, null last; rows in all)."""
    at = n_written()
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "r1", "r2")
    first = rows.groupBy("hi", "lo").agg(F.min(order).alias("x"), F.min("n_shingles").alias("n"), F.count("*").alias("copies"), F.any_value("bands").alias("bands"), F.any_value("packed").alias("packed"))
    classes = cut(first.select(F.monotonically_increasing_id().alias("rep"), "hi", "lo", "n", "copies", "x", "x.r1", "x.r2", "bands", "packed"), "classes")
    found = linked(classes, texts, percent, words)
    named_ = cut(classes.select("rep", "hi", "lo", "copies", "x").join(found.withColumnRenamed("id", "rep").hint("merge"), "rep", "left"), "class-components")
    # Every vertex with a link has a component; classes without one are their own.
    bests = cut(named_.filter("component is not null").groupBy("component").agg(F.min("x").alias("best"), F.count("*").alias("k")), "component-firsts")
    total = bests.agg(F.sum("k")).first()[0] or 0
    linked_ = with_facts(named_.filter("component is not null"), bests, ["component"], "k", total).select("hi", "lo", "copies", "best")
    firsts = cut(linked_.unionByName(named_.filter("component is null").select("hi", "lo", "copies", F.col("x").alias("best"))), "set-firsts")
    drop_written(rows.sparkSession, at, keep_last=True)
    return firsts, rows.count()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    rows = cut(signatures(docs, id_col, text_col, words), "signatures")
    able = F.col("n_shingles") > 0
    firsts, total = _labelled(rows.filter(able), named(docs, id_col, text_col), percent, words)
    one = rows.select("doc_id", "n_shingles", "hi", "lo")
    alone = one.filter(~able).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    met = with_facts(one.filter(able), firsts, ["hi", "lo"], "copies", total).select("doc_id", "n_shingles", F.col("best.doc_id").alias("component_id"))
    return met.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, words: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: the one of the smallest id (rows without ids last, then by the hash
    of id and text), columns as they were. Of rows alike in id and text one stays, whichever is met first. Rows
    without shingles all stay. Only rows that may go, or that repeat, are shuffled."""
    rows = cut(signatures(docs, id_col, text_col, words), "signatures").filter("n_shingles > 0")
    firsts, total = _labelled(rows, named(docs, id_col, text_col), percent, words)
    judged = with_facts(rows.select("hi", "lo", "r1", "r2"), firsts, ["hi", "lo"], "copies", total)
    stays = (F.col("r1") == F.col("best.r1")) & (F.col("r2") == F.col("best.r2"))
    judged = judged.select("r1", "r2", stays.alias("stays")).groupBy("r1", "r2").agg(F.bool_or("stays").alias("stays"), F.count("*").alias("n"))
    touched = cut(judged.filter("not stays or n > 1"), "touched-rows")
    n = touched.agg(F.count("*"), F.sum("n")).first()
    r1, r2 = (c.alias(f"__{k}") for c, k in zip(row_names(id_col, text_col), ("r1", "r2"), strict=True))
    key = ["__r1", "__r2"]
    asked = maybe_among(docs.select("*", r1, r2), touched.select(F.col("r1").alias("__r1"), F.col("r2").alias("__r2")), key, n[0])
    some = asked.filter("__maybe").drop("__maybe")
    facts = touched.select(F.col("r1").alias("__r1"), F.col("r2").alias("__r2"), F.col("stays").alias("__stays"), F.col("n").alias("__n"))
    met = with_facts(some, facts, key, "__n", n[1] or 0, "left")
    once = met.filter("__stays").dropDuplicates(key)  # the first of its equals: partial aggregates
    return asked.filter("not __maybe").select(*docs.columns).unionByName(met.filter("__stays is null").select(*docs.columns)).unionByName(once.select(*docs.columns))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents: 5-word shingles, similarity 0.75."""
    return near_duplicates(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT rid, doc_id, CASE WHEN ws IS NULL OR len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [ws]
                 ELSE list_distinct([ws[i:i+4] FOR i IN range(1, len(ws) - 3)]) END AS sh FROM w),
n AS (SELECT rid, doc_id, CAST(len(sh) AS BIGINT) AS n_shingles FROM s),
c AS (SELECT min(rid) AS rep, min(doc_id) AS least, sh FROM (SELECT rid, doc_id, list_sort(sh) AS sh FROM s WHERE len(sh) > 0) GROUP BY sh),
e AS (SELECT rep, len(sh) AS k, hash(unnest(sh)) AS g FROM c),
i AS (SELECT a.rep AS a, b.rep AS b, any_value(a.k) AS ka, any_value(b.k) AS kb, count(*) AS common
      FROM e a JOIN e b ON a.g = b.g AND a.rep < b.rep GROUP BY 1, 2),
l AS (SELECT a, b FROM i WHERE 100 * common >= 75 * (ka + kb - common)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT rep AS id, rep AS low FROM c UNION SELECT u.b, r.low FROM r JOIN u ON u.a = r.id WHERE r.low < u.b),
m AS (SELECT id, min(low) AS low FROM r GROUP BY id),
g AS (SELECT m.low, min(c.least) AS component_id FROM m JOIN c ON c.rep = m.id GROUP BY m.low),
k AS (SELECT s.rid, g.component_id FROM s JOIN c ON list_sort(s.sh) = c.sh JOIN m ON m.id = c.rep JOIN g ON g.low = m.low WHERE len(s.sh) > 0),
f AS (SELECT n.doc_id, n.n_shingles, CASE WHEN n.n_shingles > 0 THEN k.component_id ELSE n.doc_id END AS component_id FROM n LEFT JOIN k USING (rid))
SELECT doc_id, n_shingles, component_id, coalesce(component_id = doc_id, component_id IS NULL) AS kept FROM f
"""
