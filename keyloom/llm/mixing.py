"""Mixing sources to target weights.

Every row gets a hash-random key. Within a source, rows are ordered by that key: the key's
range is cut into buckets, token counts are summed per (source, bucket), and a running sum
over buckets plus a running sum inside each bucket is the row's exact place in its source.
A source's budget is cut at that place to the word; budgets above the source's size repeat
whole epochs first.

Rows of one id, or of none, share a key. Only groups of them are placed: by (id, size) with
their number, where rows alike in both differ in nothing that the result shows, and for
``repeated`` by key, where only the group that the cut goes through is opened, in order of a
hash of the whole row and in lanes of that hash. So no task holds more than the groups of one
bucket or the rows of one lane, however many rows have no id.

Null sources are one source, ordered last; null text has size 0; rows of size 0 are kept
with nothing taken; an empty table gives an empty result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.functions.running import before
from keyloom.llm.store import cut, table
from keyloom.llm.words import SPACED, count_words

#: Ranges of the random key within a source; a bucket of one source is the unit of sorting.
BUCKETS = 1024
#: Equal rows made by a task at once.
COPIES = 1024
SEED = "mix-1"


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """doc_id, source, size (words), the random key and the name of every row."""
    schema = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"), row_name(docs).alias("name"))
    kind = schema.schema["doc_id"].dataType.simpleString()

    def count(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(count_words(b.column(2), SPACED)), b.column(3)], ["doc_id", "source", "size", "name"])

    rows = schema.mapInArrow(count, f"doc_id {kind}, source string, size long, name long")
    return rows.withColumn("key", random_key("doc_id", seed))


def random_key(id_col: str, seed: str):
    return F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))


def row_name(docs: DataFrame):
    """A hash of all columns of a row (maps have none); nulls count as such."""
    columns = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    return F.xxhash64(*(x for c in columns for x in (c.isNull(), c)))


def source_number(source_col: str):
    """Sources are joined by a number, never by a name that may be null."""
    return F.xxhash64(F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n")))


def weighted_sources(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """source, source_size, weight: sources by code point, null last, weigh ``weights`` in turn."""
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1))
    ranked = before(by_source, [F.col("source").asc_nulls_last()], ["one"])  # sources may be hosts, and many: they are ordered in ranges
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("one_before", F.lit(len(weights))) + 1).cast("int"))
    return ranked.select("source", "source_size", weight.alias("weight"))


def targets(sources: DataFrame, max_epochs: int = 3) -> DataFrame:
    """Adds ``target``: total x weight / weights, at most ``max_epochs`` times the source's size; what a full
    source leaves is shared again by weight until none is above its limit."""
    limit = F.col("source_size") * max_epochs
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    per_weight = 0.0
    while True:
        full = limit <= F.col("weight") * F.lit(per_weight)
        row = sources.agg(F.sum(F.when(full, limit)).alias("taken"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if not row["open"]:
            break
        share = (total - (row["taken"] or 0)) / float(row["open"])
        if share <= per_weight:
            break
        per_weight = share
    return sources.withColumn("target", F.least(limit.cast("double"), F.col("weight") * F.lit(per_weight)))


def placed(groups: DataFrame, goals: DataFrame, order: list[str], buckets: int = BUCKETS) -> DataFrame:
    """``groups`` (source, key, words) with sid, source_size, target, the words ``before`` each in its source, epochs, and ``rest``: the words of the last epoch."""
    keyed = groups.withColumn("sid", source_number("source"))
    keyed = keyed.withColumn("bucket", (F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * buckets / 2**32).cast("int"))
    goals = goals.withColumn("sid", source_number("source")).select("sid", "source_size", "target")
    sums = keyed.groupBy("sid", "bucket").agg(F.sum("words").alias("bucket_size"))
    earlier = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("sid", "bucket", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("offset")).join(goals, "sid")
    inside = Window.partitionBy("sid", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = keyed.withColumn("upto", F.sum("words").over(inside)).join(offsets, ["sid", "bucket"])
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size")
    return out.withColumns({"before": F.col("offset") + F.col("upto") - F.col("words"), "epochs": epochs.cast("int"), "rest": rest})


def take(rows: DataFrame, goals: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, source, size, source_size, target and ``taken`` of every row: how many of its words the mix takes, whole epochs included."""
    groups = rows.groupBy("source", "key", "doc_id", "size").agg(F.count("*").alias("n")).withColumn("words", F.col("n") * F.col("size"))
    found = cut(placed(groups, goals, ["key", "doc_id", "size"], buckets).select("doc_id", "source", "size", "source_size", "target", "epochs", "rest", "before", "n"), "mix-groups")
    many = found.filter(F.col("n") > COPIES).withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long"))))
    few = found.filter(F.col("n") <= COPIES).withColumn("from", F.lit(0).cast("long"))
    parts = few.unionByName(many.repartition("source", "doc_id", "size", "from"))
    each = parts.withColumn("nth", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + COPIES, F.col("n")) - 1)))
    room = F.col("rest") - F.col("before") - F.col("nth") * F.col("size")
    taken = F.col("epochs") * F.col("size") + F.least(F.col("size"), F.greatest(F.lit(0), room))
    return each.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: str = SEED, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every row of ``docs``."""
    rows = cut(sized(docs, seed=seed), "mix-sizes")
    goals = cut(targets(cut(weighted_sources(rows, weights), "mix-sources"), max_epochs), "mix-targets")
    return take(rows, goals, buckets)


def _last_epoch(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """sid, epochs, and where the last epoch of each source ends: at the key ``end``, and among the rows of that key at the
    name ``name``, of whose equal rows ``n_in`` are in; no name if all rows of the key are in, no end if all of the source are."""
    by_key = placed(rows.groupBy("source", "key").agg(F.sum("size").alias("words")), goals, ["key"])
    over = F.col("before") + F.col("words") > F.col("rest")
    first = F.min(F.when(over, F.struct("key", (F.col("rest") - F.col("before")).alias("room")))).alias("first")
    ends = cut(by_key.groupBy("sid").agg(F.max("epochs").alias("epochs"), first).select("sid", "epochs", F.col("first.key").alias("end"), F.col("first.room").alias("room")), "mix-keys")
    tied = rows.withColumn("sid", source_number("source")).join(ends.select("sid", F.col("end").alias("key"), "room"), ["sid", "key"])
    tied = cut(tied.groupBy("sid", "name", "size", "room").agg(F.count("*").alias("n")).withColumns({"lane": F.shiftright("name", 54), "words": F.col("n") * F.col("size")}), "mix-tied")
    lanes = tied.groupBy("sid", "lane").agg(F.sum("words").alias("lane_words"))
    offsets = lanes.select("sid", "lane", F.coalesce(F.sum("lane_words").over(Window.partitionBy("sid").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("sid", "lane").orderBy("name", "size").rowsBetween(Window.unboundedPreceding, 0)
    left = F.col("room") - F.col("offset") - F.col("upto") + F.col("words")
    n_in = F.when(F.col("size") == 0, F.col("n")).otherwise(F.least(F.col("n"), F.greatest(F.lit(0), F.expr("floor((2 * left + size) / (2 * size))"))))
    names = tied.withColumn("upto", F.sum("words").over(inside)).join(offsets, ["sid", "lane"]).withColumn("left", left).withColumn("n_in", n_in.cast("long"))
    out = names.filter("n_in < n").groupBy("sid").agg(F.min(F.struct("name", "n_in")).alias("out")).select("sid", "out.name", "out.n_in")
    return cut(ends.drop("room").join(out, "sid", "left"), "mix-ends")


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: str = SEED) -> DataFrame:
    """Every row as often as the mix takes it, columns as they were. The one row of a source that the cut goes through
    is there once more if at least half its words are taken. Rows of one id follow each other in order of their names. What a
    source keeps is told by one row of it: its epochs and the first key and name that the last epoch leaves out; texts are not shuffled."""
    rows = cut(sized(docs, id_col, text_col, source_col, seed), "mix-sizes")
    goals = cut(targets(cut(weighted_sources(rows, weights), "mix-sources"), max_epochs), "mix-targets")
    ends = _last_epoch(rows, goals)
    sid, epochs, end, name, n_in, copies = (f"__mix_{c}" for c in ("sid", "epochs", "end", "name", "n_in", "copies"))
    ends = ends.select(*(F.col(c).alias(f"__mix_{c}") for c in ("sid", "epochs", "end", "name", "n_in")))
    joined = docs.withColumn(sid, source_number(source_col)).join(ends, sid)
    key, tied = random_key(id_col, seed), random_key(id_col, seed) == F.col(end)
    last = F.when(F.col(end).isNull() | (key < F.col(end)) | (tied & (F.col(name).isNull() | (row_name(docs) < F.col(name)))), 1).otherwise(0)
    every = joined.withColumn(copies, F.least(F.lit(max_epochs), F.col(epochs) + last)).filter(F.col(copies) > 0)
    out = every.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)
    some = (F.col(n_in) > 0) & (F.col(epochs) < max_epochs)
    if ends.filter(some).isEmpty():
        return out
    # The cut goes through equal rows: one of them stands for those that are in.
    one = joined.filter(some & tied & (row_name(docs) == F.col(name))).dropDuplicates([sid])
    parts = one.withColumn(copies, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n_in) - 1, F.lit(COPIES).cast("long"))))
    more = parts.withColumn(copies, F.explode(F.sequence(F.col(copies), F.least(F.col(copies) + COPIES, F.col(n_in)) - 1)))
    return out.unionByName(more.select(*docs.columns))


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to weights 1, 2, 3 over their sources."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
  FROM d GROUP BY source),
o AS (
  SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
         row_number() OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST) AS fills,
         coalesce(sum(3 * source_size) OVER w, 0) AS caps_before, coalesce(sum(weight) OVER w, 0) AS weights_before
  FROM s WINDOW w AS (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (
  SELECT arg_min(CAST(total - caps_before AS DOUBLE) / CAST(weights - weights_before AS DOUBLE), fills)
           FILTER (WHERE CAST(total - caps_before AS DOUBLE) / CAST(weights - weights_before AS DOUBLE) * weight < 3 * source_size) AS per_weight
  FROM o),
t AS (
  SELECT s.source, source_size, least(CAST(3 * source_size AS DOUBLE), weight * coalesce(per_weight, 1e300)) AS target FROM s, l),
p AS (
  SELECT d.*, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS budget,
         sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS place
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, source,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size * size
            + least(size, greatest(0, budget % source_size - place)) END AS BIGINT) AS taken
FROM p
"""
