"""Importance resampling of documents towards a target distribution, over hashed n-grams.

The n-grams of all texts are counted as strings; each different string is hashed once, to its bucket, and buckets of
documents and of target texts are compared. The gain of a bucket goes back to each string, and from the strings to the
feature counts of each document. A document's weight is the sum of its gains; with a Gumbel variate made of its id added,
the highest scores are a sample without replacement in proportion to the weights.

Strings on more than one in HOT of all (document, string) pairs are few whatever the data (HOT at most), so their gains
are broadcast as numbers (16 bytes each) and added up where the texts are. All other strings meet their gains in a merge
by string, where none has more than one in HOT of the rows.

Words are what ``words.ALNUM`` says; an n-gram is its words joined by one space. Null and empty texts have no features,
weight 0, and a score. A null id counts as the empty string in the variate, and comes last of equal scores. Rows that
share an id are documents of their own. Ties go to the smaller id; of rows alike in score and id it does not show which
has which rank. Empty tables give no rows; an empty target is uniform but for smoothing. Texts of any length are taken
whole. Other columns take no part. Strings are told apart by themselves, hot ones and those of one text by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions.running import before
from keyloom.llm.store import cut, table
from keyloom.llm.words import ALNUM, mix, slices, split, text_buffers

HOT = 1 << 16
BUCKETS = 10_000
SEED = "2024"
_U = np.uint64


def _grams(data: np.ndarray, offsets: np.ndarray, max_n: int) -> tuple[np.ndarray, ...]:
    """(text, hash, start, end, bytes) of each run of 1 to ``max_n`` words of the texts data[offsets[i]:offsets[i+1]]; start and end lie
    in bytes, which hold the words of all texts with one space after each. Last, the number of words of each text."""
    w = split(data, offsets, ALNUM)
    size = w.ends - w.starts
    begin = np.cumsum(size + 1) - size - 1
    where = np.repeat(w.starts - begin, size + 1) + np.arange(int((size + 1).sum()))
    base = int(offsets[0])
    folded = ALNUM[data[base : int(offsets[-1]) + 1]] if len(size) else np.zeros(0, np.uint8)
    joined = folded[np.minimum(where, len(folded) - 1)] if len(size) else folded
    # ALNUM writes a NUL inside a word as 1, but NUL separates words here, so no byte is lost
    joined[begin + size] = 0x20
    text, hashes, starts, ends = [], [], [], []
    rolling = np.zeros(len(size), np.uint64)
    for n in range(1, max_n + 1):
        m = len(size) - n + 1
        if m <= 0:
            break
        rolling = mix(rolling[:m] * _U(0x9FB21C651E98DF25) + w.hashes[n - 1 :] + _U(n))
        whole = w.text[:m] == w.text[n - 1 :]
        text.append(w.text[:m][whole])
        hashes.append(rolling[whole])
        starts.append(begin[:m][whole])
        ends.append((begin + size)[n - 1 :][whole])
    if not text:
        text, hashes, starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    return np.concatenate(text), np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends), joined, np.diff(w.bounds)


def _strings(joined: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    size = ends - starts
    bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
    where = np.repeat(starts - bounds[:-1], size) + np.arange(int(bounds[-1]))
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(joined[where].tobytes())])


def _counted(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first of each different key, how often it occurs), keys sorted by the last one first."""
    order = np.lexsort(keys)
    change = np.zeros(len(order), bool)
    change[:1] = True
    for k in keys:
        change[1:] |= k[order][1:] != k[order][:-1]
    at = np.flatnonzero(change)
    return order[at], np.diff(np.append(at, len(order)))


def dictionary(docs: DataFrame, text_col: str = "text", max_n: int = 1) -> DataFrame:
    """feature, hash, n (occurrences), n_docs (documents that hold it) of each different n-gram, counted where the texts are first."""

    def run(batches):
        for b in batches:
            offsets, data = text_buffers(b.column(0))
            for a, z in slices(offsets):
                text, hashes, starts, ends, joined, _ = _grams(data, offsets[a : z + 1], max_n)
                first, _ = _counted(text, hashes)
                at, n_docs = _counted(hashes[first])
                one, n = _counted(hashes)  # in the same order: by hash
                assert len(one) == len(at)
                yield pa.RecordBatch.from_arrays([_strings(joined, starts[one], ends[one]).cast(pa.string()), pa.array(hashes[one].view(np.int64)), pa.array(n.astype(np.int64)), pa.array(n_docs.astype(np.int64))], ["feature", "hash", "n", "n_docs"])

    rows = docs.select(text_col).mapInArrow(run, "feature string, hash long, n long, n_docs long")
    return rows.groupBy("feature").agg(F.first("hash").alias("hash"), F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def bucket(feature: str, buckets: int = BUCKETS) -> Column:
    return (F.crc32(F.col(feature).cast("binary")) % F.lit(buckets)).alias("bucket")


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain: floor(1000 ln of how much more of the target than of the source falls into the bucket), smoothed by one each.
    From dictionaries with their buckets; as many rows as buckets."""
    summed = lambda d, name: d.groupBy("bucket").agg(F.sum("n").alias(name))
    both = source.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(F.broadcast(summed(source, "s")), "bucket", "left").join(F.broadcast(summed(target, "t")), "bucket", "left").fillna(0)
    every = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    d = lambda c, add: (F.col(c) + add).cast("double")
    ratio = (d("t", 1) * d("all_s", buckets)) / (d("s", 1) * d("all_t", buckets))
    return both.crossJoin(F.broadcast(every)).select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))  # one row


def _features(docs: DataFrame, hot: list[tuple[int, int]], id_col: str, text_col: str, max_n: int) -> DataFrame:
    """Of each document one row without feature, with its id, n_words, n_features and the weight of its hot features, and one row for each
    other feature, with ``n``. ``rid`` tells documents apart."""
    kind = docs.schema[id_col].dataType.simpleString()
    known = np.array([h for h, _ in hot], np.int64).view(np.uint64)
    gain = np.array([g for _, g in hot], np.int64)
    order = np.argsort(known)
    shared = docs.sparkSession.sparkContext.broadcast((known[order], gain[order]))
    names = ["rid", "feature", "n", "doc_id", "n_words", "n_features", "weight"]

    def run(batches):
        known, gain = shared.value
        for b in batches:
            offsets, data = text_buffers(b.column(2))
            for a, z in slices(offsets):
                text, hashes, starts, ends, joined, n_words = _grams(data, offsets[a : z + 1], max_n)
                first, n = _counted(hashes, text)
                place = np.minimum(np.searchsorted(known, hashes[first]), max(0, len(known) - 1))
                is_hot = known[place] == hashes[first] if len(known) else np.zeros(len(first), bool)
                weight = np.zeros(z - a, np.int64)
                np.add.at(weight, text[first][is_hot], n[is_hot] * gain[place[is_hot]])
                rest, n = first[~is_hot], n[~is_hot]
                rids = b.column(0).slice(a, z - a)
                ids, none = b.column(1).slice(a, z - a), np.zeros(z - a, np.int64)
                n_features = np.bincount(text, minlength=z - a).astype(np.int64)
                yield pa.RecordBatch.from_arrays([rids, pa.nulls(z - a, pa.string()), pa.array(none), ids, pa.array(n_words.astype(np.int64)), pa.array(n_features), pa.array(weight)], names)
                if len(rest):
                    k = len(rest)
                    empty = [pa.nulls(k, t) for t in (ids.type, pa.int64(), pa.int64(), pa.int64())]
                    yield pa.RecordBatch.from_arrays([rids.take(pa.array(text[rest])), _strings(joined, starts[rest], ends[rest]).cast(pa.string()), pa.array(n.astype(np.int64)), *empty], names)

    named = docs.select(F.monotonically_increasing_id().alias("rid"), id_col, text_col)
    return named.mapInArrow(run, f"rid long, feature string, n long, doc_id {kind}, n_words long, n_features long, weight long")


def weights(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", max_n: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features and weight of each row of ``docs``."""
    source = cut(dictionary(docs, text_col, max_n).withColumn("bucket", bucket("feature", buckets)), "features")
    wanted = dictionary(target, target_col, max_n).withColumn("bucket", bucket("feature", buckets))
    gain = cut(gains(source, wanted, buckets).coalesce(1), "gains")
    pairs = source.agg(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0]
    hot = source.filter(F.col("n_docs") * F.lit(HOT) > F.lit(pairs)).join(F.broadcast(gain), "bucket").select("hash", "gain")
    rows = _features(docs, [tuple(r) for r in hot.collect()], id_col, text_col, max_n)  # at most HOT rows of two numbers
    rows = cut(rows, "feature-counts")
    cold = source.filter(F.col("n_docs") * F.lit(HOT) <= F.lit(pairs)).join(F.broadcast(gain), "bucket").select("feature", "gain")
    met = rows.filter("feature is not null").select("rid", "feature", "n").join(cold.hint("merge"), "feature")
    rest = met.groupBy("rid").agg(F.sum(F.col("n") * F.col("gain")).alias("more"))
    own = rows.filter("feature is null").select("rid", "doc_id", "n_words", "n_features", "weight")
    return own.join(rest.hint("merge"), "rid", "left").select("doc_id", "n_words", "n_features", (F.col("weight") + F.coalesce("more", F.lit(0))).alias("weight"))


def gumbel(id_col: str, seed: str = SEED) -> Column:
    """A standard Gumbel variate of an id, times 1000, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(weighted: DataFrame, percent: int = 10, min_words: int = 20, seed: str = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank: 1, 2, ... of the ``percent`` of documents of ``min_words`` words that are drawn, else null."""
    able = (F.col("n_words") >= min_words).cast("long")
    scored = cut(weighted.withColumn("score", F.col("weight") + gumbel("doc_id", seed)).withColumn("able", able), "scored")
    drawn = (scored.agg(F.coalesce(F.sum("able"), F.lit(0))).first()[0] * percent) // 100
    ranked = before(scored, [F.col("able").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()], ["able"])
    rank = F.when((F.col("able") == 1) & (F.col("able_before") < drawn), F.col("able_before") + 1)
    return ranked.select("doc_id", "n_features", "weight", "score", rank.cast("long").alias("rank"))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of all documents of 20 words, drawn towards the benchmark."""
    return resample(weights(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


OP11_SQL = r"""
WITH bits AS (SELECT n, list_reduce([n] || range(8), lambda c, i: CASE WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS t(n)),
crc_table AS (SELECT list(c ORDER BY n) AS crcs FROM bits),
d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
dw AS (SELECT rid, w, count(*) AS n FROM (SELECT rid, unnest(ws) AS w FROM d) GROUP BY ALL),
bw AS (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark) GROUP BY 1),
words AS (SELECT DISTINCT w FROM (SELECT w FROM dw UNION ALL SELECT w FROM bw)),
bytes AS (SELECT w, [CAST('0x' || substr(hex(encode(w)), 2 * i + 1, 2) AS BIGINT) FOR i IN range(octet_length(encode(w)))] AS bs FROM words),
hashed AS (SELECT w, xor(list_reduce([CAST(4294967295 AS BIGINT)] || bs, lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM bytes, crc_table),
s AS (SELECT bucket, sum(n) AS s FROM dw JOIN hashed USING (w) GROUP BY 1),
t AS (SELECT bucket, sum(n) AS t FROM bw JOIN hashed USING (w) GROUP BY 1),
sums AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS ss, (SELECT coalesce(sum(t), 0) FROM t) AS tt),
g AS (SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST(ss + 10000 AS DOUBLE)) / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * CAST(tt + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM s FULL JOIN t USING (bucket), sums),
wt AS (SELECT rid, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM dw JOIN hashed USING (w) JOIN g USING (bucket) GROUP BY 1),
h AS (SELECT doc_id, rid, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN wt USING (rid)),
sc AS (SELECT doc_id, rid, n_words, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((CAST(h AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score FROM h),
r AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM sc WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (10 * (SELECT count(*) FROM r)) // 100 THEN rank END AS rank FROM sc LEFT JOIN r USING (rid)
"""
