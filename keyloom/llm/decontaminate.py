"""Benchmark decontamination with suffix arrays over the training texts.

Batches of documents are shards. A shard's suffix array holds the word positions that some
test suffix could start at (their first three words occur in the benchmark), sorted by
the words that follow. Every different test suffix is binary-searched in every shard's array; the
range that remains after all its words are the places where it occurs, and runs of such
places along one diagonal are the longest verbatim matches. A place counts once for each item, so
words that repeat in an item and a text cost their number and not its square.

The benchmark goes to every task in blocks of bounded size (items longer than a piece are cut into pieces that
overlap by a window), some blocks in one pass over the documents; with more blocks than that, passes are cut through the
shared folder. Documents are not shuffled. Windows never cross texts. Null and empty
texts have no words; an item without words has no window; repeated items of one id count
once; an empty benchmark or table gives zero hits. A long text is one row, its suffixes several shards. Columns named
``n_words`` and ``matches`` are replaced, others stay.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.store import cut, table
from keyloom.llm.words import ALNUM, mix, slices, split, text_buffers

WINDOW = 10
#: Words that must agree before a position enters the array.
LEAD = 3
#: Bytes of benchmark text in a block, suffixes of an item in a piece, and blocks that are sent to the tasks at once.
BLOCK_BYTES, PIECE, BLOCKS = 8_000_000, 400_000, 8
#: Suffixes of a shard.
SHARD = 1 << 19
_BITS = 22

HITS = "array<struct<item:{kind},item_start:int,start:int,n_words:int>>"


@dataclass
class Suffixes:
    """Test suffixes of one block. ``words`` are all words of its pieces. Of equal suffixes of a piece the first is kept in
    ``at`` (where in words), ``item``, ``start`` (in the item) and ``depth`` (words); ``first`` is the start of the one kept for each
    suffix, those of piece i being first[bounds[i]:bounds[i+1]], and ``offset`` is where a piece begins in its item."""

    names: list
    words: np.ndarray
    at: np.ndarray
    item: np.ndarray
    start: np.ndarray
    depth: np.ndarray
    first: np.ndarray
    bounds: np.ndarray
    offset: np.ndarray
    leads: list[np.ndarray | None]  # for 1, 2, 3 leading words a bitmap of their hashes

    @staticmethod
    def of(names: list, offset: list[int], texts: list[str | None], window: int = WINDOW) -> Suffixes:
        offsets, data = text_buffers(pa.array(texts, pa.string()))
        w = split(data, offsets, ALNUM)
        n = np.diff(w.bounds)
        each = np.minimum(n, window)
        count = np.where(n > 0, n - each + 1, 0)
        bounds = np.append(0, np.cumsum(count))
        item = np.repeat(np.arange(len(n)), count)
        start = np.arange(len(item)) - bounds[item]
        at, depth = w.bounds[item] + start, each[item]
        names_of = np.zeros(len(item), np.uint64)
        for k in range(window):
            has = depth > k
            names_of[has] = mix(names_of[has] * np.uint64(0xD6E8FEB86659FD93) + w.hashes[at[has] + k])
        order = np.lexsort((start, names_of, item))
        new = np.ones(len(order), bool)
        new[1:] = (names_of[order][1:] != names_of[order][:-1]) | (item[order][1:] != item[order][:-1])
        first = np.zeros(len(item), np.int32)
        first[order] = start[order][new][np.cumsum(new) - 1]
        kept = np.sort(order[new])
        leads = []
        for q in range(1, LEAD + 1):
            rows = kept[np.minimum(depth[kept], LEAD) == q]
            bitmap = np.zeros(2**_BITS, bool) if len(rows) else None
            if bitmap is not None:
                bitmap[_lead([w.hashes[at[rows] + k] for k in range(q)])] = True
            leads.append(bitmap)
        small = lambda x: x[kept].astype(np.int32)
        return Suffixes(names, w.hashes, small(at), small(item), small(start), small(depth), first, bounds, np.array(offset, np.int64), leads)


def _lead(words: list[np.ndarray]) -> np.ndarray:
    out = words[0]
    for x in words[1:]:
        out = (out * np.uint64(0x9E3779B97F4A7C15)) ^ x
    return (mix(out) >> np.uint64(64 - _BITS)).astype(np.int64)


def _shards(column, blocks: list[Suffixes], window: int, counts: np.ndarray):
    """Fills in the words of each document; yields (document, position, following words) of each shard's suffixes in sorted order."""
    offsets, data = text_buffers(column)
    held, size = [], 0

    def sorted_() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        docs, places, keys = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort(keys.T[::-1])
        return docs[order], places[order], keys[order]

    for a, b in slices(offsets):
        w = split(data, offsets[a : b + 1], ALNUM)
        counts[a:b] = np.diff(w.bounds)
        h, n = w.hashes, len(w.hashes)
        able = np.zeros(n, bool)
        for q in range(1, LEAD + 1):
            bitmaps = [s.leads[q - 1] for s in blocks if s.leads[q - 1] is not None]
            if n >= q and bitmaps:
                lead = _lead([h[k : n - q + 1 + k] for k in range(q)])
                for bitmap in bitmaps:
                    able[: n - q + 1] |= bitmap[lead]
        every = np.flatnonzero(able)
        for x in range(0, len(every), SHARD):
            at = every[x : x + SHARD]
            end = w.bounds[w.text[at] + 1]
            follow = np.zeros((len(at), window), np.uint64)
            for k in range(window):
                has = at + k < end
                follow[has, k] = h[at[has] + k]
            held.append((w.text[at] + a, at - w.bounds[w.text[at]], follow))
            size += len(at)
            if size >= SHARD:
                yield sorted_()
                held, size = [], 0
    if held:
        yield sorted_()


def _search(s: Suffixes, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix, low, high): where each test suffix that occurs stands in the array. All are searched at once; a word
    more narrows each range by two binary searches."""
    live = np.arange(len(s.depth))
    low, high = np.zeros(len(live), np.int64), np.full(len(live), len(keys), np.int64)
    done = []
    for k in range(keys.shape[1]):
        column, want = keys[:, k], s.words[s.at[live] + k]
        bounds = []
        for right in (False, True):
            a, b = low.copy(), high.copy()
            while (open_ := a < b).any():
                mid = (a + b) >> 1
                v = column[np.minimum(mid, len(column) - 1)]
                up = open_ & ((v <= want) if right else (v < want))
                a = np.where(up, mid + 1, a)
                b = np.where(open_ & ~up, mid, b)
            bounds.append(a)
        low, high = bounds
        keep = low < high
        live, low, high = live[keep], low[keep], high[keep]
        end = s.depth[live] == k + 1
        done.append((live[end], low[end], high[end]))
        live, low, high = live[~end], low[~end], high[~end]
        if not len(live):
            break
    return tuple(np.concatenate(x) for x in zip(*done, strict=True)) if done else (live, low, high)


def _places(s: Suffixes, shards: list[tuple]) -> list[np.ndarray]:
    """document, item, place, start, depth of every place of a test suffix, one for each item and place, in this order."""
    found = []
    for docs, places, keys in shards:
        which, low, high = _search(s, keys)
        n = high - low
        which = np.repeat(which, n)
        at = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        found.append((docs[at], s.item[which].astype(np.int64), places[at], s.start[which].astype(np.int64), s.depth[which].astype(np.int64)))
    out = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 5
    order = np.lexsort((out[2], out[1], out[0]))
    return [x[order] for x in out]


def _runs(s: Suffixes, doc: np.ndarray, item: np.ndarray, place: np.ndarray, start: np.ndarray) -> list[tuple[int, int, int]]:
    """(first index, end index, start in the piece) of the longest verbatim runs. A run goes on where the next place's suffix is the
    next one of the item, or equal to it."""
    if not len(doc):
        return []
    new = np.ones(len(doc), bool)
    near = (doc[1:] == doc[:-1]) & (item[1:] == item[:-1]) & (place[1:] == place[:-1] + 1)
    new[1:] = ~near | (start[1:] != start[:-1] + 1)
    begins = np.flatnonzero(new)
    ends = np.append(begins[1:], len(doc))
    joins = np.append(False, near)[begins]
    if not joins.any():
        return list(zip(begins.tolist(), ends.tolist(), start[begins].tolist(), strict=True))
    first, bounds, starts, items = s.first, s.bounds.tolist(), start.tolist(), item.tolist()
    out: list[list[int]] = []
    for a, b, joined in zip(begins.tolist(), ends.tolist(), joins.tolist(), strict=True):
        while joined and a < b:
            begin, end, at = out[-1]
            base, size = bounds[items[a]], bounds[items[a] + 1] - bounds[items[a]]
            x = at + end - begin  # the suffix of the item that would go on
            if x >= size or first[base + x] != starts[a]:
                break
            k = min(b - a, size - x)
            if k > 1:
                same = first[base + x : base + x + k] == start[a : a + k]
                k = k if same.all() else int(np.argmin(same))
            out[-1][1] = a = a + k
        if a < b:
            out.append([a, b, starts[a]])
    return [tuple(x) for x in out]


def _pieces(items: DataFrame, window: int) -> DataFrame:
    """Items as rows of bounded length: item, the first word, text."""
    kind = items.schema["item"].dataType.simpleString()

    def run(batches):
        for b in batches:
            names, firsts, texts = [], [], []
            for name, text in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                if len(text) <= PIECE:
                    names, firsts, texts = [*names, name], [*firsts, 0], [*texts, text]
                    continue
                raw = text.encode()
                w = split(np.frombuffer(raw, np.uint8), np.array([0, len(raw)], np.int64), ALNUM, hashed=False)
                n = len(w.starts)
                for a in range(0, max(1, n - window + 1), PIECE):
                    end = min(n, a + PIECE + window - 1)
                    names, firsts = [*names, name], [*firsts, a]
                    texts.append(raw[int(w.starts[a]) : int(w.ends[end - 1])].decode() if n else "")
            yield pa.RecordBatch.from_arrays([pa.array([x.as_py() for x in names], b.schema.field(0).type), pa.array(firsts, pa.int64()), pa.array(texts, pa.string())], ["item", "first", "text"])

    return items.mapInArrow(run, f"item {kind}, first long, text string")


def blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES):
    """The benchmark's suffixes in blocks of about ``block_bytes``. Items are taken once, and the benchmark is read once."""
    items = benchmark.select(F.col(item_col).alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).distinct()
    rows = cut(_pieces(items, window), "benchmark")
    total = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = int(1 + total // block_bytes)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("item", "text", "first"), F.lit(n)).cast("int"))
    if n > 1:
        dealt = cut(dealt, "benchmark-blocks", "block")
    for k in range(n):
        got = dealt.filter(F.col("block") == k).collect()
        yield Suffixes.of([r["item"] for r in got], [r["first"] for r in got], [r["text"] for r in got], window)


def find(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, at_once: int = BLOCKS) -> DataFrame:
    """Every row of ``docs`` with all its columns and two more (replacing any of those names): ``n_words`` and
    ``matches``, the longest verbatim matches with where they lie in the item and in the text, counted in words."""
    spark = docs.sparkSession
    kind = benchmark.schema[item_col].dataType.simpleString()
    out = docs.withColumn("n_words", F.lit(0).cast("long")).withColumn("matches", F.lit(None).cast(HITS.format(kind=kind)))
    held, passes = [], 0
    for suffixes in blocks(benchmark, item_col, item_text_col, window, block_bytes):
        if len(held) == at_once:
            out, held, passes = cut(_pass(out, held, text_col, window), "decontaminated"), [], passes + 1
        held.append(spark.sparkContext.broadcast(suffixes))
    return _pass(out, held, text_col, window)


def _pass(out: DataFrame, shared: list, text_col: str, window: int) -> DataFrame:
    at, count_at, hits_at = (out.columns.index(c) for c in (text_col, "n_words", "matches"))

    def run(batches):
        held = [x.value for x in shared]
        for b in batches:
            hits = b.column(hits_at)
            kind = hits.type
            counts = np.zeros(b.num_rows, np.int64)
            shards = list(_shards(b.column(at), held, window, counts))
            found = [hits] if hits.null_count < len(hits) else []
            for s in held:
                doc, item, place, start, depth = _places(s, shards)
                runs = np.array(_runs(s, doc, item, place, start), np.int64).reshape(-1, 3)
                a, z = runs[:, 0], runs[:, 1] - 1
                names = pa.array([s.names[i] for i in item[a]], kind.value_type.field(0).type)
                spans = (runs[:, 2] + s.offset[item[a]], place[a], place[z] - place[a] + depth[z])
                rows = pa.StructArray.from_arrays([names, *(pa.array(x.astype(np.int32)) for x in spans)], ["item", "item_start", "start", "n_words"])
                found.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[a], np.arange(b.num_rows + 1)), pa.int32()), rows).cast(kind))
            if len(found) > 1:
                lists = [x.to_pylist() for x in found]
                found = [pa.array([sum((x or [] for x in row), []) for row in zip(*lists, strict=True)], kind)]
            columns = list(b.columns)
            columns[count_at], columns[hits_at] = pa.array(counts), found[0]
            yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    return out.mapInArrow(run, out.schema)


def covered(matches: str = "matches"):
    """Words inside any match: the union of their spans, as a column."""
    ordered = F.array_sort(F.transform(matches, lambda m: F.struct(m["start"].alias("a"), (m["start"] + m["n_words"]).alias("b"))))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def add(acc, m):
        return F.struct((acc["n"] + F.greatest(F.lit(0), m["b"] - F.greatest(m["a"], acc["end"]))).alias("n"), F.greatest(acc["end"], m["b"]).alias("end"))

    return F.aggregate(ordered, start, add, lambda acc: acc["n"].cast("long"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of what ``find`` returned."""
    items = F.array_distinct(F.transform("matches", lambda m: m["item"].cast("string")))
    return found.select("doc_id", "n_words", covered().alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort(items), ","), 256).alias("items_sha256")).withColumn(
        "contaminated", F.col("n_hit") > 0
    )


def remove(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without those that hold a window of the benchmark; columns as they were."""
    return find(docs, benchmark, **options).filter(F.size("matches") == 0).select(*docs.columns)


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 10 benchmark words in all documents."""
    return digest(find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS k, unnest([array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') FOR i IN range(1, len(ws) - least(len(ws), 10) + 2)]) AS win FROM b WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, unnest(range(1, len(ws) - k + 2)) AS pos, unnest([array_to_string(ws[i:i + k - 1], ' ') FOR i IN range(1, len(ws) - k + 2)]) AS win FROM d, sizes WHERE len(ws) >= k),
h AS (SELECT doc_id, pos, dw.k, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.k = bw.k),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(pos, pos + k)) AS p FROM h) GROUP BY 1),
i AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS sha FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)
"""
