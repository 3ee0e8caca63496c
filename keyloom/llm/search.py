"""Ranked lexical search over a tiered index, exact.

The score of a document for an item is a sum over the item's terms of integers, weight x impact, where the impact of a
posting depends on the document alone. The index is written in tiers: the first holds of each term the postings of
highest impact (about TIERS[0] of them, by ranges of impact), the next one more, the last one all. What a term has outside
a tier is bounded by its residual, the highest impact left out.

An item is looked up in the first tier. A document's score there is a lower bound of its score, and with the residuals
of the terms that it does not have there an upper one; a document that is not there at all has at most the sum of the
residuals. If the 20th best lower bound is above that sum, no other document can be among the 20: the documents whose
upper bound reaches it are taken from the last tier and scored in full. An item without that proof falls through to the
next tier, and takes its threshold along; in the last tier every residual is 0 and every score exact.

Items are stated queries: they are cut into blocks of at most BLOCK (item, term) pairs, and each block's pairs and facts
of terms, of bounded size, go to the tasks that read postings. Documents are never gathered: a task keeps at most 20 of an
item, but for equals of the last.

Terms are what ``words.ALNUM`` says, told apart by 64-bit hashes. Null and empty texts have no terms: such documents do
not count, such items have no results. Rows that share an id, of documents or items, are documents and items of their
own; a null id is an id, and comes last of equal scores. Texts of any length are taken whole; empty tables give no rows;
other columns take no part.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.llm.shares import maybe_among
from keyloom.llm.store import cut, table
from keyloom.llm.words import ALNUM, slices, split, text_buffers

#: Postings of a term in each tier but the last, about; documents for an item.
TIERS, TOP = (1_000, 16_000), 20
#: (item, term) pairs of a block of items.
BLOCK = 1 << 20
#: Impacts are below 10^6; the ranges that tiers are cut at are 2^12 wide.
RANGE_BITS = 12
#: Cells of a task's table of scores; and found rows a task holds before it drops what is beaten.
CELLS, HELD = 1 << 21, 1 << 18


def _terms(texts: DataFrame, kind: str, known: np.ndarray | None = None) -> DataFrame:
    """rid, id, n (terms with repeats), terms and counts of each row (rid, id, text): hashes in order, or, of ``known`` terms only,
    their places in it."""
    shared = None if known is None else texts.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        for b in batches:
            offsets, data = text_buffers(b.column(2))
            for a, z in slices(offsets):
                w = split(data, offsets[a : z + 1], ALNUM)
                order = np.lexsort((w.hashes, w.text))
                text, term = w.text[order], w.hashes[order]
                first = np.ones(len(order), bool)
                first[1:] = (text[1:] != text[:-1]) | (term[1:] != term[:-1])
                at = np.flatnonzero(first)
                count, text, term = np.diff(np.append(at, len(order))), text[at], term[at]
                if shared is None:
                    term = term.view(np.int64)
                else:
                    place = np.minimum(np.searchsorted(shared.value, term), max(0, len(shared.value) - 1))
                    hit = shared.value[place] == term if len(shared.value) else np.zeros(len(term), bool)
                    count, text, term = count[hit], text[hit], place[hit].astype(np.int64)
                bounds = pa.array(np.searchsorted(text, np.arange(z - a + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (term, count.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), b.column(1).slice(a, z - a), pa.array(np.diff(w.bounds).astype(np.int64)), *lists], ["rid", "id", "n", "terms", "counts"])

    return texts.mapInArrow(run, f"rid long, id {kind}, n long, terms array<long>, counts array<long>")


def _rows(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return texts.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))


@dataclass
class Queries:
    """A block of items: pairs sorted by term. The term of pair i is terms[i], a place in the block's vocabulary."""

    rids: np.ndarray
    names: list
    bounds: np.ndarray  # pairs of term t are bounds[t] .. bounds[t + 1] - 1
    item: np.ndarray
    repeats: np.ndarray
    weight: np.ndarray  # of each term

    def sums(self, impact: np.ndarray) -> np.ndarray:
        """For each item the sum over its terms, of which each has such an ``impact``."""
        term = np.repeat(np.arange(len(self.weight)), np.diff(self.bounds))
        out = np.zeros(len(self.rids), np.int64)
        np.add.at(out, self.item, self.repeats * self.weight[term] * impact[term])
        return out


def _blocks(items: DataFrame, id_col: str, text_col: str, block: int):
    """(rids, names, vocabulary, pairs) of blocks of items, each of about ``block`` pairs; an item with more is alone."""
    kind = items.schema[id_col].dataType.simpleString()
    coded = cut(_terms(_rows(items, id_col, text_col), kind).filter("n > 0"), "items")
    total = coded.agg(F.sum(F.size("terms"))).first()[0] or 0
    n = 1 + total // max(1, block)
    coded = coded.withColumn("block", F.pmod(F.xxhash64("rid"), F.lit(n)))
    for k in range(n if total else 0):
        got = coded.filter(F.col("block") == k).collect()  # some ``block`` pairs
        if got:
            terms = np.concatenate([np.array(r["terms"], np.int64) for r in got]).view(np.uint64)
            item = np.repeat(np.arange(len(got)), [len(r["terms"]) for r in got])
            repeats = np.concatenate([np.array(r["counts"], np.int64) for r in got])
            known, place = np.unique(terms, return_inverse=True)
            order = np.argsort(place, kind="stable")
            bounds = np.searchsorted(place[order], np.arange(len(known) + 1))
            yield known, Queries(np.array([r["rid"] for r in got]), [r["id"] for r in got], bounds, item[order], repeats[order], np.zeros(len(known), np.int64))


def _impact(n: np.ndarray, count: np.ndarray, docs: int, words: int) -> np.ndarray:
    """Of postings with ``count`` occurrences in documents of ``n`` terms, where ``docs`` documents have ``words`` terms."""
    scaled = np.array([75 + 25 * x * docs // words for x in n.tolist()], np.int64) if len(n) and int(n.max()) * docs > 2**57 else 75 + 25 * n * docs // words
    return 1_000_000_000 * count // (1000 * count + 12 * scaled)


def _index(docs: DataFrame, id_col: str, text_col: str, known: np.ndarray) -> tuple[DataFrame, int, int]:
    """(rid, id, n, terms, impacts) of documents with any of the ``known`` terms, the last tier, and how many documents and terms
    there are in all."""
    kind = docs.schema[id_col].dataType.simpleString()
    coded = cut(_terms(_rows(docs, id_col, text_col), kind, known).filter("n > 0"), "postings")
    n_docs, n_words = coded.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()

    def run(batches):
        for b in batches:
            sizes = np.array(b.column(3).value_lengths(), np.int64)
            n = np.repeat(np.array(b.column(2), np.int64), sizes)
            impacts = _impact(n, np.array(b.column(4).flatten(), np.int64), n_docs, n_words)
            bounds = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(bounds, b.column(3).flatten()), pa.ListArray.from_arrays(bounds, pa.array(impacts))], ["rid", "id", "terms", "impacts"])

    index = coded.filter(F.size("terms") > 0).mapInArrow(run, f"rid long, id {kind}, terms array<long>, impacts array<long>")
    return index, n_docs, n_words


def _cuts(index: DataFrame, n_terms: int, tiers: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(postings of each term, the impact from which on a posting is in each tier, the highest impact below that). Postings are counted by
    term and range of impact, and added up from above."""
    each = index.select(F.explode(F.arrays_zip("terms", "impacts")).alias("p")).select(F.col("p.terms").alias("term"), F.col("p.impacts").alias("impact"))
    ranges = each.groupBy("term", F.shiftright("impact", RANGE_BITS).alias("range")).agg(F.count("*").alias("n"), F.max("impact").alias("most"))
    above = F.sum("n").over(Window.partitionBy("term").orderBy(F.col("range").desc()))  # a term has 2^(20 - RANGE_BITS) ranges
    facts = [F.sum("n").alias("df")]
    for k, size in enumerate(tiers):
        facts += [F.min(F.when(F.col("above") <= size, F.col("range"))).alias(f"low{k}"), F.max(F.when(F.col("above") > size, F.col("most"))).alias(f"rest{k}")]
    df, low, rest = np.zeros(n_terms, np.int64), np.zeros((len(tiers), n_terms), np.int64), np.zeros((len(tiers), n_terms), np.int64)
    for r in ranges.withColumn("above", above).groupBy("term").agg(*facts).collect():  # as many rows as terms of a block
        df[r["term"]] = r["df"]
        for k in range(len(tiers)):
            low[k, r["term"]] = (1 << 40) if r[f"low{k}"] is None else r[f"low{k}"] << RANGE_BITS
            rest[k, r["term"]] = r[f"rest{k}"] or 0
    return df, low, rest


def _tier(index: DataFrame, low: np.ndarray) -> DataFrame:
    """The postings of impact ``low`` of their term and more."""
    shared = index.sparkSession.sparkContext.broadcast(low)

    def run(batches):
        for b in batches:
            doc, term, impact = _postings(b)
            stays = impact >= shared.value[term]
            has = np.bincount(doc[stays], minlength=b.num_rows)
            some = pa.array(np.flatnonzero(has))
            bounds = pa.array(np.concatenate([[0], np.cumsum(has[has > 0])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0).take(some), b.column(1).take(some), *(pa.ListArray.from_arrays(bounds, pa.array(x[stays])) for x in (term, impact))], b.schema.names)

    return index.mapInArrow(run, index.schema)


def _postings(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    doc = np.repeat(np.arange(b.num_rows), np.array(b.column(2).value_lengths(), np.int64))
    return doc, np.array(b.column(2).flatten(), np.int64), np.array(b.column(3).flatten(), np.int64)


def _look_up(tier: DataFrame, q: Queries, least: np.ndarray, top: int | None, rest: np.ndarray | None = None) -> DataFrame:
    """(item, rid, id, low) of documents of a tier for the items of ``q``, by place. With ``top``, of each task the best ``top`` of each item,
    with their lower bounds, of ``least`` at least; without, all whose upper bound is at least ``least``, given the residuals ``rest``.
    Items with negative ``least`` are passed over."""
    kind = tier.schema["id"].dataType.simpleString()
    wanted = np.flatnonzero(least >= 0)
    place = np.full(len(least), -1)
    place[wanted] = np.arange(len(wanted))
    pair = np.flatnonzero(place[q.item] >= 0)
    term = np.repeat(np.arange(len(q.weight)), np.diff(q.bounds))[pair]
    bounds = np.searchsorted(term, np.arange(len(q.weight) + 1))
    unseen = None if rest is None else q.sums(rest)[wanted]
    shared = tier.sparkSession.sparkContext.broadcast((wanted, bounds, place[q.item[pair]], q.repeats[pair] * q.weight[term], np.maximum(least[wanted], 1), rest, unseen))
    names = ["item", "rid", "id", "low"]

    def best(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks().sort_by([("item", "ascending"), ("low", "descending"), ("id", "ascending")])
        item = np.array(rows.column("item"))
        nth = np.arange(len(item)) - np.searchsorted(item, item)
        return rows.filter(pa.array(nth < top)).combine_chunks().to_batches()

    def run(batches):
        wanted, bounds, item, factor, least, rest, unseen = shared.value
        width, held, n_held = max(1, len(wanted)), [], 0
        for b in batches:
            doc, term, impact = _postings(b)
            step = max(1, CELLS // width)
            for a in range(0, b.num_rows, step):
                z = min(a + step, b.num_rows)
                lo, hi = np.searchsorted(doc, (a, z))
                size = bounds[term[lo:hi] + 1] - bounds[term[lo:hi]]
                of = np.repeat(np.arange(lo, hi), size)
                at = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + bounds[term[of]]
                cell = (doc[of] - a) * width + item[at]
                low = np.zeros((z - a) * width, np.int64)
                np.add.at(low, cell, factor[at] * impact[of])
                high = low
                if rest is not None:
                    high = low + np.tile(unseen, z - a)
                    np.subtract.at(high, cell, factor[at] * rest[term[of]])
                found = np.flatnonzero((high.reshape(-1, width) >= least).ravel() & (low > 0))
                if not len(found):
                    continue
                d = pa.array(found // width + a)
                out = pa.RecordBatch.from_arrays([pa.array(wanted[found % width]), b.column(0).take(d), b.column(1).take(d), pa.array(low[found])], names)
                if top is None:
                    yield out
                    continue
                held, n_held = [*held, out], n_held + len(found)
                if n_held > HELD:
                    held = best(held)
                    n_held = sum(x.num_rows for x in held)
                    last = pa.Table.from_batches(held)
                    per = last.group_by("item").aggregate([("low", "min"), ("low", "count")])
                    full = per.filter(pc.equal(per["low_count"], top))  # from here on only what is not beaten by those found
                    least = least.copy()
                    where = np.searchsorted(wanted, np.array(full["item"], np.int64))
                    least[where] = np.maximum(least[where], np.array(full["low_min"], np.int64))
        if held:
            yield from best(held)

    return tier.mapInArrow(run, f"item long, rid long, id {kind}, low long")


def _ranked(found: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each item. What tasks found is cut to that many before it is dealt by item."""
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("low").desc(), F.col("id").asc_nulls_last(), "rid"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", top: int = TOP, tiers: tuple[int, ...] = TIERS, block: int = BLOCK) -> DataFrame:
    """item, rank, id, score of the best ``top`` documents with a score for each item; and ``tier``, in which it was proven."""
    spark, out = docs.sparkSession, []
    item_kind, kind = items.schema[item_col].dataType.simpleString(), docs.schema[id_col].dataType.simpleString()
    for known, q in _blocks(items, item_col, item_text_col, block):
        index, n_docs, _ = _index(docs, id_col, text_col, known)
        if not n_docs:
            break
        last = cut(index, "tier-last")
        df, low, rest = _cuts(last, len(known), tiers)
        q.weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
        least, answers = np.zeros(len(q.rids), np.int64), []  # scores are above 0; what is answered goes below 0
        for k in range(len(tiers)):
            tier = cut(_tier(last, low[k]), f"tier-{k + 1}")
            best = _ranked(_look_up(tier, q, least, top), top).groupBy("item").agg(F.min("low").alias("low"), F.count("*").alias("n"))
            for r in best.filter(F.col("n") == top).collect():  # one row an item of the block
                least[r["item"]] = max(least[r["item"]], r["low"])
            unseen = q.sums(rest[k])
            proven = (least >= 0) & ((least > unseen) | (unseen == 0))
            if proven.any():
                mine = np.where(proven, least, -1)
                asked = cut(_look_up(tier, q, mine, None, rest[k]).select("rid").distinct(), "asked")
                whole = maybe_among(last, asked, ["rid"], asked.count()).filter("__maybe").drop("__maybe").join(asked, "rid", "left_semi")
                answers.append(_ranked(_look_up(whole, q, mine, top), top).withColumn("tier", F.lit(k + 1)))
                least = np.where(proven, -1, least)
            if (least < 0).all():
                break
        else:
            answers.append(_ranked(_look_up(last, q, least, top), top).withColumn("tier", F.lit(len(tiers) + 1)))
        names = spark.createDataFrame(list(zip(range(len(q.names)), q.names, strict=True)), f"item long, name {item_kind}")  # of one block
        for a in answers:
            out.append(cut(a.join(F.broadcast(names), "item").select(F.col("name").alias("item"), "rank", "id", F.col("low").alias("score"), "tier"), "found"))
    if not out:
        return spark.createDataFrame([], f"item {item_kind}, rank int, id {kind}, score long, tier int")
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole


def op13_tiered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all documents for each item of the benchmark."""
    found = search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("item").alias("item_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("doc_id"), "score")


OP13_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT item_id, row_number() OVER () AS iid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM benchmark),
q AS (SELECT iid, w, count(*) AS k FROM (SELECT iid, unnest(ws) AS w FROM i) GROUP BY ALL),
sums AS (SELECT count(*) AS nn, CAST(sum(len(ws)) AS BIGINT) AS ll FROM d WHERE len(ws) > 0),
tf AS (SELECT rid, w, count(*) AS tf FROM (SELECT rid, unnest(ws) AS w FROM d) WHERE w IN (SELECT w FROM q) GROUP BY ALL),
wt AS (SELECT w, CAST(floor(1000 * ln(CAST(2 * any_value(nn) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS wt FROM tf, sums GROUP BY w),
m AS (SELECT rid, doc_id, 75 + (25 * len(ws) * nn) // ll AS m FROM d, sums),
p AS (SELECT rid, w, wt * ((1000000000 * tf) // (1000 * tf + 12 * m)) AS s FROM tf JOIN m USING (rid) JOIN wt USING (w)),
sc AS (SELECT iid, rid, CAST(sum(k * s) AS BIGINT) AS score FROM q JOIN p USING (w) GROUP BY ALL),
r AS (SELECT iid, doc_id, score, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM sc JOIN m USING (rid) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r JOIN i USING (iid) WHERE rank <= 20
"""
