"""Line deduplication by repeated passages of lines.

The smallest passage is two successive lines. A rolling hash over the lines' hashes is taken at every
line, so every passage of two lines or more that occurs twice is found whole, wherever it stands and
whatever is around it: all of its windows of two lines repeat, those over its first and last
lines too. So it is the content that says where a removed passage begins and ends, and lines put in
before it shift nothing. Windows of one rolling hash are told apart by the SHA-256 of their bytes, so
only windows of equal bytes are repeats of each other. The first place of a window (by id, then place
in the text) keeps it; at all others its lines go, so a longer passage goes line by line up to where
the texts differ. A window that overlaps its own first place, as in three equal lines, is no
repeat. A single line that repeats between different lines stays.

Windows are counted with partial aggregates. Those that are common beyond a bound are few, so they are
broadcast to their places, which stay where they are (see shares.py). Texts that lose nothing are not
shuffled.

Blank lines between the lines of a window belong to it. A row is known by 128 bits of hash of its id and
text; rows that are equal in both are one place and keep and lose the same lines. Null and empty
texts have no lines; null stays null. A text of any length is read line by line in one task. An empty table
gives an empty result; other columns of the table are not looked at, so their names cannot clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.shares import maybe_among, with_facts
from keyloom.llm.store import cut, drop_written, n_written, table
from keyloom.llm.words import _BASE, _BYTE_VALUE, _class, _power, mix, slices, split, text_buffers

_U = np.uint64
#: A line feed (or carriage return) ends a line.
LINES = _class([(0x0A, 0x0A), (0x0D, 0x0D)], False)
LEAST_LINES = 2


def _lines(column: pa.Array):
    """(start, end, bounds, hi, lo) of the lines of a column, offsets and data. Lines of text i are bounds[i] .. bounds[i+1]-1, bytes count
    from the column's start, and hi and lo are the hash of each line and the next, where the text has a next."""
    offsets, data = text_buffers(column)
    starts, ends, counts, his, los = ([np.zeros(0, t)] for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    for a, b in slices(offsets):
        w = split(data, offsets[a : b + 1], LINES)
        base = int(offsets[a])
        piece = data[base : int(offsets[b])]
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[piece] * _power(_BASE, len(piece), "up"), out=total[1:])
        back = _power(pow(_BASE, -1, 2**64), len(piece) + 1, "down")
        hi, lo = np.zeros(len(w.starts), np.uint64), np.zeros(len(w.starts), np.uint64)
        start, end = w.starts[:-1], w.ends[1:]
        hi[:-1] = mix((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64))
        lo[:-1] = mix(w.hashes[:-1] * _U(0xD6E8FEB86659FD93) + w.hashes[1:])
        for to, x in zip((starts, ends, counts, his, los), (w.starts + base, w.ends + base, np.diff(w.bounds), hi, lo), strict=True):
            to.append(x)
    bounds = np.append(0, np.cumsum(np.concatenate(counts)))
    return np.concatenate(starts), np.concatenate(ends), bounds, np.concatenate(his).view(np.int64), np.concatenate(los).view(np.int64), offsets, data


def windows(docs: DataFrame) -> DataFrame:
    """One row for each LEAST_LINES successive lines of ``docs`` (r1, r2, doc_id, text): the row's name, doc_id, first line, rolling
    hash and SHA-256 of the bytes."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            start, end, bounds, hi, lo, _, data = _lines(b.column(3))
            n = np.diff(bounds)
            text, line = np.repeat(np.arange(len(n)), n), np.arange(bounds[-1]) - np.repeat(bounds[:-1], n)
            many = np.flatnonzero(line + LEAST_LINES <= n[text])
            at, whole = pa.array(text[many]), memoryview(data)
            held = [hashlib.sha256(whole[x:y]).digest() for x, y in zip(start[many].tolist(), end[many + LEAST_LINES - 1].tolist(), strict=True)]
            columns = [*(b.column(k).take(at) for k in range(3)), pa.array(line[many]), pa.array(hi[many]), pa.array(lo[many]), pa.array(held, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["r1", "r2", "doc_id", "line", "hi", "lo", "held"])

    return docs.mapInArrow(run, f"r1 long, r2 long, doc_id {kind}, line long, hi long, lo long, held binary")


def _without(found: DataFrame) -> DataFrame:
    """Drops the lines of each text's windows that begin at the lines in ``cuts``; adds n_lines, n_removed and the new text as ``clean``."""

    names = found.columns

    def run(batches):
        at = {c: k for k, c in enumerate(names)}
        for b in batches:
            texts, cuts = b.column(at["text"]), b.column(at["cuts"])
            start, _, bounds, _, _, offsets, data = _lines(texts)
            n, removed = np.diff(bounds), np.zeros(len(texts), np.int64)
            clean = texts.to_pylist()
            for i, c in enumerate(cuts.to_pylist()):
                if not c:
                    continue
                # A line ends where the next one begins: with the line feeds and blank lines after it.
                begins = np.append(start[bounds[i] : bounds[i + 1]], offsets[i + 1])
                gone = sorted({x + k for x in c for k in range(LEAST_LINES)})
                out, last = [], int(offsets[i])
                for k in gone:
                    out.append(data[last : begins[k]].tobytes())
                    last = int(begins[k + 1])
                out.append(data[last : offsets[i + 1]].tobytes())
                removed[i] = len(gone)
                clean[i] = b"".join(out).decode("utf-8").rstrip("\r\n")
            columns = [b.column(at[c]) for c in names if c != "cuts"] + [pa.array(n), pa.array(removed), pa.array(clean, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [c for c in names if c != "cuts"] + ["n_lines", "n_removed", "clean"])

    kept = found.drop("cuts")
    return found.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", n_lines long, n_removed long, clean string")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, n_lines, n_removed and ``clean`` (the text without repeated passages) of every row."""
    i, t = F.col(id_col), F.col(text_col)
    rows = docs.select(F.xxhash64(i.isNull(), i, t).alias("r1"), F.xxhash64(t, i.isNull(), i).alias("r2"), i.alias("doc_id"), t.alias("text"))
    at = n_written()
    all_ = cut(windows(rows), "windows")
    window, row = ["hi", "lo", "held"], ["r1", "r2"]
    place = F.struct("doc_id", "r1", "r2", "line")
    counted = all_.groupBy(*window).agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n")).filter("first != last")
    repeats = cut(counted.select(*window, "n", F.col("first.r1").alias("in_r1"), F.col("first.r2").alias("in_r2"), F.col("first.line").alias("at")), "repeats")
    # Rows alike in id and text are one place, so that a repeated row does not lose what it holds once.
    keeps = (F.col("r1") == F.col("in_r1")) & (F.col("r2") == F.col("in_r2")) & F.col("line").between(F.col("at"), F.col("at") + LEAST_LINES - 1)
    gone = with_facts(all_.select(*window, *row, "line"), repeats, window, "n", all_.count()).filter(~keeps)
    lines = gone.groupBy(*row, "line").agg(F.count("*").alias("n"))
    cuts = cut(lines.groupBy(*row).agg(F.collect_list("line").alias("cuts"), F.max("n").alias("n")), "cuts")
    drop_written(docs.sparkSession, at, keep_last=True)
    n_cuts, n_rows = cuts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # Only texts that may lose lines meet their cuts. Equal rows are alike in their cuts, so a hot one is joined by its share.
    asked = maybe_among(rows, cuts, row, n_cuts)
    some, rest = asked.filter("__maybe").drop("__maybe"), asked.filter("not __maybe")
    met = with_facts(some, cuts, row, "n", n_rows, "left").select("doc_id", "text", "cuts")
    rest = rest.select("doc_id", "text", F.lit(None).cast("array<bigint>").alias("cuts"))
    return _without(met.unionByName(rest))


def op4_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of lines taken out of all documents; the cleaned text as its SHA-256."""
    found = dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.char_length("clean").cast("long").alias("n_chars_left"), F.sha2(F.col("clean"), 256).alias("clean_sha256"))
