"""Toxicity by a weighted lexicon.

Texts are folded (compatibility forms, lower case, look-alike letters of other scripts,
invisible characters, digits and signs that stand for letters inside a word) and cut into
words. Lexicon entries are whole words or beginnings of words, each with a weight; an
Aho-Corasick automaton finds all of them in one pass, and hits inside an exception phrase
do not count. A beginning is found only where its word goes on. The sum of weights is
normalised by length in two ways, as its excess over what clean text of that length has (in
standard deviations) and as its density; a logistic calibration makes a probability of both.

``fit`` learns the weights from labelled texts: how much oftener a word or beginning occurs
in toxic texts, kept where a likelihood-ratio test is beyond chance. It learns exception phrases from
the same texts: two neighbouring words, one of them in the lexicon, that clean texts hold at least as often as toxic ones. It
uses at most about SAMPLE labelled rows, chosen by a hash of the id. Without toxic or without
clean labels the built-in lexicon and calibration are used.

Null and empty texts have no hits and get the score of a text without hits. A text of any length is
read once, in time that grows with its length. Labels that are null or not 0/1 are passed over, repeated labels
count once, repeated documents as often as they come. An empty table gives an empty result; a column named ``score``
is replaced, others stay.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.store import cut, table

#: Labelled rows that a model is fitted on, at most (in expectation, by a hash threshold).
SAMPLE = 16_000
#: Pieces in which the sample is worked on, however few files it comes from.
PIECES = 48
#: Lexicon entries at most, the most significant first.
ENTRIES = 2_000
#: Lengths of word beginnings that can be entries.
SHORTEST, LONGEST = 2, 8
#: Least number of toxic texts with an entry, and least likelihood ratio statistic.
SUPPORT, SIGNIFICANT = 4, 18.0
#: Least weight: an entry occurs in toxic texts at least about 20 times as often as in clean ones.
LEAST_WEIGHT = 3.0
#: Exception phrases learned at most, those of most clean texts first.
PHRASES = 500
CUTOFF = 0.7

# Letters of other scripts and the Latin letters they look like.
LOOK_ALIKES = str.maketrans(
    "аеорсухіјѕԁһӏԛԝвкмнтзαβεικνορτυχγηωɑɡıℓ",
    "aeopcyxijsdhlqwbkmhtzabeikvoptuxynwagil",
)
# Digits and signs and the letters they stand for inside a word.
STAND_INS = str.maketrans("0134578@$", "oieastbas")
# A small lexicon for use without labels.
BUILT_IN = dict.fromkeys((" idiot ", " stupid ", " moron ", " scum ", " worthless ", " pathetic ", " disgusting ", " loser "), 3.0)
# Phrases in which a word of the lexicon is harmless.
EXCEPTIONS = (" trash can ", " trash bin ", " trash collection ", " clown fish ", " class clown ", " loser bracket ", " pond scum ", " soap scum ", " idiot proof ", " stupid simple ")

_INVISIBLE = re.compile("[­​-‏⁠﻿]")
_FOREIGN = re.compile("[ɐ-ʯͰ-ԯℓı]")
# From the first letter or sign of a run only, and without going back, so that long runs cost no more than their length.
_MIXED = re.compile(r"(?<![^\W\d_])[^\W\d_]++[0134578@$]++[\w@$]*+|(?<![\w@$])[0134578@$]++[^\W\d_][\w@$]*+")
_GAPS = re.compile(r"[\W_]+")


def fold(text: str | None) -> str:
    """The text's words in plain letters, each with a space before and after; " " if there are none."""
    if not text:
        return " "
    if not text.isascii():
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
        text = _INVISIBLE.sub("", text)
    text = text.lower()
    if not text.isascii() and _FOREIGN.search(text):
        text = text.translate(LOOK_ALIKES)
    text = _MIXED.sub(lambda m: m[0].translate(STAND_INS), text)
    words = _GAPS.sub(" ", text).strip()
    return f" {words} " if words else " "


@dataclass
class Model:
    """Weights of entries (" word " or " beginning"), exception phrases, and a logistic calibration."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    beta: tuple[float, float, float] = (-4.0, 2.0, 1.0)
    clean: tuple[float, float] = (0.0, 0.0)  # mean and variance of the weight per word in clean texts
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}

    def automaton(self):
        if self._automaton is None:
            a = ahocorasick.Automaton()
            for term, w in self.weights.items():
                a.add_word(term, (len(term), w))
            for phrase in self.exceptions:
                a.add_word(phrase, (len(phrase), self.weights.get(phrase)))
            a.add_word("\0", (1, 0.0))
            a.make_automaton()
            self._automaton = a
        return self._automaton

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of each entry found outside exception phrases."""
        found, excused = [], []
        for end, (n, w) in self.automaton().iter(folded):
            if w is None:
                excused.append((end + 1 - n, end + 1, w))
            elif folded[end] == " " or folded[end + 1 : end + 2] != " ":
                found.append((end + 1 - n, end + 1, w))
        if excused:  # of the phrases that begin at or before a hit, does the one that goes furthest hold it?
            excused.sort()
            begins, reach = [a for a, _, _ in excused], list(accumulate((b for _, b, _ in excused), max))
            held = lambda h: (k := bisect_right(begins, h[0])) and h[1] <= reach[k - 1]
            found = [h for h in found if not held(h)]
        best: dict[int, tuple[int, int, float]] = {}
        for h in found:  # of the entries that begin a word, the heaviest counts
            if h[0] not in best or best[h[0]][2] < h[2]:
                best[h[0]] = h
        return list(best.values())

    def measure(self, text: str | None) -> tuple[float, int]:
        """(sum of weights, words)."""
        return self.measure_folded(fold(text))

    def measure_folded(self, folded: str) -> tuple[float, int]:
        return sum(h[2] for h in self.hits(folded)), folded.count(" ") - 1

    def features(self, measures: np.ndarray) -> np.ndarray:
        total, words = measures[:, 0], measures[:, 1]
        excess = np.maximum(0, total - words * self.clean[0]) / np.sqrt(1 + words * self.clean[1])
        return np.c_[np.log1p(excess), np.log1p(100 * total / (words + 20))]

    def scores(self, measures: np.ndarray) -> np.ndarray:
        z = self.beta[0] + self.features(measures) @ np.array(self.beta[1:])
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def entries_of(folded: str) -> set[str]:
    out = set()
    for w in set(folded.split()):
        out.add(f" {w} ")
        for k in range(SHORTEST, min(LONGEST + 1, len(w))):
            out.add(f" {w[:k]}")
    return out


def sample_of(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """Folded text and toxic of about ``bound`` labelled rows at most that are not held out."""
    usable = labels.filter("doc_id is not null and toxic in (0, 1)").filter(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) != 1).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    n = usable.count()
    if n > bound:
        usable = usable.filter(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < int(1_000_000 * bound / n))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([fold(t) for t in b.column(0).to_pylist()], pa.string()), b.column(1)], ["text", "toxic"])

    rows = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(usable), "doc_id").select("text", "toxic")
    return rows.repartition(PIECES).mapInArrow(run, "text string, toxic int")


def _counts(sample: DataFrame) -> DataFrame:
    """Texts with each entry: toxic ones and clean ones."""

    def run(batches):
        for b in batches:
            seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen[y].update(entries_of(text))
            terms = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([seen[y][t] for t in terms], pa.int64()) for y in (1, 0))], ["term", "toxic", "clean"])

    return sample.mapInArrow(run, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _phrases(sample: DataFrame, weights: dict[str, float], toxic: int, clean: int) -> tuple[str, ...]:
    """Neighbouring words, one of them in the lexicon, that SUPPORT clean texts hold at least, and toxic ones no oftener."""
    shared = sample.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        known: dict[str, bool] = {}
        for b in batches:
            seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = text.split()
                for w in set(words) - known.keys():
                    known[w] = f" {w} " in shared.value or any(f" {w[:k]}" in shared.value for k in range(SHORTEST, min(LONGEST + 1, len(w))))
                at = [i for i, w in enumerate(words) if known[w]]
                seen[y].update({f" {words[k]} {words[k + 1]} " for i in at for k in (i - 1, i) if 0 <= k < len(words) - 1})
                if len(known) > 200_000:
                    known.clear()
            terms = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([seen[y][t] for t in terms], pa.int64()) for y in (1, 0))], ["term", "toxic", "clean"])

    found = sample.mapInArrow(run, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    harmless = (F.col("clean") >= SUPPORT) & (F.col("toxic") * F.lit(clean) <= F.col("clean") * F.lit(toxic))
    return tuple(r["term"] for r in found.filter(harmless).orderBy(F.desc("clean"), "term").limit(PHRASES).collect())


def _choose(rows: list, toxic: int, clean: int) -> dict[str, float]:
    """Weights of the entries that say more than the shorter beginnings they extend."""
    out: dict[str, float] = {}
    for r in sorted(rows, key=lambda r: (len(r["term"].rstrip()), r["term"])):
        w = math.log((r["toxic"] + 0.5) / (toxic + 1)) - math.log((r["clean"] + 0.5) / (clean + 1))
        word = r["term"].rstrip()
        if w >= LEAST_WEIGHT and not any(out.get(word[:k], 0) >= w - 1 for k in range(SHORTEST + 1, len(word) + 1)):
            out[r["term"]] = w
    return out


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Model:
    """A model from the labelled rows of ``docs`` that are not held out."""
    spark = docs.sparkSession
    sample = cut(sample_of(docs, labels, bound), "toxicity-sample")
    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return Model(dict(BUILT_IN))
    n, rate = F.col("toxic") + F.col("clean"), toxic / (toxic + clean)
    part = lambda k, p: F.when(k > 0, k * F.log(k / (n * F.lit(p)))).otherwise(F.lit(0.0))
    ratio = 2 * (part(F.col("toxic"), rate) + part(F.col("clean"), 1 - rate))
    kept = _counts(sample).filter(F.col("toxic") >= SUPPORT).filter(F.col("toxic") > n * rate).withColumn("ratio", ratio).filter(F.col("ratio") >= SIGNIFICANT)
    rows = kept.orderBy(F.desc("ratio"), "term").limit(ENTRIES).collect()
    weights = _choose(rows, toxic, clean) or dict(BUILT_IN)
    model = Model(weights, (*EXCEPTIONS, *sorted(set(_phrases(sample, weights, toxic, clean)) - set(EXCEPTIONS))))
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            m = np.array([shared.value.measure_folded(t) for t in b.column(0).to_pylist()], float).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(m[:, 0]), pa.array(m[:, 1]), b.column(1)], ["total", "words", "y"])

    got = sample.mapInArrow(run, "total double, words double, y int").groupBy("total", "words", "y").agg(F.count("*").alias("n")).collect()
    got = np.array(sorted((r["total"], r["words"], r["y"], r["n"]) for r in got), float)
    ok = got[got[:, 2] == 0]
    total, words, n = ok[:, 0], ok[:, 1], ok[:, 3]
    mean = float((n * total).sum() / max(1, (n * words).sum()))
    model.clean = mean, float((n * (total - words * mean) ** 2).sum() / max(1, (n * words).sum()))
    model.beta = _logistic(model.features(got), got[:, 2], got[:, 3])
    return model


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 0.05, steps: int = 60) -> tuple[float, float, float]:
    """Logistic regression by Newton's method, rows counted n times; both slopes are held at 0 or more."""
    x = np.c_[np.ones(len(x)), x]
    beta, hold = np.zeros(3), np.array([1e-6, ridge, ridge])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (n * (y - p)) - hold * beta
        hess = (x * (n * p * (1 - p))[:, None]).T @ x + np.diag(hold)
        beta = np.clip(beta + np.clip(np.linalg.solve(hess, grad), -2, 2), [-50, 0, 0], 50)
    return tuple(float(b) for b in beta)


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """Every row with all its columns and its score (0 to 1) as ``name``, which replaces any column of that name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.withColumn(name, F.lit(0.0))
    at, to = out.columns.index(text_col), out.columns.index(name)

    def run(batches):
        m = shared.value
        for b in batches:
            columns = list(b.columns)
            measures = np.array([m.measure(t.as_py()) for t in b.column(at)], float).reshape(-1, 2)
            columns[to] = pa.array(m.scores(measures))
            yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    return out.mapInArrow(run, out.schema)


def keep_clean(docs: DataFrame, model: Model, cutoff: float = CUTOFF) -> DataFrame:
    """``docs`` without the rows that score ``cutoff`` or more; columns as they were."""
    return score(docs, model, name="__toxicity").filter(F.col("__toxicity") < cutoff).drop("__toxicity")


def op1_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels are learned where crc32(doc_id) mod 3 is not 1."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score(docs.select("doc_id", "text"), fit(docs, labels)).drop("text")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))
