"""Sources of events, models, cohorts, predictions and telemetry. Schemas are fixed, never inferred."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.functions.columns import NS, behaviour_code, digits_only
from keyloom.functions.running import first

# Columns of the files and names of the telemetry, in their order.
RAW = T.StructType([T.StructField(n, T.StringType()) for n in ("user_id", "item_id", "category_id", "behavior", "timestamp_s")])
EVENT = "seq long, event_ts_ns long, key long, item_id long, category_id long, behavior_code int"
QUERY = "query_id long, key long, query_ts_ns long"
COHORT = "seq long, user_id long, event_ts_ns long, split string, group_id string, label int, censored int"
TELEMETRY = "summary struct<events_processed:long,writes_emitted:long,events_absorbed:long,queries_offered:long,queries_answered:long>, queries array<struct<query_id:string,query_ts_ns:long,feature_ts_ns:long,latency_ms:double>>"
# Event types of the table and the behaviours they stand for; any other type is out of the domain.
BEHAVIOURS = {"view": "pv", "click": "cart", "signup": "fav", "purchase": "buy"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of the events table in the terms of the model; ``behavior`` is null outside the domain."""
    name = F.create_map(*[F.lit(x) for kv in BEHAVIOURS.items() for x in kv])
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("event_ts_ns"), F.col("user_id").alias("key"),
        F.get_json_object("props", "$.k").cast("long").alias("item_id"), F.floor("value").cast("long").alias("category_id"), F.try_element_at(name, F.col("event_type")).alias("behavior"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the domain, in the canonical schema."""
    found = raw_events(spark, sf_dir).filter("behavior is not null")
    return found.select("seq", "event_ts_ns", "key", "item_id", "category_id", behaviour_code(F.col("behavior")).alias("behavior_code"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point queries: the rows outside the domain ask for their key at their time; one in ten asks for a key no one has."""
    found = raw_events(spark, sf_dir).filter("behavior is null")
    return found.select(F.col("seq").alias("query_id"), F.when(F.col("seq") % 10 == 0, F.col("key") + 1_000_000_000).otherwise(F.col("key")).alias("key"), F.col("event_ts_ns").alias("query_ts_ns"))


def placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, file, block, line: the lines of text files, and where each stands: a file is read in splits that begin at ``block``, and
    ``line`` rises within a split, so that (file, block, line) is the order of arrival however the files are cut."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))


def read_events_csv(spark: SparkSession, path: str, ordered: bool = True) -> DataFrame:
    """Canonical event file: the header must match, every value must parse and be in its domain (a behaviour from 0 to 3, nothing negative).
    Unless ``ordered`` is false, numbers must rise strictly and times must not fall from line to line, as they arrive, which is
    checked over all files before this returns; files follow one another by name."""
    rows = spark.read.schema(EVENT).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").option("quote", "").csv(path)
    sound = F.coalesce(F.col("behavior_code").between(0, 3), F.lit(False))
    for name in ("seq", "event_ts_ns", "key", "item_id", "category_id"):
        sound = sound & F.coalesce(F.col(name) >= 0, F.lit(False))
    if ordered and (wrong := {k: v for k, v in arrival_faults(rows).first().asDict().items() if v}):
        raise ValueError(f"events arrive out of order: {wrong}")
    return rows.withColumn("seq", F.when(sound, F.col("seq")).otherwise(F.raise_error(F.lit("an event outside its domain")).cast("long")))


def arrival_faults(rows: DataFrame) -> DataFrame:
    """One row: pairs of successive lines of the files ``rows`` are read from whose seq does not rise, and whose time falls. Nothing is sorted
    by what is under test: lines are compared where they lie, split by split, and splits by their first and last lines."""
    placed = rows.select("seq", "event_ts_ns", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))

    def told(at: list, first: tuple, last: tuple, still: int, back: int) -> pa.RecordBatch:
        values = [*at, *first, *last, still, back]
        return pa.RecordBatch.from_arrays([pa.array([v], pa.string() if i == 0 else pa.int64()) for i, v in enumerate(values)], names)

    names = ["file", "block", "first_seq", "first_ns", "last_seq", "last_ns", "still", "back"]

    def run(batches):
        now, first, last, still, back = None, None, None, 0, 0
        for b in batches:
            files, blocks = b.column(2).dictionary_encode(), b.column(3).to_numpy()
            code = files.indices.to_numpy()
            seq, ns = (b.column(i).fill_null(-1).to_numpy() for i in (0, 1))
            edges = [0, *(np.flatnonzero((code[1:] != code[:-1]) | (blocks[1:] != blocks[:-1])) + 1).tolist(), b.num_rows]
            for x, z in zip(edges, edges[1:], strict=False):
                if z == x:
                    continue
                at = [files.dictionary[int(code[x])].as_py(), int(blocks[x])]
                if at != now:
                    if now is not None:
                        yield told(now, first, last, still, back)
                    now, first, last, still, back = at, (int(seq[x]), int(ns[x])), None, 0, 0
                if last is not None:
                    still, back = still + int(seq[x] <= last[0]), back + int(ns[x] < last[1])
                still, back = still + int((seq[x + 1 : z] <= seq[x : z - 1]).sum()), back + int((ns[x + 1 : z] < ns[x : z - 1]).sum())
                last = int(seq[z - 1]), int(ns[z - 1])
        if now is not None:
            yield told(now, first, last, still, back)

    splits = placed.mapInArrow(run, "file string, block long, first_seq long, first_ns long, last_seq long, last_ns long, still long, back long")
    before = Window.orderBy("file", "block")  # as many rows as splits
    splits = splits.withColumns({"still": F.col("still") + F.coalesce((F.col("first_seq") <= F.lag("last_seq").over(before)).cast("int"), F.lit(0)), "back": F.col("back") + F.coalesce((F.col("first_ns") < F.lag("last_ns").over(before)).cast("int"), F.lit(0))})
    return splits.agg(F.coalesce(F.sum("still"), F.lit(0)).alias("seq_does_not_rise"), F.coalesce(F.sum("back"), F.lit(0)).alias("time_falls"))


def read_events_by_name(spark: SparkSession, path: str, columns: str = EVENT) -> DataFrame:
    """Columns of an event or label file by name, in any order; a row without a number where one belongs is passed over."""
    rows = spark.read.option("header", True).csv(path)
    return rows.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in T._parse_datatype_string(columns)]).dropna()


def read_table_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A strict table of strings: the header is exactly ``columns``, every row has as many values, all ASCII, none blank or quoted. What
    is not fails the job when it is read."""
    lines = placed_lines(spark, path)
    heads = lines.filter("block = 0").groupBy("file").agg(F.min_by("value", "line").alias("head"), F.min("line").alias("head_line"))  # one row a file
    found = heads.agg(F.count("*").alias("n"), F.count_if(F.col("head") != ",".join(columns)).alias("other")).first()
    if not found["n"] or found["other"]:
        raise ValueError(f"the header is not {columns}")
    # Only a file's first line is its header; a later one of the same words is a row.
    rows = lines.join(F.broadcast(heads.select("file", "head_line")), "file").filter("block > 0 or line > head_line")
    cells = rows.select(F.split("value", ",", -1).alias("c"), "value")
    good = (F.size("c") == len(columns)) & F.col("value").rlike("^[\\x20-\\x7e]*$") & ~F.col("value").contains('"') & ~F.exists("c", lambda x: F.trim(x) == "")
    c = F.when(good, F.col("c")).otherwise(F.raise_error(F.lit("malformed table row")).cast("array<string>"))
    return cells.select(c.alias("c")).select(*[F.col("c")[i].alias(n) for i, n in enumerate(columns)])


def read_raw_csv(spark: SparkSession, path: str, max_rows: int | None = None, placed: bool = False) -> DataFrame:
    """Raw behaviour file without a header. A row of wrong width, with an empty or negative or non-numeric field or an
    unknown behaviour fails the job. With ``max_rows`` only the first so many lines, in order of arrival, are read; ``placed`` adds
    where each stood (file, block, line)."""
    place = ["file", "block", "line"] if placed else []
    found = placed_lines(spark, path) if placed or max_rows is not None else spark.read.text(path)
    if max_rows is not None:
        found = first(found, ["file", "block", "line"], max_rows)
    rows = found.select(F.split("value", ",", -1).alias("c"), *place)
    bad = F.lit("malformed raw event row")
    names = [f.name for f in RAW]
    out = rows.select(F.when(F.size("c") == 5, F.col("c")).otherwise(F.raise_error(bad).cast("array<string>")).alias("c"), *place).select(*[F.col("c")[i].alias(n) for i, n in enumerate(names)], *place)
    number = lambda n: F.coalesce(digits_only(F.col(n)), F.when(F.col(n).rlike("^-[0-9]+$") & F.lit(n == "timestamp_s"), F.col(n).try_cast("bigint")), F.raise_error(bad).cast("long")).alias(n)
    code = F.coalesce(behaviour_code(F.col("behavior")), F.raise_error(bad).cast("int"))
    return out.select(*[number(n) for n in ("user_id", "item_id", "category_id")], F.when(code.isNotNull(), F.col("behavior")).alias("behavior"), number("timestamp_s"), *place)


def read_queries_csv(spark: SparkSession, path: str) -> DataFrame:
    """Query file by column name, in any order of columns; rows without all three values are passed over."""
    rows = spark.read.option("header", True).csv(path)
    return rows.select(*[digits_only(F.col(c)).alias(c) for c in ("query_id", "key", "query_ts_ns")]).dropna()


def read_cohort_csv(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Cohort file by column name, optionally one split; blank labels are null. For a cohort to evaluate on see ``evaluation_cohort``."""
    found = spark.read.option("header", True).csv(path)
    out = found.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in T._parse_datatype_string(COHORT)])
    return out if split is None else out.filter(F.col("split") == split)


class BadCohort(ValueError):
    """What is wrong with a cohort, and how often."""


def evaluation_cohort(spark: SparkSession, path: str, split: str | None = "validation") -> DataFrame:
    """The uncensored rows of a cohort file's split. Raises on a missing column, a value that does not parse, a label other than 0 and 1,
    a blank group, a number that is there twice, and a split without rows. One pass counts all of them."""
    found = spark.read.option("header", True).csv(path)
    schema = T._parse_datatype_string(COHORT)
    if missing := [f.name for f in schema if f.name not in found.columns]:
        raise BadCohort(f"missing columns: {missing}")
    rows = found if split is None else found.filter(F.col("split") == split)
    cast = {f.name: F.col(f.name).try_cast("double" if f.name == "label" else f.dataType) for f in schema}
    rows = rows.select(*[c.alias(n) for n, c in cast.items()]).filter(F.col("censored").isNull() | (F.col("censored") != 1))
    malformed = F.greatest(*[F.col(n).isNull().cast("int") for n in ("seq", "user_id", "event_ts_ns", "censored", "label")]) == 1
    per = rows.groupBy("seq").agg(F.count("*").alias("n"), F.count_if(malformed).alias("malformed"), F.count_if(~F.col("label").isin(0.0, 1.0)).alias("labels"), F.count_if(F.trim(F.coalesce("group_id", F.lit(""))) == "").alias("groups"))
    total = per.agg(F.sum("n").alias("rows"), F.sum("malformed").alias("malformed"), F.sum("labels").alias("bad labels"), F.sum("groups").alias("blank groups"), F.sum(F.when(F.col("seq").isNotNull(), F.col("n") - 1)).alias("duplicates")).first().asDict()
    if not total.pop("rows"):
        raise BadCohort(f"no rows of split {split!r}")
    if wrong := {k: v for k, v in total.items() if v}:
        raise BadCohort(str(wrong))
    return rows.withColumn("label", F.col("label").cast("int"))


def window_events(rows: DataFrame, first_s: int, last_s: int, test_start_s: int, n: int, cohort: DataFrame | None = None, split: str = "validation") -> DataFrame:
    """The first n events (by seq) of a window of time, none of them at or after the start of the test; with ``cohort`` only those of its
    split. Raises where there are none. What is short of n is for ``workload.cyclic`` to repeat."""
    t = F.expr(f"event_ts_ns div {NS}")
    found = rows.filter(t.between(first_s, last_s) & (t < test_start_s))
    if cohort is not None:
        found = found.join(cohort.filter(F.col("split") == split).select("seq"), "seq", "left_semi")
    found = first(found, ["seq"], n)
    if found.isEmpty():
        raise ValueError("no events in the window")
    return found


def with_default_score(cohort: DataFrame, scores: DataFrame, default: float = 0.1225) -> DataFrame:
    """Every row of the cohort with its score (by seq), or the default where the engine gave none."""
    return cohort.join(scores.select("seq", "score"), "seq", "left").withColumn("score", F.coalesce("score", F.lit(default)))


def read_predictions(spark: SparkSession, paths: list[str]) -> DataFrame:
    """sample_id, score and label (null where a file has none) of several prediction files, one row each; see ``mean_scores``."""
    return spark.read.option("header", True).schema("sample_id string, score double, label int").csv(paths)


def mean_scores(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("sample_id").agg(F.avg("score").alias("score"), F.count("*").alias("n_runs"))


def read_telemetry(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(one-row summary, queries) of nested telemetry files."""
    found = spark.read.schema(TELEMETRY).json(path, multiLine=True)
    return found.select("summary.*"), found.select(F.explode("queries").alias("q")).select("q.*")


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256, kind, lines (ends of lines; null for files that are not text) and header (of a CSV) of every file below a
    folder. A file is one value here; for folders of large data files see Spark's readers."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    kind = F.when(F.col("path").rlike(r"\.(csv|parquet|json)$"), "data").when(F.col("path").rlike(r"\.(py|cpp|hpp|sh)$"), "code").when(F.col("path").rlike(r"\.(md|txt|pdf)$"), "text").otherwise("other")
    text = F.when(F.col("path").rlike(r"\.(csv|json|py|cpp|hpp|sh|md|txt)$"), F.decode("content", "ISO-8859-1"))
    lines = (F.char_length(text) - F.char_length(F.replace(text, F.lit("\n")))).cast("long")
    header = F.when(F.col("path").endswith(".csv"), F.substring_index(text, "\n", 1))
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), kind.alias("kind"), lines.alias("lines"), header.alias("header"))


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """path and what happened to it (added, removed, changed) between two inventories; no rows if nothing did."""
    a, b = before.select("path", F.col("sha256").alias("a")), after.select("path", F.col("sha256").alias("b"))
    what = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, "path", "full_outer").select("path", what.alias("what")).filter("what is not null")


@dataclass(frozen=True)
class LogisticModel:
    """bias and seven weights. The text form has a schema line and each value once, with 17 significant digits."""

    bias: float
    weights: tuple[float, ...]

    SCHEMA = "keyloom.features.v1"

    @staticmethod
    def load(path: str) -> LogisticModel:
        lines = Path(path).read_text().splitlines()
        if not lines or lines[0] != f"schema={LogisticModel.SCHEMA}":
            raise ValueError("unknown model schema")
        found: dict[str, float] = {}
        for line in lines[1:]:
            name, eq, value = line.partition("=")
            number = float(value) if eq and value == value.strip() and "_" not in value else math.nan
            if name in found or name not in ("bias", *(f"w{i}" for i in range(7))) or not math.isfinite(number):
                raise ValueError(f"bad model line: {line!r}")
            found[name] = number
        if len(found) != 8:
            raise ValueError("incomplete model")
        return LogisticModel(found["bias"], tuple(found[f"w{i}"] for i in range(7)))

    def save(self, path: str) -> None:
        rows = [f"schema={self.SCHEMA}", f"bias={self.bias:.17g}", *(f"w{i}={w:.17g}" for i, w in enumerate(self.weights))]
        Path(path).write_text("\n".join(rows) + "\n")


def unique_json(text: str) -> dict:
    """JSON in which a repeated key or a number that is not finite is an error."""

    def pairs(items):
        if len({k for k, _ in items}) != len(items):
            raise ValueError("repeated key")
        return dict(items)

    def constant(name):
        raise ValueError(f"not finite: {name}")

    return json.loads(text, object_pairs_hook=pairs, parse_constant=constant)
