"""The newest published version of each key, kept between runs in a folder of versions that are committed one after another.

A commit writes one part: for each key with new publications its newest one, numbered after the version the key had. Then it
publishes a manifest, which names all parts that count; manifests are numbered, and the number is taken by a rename that
fails where another writer was first. That writer's manifest is then read, and the commit is worked out anew on top of it:
nothing is lost and no version number is given twice. What no manifest names is not part of the store.

Parts are bucketed by key. A lookup deals its queries by key once and meets each part where it lies, so the store is never
shuffled, and compaction bounds the number of parts.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions.columns import FEATURES

COLUMNS = ("key", "version_id", "latest_included_seq", "latest_event_ts_ns", *FEATURES)
SCHEMA = "key long, version_id long, latest_included_seq long, latest_event_ts_ns long, " + ", ".join(f"{x} double" for x in FEATURES)
#: More parts than this are compacted by the next commit.
MOST_PARTS = 8


class KeyBudget(ValueError):
    """A commit would bring in more keys than the store may have; nothing of it is kept."""


@dataclass(frozen=True)
class Manifest:
    """What counts: the parts in order, the number of keys, and of publications ever made."""

    number: int = 0
    parts: tuple[str, ...] = ()
    size: int = 0
    total_publications: int = 0


@dataclass
class VersionStore:
    """``path``: a folder that all executors share. ``max_keys``: the budget of keys, if there is one."""

    spark: SparkSession
    path: str
    buckets: int = 64
    max_keys: int | None = None
    conflicts: int = field(default=0, init=False)  # how often another writer was first

    # --- manifests

    def _file(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path.rstrip('/')}/{name}")
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def snapshot(self) -> Manifest:
        """The last manifest; an empty one where nothing has been committed."""
        folder, fs = self._file("manifests")
        if not fs.exists(folder):
            return Manifest()
        names = [f.getPath().getName() for f in fs.listStatus(folder)]
        last = max((n for n in names if n.isdigit()), key=int, default=None)
        if last is None:
            return Manifest()
        at, fs = self._file(f"manifests/{last}")
        stream = fs.open(at)
        try:
            told = json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()
        return Manifest(told["number"], tuple(told["parts"]), told["size"], told["total_publications"])

    def _publish(self, new: Manifest) -> bool:
        """Takes the manifest's number; false where it is taken."""
        pending, fs = self._file(f"manifests/.{new.number}-{uuid.uuid4().hex}")
        stream = fs.create(pending, False)
        stream.write(bytearray(json.dumps({"number": new.number, "parts": list(new.parts), "size": new.size, "total_publications": new.total_publications}).encode()))
        stream.close()
        to, _ = self._file(f"manifests/{new.number:08d}")
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        never_over = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
        try:
            hadoop.FileContext.getFileContext(to.toUri(), self.spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(pending), fs.makeQualified(to), never_over)
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise
            fs.delete(pending, False)
            self.conflicts += 1
            return False
        return True

    # --- parts

    def _read(self, part: str) -> DataFrame:
        """A part with its buckets: a table of this session for as long as it takes to read its plan."""
        name = f"part_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} ({SCHEMA}) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {self.buckets} BUCKETS LOCATION '{self.path.rstrip('/')}/{part}'")
        try:
            return self.spark.table(name)
        finally:
            self._forget(name)

    def _forget(self, name: str) -> None:
        try:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")  # its files are not the table's own and stay
        except AnalysisException:
            pass

    def _write(self, rows: DataFrame) -> str:
        part, name = f"parts/{uuid.uuid4().hex}", f"part_{uuid.uuid4().hex}"
        dealt = rows.select(*COLUMNS).repartition(self.buckets, "key")  # one file a bucket
        dealt.write.bucketBy(self.buckets, "key").sortBy("key").option("path", f"{self.path.rstrip('/')}/{part}").saveAsTable(name)
        self._forget(name)
        return part

    def _drop(self, part: str) -> None:
        at, fs = self._file(part)
        fs.delete(at, True)

    def _met(self, rows: DataFrame, now: Manifest) -> DataFrame:
        """``rows``, which have a key, with ``__has``: the key's newest version, or null. Each part has a key once, later ones newer versions."""
        rows = rows.withColumn("__has", F.lit(None).cast(f"struct<{SCHEMA.replace(' ', ':').replace(',:', ',')}>"))
        if now.parts:
            rows = rows.repartition(self.buckets, "key")
        for part in now.parts:
            found = self._read(part).select(F.col("key").alias("__key"), F.struct(*COLUMNS).alias("__newer"))
            rows = rows.join(found.hint("merge"), F.col("key") == F.col("__key"), "left").withColumn("__has", F.coalesce("__newer", "__has")).drop("__key", "__newer")
        return rows

    # --- what users do

    def commit(self, published: DataFrame) -> Manifest:
        """Adds publications (key, seq, event_ts_ns and the features; a key's are in order of seq): a key's version grows by as many as it has.
        Raises KeyBudget, and keeps nothing, where that is more keys than allowed."""
        new = published.groupBy("key").agg(F.count("*").alias("__n"), F.max_by(F.struct(F.col("seq").alias("latest_included_seq"), F.col("event_ts_ns").alias("latest_event_ts_ns"), *FEATURES), "seq").alias("v"))
        while True:
            now = self.snapshot()
            if len(now.parts) > MOST_PARTS:
                self.compact()
                continue
            grown = self._met(new, now).select("key", (F.coalesce("__has.version_id", F.lit(0)) + F.col("__n")).alias("version_id"), "v.*")
            part = self._write(grown)
            before = self._met(new.select("key", "__n"), now)
            n, keys = before.agg(F.coalesce(F.sum("__n"), F.lit(0)), F.count_if(F.col("__has").isNull())).first()
            if self.max_keys is not None and now.size + keys > self.max_keys:
                self._drop(part)
                raise KeyBudget(f"{now.size + keys} keys, {self.max_keys} at most")
            made = Manifest(now.number + 1, (*now.parts, part), now.size + keys, now.total_publications + n)
            if n and self._publish(made):
                return made
            self._drop(part)
            if not n:
                return now

    def latest(self, at: Manifest | None = None) -> DataFrame:
        """The newest version of each key."""
        now = at or self.snapshot()
        if not now.parts:
            return self.spark.createDataFrame([], SCHEMA)
        # As plain files: a union of bucketed scans passes for dealt by key where it is not.
        rows = self.spark.read.schema(SCHEMA).parquet(*[f"{self.path.rstrip('/')}/{part}" for part in now.parts])
        return rows.groupBy("key").agg(F.max_by(F.struct(*COLUMNS[1:]), "version_id").alias("v")).select("key", "v.*")

    def lookup(self, queries: DataFrame) -> DataFrame:
        """``queries``, which have a key, with the newest version of each one's key, and ``cold_start`` where there is none."""
        met = self._met(queries, self.snapshot())
        return met.select(*queries.columns, F.col("__has").isNull().alias("cold_start"), *[F.col(f"__has.{c}").alias(c) for c in COLUMNS[1:]])

    def compact(self) -> Manifest:
        """The same versions in one part."""
        while True:
            now = self.snapshot()
            if len(now.parts) < 2:
                return now
            made = Manifest(now.number + 1, (self._write(self.latest(now)),), now.size, now.total_publications)
            if self._publish(made):
                return made

    def clear(self) -> Manifest:
        """No keys and no publications; what readers have begun to read stays where it is."""
        while True:
            made = Manifest(self.snapshot().number + 1)
            if self._publish(made):
                return made
