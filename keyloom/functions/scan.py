"""Ordered scans: state that each row of a key changes in turn, where no window can express it, without one task a key.

A step of such a state is a map, and maps compose. So the rows of a key can be cut into ranges: what a range does to any
state is worked out where the range lies, the few maps of all ranges are composed one after another, and then each range
knows the state it begins with. Keys of few rows are dealt by hash and need none of that; both go through the same work of
numpy on a batch of rows, in which many keys follow one another.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.sources.store import written

#: A key with more rows is cut into ranges; fewer are read by one task in a second or two, in batches.
HOT_ROWS = 1 << 20
RANGE, OPEN = "__range", "__open"
_KINDS = {"bigint": np.int64, "int": np.int32, "double": np.float64, "boolean": np.bool_}


@dataclass(frozen=True)
class Scan:
    """How rows change a state.

    ``run(columns, starts, state)``: the new columns, and the state after the last row. ``columns`` are arrays of ``inputs``, ``starts``
    marks the first row of each key; rows before the first mark go on with ``state``, else it is None.
    ``states``: columns of ``inputs`` or ``out`` whose values at a row are the state after it.
    ``grow(columns, found)``: a small array of numbers, what rows of one key do to any state, after ``found`` (None at first).
    ``apply(found, state)``: the state after such rows. ``carry`` takes the place of both, where no small array can say it."""

    inputs: tuple[str, ...]
    out: str
    run: Callable[[dict[str, np.ndarray], np.ndarray, Any], tuple[dict[str, np.ndarray], Any]]
    states: tuple[str, ...]
    grow: Callable[[dict[str, np.ndarray], np.ndarray | None], np.ndarray] | None = None
    apply: Callable[[np.ndarray, tuple | None], tuple] | None = None
    carry: Callable[[DataFrame, list[dict]], dict[int, tuple | None]] | None = None


def scan(df: DataFrame, by: Scan, key: str = "key", order: str = "seq", hot_rows: int | None = None) -> DataFrame:
    """Every row with the columns of ``by.out`` added. ``key`` may be null, which is a key; ``order`` tells the rows of a key apart."""
    hot = df.groupBy(key).agg(F.count("*").alias("__n")).filter(F.col("__n") > (HOT_ROWS if hot_rows is None else hot_rows)).select(F.col(key).alias("__hot"))
    if hot.isEmpty():
        return _by_key(df, by, key, order)
    hot = written(hot, "hot-keys")
    same = F.col(key).eqNullSafe(F.col("__hot"))
    return _by_key(df.join(hot, same, "left_anti"), by, key, order).unionByName(_by_ranges(df.join(hot, same, "left_semi"), by, key, order))


def _added(df: DataFrame, by: Scan, *more: T.StructField) -> tuple[list[str], T.StructType]:
    new = T._parse_datatype_string(by.out)
    kept = [f for f in df.schema if f.name not in {*new.names, *(m.name for m in more)}]
    return [f.name for f in kept], T.StructType([*kept, *new, *more])


def _columns(b: pa.RecordBatch, names: tuple[str, ...]) -> dict[str, np.ndarray]:
    out = {}
    for n in names:
        c = b.column(b.schema.get_field_index(n))
        if c.null_count:
            raise ValueError(f"{n} is null in an ordered scan")
        out[n] = c.to_numpy(zero_copy_only=False)
    return out


def _keys(b: pa.RecordBatch, key: str) -> tuple[np.ndarray, np.ndarray]:
    c = b.column(b.schema.get_field_index(key))
    none = np.array(c.is_null())
    return none, c.fill_null("" if pa.types.is_string(c.type) else 0).to_numpy(zero_copy_only=False)


def _changes(none: np.ndarray, keys: np.ndarray, last: tuple | None) -> np.ndarray:
    out = np.empty(len(keys), bool)
    out[:1] = last is None or (none[:1] != last[0]) | (keys[:1] != last[1])
    out[1:] = (none[1:] != none[:-1]) | (keys[1:] != keys[:-1])
    return out


def _made(b: pa.RecordBatch, kept: list[str], new: dict[str, np.ndarray], schema: T.StructType) -> pa.RecordBatch:
    kinds = {f.name: _KINDS[f.dataType.simpleString()] for f in schema if f.name in new}
    return pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(n)) for n in kept] + [pa.array(np.asarray(v, kinds[n])) for n, v in new.items()], kept + list(new))


def _by_key(df: DataFrame, by: Scan, key: str, order: str) -> DataFrame:
    kept, schema = _added(df, by)

    def run(batches):
        last = state = None
        for b in batches:
            if not b.num_rows:
                continue
            none, keys = _keys(b, key)
            new, state = by.run(_columns(b, by.inputs), _changes(none, keys, last), state)
            last = none[-1], keys[-1]
            yield _made(b, kept, {f: new[f] for f in schema.names if f in new}, schema)

    return df.repartition(key).sortWithinPartitions(key, order).mapInArrow(run, schema)


def _by_ranges(df: DataFrame, by: Scan, key: str, order: str) -> DataFrame:
    """Rows in ranges of (key, order). All but the rows of a range's first key are done at once; those wait for the state they begin with."""
    kept, schema = _added(df, by, T.StructField(RANGE, T.IntegerType()), T.StructField(OPEN, T.BooleanType()))
    out = [f.name for f in T._parse_datatype_string(by.out)]

    def begin(batches):
        at, first, last, state = TaskContext.get().partitionId(), None, None, None
        for b in batches:
            if not b.num_rows:
                continue
            none, keys = _keys(b, key)
            first = first or (none[0], keys[0])
            n = int(((none == first[0]) & (keys == first[1])).sum())  # they stand first
            columns = _columns(b, by.inputs)
            new = {f: np.zeros(b.num_rows, _KINDS[schema[f].dataType.simpleString()]) for f in out}
            if n < b.num_rows:
                rest, state = by.run({k: v[n:] for k, v in columns.items()}, _changes(none, keys, last)[n:], state)
                for f in out:
                    new[f][n:] = rest[f]
            last = none[-1], keys[-1]
            yield _made(b, kept, new | {RANGE: np.full(b.num_rows, at), OPEN: np.arange(b.num_rows) < n}, schema)

    placed = written(df.repartitionByRange(key, order).sortWithinPartitions(key, order).mapInArrow(begin, schema), "ranges", OPEN)
    placed = placed.select(*schema.names)
    state = F.struct(*by.states)
    edges = placed.groupBy(RANGE).agg(
        F.min(F.struct(key)).alias("first"), F.max(F.struct(key)).alias("last"), F.count_if(OPEN).alias("open"), F.max_by(F.when(~F.col(OPEN), state), F.struct(key, order)).alias("state")
    )
    ranges = [r.asDict() for r in edges.orderBy(RANGE).collect()]  # as many rows as ranges
    waiting = placed.filter(OPEN)
    begins = by.carry(waiting, ranges) if by.carry else _composed(waiting, ranges, by, order)

    def end(batches):
        now = state = None
        for b in batches:
            at = np.array(b.column(b.schema.get_field_index(RANGE)))
            for a, z in _runs(at):
                part = b.slice(a, z - a)
                starts = np.zeros(z - a, bool)
                if at[a] != now:
                    now, state = at[a], begins[int(at[a])]
                    starts[0] = state is None
                new, state = by.run(_columns(part, by.inputs), starts, state)
                yield _made(part, kept, {f: new[f] for f in out}, schema)

    whole = T.StructType([f for f in schema if f.name not in {RANGE, OPEN}])
    done = waiting.repartitionByRange(len(ranges), RANGE).sortWithinPartitions(RANGE, order).mapInArrow(end, whole)  # a task a range
    return placed.filter(~F.col(OPEN)).select(*whole.names).unionByName(done)


def _runs(at: np.ndarray) -> list[tuple[int, int]]:
    edges = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
    return [(a, z) for a, z in zip(edges, edges[1:], strict=False) if z > a]


def is_whole(r: dict) -> bool:
    """Whether a range holds one key alone."""
    return r["first"] == r["last"]


def _composed(waiting: DataFrame, ranges: list[dict], by: Scan, order: str) -> dict[int, tuple | None]:
    """The state that each range begins with: what ranges of one key alone do is worked out in these and composed here."""
    whole = [r[RANGE] for r in ranges if is_whole(r)]

    def grow(batches):
        now = found = None
        for b in batches:
            at = np.array(b.column(b.schema.get_field_index(RANGE)))
            for a, z in _runs(at):
                if at[a] != now:
                    if now is not None:
                        yield pa.RecordBatch.from_pydict({RANGE: pa.array([now], pa.int32()), "found": [found.tolist()]})
                    now, found = at[a], None
                found = by.grow(_columns(b.slice(a, z - a), by.inputs), found)
        if now is not None:
            yield pa.RecordBatch.from_pydict({RANGE: pa.array([now], pa.int32()), "found": [found.tolist()]})

    rows = waiting.join(F.broadcast(waiting.sparkSession.createDataFrame([(r,) for r in whole], f"{RANGE} int")), RANGE, "left_semi").select(RANGE, order, *(i for i in by.inputs if i != order))
    maps = {r[RANGE]: np.array(r["found"]) for r in rows.repartition(RANGE).sortWithinPartitions(RANGE, order).mapInArrow(grow, f"{RANGE} int, found array<double>").collect()}
    return carried(ranges, lambda r, state: by.apply(maps[r[RANGE]], state))


def carried(ranges: list[dict], through: Callable[[dict, tuple | None], tuple]) -> dict[int, tuple | None]:
    begins, last, state = {}, None, None
    for r in ranges:
        begins[r[RANGE]] = state if last == r["first"] else None
        state = through(r, begins[r[RANGE]]) if is_whole(r) else tuple(r["state"])
        last = r["last"]
    return begins


# --- what scans are made of, on rows in which keys follow one another


def first_of(starts: np.ndarray) -> np.ndarray:
    """For each row where its key begins; rows that go on with another batch's key begin at 0."""
    return np.maximum.accumulate(np.where(starts, np.arange(len(starts)), 0))


def sums(x: np.ndarray, starts: np.ndarray, before: float | int) -> np.ndarray:
    """Running sums within each key; those of the key that goes on begin with ``before``."""
    total = np.concatenate([np.zeros(1, x.dtype), np.cumsum(x)])
    out = total[1:] - total[first_of(starts)]
    goes_on = np.cumsum(starts) == 0
    out[goes_on] += before
    return out


def affine(m: np.ndarray, b: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the composition of s -> m s + b over its key's rows up to it, by doubling: (m, b) of the composed map."""
    m, b, first, d = m.astype(float), b.astype(float), first_of(starts), 1
    at = np.arange(len(m))
    reach = int((at - first).max()) + 1 if len(m) else 0
    while d < reach:
        i = np.flatnonzero(at - d >= first)
        b[i], m[i] = b[i] + m[i] * b[i - d], m[i] * m[i - d]
        d *= 2
    return m, b


#: So many rows of a key are averaged one after another (over all keys of a batch at once), in the order of the definition.
STEPS = 256


def averaged(alpha: np.ndarray, x: np.ndarray, starts: np.ndarray, before: float) -> np.ndarray:
    """s += alpha (x - s) over each key's rows, from 0, and from ``before`` for the key that goes on. Short keys come out to the last bit as
    one row after another gives them; what is beyond STEPS rows of a key in a batch is composed."""
    n = len(x)
    place = np.arange(n) - first_of(starts)
    order = np.argsort(place, kind="stable")
    edges = np.searchsorted(place[order], np.arange(STEPS + 1))
    s = np.zeros(n)
    for j in range(STEPS):
        i = order[edges[j] : edges[j + 1]]
        if not len(i):
            return s
        last = s[i - 1] if j else np.where(starts[i], 0.0, before)
        s[i] = last + alpha[i] * (x[i] - last)
    rest = np.flatnonzero(place >= STEPS)
    if len(rest):
        m, b = affine(1 - alpha[rest], alpha[rest] * x[rest], place[rest] == STEPS)
        s[rest] = m * s[rest - place[rest] + STEPS - 1] + b
    return s


def chained(successor: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Marks what is reached from ``entries`` by following ``successor``; len(successor) stands for none. By jumps of doubling length."""
    n = len(successor)
    jumps = [np.append(successor, n)]
    while (jumps[-1][:n] < n).any():
        jumps.append(jumps[-1][jumps[-1]])
    mark = np.zeros(n + 1, bool)
    mark[entries] = True
    for jump in reversed(jumps):
        mark[jump[np.flatnonzero(mark)]] = True
    return mark[:n]


def publications(published: np.ndarray, starts: np.ndarray, version: int, pending: int) -> tuple[np.ndarray, np.ndarray]:
    """(version_id, pending) after each row: publications so far, rows since the last one."""
    versions = sums(published.astype(np.int64), starts, version)
    at = np.arange(len(published))
    last = np.maximum.accumulate(np.where(published, at, -1))
    first = first_of(starts)
    since = np.where(last >= first, at - last, at - first + 1)
    goes_on = (np.cumsum(starts) == 0) & (last < 0)
    since[goes_on] += pending
    return versions, since
