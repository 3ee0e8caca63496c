"""Greedy publications as chains: each event has one next publication if it is one itself, so what is published is what can be
reached from a key's first publication. Jumps of doubling length find that without a loop over events."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.scan import RANGE, Scan, carried, chained, is_whole, publications
from keyloom.sources.store import written

OUT = "published boolean, version_id long, pending long"
#: Times and thresholds beyond this are not told apart.
FAR = 1 << 62


# --- every so many events, by a cadence of each event


def adaptive(low: int, high: int) -> Scan:
    """An event is published if it is the k-th since the last publication or more, k from ``low`` to ``high`` by the event's ``pressure``.
    What rows do to any state is a table: what becomes of each number of pending events, of which there are ``high`` at most."""

    def cadences(c: dict[str, np.ndarray]) -> np.ndarray:
        p = c["pressure"].astype(float)
        if np.isnan(p).any():
            raise ValueError("a pressure is not a number")
        return np.clip(low + np.trunc(np.clip(p, 0.0, 1.0) * (high - low)), low, high).astype(np.int64)

    def entry(k: np.ndarray, key: np.ndarray, at: np.ndarray, pending: np.ndarray) -> np.ndarray:
        """The first publication at ``at`` or after it with so many pending; len(k) where the key ends before."""
        n = len(k)
        out = np.full(len(at), n)
        for d in reversed(range(high)):
            there = np.minimum(at + d, n - 1)
            out = np.where((at + d < n) & (key[there] == key[at]) & (k[there] <= pending + d + 1), there, out)
        return out

    def run(c, starts, state):
        k, key = cadences(c), np.cumsum(starts)
        version, pending = state if state is not None and not starts[0] else (0, 0)
        n = len(k)
        following = np.append(entry(k, key, np.arange(1, n), np.zeros(n - 1, np.int64)), n)
        following[:-1][starts[1:]] = n  # the next event is another key's
        begins = np.flatnonzero(starts)
        at, has = (begins, np.zeros(len(begins), np.int64)) if starts[0] else (np.append(begins, 0), np.append(np.zeros(len(begins), np.int64), pending))
        published = chained(following, entry(k, key, at, has))
        versions, since = publications(published, starts, version, pending)
        return {"published": published, "version_id": versions, "pending": since}, (versions[-1], since[-1])

    def grow(c, found):
        k = cadences(c)
        n, key = len(k), np.zeros(len(k), np.int64)
        states = np.arange(high)
        jumps = [np.append(np.append(entry(k, key, np.arange(1, n), np.zeros(n - 1, np.int64)), n), n)]
        while (jumps[-1][:n] < n).any():
            jumps.append(jumps[-1][jumps[-1]])
        at = entry(k, key, np.zeros(high, np.int64), states)
        count = (at < n).astype(np.int64)
        for level in reversed(range(len(jumps))):
            there = jumps[level][at]
            count += np.where(there < n, 1 << level, 0)
            at = np.where(there < n, there, at)
        left = np.where(at < n, n - 1 - at, states + n)
        if found is None:
            return np.concatenate([left, count]).astype(float)
        before = found[:high].astype(np.int64)
        before = np.minimum(before, high - 1)  # states that cannot be
        return np.concatenate([left[before], found[high:] + count[before]])

    def apply(found, state):
        version, pending = state or (0, 0)
        return int(version + found[high + int(pending)]), int(found[int(pending)])

    return Scan(("pressure",), OUT, run, ("version_id", "pending"), grow, apply)


# --- every so much time


def elapsed(threshold: int) -> Scan:
    """The first event of a key is published, and then each one that is ``threshold`` ns or more after the last publication."""

    def run(c, starts, state):
        ts, n = c["event_ts_ns"], len(starts)
        public, version, pending = state if state is not None and not starts[0] else (None, 0, 0)
        if threshold == 0:
            published = np.ones(n, bool)
        elif ((ts[1:] < ts[:-1]) & ~starts[1:]).any():
            published = _one_by_one(ts, starts, public, threshold)
        else:
            ends = np.flatnonzero(starts)
            entries = ends if starts[0] else np.append(ends, np.searchsorted(ts[: ends[0] if len(ends) else n], min(public + threshold, FAR)) if public is not None else 0)
            if not starts[0] and len(ends) and entries[-1] == ends[0]:
                entries = ends  # the key that goes on has no further publication here
            published = chained(_following(ts, np.cumsum(starts), threshold), entries)
        versions, since = publications(published, starts, version, pending)
        last = np.maximum.accumulate(np.where(published, np.arange(n), -1))
        publics = np.where(last >= 0, ts[last], 0 if public is None else public)
        return {"published": published, "version_id": versions, "pending": since, "public_ns": publics}, (publics[-1], versions[-1], since[-1])

    return Scan(("event_ts_ns",), f"{OUT}, public_ns long", run, ("public_ns", "version_id", "pending"), carry=lambda waiting, ranges: _portals(waiting, ranges, threshold))


def _one_by_one(ts: np.ndarray, starts: np.ndarray, public: int | None, threshold: int) -> np.ndarray:
    """Where a key's time runs back."""
    out, last = np.zeros(len(ts), bool), public
    for i, (t, first) in enumerate(zip(ts.tolist(), starts.tolist(), strict=True)):
        if first or last is None or t - last >= threshold:
            out[i], last = True, t
    return out


def _following(ts: np.ndarray, key: np.ndarray, threshold: int) -> np.ndarray:
    """For each event the first one of its key that is ``threshold`` or more later; len(ts) where there is none. Times are in order."""
    n = len(ts)
    probe = np.minimum(ts, FAR - threshold) + threshold if threshold < FAR else np.full(n, FAR)
    order = np.lexsort((np.repeat((1, 0), n), np.concatenate([ts, probe]), np.concatenate([key, key])))
    event = np.where(order < n, order, n)
    after = np.minimum.accumulate(event[::-1])[::-1]  # events stand in order, so the least is the nearest
    out = np.full(n, n)
    is_probe = order >= n
    out[order[is_probe] - n] = after[is_probe]
    found = out < n
    out[found] = np.where(key[out[found]] == key[found], out[found], n)
    return out


def _portals(waiting: DataFrame, ranges: list[dict], threshold: int) -> dict[int, tuple | None]:
    """The state that each range begins with, where a range may hold one key alone. There, following publications from any event ends at an
    exit, an event whose next publication lies in a later range. Exits point to each other; the one path that starts at what is known
    before the first such range is marked by jumps of doubling length, each a join of exits."""
    whole = [r for r in ranges if is_whole(r)]
    if not whole:
        return carried(ranges, lambda r, state: state)
    spark = waiting.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(r[RANGE],) for r in whole], f"{RANGE} int"))
    rows = waiting.join(wanted, RANGE, "left_semi").select(RANGE, "seq", "event_ts_ns")
    spans = {r[RANGE]: (r["n"], r["last"]) for r in rows.groupBy(RANGE).agg(F.count("*").alias("n"), F.max("event_ts_ns").alias("last")).collect()}  # one row a range
    chains: list[list[dict]] = []
    for r, before in zip(ranges, [None, *ranges], strict=False):
        if is_whole(r):
            if chains and before is not None and chains[-1][-1] is before and before["last"] == r["first"]:
                chains[-1].append(r)
            else:
                chains.append([r])
    of = {r[RANGE]: (i, k) for i, chain in enumerate(chains) for k, r in enumerate(chain)}
    lasts = [np.array([spans[r[RANGE]][1] for r in chain]) for chain in chains]
    names = [np.array([r[RANGE] for r in chain]) for chain in chains]

    def target(i: int, after: int, at: np.ndarray) -> np.ndarray:
        """Ranges of chain i, from its ``after``-th on, that hold the first event at ``at`` or later; -1 where none does."""
        k = np.maximum(np.searchsorted(lasts[i], at), after)
        return np.where(k < len(lasts[i]), names[i][np.minimum(k, len(lasts[i]) - 1)], -1)

    def exits(batches):
        held: dict[int, list[np.ndarray]] = {}

        def done(r: int) -> pa.RecordBatch:
            ts = np.concatenate(held.pop(r))
            if (ts[1:] < ts[:-1]).any():
                raise ValueError("the time of a key that is cut into ranges runs back")
            n, at = len(ts), np.arange(len(ts))
            to = np.maximum(np.searchsorted(ts, ts + threshold), at + 1)  # without a threshold the next one follows, equal or not
            moves = (to < n).astype(np.int64)
            to = np.where(to < n, to, at)
            while (to[to] != to).any():
                moves, to = moves + moves[to], to[to]
            i, k = of[r]
            goes = np.where(to == at, target(i, k + 1, ts + threshold), -1)
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, r), pa.int32()), pa.array(at), pa.array(ts), pa.array(to), pa.array(ts[to]), pa.array(moves + 1), pa.array(goes.astype(np.int32))], ["r", "p", "at", "exit_p", "exit_at", "n", "goes"])

        for b in batches:
            for r, t in _split(b):
                for other in [x for x in held if x != r]:
                    yield done(other)
                held.setdefault(r, []).append(t)
        for r in list(held):
            yield done(r)

    events = written(rows.repartition(RANGE).sortWithinPartitions(RANGE, "seq").mapInArrow(exits, "r int, p long, at long, exit_p long, exit_at long, n long, goes int"), "exits")
    # what is known before each chain: the state that the range before it ends with, or that the key is new
    sources = []
    for i, chain in enumerate(chains):
        place = ranges.index(chain[0])
        before = ranges[place - 1] if place and ranges[place - 1]["last"] == chain[0]["first"] else None
        if before is None:
            sources.append((-1 - i, 0, chain[0][RANGE], -FAR))
        else:
            at = min(before["state"]["public_ns"] + threshold, FAR)
            sources.append((-1 - i, 0, int(target(i, 0, np.array([at]))[0]), at))
    probes = events.filter("goes >= 0").select(F.col("r").alias("from_r"), F.col("p").alias("from_p"), F.col("goes").alias("r"), (F.col("at") + threshold).alias("at"))
    probes = probes.unionByName(spark.createDataFrame([s for s in sources if s[2] >= 0], "from_r int, from_p long, r int, at long"))
    both = events.select("r", "at", F.lit(1).alias("kind"), "p", F.struct("exit_p", "exit_at", "n").alias("exit")).unionByName(probes.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    backwards = Window.partitionBy("r").orderBy(F.col("at").desc(), F.col("kind").desc(), F.col("p").desc()).rowsBetween(Window.unboundedPreceding, 0)
    links = both.withColumn("exit", F.last("exit", True).over(backwards)).filter("kind = 0 and exit is not null").select("from_r", "from_p", "r", F.col("exit.exit_p").alias("p"), F.col("exit.exit_at").alias("at"), F.col("exit.n").alias("n"))
    links = written(links, "links")
    jumps, longest = [links.select("from_r", "from_p", "r", "p")], max(map(len, chains))
    while 1 << len(jumps) <= longest:
        a, b = jumps[-1], jumps[-1].select(F.col("from_r").alias("r"), F.col("from_p").alias("p"), F.col("r").alias("to_r"), F.col("p").alias("to_p"))
        jumps.append(written(a.join(b, ["r", "p"]).select("from_r", "from_p", F.col("to_r").alias("r"), F.col("to_p").alias("p")), "jumps"))
    seen = spark.createDataFrame([(s[0], s[1]) for s in sources], "from_r int, from_p long")
    for jump in reversed(jumps):
        seen = written(seen.unionByName(seen.join(jump, ["from_r", "from_p"]).select(F.col("r").alias("from_r"), F.col("p").alias("from_p"))), "seen")  # one a range at most
    path = {r["r"]: r for r in links.join(F.broadcast(seen), ["from_r", "from_p"], "left_semi").collect()}  # one a range at most

    def through(r: dict, state: tuple | None) -> tuple:
        public, version, pending = state or (None, 0, 0)
        n, step = spans[r[RANGE]][0], path.get(r[RANGE])
        return (public, version, pending + n) if step is None else (step["at"], version + step["n"], n - step["p"] - 1)

    return carried(ranges, through)


def _split(b: pa.RecordBatch) -> list[tuple[int, np.ndarray]]:
    at, ts = np.array(b.column(0)), np.array(b.column(2))
    edges = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
    return [(int(at[a]), ts[a:z]) for a, z in zip(edges, edges[1:], strict=False) if z > a]
