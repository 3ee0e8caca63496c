"""Seven causal features of each event, from the key's events up to and including it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from keyloom.functions.columns import FEATURES, NS, WEIGHTS, dot, finite, logistic
from keyloom.functions.scan import Scan, affine, averaged, scan, sums
from keyloom.sources.events import LogisticModel

ALPHA = 0.1


def w_key() -> WindowSpec:
    """A key's events in order."""
    return Window.partitionBy("key").orderBy("seq")


def running() -> WindowSpec:
    """A key's events up to and including each."""
    return w_key().rowsBetween(Window.unboundedPreceding, 0)


def counts(events: DataFrame) -> DataFrame:
    """Adds running pv, cart_fav, buy and n of the key."""
    some = lambda *codes: F.sum(F.when(F.col("behavior_code").isin(*codes), 1).otherwise(0)).over(running())
    return events.withColumns({"pv": some(0), "cart_fav": some(1, 2), "buy": some(3), "n": F.count("*").over(running())})


def gaps(events: DataFrame) -> DataFrame:
    """Adds ``gap_s``: seconds since the key's previous event, 0 for its first."""
    return events.withColumn("gap_s", F.coalesce((F.col("event_ts_ns") - F.lag("event_ts_ns").over(w_key())) / F.lit(float(NS)), F.lit(0.0)))


_WEIGHTS = np.array(WEIGHTS)


def _gaps(ts: np.ndarray, starts: np.ndarray, before: int | None) -> np.ndarray:
    out = np.zeros(len(ts))
    out[1:] = (ts[1:] - ts[:-1]) / float(NS)
    if before is not None:
        out[0] = (ts[0] - before) / float(NS)
    out[starts] = 0.0
    return out


def _checked(c: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    code, alpha = c["behavior_code"], c["alpha"].astype(float)
    if len(code) and not (0 <= code.min() and code.max() < len(WEIGHTS)):
        raise ValueError("a behaviour outside the domain")
    if not ((alpha > 0) & (alpha <= 1)).all():
        raise ValueError("alpha is not in (0, 1]")
    return code, alpha, c["event_ts_ns"]


def _run(c: dict[str, np.ndarray], starts: np.ndarray, state: tuple | None) -> tuple[dict[str, np.ndarray], tuple]:
    code, alpha, ts = _checked(c)
    pv, cart_fav, buy, n, before, engagement, gap = state if state is not None and not starts[0] else (0, 0, 0, 0, None, 0.0, 0.0)
    some = lambda hit, start: sums(hit.astype(np.int64), starts, start)
    gap_s = _gaps(ts, starts, before)
    out = {"pv": some(code == 0, pv), "cart_fav": some((code == 1) | (code == 2), cart_fav), "buy": some(code == 3, buy), "n": some(code >= 0, n), "gap_s": gap_s}
    for name, x, start in (("engagement_ema", _WEIGHTS[code], engagement), ("gap_ema", gap_s, gap)):
        out[name] = averaged(alpha, x, starts, start)
    after = [out[k][-1] for k in ("pv", "cart_fav", "buy", "n")]
    return out, (*after, ts[-1], out["engagement_ema"][-1], out["gap_ema"][-1])


def _grow(c: dict[str, np.ndarray], found: np.ndarray | None) -> np.ndarray:
    """Of the rows of a key: counts, time of the first and the last (seconds, nanoseconds), step and weight of the first, whose gap depends on
    what was before, and the maps of all rows after it: one factor, and what each average gains."""
    code, alpha, ts = _checked(c)
    counts = [(code == 0).sum(), ((code == 1) | (code == 2)).sum(), (code == 3).sum(), len(code)]
    none = np.zeros(len(code), bool)
    if found is None:
        first, tail = [*divmod(int(ts[0]), NS), *divmod(int(ts[-1]), NS), alpha[0], _WEIGHTS[code[0]]], 1
        found, gap_s = np.array([0, 0, 0, 0, *first, 1.0, 0.0, 0.0]), _gaps(ts, none, None)
    else:
        tail, gap_s = 0, _gaps(ts, none, int(found[6]) * NS + int(found[7]))
    found = found.copy()
    found[:4] += counts
    found[6:8] = divmod(int(ts[-1]), NS)
    if len(code) > tail:
        factor, engaged = affine(1 - alpha[tail:], (alpha * _WEIGHTS[code])[tail:], none[tail:])
        gapped = affine(1 - alpha[tail:], (alpha * gap_s)[tail:], none[tail:])[1]
        found[10:] = found[10] * factor[-1], found[11] * factor[-1] + engaged[-1], found[12] * factor[-1] + gapped[-1]
    return found


def _apply(found: np.ndarray, state: tuple | None) -> tuple:
    counts = [int(x) for x in found[:4]]
    first, last = (int(found[i]) * NS + int(found[i + 1]) for i in (4, 6))
    alpha, weight, factor, engaged, gapped = found[8:]
    if state is None:
        engagement, gap = alpha * weight, 0.0
    else:
        counts = [int(a) + b for a, b in zip(state, counts, strict=False)]
        engagement, gap = state[5] + alpha * (weight - state[5]), state[6] + alpha * ((first - state[4]) / float(NS) - state[6])
    return (*counts, last, factor * engagement + engaged, factor * gap + gapped)


#: Running counts, gaps and both averages of a key, from 0, with the step ``alpha`` of each event: s += alpha * (x - s).
AVERAGES = Scan(
    ("event_ts_ns", "behavior_code", "alpha"), "pv long, cart_fav long, buy long, n long, gap_s double, engagement_ema double, gap_ema double", _run,
    ("pv", "cart_fav", "buy", "n", "event_ts_ns", "engagement_ema", "gap_ema"), _grow, _apply,
)


def vector(events: DataFrame, alpha: Column | float = ALPHA, hot_rows: int | None = None) -> DataFrame:
    """Adds x0 .. x6. Counts, gaps and averages are one scan with one shuffle; a key of more than ``hot_rows`` events is cut into ranges.
    A step that is not in (0, 1], or a behaviour outside the domain, is an error."""
    if not isinstance(alpha, Column) and not 0 < alpha <= 1:
        raise ValueError("alpha is not in (0, 1]")
    out = scan(events.withColumn("alpha", alpha if isinstance(alpha, Column) else F.lit(float(alpha))), AVERAGES, hot_rows=hot_rows)
    xs = (F.col("engagement_ema"), F.log1p("pv"), F.log1p("cart_fav"), F.least("gap_s", F.lit(3600.0)) / 3600.0, F.col("buy") / F.col("n").cast("double"), F.log1p("buy"), F.col("gap_ema"))
    return out.withColumns(dict(zip(FEATURES, xs, strict=True))).drop("engagement_ema", "gap_ema")


def scored(features: DataFrame, model: LogisticModel) -> DataFrame:
    """Adds ``score``; fails when read where features and weights give no finite number."""
    z = finite(dot(model.bias, model.weights, [F.col(x) for x in FEATURES]), "the score of an event")
    return features.withColumn("score", logistic(z))


def kernel_weights(alphas: str = "alphas") -> Column:
    """Weight of each input in a varying exponential average: alpha_i times the product of the later (1 - alpha_j);
    the last element is what is left of the initial state. For short arrays; ``kernel_rows`` does the same over rows."""
    tail = F.struct(F.lit(1.0).alias("left"), F.array().cast("array<double>").alias("ws"))
    return F.aggregate(F.reverse(alphas), tail, lambda acc, a: F.struct((acc["left"] * (1 - a)).alias("left"), F.concat(F.array(a * acc["left"]), acc["ws"]).alias("ws")), lambda acc: F.array_append(acc["ws"], acc["left"]))


def kernel_rows(rows: DataFrame) -> DataFrame:
    """key, i, weight: ``kernel_weights`` of each key's ``alpha`` in order of seq, one row each and one for what is left of the
    initial state. Logarithms are summed backwards, and alphas of 1 counted, so that no key's rows meet in an array."""
    one = F.col("alpha") >= 1
    logs, ones = F.sum(F.when(~one, F.log1p(-F.col("alpha")))), F.count_if(one)
    later = Window.partitionBy("key").orderBy(F.col("seq").desc()).rowsBetween(Window.unboundedPreceding, -1)
    left = lambda logs, ones: F.when(ones > 0, 0.0).otherwise(F.exp(F.coalesce(logs, F.lit(0.0))))
    each = rows.select("key", (F.row_number().over(w_key()) - 1).alias("i"), (F.col("alpha") * left(logs.over(later), ones.over(later))).alias("weight"))
    return each.unionByName(rows.groupBy("key").agg(F.count("*").cast("int").alias("i"), left(logs, ones).alias("weight")))
