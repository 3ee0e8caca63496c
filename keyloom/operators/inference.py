"""Paired inference by permutation and bootstrap, between and within clusters.

Draws are distributed. For metrics that are sums over rows (Brier score, log loss, accuracy) or follow from sums (F1), a draw reads
the clusters' sums; for ranking metrics all draws are worked out range by range of the scores (ranked_draws.py). Clusters are few by
design (hours, days): their sums are gathered, MOST_CLUSTERS at most, and more than that is an error.
"""

from __future__ import annotations

import hashlib
import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.columns import log_loss
from keyloom.operators.ranked_draws import BLOCK, cells, differences

#: Up to so many clusters all sign patterns or swaps are enumerated.
EXACT, EXACT_SWAPS = 16, 12
MOST_CLUSTERS = 100_000
LOSSES = ("brier", "log_loss")
METRICS = ("auroc", "average_precision", "accuracy", "f1", *LOSSES)


def gathered(clusters: DataFrame, order: str = "group_id") -> list:
    """The rows of a table of clusters, in order; too many are an error and not a slow driver."""
    rows = clusters.orderBy(order).take(MOST_CLUSTERS + 1)
    if len(rows) > MOST_CLUSTERS:
        raise ValueError(f"more than {MOST_CLUSTERS} clusters")
    return rows


def group_sums(pairs: DataFrame, group: str = "group_id", difference: str = "d") -> DataFrame:
    """One row per cluster: sum and number of differences."""
    return pairs.groupBy(F.col(group).alias("group_id")).agg(F.sum(difference).alias("d_sum"), F.count("*").alias("n"))


def least_extreme(observed: float) -> float:
    """What counts as being as far out as ``observed``, but for rounding."""
    return abs(observed) - max(8 * math.ulp(abs(observed)), 1e-12 * abs(observed))


def signs(ids: np.ndarray, n: int, exact: bool, seed: int) -> np.ndarray:
    """A row of n zeros and ones for each id: the bits of the id, or seeded ones."""
    if exact:
        return (ids[:, None] >> np.arange(n)) & 1
    return np.array([np.random.default_rng([seed, int(i)]).integers(0, 2, n) for i in ids]).reshape(-1, n)


def sign_flip(sums: DataFrame, draws: int = 4096, seed: int = 7) -> DataFrame:
    """One row: n clusters, mean of the cluster means, two-sided p-value of sign flips, and whether it is exact.

    Exact: all 2^n patterns as a range of numbers; each pattern's mean is a sum over bits. Otherwise ``draws`` seeded ones,
    counted with one added."""
    spark = sums.sparkSession
    d = np.array([r["d_sum"] / r["n"] for r in gathered(sums.filter("n > 0"))])
    n = len(d)
    if n < 2:
        raise ValueError("at least two clusters")
    exact, edge = n <= EXACT, least_extreme(float(d.mean()))
    total = 2**n if exact else draws

    def run(batches):
        for b in batches:
            flips = 1 - 2 * signs(b.column(0).to_numpy(), n, exact, seed)
            yield pa.RecordBatch.from_arrays([pa.array((np.abs(flips @ d / n) >= edge).astype(np.int64))], ["hit"])

    hits = spark.range(total).mapInArrow(run, "hit long").agg(F.sum("hit").alias("hits"))
    p = F.col("hits") / F.lit(float(total)) if exact else (F.col("hits") + 1) / F.lit(float(total + 1))
    return hits.select(F.lit(n).alias("n_clusters"), F.lit(float(d.mean())).alias("mean_difference"), p.alias("p_value"), F.lit(exact).alias("exact"))


def row_sign_flip(rows: DataFrame, d: str, order: str, draws: int = 2000, seed: int = 7) -> float:
    """The same p-value where every row is a unit, however many rows: partitions add up their flipped sums, and one row of ``draws`` sums
    for each is added. A row's signs are the bits of SHA-256 of "seed:number:block", 256 draws a block, where ``order`` is its number:
    they are the same however rows are dealt, and in any language."""
    blocks = -(-draws // 256)

    def run(batches):
        total, observed, n = np.zeros(blocks * 256), 0.0, 0
        for b in batches:
            x, ids = b.column(0).to_numpy(), b.column(1).to_pylist()
            for k in range(0, len(x), 2048):
                part = ids[k : k + 2048]
                held = b"".join(hashlib.sha256(f"{seed}:{i}:{j}".encode()).digest() for i in part for j in range(blocks))
                flips = np.unpackbits(np.frombuffer(held, np.uint8).reshape(len(part), -1), axis=1).astype(np.float64) * 2 - 1
                total += x[k : k + 2048] @ flips
            observed, n = observed + float(x.sum()), n + len(x)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()]), pa.array([observed]), pa.array([n])], ["sums", "observed", "n"])

    found = rows.select(F.col(d).cast("double"), F.col(order).cast("long")).mapInArrow(run, "sums array<double>, observed double, n long")
    added = found.select(F.posexplode("sums").alias("draw", "v"), "observed").groupBy("draw").agg(F.sum("v").alias("v"), F.sum("observed").alias("o"))
    edge = "abs(o) - greatest(abs(o) * 1e-12, 1e-300)"
    hits = added.filter(f"draw < {draws}").agg(F.count_if(F.expr(f"abs(v) >= {edge}"))).first()[0]
    return (hits + 1) / (draws + 1)


def student_interval(rows: DataFrame, d: str, level: float = 0.95, by: tuple[str, ...] = ()) -> DataFrame:
    """n, effect, low, high and dz (effect over deviation, null without any) of paired differences, Student's t."""
    one = rows.groupBy(*by).agg(F.count(d).alias("n"), F.avg(d).alias("effect"), F.stddev_samp(d).alias("sd"))

    def criticals(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([student_t_critical(1 - level, n - 1) for n in b.column(0).to_pylist()])], ["__size", "t"])

    sizes = one.filter("n >= 2").select(F.col("n").alias("__size")).distinct().mapInArrow(criticals, "__size long, t double")
    one, t = one.join(sizes, F.col("n") == F.col("__size"), "left").drop("__size"), F.col("t")
    margin = F.coalesce(t * F.col("sd") / F.sqrt("n"), F.lit(0.0))
    return one.select(*by, "n", "effect", (F.col("effect") - margin).alias("low"), (F.col("effect") + margin).alias("high"), F.when(F.col("sd") > 0, F.col("effect") / F.col("sd")).alias("dz"))


def bootstrap(sums: DataFrame, draws: int = 2000, seed: int = 11, level: float = 0.95) -> DataFrame:
    """One row: mean difference over rows and its percentile and bias-corrected accelerated intervals, clusters resampled."""
    spark = sums.sparkSession
    rows = gathered(sums)
    s, k = np.array([r["d_sum"] for r in rows], float), np.array([r["n"] for r in rows], float)
    n, mean = len(rows), s.sum() / k.sum()

    def run(batches):
        for b in batches:
            picks = np.array([np.random.default_rng([seed, int(i)]).integers(0, n, n) for i in b.column(0).to_numpy()]).reshape(-1, n)
            yield pa.RecordBatch.from_arrays([pa.array(s[picks].sum(axis=1) / k[picks].sum(axis=1))], ["mean"])

    means = np.sort(np.array([r[0] for r in spark.range(draws).mapInArrow(run, "mean double").collect()]))
    found = accelerated(means, mean, [(s.sum() - s) / (k.sum() - k)], level) or (float(means.min()), float(means.max()))
    plain = np.quantile(means, [(1 - level) / 2, (1 + level) / 2])
    return spark.createDataFrame([(n, float(mean), float(plain[0]), float(plain[1]), *found)], "n_clusters int, mean_difference double, low double, high double, bca_low double, bca_high double")


def acceleration(left_out: list[np.ndarray]) -> float:
    """A sixth of the skewness of the statistic's influence values; ``left_out`` has, for each stratum, the statistic without each of its
    clusters. 0 where no cluster matters."""
    influence = np.concatenate([(1 - 1 / len(x)) * (np.average(x) - x) for x in left_out])
    scale = np.linalg.norm(influence)
    return float(np.sum((influence / scale) ** 3)) / 6 if scale > 0 else 0.0


def accelerated(draws: np.ndarray, value: float, left_out: list[np.ndarray], level: float = 0.95) -> tuple[float, float] | None:
    """Efron's bias-corrected and accelerated interval: quantiles of the sorted bootstrap ``draws``, at shares moved by how far the median
    of the draws is off ``value`` and by the acceleration. None unless both shares exist and differ, and the draws do too."""
    n, normal = len(draws), NormalDist()
    if n == 0:
        return None
    rank = (np.searchsorted(draws, value, "left") + np.searchsorted(draws, value, "right")) / 2  # ties count half
    bias = normal.inv_cdf(min(max(float(rank), 0.5), n - 0.5) / n)
    a = acceleration(left_out)

    def moved(share: float) -> float:
        z = bias + normal.inv_cdf(share)
        return normal.cdf(bias + z / (1 - a * z)) if a * z < 1 else math.nan

    low, high = moved((1 - level) / 2), moved((1 + level) / 2)
    if not (draws[0] < draws[-1] and low < high):
        return None
    return float(np.quantile(draws, low)), float(np.quantile(draws, high))


def student_t_within(angle: float, df: int) -> float:
    """Probability that |t| stays below sqrt(df) tan(angle), for a whole number of degrees of freedom: the finite series in powers of the
    angle's cosine."""
    s, c = math.sin(angle), math.cos(angle)
    k = np.arange(2 + df % 2, df, 2, dtype=float)  # each term of the series is the last one times (k - 1) / k cos^2
    series = 1 + float(np.cumprod((k - 1) / k * c * c).sum())
    if df % 2 == 0:
        return s * series
    return 2 / math.pi * (angle + (s * c * series if df > 1 else 0.0))


def student_t_critical(alpha: float, df: int) -> float:
    """The t that leaves ``alpha`` in both tails. Beyond 100,000 degrees of freedom by its expansion around the normal quantile."""
    if df > 100_000:
        z = NormalDist().inv_cdf(1 - alpha / 2)
        return z + (z**3 + z) / (4 * df)
    low, high = 0.0, math.pi / 2
    while high - low > 1e-15:
        angle = (low + high) / 2
        if angle in (low, high):
            break
        low, high = (angle, high) if student_t_within(angle, df) < 1 - alpha else (low, angle)
    return math.sqrt(df) * math.tan(low)


def _value(metric: str, y: Column, p: Column, threshold: float) -> Column:
    if metric == "accuracy":
        return ((p >= threshold).cast("int") == y).cast("double")
    return (p - y) * (p - y) if metric == "brier" else log_loss(y, p)


class _Sums:
    """Sums of each cluster, and the difference of a metric between two models over weighted or swapped clusters."""

    def __init__(self, rows: DataFrame, metric: str, threshold: float):
        y, a, b = F.col("label"), F.col("a"), F.col("b")
        self.metric, self.sign = metric, -1.0 if metric in LOSSES else 1.0
        if metric == "f1":
            call = lambda p: (p >= threshold).cast("int")
            parts = [F.sum(call(a) * y), F.sum(call(a)), F.sum(call(b) * y), F.sum(call(b))]
        else:
            parts = [F.sum(_value(metric, y, a, threshold)), F.sum(_value(metric, y, b, threshold))]
        got = gathered(rows.groupBy("group_id").agg(F.count("*").alias("n"), F.sum("label").alias("pos"), *[x.cast("double").alias(f"m{i}") for i, x in enumerate(parts)]))
        self.n, self.pos = (np.array([r[c] for r in got], float) for c in ("n", "pos"))
        self.m = np.array([[r[f"m{i}"] for i in range(len(parts))] for r in got], float)

    def difference(self, weight: np.ndarray, swap: np.ndarray | None = None) -> np.ndarray:
        """One value for each row of ``weight`` (draws x clusters); null (nan) where a class is missing."""
        half = self.m.shape[1] // 2
        mine, other = self.m[:, :half], self.m[:, half:]
        s = np.zeros_like(weight) if swap is None else swap
        a, b = (weight * (1 - s)) @ mine + (weight * s) @ other, (weight * s) @ mine + (weight * (1 - s)) @ other
        n, pos = weight @ self.n, weight @ self.pos
        if self.metric == "f1":
            f1 = lambda x: np.where((d := x[:, 1] + pos) > 0, 2 * x[:, 0] / np.maximum(d, 1), 0.0)
            out = f1(a) - f1(b)
        else:
            with np.errstate(invalid="ignore", divide="ignore"):
                out = (a - b)[:, 0] / n
        return np.where((pos > 0) & (pos < n), self.sign * out, np.nan)


def _by_draw(spark, draws: int, sums: _Sums, n: int, weights, swaps) -> np.ndarray:
    """The difference for each draw, in order; a task goes through its draws in blocks of bounded size."""
    block = max(1, BLOCK // n)

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, block):
                ids = b.column(0).slice(k, block).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(sums.difference(weights(ids), swaps(ids)))], ["id", "v"])

    return np.array([r["v"] for r in spark.range(draws).mapInArrow(run, "id long, v double").orderBy("id").collect()], float)


def paired_groups(rows: DataFrame, metric: str, draws: int = 2000, seed: int = 13, level: float = 0.95, threshold: float = 0.5) -> DataFrame:
    """One row that compares two models by ``metric`` over rows (group_id, label, a, b): effect (positive if a is better), interval by
    stratified bootstrap of clusters, and the two-sided p-value of swapping the models within clusters (exact for few). Clusters with
    one class each are resampled within their class. Where the interval is not defined it is the metric's whole range."""
    if metric not in METRICS or not 0 < level < 1 or draws < 1:
        raise ValueError("unknown metric, or a level or number of draws out of range")
    spark, ranks = rows.sparkSession, metric in ("auroc", "average_precision")
    rows = rows.filter(F.col("label").isNotNull()).select(F.col("group_id").cast("string").alias("group_id"), F.col("label").cast("int").alias("label"), F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b"))
    bad = rows.filter(F.col("group_id").isNull() | (F.trim("group_id") == "") | ~F.col("label").isin(0, 1) | ~F.coalesce(F.col("a").between(0, 1) & F.col("b").between(0, 1), F.lit(False)))
    if not bad.isEmpty():
        raise ValueError("labels must be 0 or 1, scores between 0 and 1, and groups named")
    if ranks:
        got = gathered(rows.groupBy("group_id").agg(F.count("*").alias("n"), F.sum("label").alias("pos")))
        count, pos = np.array([r["n"] for r in got], float), np.array([r["pos"] for r in got], float)
    else:
        sums = _Sums(rows, metric, threshold)
        count, pos = sums.n, sums.pos
    n = len(count)
    if n < 2 or not 0 < pos.sum() < count.sum():
        raise ValueError("at least two clusters and both classes")
    exact = n <= EXACT_SWAPS
    pure = bool(((pos == 0) | (pos == count)).all())
    strata = [np.flatnonzero(pos == 0), np.flatnonzero(pos > 0)] if pure else [np.arange(n)]
    # One plan of draws: as observed, swapped, resampled, and each cluster left out.
    swapped_to = 1 + (2**n if exact else draws)
    resampled_to = swapped_to + draws

    def weights(ids: np.ndarray) -> np.ndarray:
        out = np.ones((len(ids), n))
        for row, i in zip(out, ids.tolist(), strict=True):
            if i >= resampled_to:
                row[i - resampled_to] = 0
            elif i >= swapped_to:
                r = np.random.default_rng([seed, 1, i - swapped_to])
                row[:] = 0
                for s in strata:
                    np.add.at(row, r.choice(s, len(s)), 1)
        return out

    def swaps(ids: np.ndarray) -> np.ndarray:
        out = np.zeros((len(ids), n))
        some = (ids >= 1) & (ids < swapped_to)
        out[some] = signs(ids[some] - 1, n, exact, seed)
        return out

    if ranks:
        values = differences(cells(rows, [r["group_id"] for r in got]), metric, resampled_to + n, n, weights, swaps)
    else:
        values = _by_draw(spark, resampled_to + n, sums, n, weights, swaps)
    effect, swapped, drawn, alone = float(values[0]), values[1:swapped_to], values[swapped_to:resampled_to], values[resampled_to:]
    hits = int((np.abs(swapped) >= least_extreme(effect)).sum())
    p = hits / 2**n if exact else (hits + 1) / (draws + 1)
    found = None
    if np.isfinite(drawn).all() and all(len(s) >= 2 and np.isfinite(alone[s]).all() for s in strata):
        found = accelerated(np.sort(drawn), effect, [alone[s] for s in strata], level)
    bound = -math.log(1e-15) if metric == "log_loss" else 1.0
    low, high = found or (-bound, bound)
    table = [(metric, effect, low, high, p, n, exact, pure, int((~np.isfinite(drawn)).sum()), found is None)]
    return spark.createDataFrame(table, "metric string, effect double, low double, high double, p_value double, n_clusters int, exact boolean, stratified boolean, invalid_draws int, degenerate boolean")


def factorial_effects(df: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """Main effects and synergy of two 0/1 factors on the mean of ``value``."""
    cell = lambda i, j: F.avg(F.when((F.col(a) == i) & (F.col(b) == j), F.col(value)))
    m = df.agg(cell(0, 0).alias("m00"), cell(1, 0).alias("m10"), cell(0, 1).alias("m01"), cell(1, 1).alias("m11"))
    return m.select("m00", "m10", "m01", "m11", ((F.col("m10") + F.col("m11") - F.col("m00") - F.col("m01")) / 2).alias("effect_a"), ((F.col("m01") + F.col("m11") - F.col("m00") - F.col("m10")) / 2).alias("effect_b"), (F.col("m11") - F.col("m10") - F.col("m01") + F.col("m00")).alias("synergy"))


def signatures(df: DataFrame, config: str, columns: list[str]) -> DataFrame:
    """Sums of the columns by configuration, and whether no other configuration has the same."""
    g = df.groupBy(config).agg(*[F.sum(c).alias(c) for c in columns])
    return g.withColumn("distinct", F.count("*").over(Window.partitionBy(*columns)) == 1)
