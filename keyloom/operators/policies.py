"""Publication policies: which event of a key makes a new version of its features public."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.columns import log_loss
from keyloom.functions import chains
from keyloom.functions.scan import scan
from keyloom.operators.features import running, w_key


@dataclass(frozen=True)
class Policy:
    """kind: exact_fresh, fixed_cadence, elapsed, adaptive or quota; the other fields are those it uses."""

    kind: str
    cadence: int = 1
    elapsed_ns: int = 0
    cadence_max: int = 16
    quota: int = 0

    # Other names of the kinds.
    NAMES = {
        "exactfresh": "exact_fresh", "fresh": "exact_fresh", "u1": "exact_fresh", "fixedcadence": "fixed_cadence", "cadence": "fixed_cadence",
        "elapsedthreshold": "elapsed", "elapsed_threshold": "elapsed", "adaptivepressure": "adaptive", "adaptive_pressure": "adaptive",
    }

    @staticmethod
    def of(name: str, cadence: int = 1, elapsed_ns: int = 0, quota: int = 0) -> Policy:
        """By name, whatever its case."""
        kind = name.lower()
        return Policy(Policy.NAMES.get(kind, kind), cadence, elapsed_ns, max(16, cadence), quota)

    def __post_init__(self) -> None:
        if self.kind not in {"exact_fresh", "fixed_cadence", "elapsed", "adaptive", "quota"}:
            raise ValueError(f"unknown policy {self.kind!r}")
        if self.cadence < 1 or self.elapsed_ns < 0 or self.cadence_max < self.cadence or self.quota < 0:
            raise ValueError("policy bounds")


def _finish(decided: DataFrame) -> DataFrame:
    """Adds version_id (running number of publications) and pending (events since the last one)."""
    out = decided.withColumn("version_id", F.sum(F.col("published").cast("long")).over(running()))
    place = F.row_number().over(Window.partitionBy("key", "version_id").orderBy("seq"))
    return out.withColumn("pending", (place - F.when(F.col("version_id") > 0, 1).otherwise(0)).cast("long"))


def publish(events: DataFrame, policy: Policy, rank: str = "seq", total: int | None = None, hot_rows: int | None = None) -> DataFrame:
    """Adds published, version_id and pending. Quota: ``rank`` numbers all events from 0, of ``total``. Elapsed and adaptive: a key of more
    than ``hot_rows`` events is cut into ranges; the elapsed one needs such a key's times in order."""
    if policy.kind == "exact_fresh":
        return _finish(events.withColumn("published", F.lit(True)))
    if policy.kind == "fixed_cadence":
        return _finish(events.withColumn("published", F.row_number().over(w_key()) % policy.cadence == 0))
    if policy.kind == "quota":
        n = total if total is not None else events.count()
        share = lambda i: F.expr(f"({i}) * {policy.quota} div {max(1, n)}")
        return _finish(events.withColumn("published", share(f"{rank} + 1") > share(rank)))

    if policy.kind == "elapsed":
        return scan(events, chains.elapsed(policy.elapsed_ns), hot_rows=hot_rows).drop("public_ns")
    return scan(events, chains.adaptive(policy.cadence, policy.cadence_max), hot_rows=hot_rows)


def accounting(published: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """One row: processed, published, coalesced, and with queries how many of them were cold; conserved if it adds up."""
    one = published.agg(F.count("*").alias("processed"), F.count_if("published").alias("published"), F.count_if(~F.col("published")).alias("coalesced"))
    if queries is not None:
        one = one.crossJoin(queries.agg(F.count("*").alias("queries"), F.count_if("cold_start").alias("cold"), F.count_if(~F.col("cold_start")).alias("warm")))  # one row each
    return one.withColumn("conserved", F.col("processed") == F.col("published") + F.col("coalesced"))


CANDIDATES = (2, 3, 5, 8, 10, 15, 20)
WORK_PRICE = 0.05


def cached_scores(scored: DataFrame, cadences: dict[str, int], cold: float) -> DataFrame:
    """Adds for each name the score that is public at each event under its cadence: that of the key's last published event, or
    ``cold`` before the first. ``scored`` has key, seq and ``score``, the fresh one."""
    at = scored.withColumn("__rn", F.row_number().over(w_key()))
    public = lambda k: F.last(F.when(F.col("__rn") % k == 0, F.col("score")), True).over(running())
    return at.withColumns({name: F.coalesce(public(k), F.lit(cold)) for name, k in cadences.items()}).drop("__rn")


def tune_cadence(scored: DataFrame, rows: DataFrame, cold: float, work_price: float = WORK_PRICE, candidates: tuple[int, ...] = CANDIDATES) -> DataFrame:
    """For each cadence: publications and work ratio over all events, mean gap (how much more log loss the public score has than the
    fresh one, where it has more) over the labelled ``rows`` (seq, label), objective = gap + price x work ratio, and which is chosen:
    the least, the first of equals. Labels are the rows' own; all candidates are taken in one pass."""
    names = {f"__c{k}": k for k in candidates}
    public = cached_scores(scored, names, cold).withColumn("__n", F.row_number().over(w_key()))
    loss = lambda p: log_loss(F.col("label"), F.col(p))
    work = public.agg(F.count("*").alias("all"), *[F.count_if(F.col("__n") % k == 0).alias(n) for n, k in names.items()])
    gaps = public.join(rows, "seq").agg(*[F.avg(F.greatest(F.lit(0.0), loss(n) - loss("score"))).alias(n) for n in names])
    long = lambda df, value, *more: df.select(*more, F.explode(F.array(*[F.struct(F.lit(k).alias("cadence"), F.lit(i).alias("rank"), F.col(n).alias(value)) for i, (n, k) in enumerate(names.items())])).alias("x")).select(*more, "x.*")
    costs = long(work, "publications", "all").join(long(gaps, "mean_gap").drop("rank"), "cadence").withColumn("work_ratio", F.col("publications") / F.col("all"))
    costs = costs.withColumn("objective", F.col("mean_gap") + F.lit(work_price) * F.col("work_ratio"))
    chosen = F.row_number().over(Window.orderBy("objective", "rank")) == 1  # as many rows as candidates
    return costs.withColumn("chosen", chosen).select("cadence", "publications", "work_ratio", "mean_gap", "objective", "chosen")
