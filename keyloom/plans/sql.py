"""The same queries in SQL, written independently: windows, as-of joins and recursion instead of folds."""

from __future__ import annotations

RAW = r"""
raw AS (
  SELECT event_id AS seq, epoch_us(ts) * 1000 AS event_ts_ns,
  user_id AS key, CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS BIGINT) AS item_id, CAST(floor(value) AS BIGINT) AS category_id,

  CASE event_type WHEN 'view' THEN 'pv' WHEN 'click' THEN 'cart' WHEN 'signup' THEN 'fav' WHEN 'purchase' THEN 'buy' END AS behavior
  FROM events),
ev AS (SELECT seq, event_ts_ns, key, item_id, category_id,
  CASE behavior WHEN 'pv' THEN 0 WHEN 'cart' THEN 1 WHEN 'fav' THEN 2 ELSE 3 END AS code FROM raw
  WHERE behavior IS NOT NULL)"""

COUNTED = RAW + r""",
c AS (
  SELECT *, row_number() OVER w AS rn, count(*) FILTER (WHERE code = 0) OVER w AS pv,
  count(*) FILTER (WHERE code IN (1, 2)) OVER w AS cart_fav, count(*) FILTER (WHERE code = 3) OVER w AS buy,
  count(*) OVER w AS n,
         coalesce(CAST(event_ts_ns - lag(event_ts_ns) OVER (PARTITION BY key ORDER BY seq) AS DOUBLE) / 1e9, 0e0) AS gap_s,
         CASE code WHEN 0 THEN 1e0 WHEN 1 THEN 3e0 WHEN 2 THEN 2e0 ELSE 5e0 END AS wt
  FROM ev WINDOW w AS (PARTITION BY key ORDER BY seq ROWS UNBOUNDED PRECEDING))"""

AVERAGED = r""",
r AS (
  SELECT key, rn, 0e0 + {step} * (wt - 0e0) AS s, 0e0 + {step} * (gap_s - 0e0) AS g FROM c WHERE rn = 1
  UNION ALL SELECT c.key, c.rn, r.s + {step} * (c.wt - r.s), r.g + {step} * (c.gap_s - r.g) FROM r
  JOIN c ON c.key = r.key AND c.rn = r.rn + 1),
f AS (
  SELECT c.seq, c.event_ts_ns, c.key, c.code, c.item_id, c.rn, r.s AS x0, ln(1e0 + pv) AS x1,
  ln(1e0 + cart_fav) AS x2, least(gap_s, 3600e0) / 3600e0 AS x3, CAST(buy AS DOUBLE) / n AS x4,
  ln(1e0 + buy) AS x5, r.g AS x6
  FROM c JOIN r ON r.key = c.key AND r.rn = c.rn),
z AS (SELECT *, 2e-1 + 4e-1 * x0 + -1e-1 * x1 + 3e-1 * x2 + 2e-1 * x3 + -4e-1 * x4 + 1e-1 * x5 + 1e-6 * x6 AS zz FROM f),
sc AS (SELECT *,
  floor(CASE WHEN zz >= 0 THEN 1 / (1 + exp(-zz)) ELSE exp(zz) / (1 + exp(zz)) END * 1e6 + 0.5e0) / 1e6 AS score
  FROM z)"""
FEATURES = COUNTED + AVERAGED.replace("{step}", "1e-1")

LABELS = RAW + r""",
lb AS (

  SELECT e.seq, e.event_ts_ns, e.key AS user_id, b.seq AS b_seq, b.event_ts_ns AS b_ts, e.event_ts_ns > 1706659199000000000 - 86400000000000 AS cut
  FROM ev e ASOF LEFT JOIN (SELECT * FROM ev WHERE code = 3) b ON e.key = b.key AND e.event_ts_ns < b.event_ts_ns),
labels_ AS (
  SELECT seq, event_ts_ns, user_id,
  CASE WHEN NOT cut THEN CAST(coalesce(b_ts <= event_ts_ns + 86400000000000, false) AS INTEGER) END AS label, CAST(NOT cut AS INTEGER) AS label_valid, CAST(cut AS INTEGER) AS censored,
         CASE WHEN NOT cut AND b_ts <= event_ts_ns + 86400000000000 THEN b_seq END AS positive_witness_seq FROM lb)"""

SPLITS_ONLY = r""",
sp0 AS (
  SELECT *, event_ts_ns // 1000000000 AS s, CAST('0x' || substr(sha256(CAST(user_id AS VARCHAR)), 1, 8) AS BIGINT) % 10 = 0 AS ood
  FROM labels_),
parts AS (
  SELECT *
  FROM (VALUES ('train', 'train_hour_', 3, 1704067200, 1705276799), ('train_embargo', 'embargo_1_hour_', 2, 1705276800, 1705449599),
    ('validation', 'val_hour_', 2, 1705449600, 1705881599), ('val_embargo', 'embargo_2_hour_', 2, 1705881600, 1706054399),
    ('test', 'test_hour_', 2, 1706054400, 1706572799), ('tail_censored', 'tail_hour_', 2, 1706572800, 1706659199)) t(part, prefix, width, a, b)),
sp1 AS (
  SELECT sp0.*, part, CASE WHEN ood THEN 'ood_hour_' ELSE prefix END AS prefix, CASE WHEN ood THEN 3 ELSE width END AS width,

  CASE WHEN ood THEN least(greatest((s - 1704067200) // 3600, 0), 719) ELSE least(greatest((s - a) // 3600, 0), (b - a) // 3600) END AS h
  FROM sp0 JOIN parts ON (s >= a OR part = 'train') AND (s <= b OR part = 'tail_censored')),
cohort AS (
  SELECT seq, user_id, event_ts_ns, CASE WHEN ood THEN 'ood' ELSE part END AS split,
         prefix ||
  CASE WHEN length(CAST(h AS VARCHAR)) < width THEN lpad(CAST(h AS VARCHAR), width, '0') ELSE CAST(h AS VARCHAR) END AS group_id,
         CASE WHEN s <= 1706572799 THEN label END AS label, CASE WHEN s > 1706572799 THEN 1 ELSE censored END AS censored
  FROM sp1)"""

SPLITS = LABELS + SPLITS_ONLY
SCORED = FEATURES + LABELS.removeprefix(RAW) + r""",
sl AS (SELECT sc.seq, sc.event_ts_ns, sc.key AS user_id, sc.score, l.label FROM sc JOIN labels_ l ON l.seq = sc.seq)"""
# What each configuration has public at each labelled test row: the score of the key's last published event.
CADENCED = SCORED + SPLITS_ONLY + r""",
pub AS (
  SELECT a.seq, a.event_ts_ns, a.key AS user_id, a.rn, k.config, k.cadence, a.score AS fresh,
         coalesce(b.score, floor(1 / (1 + exp(-2e-1)) * 1e6 + 0.5e0) / 1e6) AS score
  FROM sc a CROSS JOIN (VALUES {configs}) k(config, cadence) LEFT
  JOIN sc b ON b.key = a.key AND b.rn = a.rn // k.cadence * k.cadence),
cmp AS (
  SELECT p.*, c.label, c.split, CAST(p.event_ts_ns // 86400000000000 AS VARCHAR) AS group_id,
         -(c.label * ln(least(greatest(score, 1e-15), 1 - 1e-15)) + (1 - c.label) * ln(1 - least(greatest(score, 1e-15), 1 - 1e-15))) AS loss,
         -(c.label * ln(least(greatest(fresh, 1e-15), 1 - 1e-15)) + (1 - c.label) * ln(1 - least(greatest(fresh, 1e-15), 1 - 1e-15))) AS fresh_loss
  FROM pub p JOIN cohort c ON c.seq = p.seq WHERE c.label IS NOT NULL)"""
COMPARED = CADENCED.replace("{configs}", "('exact_fresh', 1), ('tuned_static', 4), ('slow_static', 9)") + r""",
te AS (SELECT * FROM cmp WHERE split = 'test'),
pairs AS (
  SELECT a.seq, a.config AS candidate, b.config AS base, a.group_id, a.label, a.score AS a, b.score AS b, a.loss - b.loss AS d
  FROM te a JOIN te b ON a.seq = b.seq AND a.config <> b.config)"""
# Swaps of two models within clusters: all patterns of six clusters or fewer, as bits of a number.
SWAPPED = r""",
cl AS (SELECT row_number() OVER (PARTITION BY candidate, base ORDER BY group_id) - 1 AS i, * FROM clusters),
tot AS (SELECT candidate, base, count(*) AS k, sum(d) AS d, sum(n) AS n FROM cl GROUP BY 1, 2),
sw AS (
  SELECT t.candidate, t.base, p, sum(CASE WHEN (p >> i) % 2 = 1 THEN -cl.d ELSE cl.d END) / any_value(t.n) AS v
  FROM tot t CROSS JOIN range(4096) r(p) JOIN cl ON cl.candidate = t.candidate AND cl.base = t.base WHERE p < 1 << t.k
  GROUP BY 1, 2, 3),
pv AS (
  SELECT t.candidate, t.base, any_value(t.k) AS k, any_value(t.d / t.n) AS effect,
         CAST(count(*) FILTER (WHERE abs(v) >= abs(t.d / t.n) * (1 - 1e-12)) AS DOUBLE) / (1 << any_value(t.k)) AS p
  FROM tot t JOIN sw ON sw.candidate = t.candidate AND sw.base = t.base GROUP BY 1, 2)"""

QUERIED = FEATURES + r""",
q AS (SELECT seq AS query_id, CASE WHEN seq % 10 = 0 THEN key + 1000000000 ELSE key END AS key,
  event_ts_ns AS query_ts_ns, seq * 4 // (SELECT count(*) FROM raw) AS ph FROM raw WHERE behavior IS NULL),
fp AS (SELECT *, seq * 4 // (SELECT count(*) FROM raw) AS ph FROM f)"""

ANSWER = r"""
SELECT a.query_id, a.key, a.query_ts_ns, v.key IS NULL AS cold_start,
  CASE WHEN v.key IS NULL THEN 0 ELSE a.rn // 4 END AS version_id, coalesce(v.seq, 0) AS latest_included_seq,
  coalesce(v.event_ts_ns, 0) AS latest_event_ts_ns,

  CASE WHEN v.key IS NULL THEN a.query_ts_ns ELSE greatest(0, a.query_ts_ns - v.event_ts_ns) END AS event_time_age_ns,
  coalesce(a.rn % 4, 0) AS update_staleness,
       floor(sqrt(0e0 + (coalesce(v.x0, 0) - coalesce(n.x0, 0)) ** 2 + (coalesce(v.x1, 0) - coalesce(n.x1, 0)) ** 2 + (coalesce(v.x2, 0) - coalesce(n.x2, 0)) ** 2 + (coalesce(v.x3, 0) - coalesce(n.x3, 0)) ** 2
         + (coalesce(v.x4, 0) - coalesce(n.x4, 0)) ** 2 + (coalesce(v.x5, 0) - coalesce(n.x5, 0)) ** 2 + (coalesce(v.x6, 0) - coalesce(n.x6, 0)) ** 2) * 1e3 + 0.5e0) / 1e3 AS feature_error
FROM a LEFT JOIN f v ON v.key = a.key AND v.rn = a.rn // 4 * 4 AND v.rn > 0 LEFT JOIN f n ON n.key = a.key AND n.rn = a.rn
"""


def sql(*parts: str) -> str:
    return "WITH RECURSIVE " + "".join(parts)


RANKED = r""",
g AS (SELECT {by} score AS s, CAST(sum(label) AS BIGINT) AS pos, count(*) AS n FROM {rows} WHERE label IS NOT NULL
  GROUP BY {by} score),
g2 AS (SELECT *, coalesce(sum(n - pos) OVER ({part}
  ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(pos) OVER ({part}
  ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS tp,
              sum(n) OVER ({part} ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS seen FROM g),
g3 AS (SELECT {by} sum(pos) AS p, sum(n - pos) AS q, sum(pos * (2 * below + n - pos)) AS u2,
  sum(pos * CAST(tp AS DOUBLE) / CAST(seen AS DOUBLE)) AS a, CAST(sum(n) AS BIGINT) AS n FROM g2 {group})
SELECT {by} n,
  floor(CASE WHEN p > 0 AND q > 0 THEN CAST(u2 AS DOUBLE) / (2e0 * CAST(p AS DOUBLE) * CAST(q AS DOUBLE)) END * 1e9 + 0.5e0) / 1e9 AS auroc,
  floor(CASE WHEN p > 0 AND q > 0 THEN a / CAST(p AS DOUBLE) END * 1e9 + 0.5e0) / 1e9 AS ap FROM g3
"""

R9 = "floor(({}) * 1e9 + 0.5e0) / 1e9"
R6 = "floor(({}) * 1e6 + 0.5e0) / 1e6"
XS = ", ".join(f"{R6.format(f'x{i}')} AS x{i}" for i in range(7))
DEALT = r""",
d AS (SELECT seq, key, row_number() OVER (ORDER BY seq) - 1 AS rank FROM ev),
b0 AS (SELECT rank // 100 AS generation, min(seq) AS first_seq, max(seq) AS last_seq,
  count(*) AS actual_count, CAST(count(DISTINCT key) AS DOUBLE) / count(*) AS occupancy FROM d GROUP BY 1),
oc AS (SELECT generation, occupancy, 0e0 + 2e-1 * (occupancy - 0e0) AS v FROM b0 WHERE generation = 0
       UNION ALL SELECT b0.generation, b0.occupancy, oc.v + 2e-1 * (b0.occupancy - oc.v) FROM oc
  JOIN b0 ON b0.generation = oc.generation + 1)"""
PHASED = r""",
tot AS (SELECT count(*) AS m FROM ev),
ph AS (SELECT *
  FROM (VALUES (0, 'warmup', 2000, 0, 1000), (1, 'steady', 5000, 1000, 1000), (2, 'stress', 15000, 3000, 5000), (3, 'recovery', 5000, 1000, 1000)) t(phase_idx, phase, e, q, rate)),
ph2 AS (SELECT *,
  CASE phase_idx WHEN 3 THEN m - 2000 * m // 27000 - 5000 * m // 27000 - 15000 * m // 27000 ELSE e * m // 27000 END AS en, q * m // 27000 AS qn, 1000000000 // rate AS step
  FROM ph, tot),
ph3 AS (SELECT *, coalesce(sum(en) OVER w, 0) AS first, coalesce(sum(en * step) OVER w, 0) AS t0 FROM ph2
  WINDOW w AS (ORDER BY phase_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
pl AS (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS place FROM ev),
tr AS (SELECT pl.*, phase, phase_idx, CAST((place - first) * step + t0 AS BIGINT) AS t_sched_ns,
  CASE WHEN qn > 0 THEN greatest(1, en // qn) ELSE 0 END AS every FROM pl
  JOIN ph3 ON place >= first AND place < first + en)"""


def _newton(name: str, k: int, steps: int = 15) -> str:
    """Whole Newton steps on mean log loss + 1e-4 / 2 |w|^2 over ``ex`` with its first k features: b0 is the bias. The equations are solved by
    elimination, one column after another."""
    x = ["1e0", *[f"x{i}" for i in range(k)]]
    n = k + 1
    cells = [(i, j) for i in range(n) for j in range(i, n)]
    z = " + ".join(f"b{i} * {v}" for i, v in enumerate(x))
    b = ", ".join(f"b{i}" for i in range(n))
    pen = lambda i: "0e0" if i == 0 else "1e-4"
    q = f"SELECT step, {b}, {', '.join(x[1:])}, label, CAST(1 AS DOUBLE) / (1 + exp(-({z}))) AS p FROM {name}_r, ex WHERE step < {steps}"
    q = f"SELECT step, {b}, " + ", ".join([f"avg((p - label) * {v}) + {pen(i)} * b{i} AS g{i}" for i, v in enumerate(x)] + [f"avg(p * (1 - p) * {x[i]} * {x[j]})" + (f" + {pen(i)}" if i == j else "") + f" AS h{i}_{j}" for i, j in cells]) + f" FROM ({q}) GROUP BY step, {b}"
    for e in range(n - 1):
        rest = [f"g{i} - h{e}_{i} / h{e}_{e} * g{e} AS g{i}" for i in range(e + 1, n)] + [f"h{i}_{j} - h{e}_{i} / h{e}_{e} * h{e}_{j} AS h{i}_{j}" for i, j in cells if i > e]
        kept = [f"g{i}" for i in range(e + 1)] + [f"h{i}_{j}" for i, j in cells if i <= e]
        q = f"SELECT step, {b}, " + ", ".join(kept + rest) + f" FROM ({q})"
    for e in reversed(range(n)):
        known = "".join(f" - h{e}_{j} * s{j}" for j in range(e + 1, n))
        q = f"SELECT *, (g{e}{known}) / h{e}_{e} AS s{e} FROM ({q})"
    first = ", ".join(["(SELECT ln(avg(label) / (1 - avg(label))) FROM ex) AS b0", *[f"0e0 AS b{i}" for i in range(1, n)]])
    return f"""{name}_r AS (SELECT 0 AS step, {first}
  UNION ALL SELECT step + 1, {", ".join(f"b{i} - s{i}" for i in range(n))} FROM ({q})),
{name} AS (SELECT '{name}' AS model, b0, {", ".join(f"b{i}" if i < n else f"0e0 AS b{i}" for i in range(1, 8))} FROM {name}_r WHERE step = {steps})"""


SQL = {
    "canonical_events": sql(RAW, r""",
k AS (SELECT DISTINCT event_ts_ns, key, item_id, category_id, behavior FROM raw
  WHERE behavior IS NOT NULL AND event_ts_ns >= 1704067200000000000 AND event_ts_ns <= 1706659199000000000)
SELECT row_number() OVER (ORDER BY event_ts_ns, key, item_id, category_id,
  CASE behavior WHEN 'pv' THEN 0 WHEN 'fav' THEN 1 WHEN 'cart' THEN 2 ELSE 3 END) - 1 AS seq, event_ts_ns, key, item_id, category_id,
       CASE behavior WHEN 'pv' THEN 0 WHEN 'cart' THEN 1 WHEN 'fav' THEN 2 ELSE 3 END AS behavior_code FROM k"""),
    "released_events": sql(RAW, r""",
inside AS (SELECT *, behavior IS NOT NULL AS domain, event_ts_ns BETWEEN 1704067200000000000 AND 1706659199000000000 AS during FROM raw),
k AS (SELECT event_ts_ns, key, item_id, category_id, behavior, count(*) AS copies FROM inside WHERE domain AND during GROUP BY ALL),
told AS (SELECT (SELECT count(*) FROM raw) AS raw, (SELECT count(*) FROM inside WHERE domain AND NOT during) AS outliers, (SELECT CAST(sum(copies - 1) AS BIGINT) FROM k) AS duplicates)
SELECT row_number() OVER (ORDER BY event_ts_ns, key, item_id, category_id, list_position(['pv', 'fav', 'cart', 'buy'], behavior)) - 1 AS seq,
       event_ts_ns, key, item_id, category_id, list_position(['pv', 'cart', 'fav', 'buy'], behavior) - 1 AS behavior_code, told.* FROM k CROSS JOIN told"""),
    "exclusion_ledger": sql(RAW, r""",
t AS (SELECT *,
  CASE WHEN behavior IS NULL THEN 'domain' WHEN event_ts_ns < 0 THEN 'negative' WHEN event_ts_ns < 1704067200000000000 THEN 'before' WHEN event_ts_ns > 1706659199000000000 THEN 'after' END AS reason
  FROM raw),
u AS (SELECT count(*) AS raw, count(*) FILTER (WHERE reason = 'domain') AS n_domain,
  count(*) FILTER (WHERE reason = 'negative') AS n_negative, count(*) FILTER (WHERE reason = 'before') AS n_before,
  count(*) FILTER (WHERE reason = 'after') AS n_after,
             count(*) FILTER (WHERE reason IS NULL) AS in_window, (SELECT count(*)
  FROM (SELECT DISTINCT event_ts_ns, key, item_id, category_id, behavior FROM t WHERE reason IS NULL)) AS emitted
  FROM t)
SELECT *, in_window - emitted AS duplicates, n_negative + n_before + n_after AS outliers, raw = emitted + n_negative + n_before + n_after + n_domain + in_window - emitted AS conserved
  FROM u"""),
    "behavior_profile": sql(RAW, " SELECT code AS behavior_code, count(*) AS n, count(DISTINCT key) AS n_keys, min(event_ts_ns) AS first_ns, "
        "max(event_ts_ns) AS last_ns, max(category_id) AS max_category FROM ev GROUP BY code"),
    "data_profile": sql(RAW, " SELECT count(*) AS n_rows, count(DISTINCT key) AS n_keys, min(event_ts_ns) AS first_ns, "
        "max(event_ts_ns) AS last_ns, max(category_id) AS max_category, "
        "count(*) FILTER (WHERE behavior IS NULL) AS n_invalid, count(seq) - count(DISTINCT seq) AS n_duplicate_seq"
        " FROM raw"),
    "keyed_counts": sql(COUNTED, " SELECT seq, key, CAST(pv AS BIGINT) AS pv, CAST(cart_fav AS BIGINT) AS cart_fav, CAST(buy AS BIGINT) AS buy, n"
        " FROM c"),
    "gap_feature": sql(COUNTED, " SELECT seq, key, gap_s FROM c"),
    "engagement_ema": sql(FEATURES, " SELECT seq, key, x0 AS engagement_ema FROM f"),
    "gap_ema": sql(FEATURES, " SELECT seq, key, x6 AS gap_ema FROM f"),
    "feature_vector": sql(FEATURES, f" SELECT seq, key, {XS} FROM f"),
    "logistic_score": sql(FEATURES, " SELECT seq, key, score FROM sc"),
    "stream_features_batch_parity": sql(FEATURES, f" SELECT seq, key, {XS}, rn % 4 = 0 AS published, rn // 4 AS version_id, rn % 4 AS pending FROM f"),
    "top_users": sql(FEATURES, " SELECT key, n, mean_score, CAST(row_number() OVER (ORDER BY mean_score DESC, key) AS INTEGER) AS place"
        " FROM (SELECT key, count(*) AS n, floor(avg(score) * 1e6 + 0.5e0) / 1e6 AS mean_score FROM sc"
        " GROUP BY key) QUALIFY place <= 10"),
    "event_order_violations": sql(RAW, r""",
o AS (SELECT event_ts_ns, lag(event_ts_ns) OVER (PARTITION BY key ORDER BY seq) AS a,
  lag(event_ts_ns) OVER (ORDER BY seq) AS b FROM ev)
SELECT (SELECT count(*) - count(DISTINCT seq) FROM ev) AS duplicate_seq,
  count(*) FILTER (WHERE a > event_ts_ns) AS key_regressions,
  count(*) FILTER (WHERE b > event_ts_ns) AS global_regressions FROM o"""),
    "key_budget": sql(RAW, " SELECT count(DISTINCT key) AS n_keys, count(DISTINCT key) <= 1000000 AS within_budget FROM ev"),
    "causal_labels": sql(LABELS, " SELECT * FROM labels_"),
    "released_labels": sql(LABELS, " SELECT * FROM labels_"),
    "fit_users": sql(SPLITS, " SELECT user_id, count(*) AS n FROM cohort WHERE split IN ('train', 'validation') GROUP BY user_id"),
    "label_manifest": sql(LABELS, " SELECT count(*) AS total, count(label) AS evaluated, CAST(sum(censored) AS BIGINT) AS censored, "
        "count(*) FILTER (WHERE label = 1) AS positive, count(*) FILTER (WHERE label = 0) AS negative, "
        "count(positive_witness_seq) AS witnesses, CAST(count(*) FILTER (WHERE label = 1) AS DOUBLE) / count(label) AS positive_rate"
        " FROM labels_"),
    "cohort_splits": sql(SPLITS, " SELECT * FROM cohort"),
    "evaluated_cohort": sql(SPLITS, " SELECT seq, split, group_id, label FROM cohort"
        " WHERE split NOT IN ('train_embargo', 'val_embargo', 'tail_censored')"),
    "split_summary": sql(SPLITS, " SELECT split, count(*) AS n, count(DISTINCT user_id) AS n_users, "
        "count(*) FILTER (WHERE label = 1) AS positive, "
        "count(*) FILTER (WHERE label = 0) AS negative, CAST(sum(censored) AS BIGINT) AS censored FROM cohort"
        " GROUP BY split"),
    "test_groups": sql(SPLITS, " SELECT group_id, count(*) FILTER (WHERE label = 1) AS positive, count(*) FILTER (WHERE label = 0) AS negative, "
        "count(*) FILTER (WHERE label IS NOT NULL) >= 30 AS enough FROM cohort WHERE split = 'test' GROUP BY group_id"),
    "ood_users": sql(SPLITS, " SELECT user_id, count(*) AS n FROM cohort WHERE split = 'ood' GROUP BY user_id"),
    "ood_overlaps": sql(SPLITS, ", o AS (SELECT DISTINCT user_id FROM cohort WHERE split = 'ood') SELECT " + ", ".join(f"(SELECT count(DISTINCT user_id) FROM cohort WHERE split = '{p}' AND user_id IN (FROM o)) AS ood_{p}" for p in ("train", "validation", "test"))),
    "publish_exact_fresh": sql(COUNTED, " SELECT seq, key, true AS published, rn AS version_id, 0 AS pending FROM c"),
    "publish_cadence": sql(COUNTED, " SELECT seq, key, rn % 4 = 0 AS published, rn // 4 AS version_id, rn % 4 AS pending FROM c"),
    "publish_quota": sql(RAW, r""",
d AS (SELECT seq, key, row_number() OVER (ORDER BY seq) - 1 AS i, count(*) OVER () AS n FROM ev),
e AS (SELECT *, (i + 1) * (n // 5) // n > i * (n // 5) // n AS published FROM d),
v AS (SELECT *, CAST(sum(CAST(published AS INTEGER)) OVER (PARTITION BY key
  ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS version_id FROM e)
SELECT seq, key, published, version_id, row_number() OVER (PARTITION BY key, version_id ORDER BY seq) -
  CASE WHEN version_id > 0 THEN 1 ELSE 0 END AS pending FROM v"""),
    "publish_elapsed": sql(COUNTED, r""",
e AS (SELECT key, rn, seq, event_ts_ns AS last,
  true AS published, CAST(1 AS BIGINT) AS version_id, CAST(0 AS BIGINT) AS pending FROM c WHERE rn = 1
      UNION ALL SELECT c.key, c.rn, c.seq,
  CASE WHEN c.event_ts_ns - e.last >= 86400000000000 THEN c.event_ts_ns ELSE e.last END, c.event_ts_ns - e.last >= 86400000000000,
        CASE WHEN c.event_ts_ns - e.last >= 86400000000000 THEN e.version_id + 1 ELSE e.version_id END,
  CASE WHEN c.event_ts_ns - e.last >= 86400000000000 THEN 0 ELSE e.pending + 1 END FROM e
  JOIN c ON c.key = e.key AND c.rn = e.rn + 1)
SELECT seq, key, published, version_id, pending FROM e"""),
    "publish_adaptive": sql(COUNTED, r""",
k AS (SELECT *,
  CASE WHEN seq // 100 % 3 = 1 THEN 1 + CAST(floor(0.85e0 * 15) AS BIGINT) ELSE 1 + CAST(floor(0.10e0 * 15) AS BIGINT) END AS cad
  FROM c),
e AS (SELECT key, rn, seq, cad <= 1 AS published, CAST(CASE WHEN cad <= 1 THEN 1 ELSE 0 END AS BIGINT) AS version_id, CAST(CASE WHEN cad <= 1 THEN 0 ELSE 1 END AS BIGINT) AS pending
  FROM k WHERE rn = 1
      UNION ALL SELECT k.key, k.rn, k.seq, e.pending + 1 >= k.cad,
  CASE WHEN e.pending + 1 >= k.cad THEN e.version_id + 1 ELSE e.version_id END,
  CASE WHEN e.pending + 1 >= k.cad THEN 0 ELSE e.pending + 1 END
      FROM e JOIN k ON k.key = e.key AND k.rn = e.rn + 1)
SELECT seq, key, published, version_id, pending FROM e"""),
    "cache_versions": sql(FEATURES, f" SELECT key, rn // 4 AS version_id, seq AS latest_included_seq, event_ts_ns AS latest_event_ts_ns, {XS} FROM f WHERE rn % 4 = 0"),
    "cache_latest": sql(FEATURES, f" SELECT key, rn // 4 AS version_id, seq AS latest_included_seq, event_ts_ns AS latest_event_ts_ns, {XS} FROM f WHERE rn % 4 = 0 QUALIFY row_number() OVER (PARTITION BY key ORDER BY rn DESC) = 1"),
    "cache_committed": sql(FEATURES, f" SELECT key, rn // 4 AS version_id, seq AS latest_included_seq, event_ts_ns AS latest_event_ts_ns, {XS} FROM f WHERE rn % 4 = 0 QUALIFY row_number() OVER (PARTITION BY key ORDER BY rn DESC) = 1"),
    "query_committed": sql(QUERIED, f""", v AS (SELECT key, rn // 4 AS version_id, seq AS latest_included_seq, event_ts_ns AS latest_event_ts_ns, {XS} FROM f WHERE rn % 4 = 0 QUALIFY row_number() OVER (PARTITION BY key ORDER BY rn DESC) = 1)
SELECT q.query_id, q.key, v.key IS NULL AS cold_start, coalesce(version_id, 0) AS version_id, coalesce(latest_included_seq, 0) AS latest_included_seq, coalesce(latest_event_ts_ns, 0) AS latest_event_ts_ns,
  x0, x1, x2, x3, x4, x5, x6 FROM q LEFT JOIN v ON v.key = q.key"""),
    "query_final_state": sql(QUERIED, ", a AS (SELECT q.*, (SELECT max(rn) FROM f WHERE f.key = q.key) AS rn FROM q)", ANSWER),
    "query_asof_before": sql(QUERIED, ", a AS (SELECT q.*, f.rn FROM q ASOF LEFT JOIN f ON q.key = f.key AND q.query_id > f.seq)", ANSWER),
    "query_phase_end": sql(QUERIED, ", a AS (SELECT q.query_id, q.key, q.query_ts_ns, max(fp.rn) AS rn FROM q LEFT"
        " JOIN fp ON fp.key = q.key AND fp.ph <= q.ph GROUP BY ALL)", ANSWER),
    "publication_accounting": sql(QUERIED, r""", a AS (SELECT q.*, (SELECT max(rn) FROM f WHERE f.key = q.key) AS rn FROM q)
SELECT (SELECT count(*) FROM f) AS processed, (SELECT count(*) FROM f WHERE rn % 4 = 0) AS published, (SELECT count(*)
  FROM f WHERE rn % 4 <> 0) AS coalesced, count(*) AS queries,
       count(*) FILTER (WHERE coalesce(rn, 0) < 4) AS cold, count(*) FILTER (WHERE rn >= 4) AS warm, true AS conserved FROM a"""),
    "auroc_ap": sql(SCORED, RANKED.format(by="", rows="sl", part="", group="")),
    "activity_terciles": sql(COMPARED, r""",
ac AS (
  SELECT *, CASE WHEN count(*) OVER w <= 3 THEN 'low' WHEN count(*) OVER w <= 15 THEN 'med' ELSE 'high' END AS tier
  FROM te WINDOW w AS (PARTITION BY user_id, config))""",
        RANKED.format(by="tier, config,", rows="ac", part="PARTITION BY tier, config", group="GROUP BY tier, config")),
    "ap_untied": sql(SCORED, r""",
o AS (SELECT label, sum(label) OVER (ORDER BY score DESC, seq ROWS UNBOUNDED PRECEDING) AS tp,
  row_number() OVER (ORDER BY score DESC, seq) AS k FROM sl WHERE label IS NOT NULL)
SELECT """, R9.format("sum(CASE WHEN label = 1 THEN CAST(tp AS DOUBLE) / CAST(k AS DOUBLE) END) / sum(label)"), " AS ap FROM o"),
    "proper_scores": sql(SCORED, r""",
o AS (SELECT label AS y, score AS p, CAST(score >= 0.8e0 AS INTEGER) AS h FROM sl WHERE label IS NOT NULL)
SELECT count(*) AS n, """, R9.format("avg(CAST(h = y AS INTEGER))"), " AS accuracy, ", R9.format("CASE WHEN sum(h) + sum(y) > 0 THEN 2e0 * sum(h * y) / (sum(h) + sum(y)) ELSE 0e0 END"), " AS f1, ", R9.format("avg((p - y) * (p - y))"), " AS brier, ",
        R9.format("avg(-(y * ln(least(greatest(p, 1e-15), 1 - 1e-15)) + (1 - y) * ln(1 - least(greatest(p, 1e-15), 1 - 1e-15))))"), " AS log_loss FROM o"),
    "reliability_curve": sql(SCORED, r""",
o AS (SELECT CAST(least(floor(score * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(score) AS m, avg(label) AS y
  FROM sl WHERE label IS NOT NULL GROUP BY 1)
SELECT CAST(b AS INTEGER) AS bin, coalesce(n, 0) AS n, """, R9.format("coalesce(m, (b + 0.5e0) / 10)"), " AS mean_score, ", R9.format("coalesce(y, 0)"), " AS observed FROM range(10) t(b) LEFT JOIN o ON o.bin = b"),
    "loss_gap_summary": sql(SCORED, r""",
o AS (SELECT -(label * ln(least(greatest(score, 1e-15), 1 - 1e-15)) + (1 - label) * ln(1 - least(greatest(score, 1e-15), 1 - 1e-15))) + (label * ln(0.3e0) + (1 - label) * ln(1 - 0.3e0)) AS g
  FROM sl WHERE label IS NOT NULL)
SELECT count(*) AS n, """, R6.format("avg(g)"), " AS mean_gap, ", R6.format("quantile_cont(g, 0.95)"), " AS p95_gap, ", R6.format("max(g)"), " AS max_gap FROM o"),
    "metric_summary": sql(COUNTED, " SELECT code AS behavior_code, count(gap_s) AS n, ", ", ".join(f"{R6.format(x)} AS {n}" for x, n in (("avg(gap_s)", "mean"), ("coalesce(stddev_samp(gap_s), 0)", "std"), ("min(gap_s)", "min"), ("max(gap_s)", "max"), ("quantile_cont(gap_s, 0.5)", "p50"), ("quantile_cont(gap_s, 0.95)", "p95"), ("quantile_cont(gap_s, 0.99)", "p99"), ("CASE WHEN avg(gap_s) > 0 THEN coalesce(stddev_samp(gap_s), 0) / avg(gap_s) ELSE 0 END", "cv"))), " FROM c GROUP BY code"),
    "upper_medians": sql(COUNTED, ", o AS (SELECT code, gap_s, row_number() OVER (PARTITION BY code ORDER BY gap_s) AS k, "
        "count(*) OVER (PARTITION BY code) AS m FROM c) SELECT code AS behavior_code, gap_s AS upper_median FROM o"
        " WHERE k = m // 2 + 1"),
    "line_fit": sql(COUNTED, ", u AS (SELECT key, count(*) AS n, sum(gap_s) AS total FROM c GROUP BY key) SELECT ", R6.format("regr_slope(total, n)"), " AS slope, ", R6.format("regr_intercept(total, n)"), " AS intercept, CAST(regr_count(total, n) AS BIGINT) AS n FROM u"),
    "holm": "WITH h AS (SELECT n_nationkey AS id, "
        "n_regionkey AS family, CAST((n_nationkey * 7) % 25 + 1 AS DOUBLE) / 500e0 AS p FROM nation), r AS (SELECT *, "
        "least(1e0, p * (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family"
        " ORDER BY p, id) + 1)) AS w FROM h) SELECT CAST(id AS BIGINT) AS id, CAST(family AS BIGINT) AS family, p, "
        "max(w) OVER (PARTITION BY family ORDER BY p, id ROWS UNBOUNDED PRECEDING) AS adjusted FROM r",
    "ema_kernel_weights": sql(RAW, r""",
o AS (SELECT key, seq, row_number() OVER (PARTITION BY key
  ORDER BY seq) - 1 AS i, 0.02e0 + 0.28e0 * (CAST(item_id % 10 AS DOUBLE) / 10e0) AS a FROM ev),
w AS (SELECT key, i, a * coalesce(product(1 - a) OVER (PARTITION BY key
  ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1) AS w FROM o UNION ALL SELECT key, count(*),
  product(1 - a) FROM o GROUP BY key)
SELECT key, CAST(i AS INTEGER) AS i, """, R9.format("w"), " AS weight FROM w"),
    "ema_response": sql(RAW, ", o AS (SELECT key, (count(*) % 19 + 1) / 20e0 AS alpha, count(*) FILTER (code = 3) % 16 * 3.141592653589793e0 / 16e0 AS omega FROM ev GROUP BY key), "
        "p AS (SELECT *, alpha + 2 * (1 - alpha) * sin(omega / 2) * sin(omega / 2) AS re, (1 - alpha) * sin(omega) AS im"
        " FROM o) SELECT key, alpha, " + R6.format("omega") + " AS omega, " + R6.format("alpha * re / (re * re + im * im)") + " AS re, " + R6.format("-alpha * im / (re * re + im * im)") + " AS im, " + R6.format("(re * (1 - alpha) * cos(omega) - im * (1 - alpha) * sin(omega)) / (re * re + im * im)") + " AS group_delay, (2 - alpha) / alpha AS span FROM p"),
    "reconcile_status": sql(SPLITS, r""",
p0 AS (SELECT seq, user_id, CASE WHEN seq % 97 = 0 THEN 1.5e0 ELSE 0.5e0 END AS score,
  CASE WHEN seq % 89 = 0 THEN 1 - label ELSE label END AS label FROM cohort WHERE seq % 101 <> 0 AND split = 'test'),
p AS (SELECT seq, CASE WHEN seq % 83 = 0 THEN user_id + 1 ELSE user_id END AS user_id, score, label FROM p0 UNION ALL
  SELECT seq, user_id, score, label FROM p0 WHERE seq % 103 = 0 UNION ALL
  SELECT seq + 1000000000, user_id, score, label FROM p0 WHERE seq % 107 = 0),
pp AS (SELECT seq, count(*) AS k, min(user_id) AS u, min(score) AS score, min(label) AS label FROM p GROUP BY seq),
cc AS (SELECT * FROM cohort WHERE split = 'test')
SELECT coalesce(cc.seq, pp.seq) AS seq,
  CASE WHEN cc.seq IS NULL THEN 'phantom' WHEN pp.seq IS NULL THEN 'missing' WHEN k > 1 THEN 'duplicate' WHEN u IS DISTINCT
  FROM cc.user_id THEN 'key_mismatch'
  WHEN pp.label IS NOT NULL AND pp.label IS DISTINCT
  FROM cc.label THEN 'label_tampered' WHEN pp.score IS NULL OR pp.score > 1 OR pp.score < 0 THEN 'bad_score' ELSE 'ok' END AS status
  FROM cc FULL JOIN pp ON cc.seq = pp.seq"""),
    "burst_count": sql(SPLITS, r""",
o AS (
  SELECT *,
  count(*) FILTER (WHERE split = 'test') OVER w AS prior, CAST(event_ts_ns - max(event_ts_ns) OVER w AS DOUBLE) / 1e9 AS gap_s
  FROM cohort WINDOW w AS (PARTITION BY user_id ORDER BY event_ts_ns, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT seq, user_id, prior, gap_s,
  (SELECT count(*) FROM cohort b
  WHERE b.user_id = o.user_id AND (b.event_ts_ns < o.event_ts_ns OR b.event_ts_ns = o.event_ts_ns AND b.seq < o.seq)
   AND o.event_ts_ns - b.event_ts_ns <= 3600000000000) AS burst
FROM o WHERE split = 'test'"""),
    "failure_taxonomy": sql(SCORED, SPLITS_ONLY, r""",
o AS (
  SELECT *,
  count(*) FILTER (WHERE split = 'test') OVER w AS prior, CAST(event_ts_ns - max(event_ts_ns) OVER w AS DOUBLE) / 1e9 AS gap_s
  FROM cohort WINDOW w AS (PARTITION BY user_id ORDER BY event_ts_ns, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT o.label AS y, sc.score AS p, prior, gap_s,
    (SELECT count(*) FROM cohort b
  WHERE b.user_id = o.user_id AND (b.event_ts_ns < o.event_ts_ns OR b.event_ts_ns = o.event_ts_ns AND b.seq < o.seq)
     AND o.event_ts_ns - b.event_ts_ns <= 3600000000000) AS burst
  FROM o JOIN sc ON sc.seq = o.seq WHERE split = 'test' AND o.label IS NOT NULL),
tau AS (SELECT list_sort(list(p))[count(*) // 2 + 1] AS tau FROM t),
k AS (
  SELECT CASE WHEN y = 1 AND p < tau AND burst >= 2 THEN 'stale_feature_lag_fn'
    WHEN y = 1 AND p < tau AND (gap_s IS NULL OR gap_s > 3600) THEN 'inter_arrival_decay_obsolescence'
    WHEN y = 0 AND p >= tau AND prior <= 2 THEN 'cold_start_miscalibration_fp'
    WHEN abs(p - tau) < 0.002e0 AND y <> CAST(p >= tau AS INTEGER) THEN 'marginal_decision_ambiguity'
    WHEN y <> CAST(p >= tau AS INTEGER) THEN 'other' ELSE 'none' END AS category FROM t, tau),
names AS (SELECT * FROM (VALUES ('stale_feature_lag_fn', 'SEV-2'), ('inter_arrival_decay_obsolescence', 'SEV-2'),
  ('cold_start_miscalibration_fp', 'SEV-3'), ('marginal_decision_ambiguity', 'SEV-4')) v(category, severity))
SELECT coalesce(names.category, g.category) AS category, severity, coalesce(n, 0) AS n,
  """, R6.format("CAST(coalesce(n, 0) AS DOUBLE) / (SELECT count(*) FROM k)"), r""" AS share
FROM names FULL JOIN (SELECT category, count(*) AS n FROM k GROUP BY category) g ON names.category = g.category"""),
    "fixed_batches": sql(RAW, DEALT, " SELECT generation, first_seq, last_seq, actual_count, actual_count < 100 AS is_tail FROM b0"),
    "occupancy_ema": sql(RAW, DEALT, " SELECT generation, occupancy, v AS occupancy_ema FROM oc"),
    "alpha_slew": sql(RAW, DEALT, r""",
al AS (SELECT generation,
  least(greatest(0.01e0 + least(greatest(0.02e0 + (0.3e0 - 0.02e0) * least(greatest(v, 0e0), 1e0) - 0.01e0, -0.1e0), 0.1e0), 0.02e0), 0.3e0) AS alpha
  FROM oc WHERE generation = 0
       UNION ALL SELECT oc.generation,
  least(greatest(al.alpha + least(greatest(0.02e0 + (0.3e0 - 0.02e0) * least(greatest(oc.v, 0e0), 1e0) - al.alpha, -0.1e0), 0.1e0), 0.02e0), 0.3e0)
  FROM al JOIN oc ON oc.generation = al.generation + 1)
SELECT generation, """, R9.format("alpha"), " AS alpha FROM al"),
    "mimd_batches": sql(RAW, DEALT, r""",
mb AS (SELECT generation, CAST(CASE WHEN v > 0.7e0 AND 8 > 8 THEN 8 WHEN v < 0.3e0 THEN least(256,
  greatest(9, CAST(floor(8 * 1.25e0) AS BIGINT))) ELSE 8 END AS BIGINT) AS n FROM oc WHERE generation = 0
       UNION ALL SELECT oc.generation,
  CASE WHEN v > 0.7e0 AND n > 8 THEN greatest(8, CAST(floor(n * 0.7e0) AS BIGINT)) WHEN v < 0.3e0 AND n < 256 THEN least(256,
  greatest(n + 1, CAST(floor(n * 1.25e0) AS BIGINT))) ELSE n END FROM mb JOIN oc ON oc.generation = mb.generation + 1)
SELECT generation, CAST(n AS INTEGER) AS batch_target FROM mb"""),
    "tune_static_cadence": sql(CADENCED.replace("{configs}", "('2', 2), ('3', 3), ('5', 5), ('8', 8), ('10', 10), ('15', 15), ('20', 20)"), r""",
w AS (
  SELECT cadence,
  count(*) FILTER (WHERE rn % cadence = 0) AS publications, CAST(count(*) FILTER (WHERE rn % cadence = 0) AS DOUBLE) / count(*) AS work_ratio
  FROM pub GROUP BY cadence),
g AS (SELECT cadence, avg(greatest(0, loss - fresh_loss)) AS mean_gap FROM cmp WHERE split = 'validation' GROUP BY cadence),
o AS (SELECT *, mean_gap + 0.05e0 * work_ratio AS objective FROM w JOIN g USING (cadence))
SELECT CAST(cadence AS INTEGER) AS cadence, publications, """, R9.format("work_ratio"), " AS work_ratio, ", R9.format("mean_gap"), " AS mean_gap, ",
        R9.format("objective"), " AS objective, row_number() OVER (ORDER BY objective, cadence) = 1 AS chosen FROM o"),
    "actuator_grid": sql(COUNTED, r""",
k AS (SELECT * FROM (VALUES (1), (5), (20)) t(cadence)), b AS (SELECT * FROM (VALUES (8), (32), (128)) t(batch_size)),
o AS (SELECT cadence, count(*) FILTER (WHERE rn % cadence = 0) AS publications, count(*) AS n FROM c, k GROUP BY cadence)
SELECT cadence, batch_size, publications, CAST(ceil(CAST(n AS DOUBLE) / batch_size) AS BIGINT) AS batches,
  coalesce(publications <= lag(publications) OVER (PARTITION BY batch_size ORDER BY cadence), true) AS falls
  FROM o, b"""),
    "workload_trace": sql(RAW, PHASED, " SELECT place, seq, key, phase, CAST(phase_idx AS INTEGER) AS phase_idx, t_sched_ns FROM tr"),
    "workload_queries": sql(RAW, PHASED, " SELECT place AS query_id, phase, CAST(phase_idx AS INTEGER) AS phase_idx, t_sched_ns AS query_ts_ns,"
        " CASE WHEN place // every % 10 = 0 THEN key + 1000000000 ELSE key END AS key FROM tr"
        " WHERE every > 0 AND place % every = 0"),
    "phase_telemetry": sql(RAW, PHASED, r""",
s AS (SELECT phase, row_number() OVER (PARTITION BY key ORDER BY place) % 5 AS pending FROM tr)
SELECT phase, count(*) AS events, count(*) FILTER (WHERE pending = 0) AS publications,
  count(*) FILTER (WHERE pending > 0) AS coalesced, """, R9.format("avg(pending)"), " AS mean_staleness, max(pending) AS max_staleness, ", R9.format("quantile_cont(pending, 0.95)"), " AS p95_staleness, true AS conserved FROM s GROUP BY ROLLUP (phase)"),
    "policy_suite": sql(RAW, PHASED, r""",
k AS (SELECT *
  FROM (VALUES ('exact_fresh', 1, 1), ('static_5', 5, 5), ('static_20', 20, 20), ('adaptive_16', 1, 16), ('adaptive_20', 1, 20)) t(config, lo, hi)),
m AS (SELECT key, place, phase, row_number() OVER (PARTITION BY key ORDER BY place) AS rn FROM tr),
e AS (SELECT config, key, rn, phase, CAST(CASE WHEN lo + CAST(floor(CASE phase WHEN 'stress' THEN 0.85e0 ELSE 0.1e0 END * (hi - lo)) AS BIGINT) <= 1 THEN 0 ELSE 1 END AS BIGINT) AS pending
  FROM m, k WHERE rn = 1
      UNION ALL SELECT k.config, m.key, m.rn, m.phase,
  CASE WHEN e.pending + 1 >= lo + CAST(floor(CASE m.phase WHEN 'stress' THEN 0.85e0 ELSE 0.1e0 END * (hi - lo)) AS BIGINT) THEN 0 ELSE e.pending + 1 END
      FROM e JOIN k ON k.config = e.config JOIN m ON m.key = e.key AND m.rn = e.rn + 1)
SELECT config, phase, count(*) AS events, count(*) FILTER (WHERE pending = 0) AS publications, """, R9.format("avg(pending)"), " AS mean_staleness FROM e GROUP BY config, phase"),
    "cyclic_padding": sql(RAW, ", d AS (SELECT seq, key, row_number() OVER (ORDER BY seq) - 1 AS rank FROM ev), n AS (SELECT count(*) AS m"
        " FROM d) SELECT p AS place, seq, key FROM n, range((SELECT m * 5 // 2 FROM n)) t(p) JOIN d ON d.rank = p % m"),
    "streaming_metrics": sql(RAW, r""",
q AS (SELECT seq, event_ts_ns AS qt, event_ts_ns - (seq % 7) * 1000000 AS ft, CAST(seq % 11 AS DOUBLE) AS lat FROM raw
  WHERE behavior IS NULL)
SELECT (SELECT count(*) FROM q) / CAST((SELECT count(*) FROM q) AS DOUBLE) AS coverage, CAST((SELECT count(*) FROM ev
  WHERE seq % 4 = 0) AS DOUBLE) / (SELECT count(*) FROM ev) AS write_work_ratio, true AS conserved,
  count(*) AS n_queries, """,
        R9.format("avg(greatest(0, qt - ft) / 1e6)"), " AS mean_staleness_ms, max(greatest(0, qt - ft) / 1e6) AS max_staleness_ms, ", R9.format("avg(CAST(lat <= 8 AS INTEGER))"), " AS deadline_utility FROM q"),
    "temporal_leaks": sql(RAW, " SELECT CAST(seq AS VARCHAR) AS query_id, CAST(1000000 AS BIGINT) AS leak_ns FROM raw"
        " WHERE behavior IS NULL AND seq % 13 = 0"),
    "mean_scores": sql(FEATURES, ", u AS (SELECT seq, score * (1 + r * 0.01e0) AS s FROM sc, range(5) t(r))"
        " SELECT CAST(seq AS VARCHAR) AS sample_id, ", R9.format("avg(s)"), " AS score, count(*) AS n_runs FROM u GROUP BY seq"),
    "pressure_maps": sql(RAW, ", k AS (SELECT key, (count(*) % 29 - 4) / 20e0 AS p FROM ev GROUP BY key) "
        "SELECT key, p AS pressure, CAST(least(greatest(1 + CAST(floor(least(greatest(p, 0e0), 1e0) * 15e0) AS BIGINT), 1), 16) AS INTEGER) AS cadence, 0.02e0 + 0.28e0 * least(greatest(p, 0e0), 1e0) AS alpha FROM k"),
    "hourly_counts": sql(RAW, " SELECT event_ts_ns // 3600000000000 * 3600 AS hour_s, code AS behavior_code, count(*) AS n FROM ev GROUP BY ALL"),
    "train_logistic": sql(FEATURES, LABELS.removeprefix(RAW), SPLITS_ONLY, r""",
ex AS (
  SELECT CAST(c.label AS DOUBLE) AS label, f.x0, f.x1, f.x2, f.x3, f.x4, f.x5, f.x6 FROM cohort c JOIN f ON f.seq = c.seq
  WHERE split = 'train' AND c.label IS NOT NULL),
""", _newton("logistic", 7), ",\n", _newton("x0_only", 1), r""",
models AS (
  SELECT * FROM logistic UNION ALL SELECT * FROM x0_only
  UNION ALL SELECT 'prior', ln(avg(label) / (1 - avg(label))), 0, 0, 0, 0, 0, 0, 0 FROM ex),
zs AS (
  SELECT m.*, label, b0 + b1 * x0 + b2 * x1 + b3 * x2 + b4 * x3 + b5 * x4 + b6 * x5 + b7 * x6 AS z FROM models m, ex),
ob AS (
  SELECT model, count(*) AS n, avg(greatest(z, 0e0) - label * z + ln(1 + exp(-abs(z)))) +
    1e-4 / 2 * any_value(b1 * b1 + b2 * b2 + b3 * b3 + b4 * b4 + b5 * b5 + b6 * b6 + b7 * b7) AS objective FROM zs GROUP BY model)
SELECT model, n, """, R6.format("objective"), " AS objective, ", R6.format("b0"), " AS bias, ", ", ".join(f"{R6.format(f'b{i + 1}')} AS w{i}" for i in range(7)), " FROM models JOIN ob USING (model)"),
    "stream_run_receipt": sql(COUNTED, r""",
p AS (SELECT *, CAST(seq * 2 // (1 + (SELECT max(seq) FROM c)) AS INTEGER) AS part FROM c)
SELECT part, count(*) AS read, count(*) AS extracted, count(*) AS scored, count(*) AS written, count(*) FILTER (WHERE rn % 4 = 0) AS published,
  count(*) FILTER (WHERE rn % 4 <> 0) AS coalesced, CAST(sum(count(*) FILTER (WHERE rn = 1)) OVER (ORDER BY part) AS BIGINT) AS keys
  FROM p GROUP BY part"""),
    "stream_hourly_ledger": sql(RAW, r""",
m AS (SELECT max(event_ts_ns) FILTER (WHERE key % 7 <> 0) - 3600000000000 AS first, max(event_ts_ns) - 3600000000000 AS last FROM ev),
h AS (SELECT *, event_ts_ns // 3600000000000 * 3600 AS hour_s FROM ev)
SELECT CASE WHEN key % 7 = 0 AND (hour_s + 3600) * 1000000000 <= first THEN 'late'
            WHEN (hour_s + 3600) * 1000000000 <= last THEN 'closed' ELSE 'open' END AS kind,
  hour_s, code AS behavior_code, count(*) AS n FROM h, m GROUP BY ALL"""),
    "controller_actions": sql(COUNTED, ", d AS (SELECT key, seq, sign(code - lag(code) OVER (PARTITION BY key ORDER BY seq)) AS d FROM c), "
        "e AS (SELECT key, d, d <> lag(d) OVER (PARTITION BY key ORDER BY seq) AS t FROM d WHERE d <> 0) SELECT key, "
        "count(*) FILTER (WHERE d > 0) AS increases, count(*) FILTER (WHERE d < 0) AS decreases, "
        "count(*) FILTER (WHERE t) AS turns FROM e GROUP BY key"),
    "factorial_effects": sql(COUNTED, ", m AS (SELECT " + ", ".join(f"avg(gap_s) FILTER (WHERE seq % 2 = {i} AND item_id % 2 = {j}) AS m{i}{j}" for i in (0, 1) for j in (0, 1)) + " FROM c) SELECT ", ", ".join(f"{R6.format(x)} AS {n}" for n, x in (("m00", "m00"), ("m10", "m10"), ("m01", "m01"), ("m11", "m11"), ("effect_a", "(m10 + m11 - m00 - m01) / 2"), ("effect_b", "(m01 + m11 - m00 - m10) / 2"), ("synergy", "m11 - m10 - m01 + m00"))), " FROM m"),
    "policy_signatures": sql(COUNTED, ", "
        "o AS (SELECT cadence, CAST(sum(CASE WHEN rn % cadence = 0 THEN 1 ELSE 0 END) AS BIGINT) AS publications, CAST(sum(rn % cadence) AS BIGINT) AS staleness"
        " FROM c, (VALUES (1), (4), (9)) t(cadence) GROUP BY cadence) SELECT cadence, publications, staleness, "
        "count(*) OVER (PARTITION BY publications, staleness) = 1 AS \"distinct\" FROM o"),
    "budget_match": sql(COUNTED, ", t AS (SELECT count(*) FILTER (WHERE rn % 5 = 0) AS a, count(*) AS n FROM c), u AS (SELECT a, a AS b FROM t)"
        " SELECT a, b, "
        "abs(a - b) AS difference, CAST(abs(a - b) AS DOUBLE) / greatest(1, a) AS relative, CAST(abs(a - b) AS DOUBLE) / greatest(1, a) <= 0.01 AS matched"
        " FROM u"),
    "dispositions": sql(RAW, " SELECT coalesce(behavior, 'served') AS disposition, count(*) AS n FROM raw GROUP BY 1"),
    "engine_replay": sql(COUNTED.replace("AS wt\n", "AS wt, 2e-2 + 28e-2 * least(greatest((seq % 29 - 4) / 20e0, 0e0), 1e0) AS step\n"), AVERAGED.replace("{step}", "c.step"), r""",
u AS (SELECT key, min(seq) AS since FROM f WHERE seq % 307 = 0 OR seq % 401 = 0 GROUP BY key),
e AS (SELECT f.*, coalesce(seq < since, true) AS known FROM f LEFT JOIN u ON u.key = f.key),
told AS (SELECT * FROM e WHERE seq % 307 <> 0),
x AS (
  SELECT seq, 'missing' AS rule, CAST(NULL AS DOUBLE) AS told, CAST(NULL AS DOUBLE) AS due FROM e WHERE seq % 307 = 0
  UNION ALL SELECT seq, 'twice', 2, 1 FROM told WHERE seq % 229 = 0
  UNION ALL SELECT seq + 1000000000, 'phantom', NULL, NULL FROM told WHERE seq % 233 = 0
  UNION ALL SELECT seq, 'alpha_used', 1.5, NULL FROM told WHERE seq % 401 = 0
  UNION ALL SELECT seq, 'x0', x0 + 1e-3, x0 FROM told WHERE seq % 211 = 0 AND known
  UNION ALL SELECT seq, 'x1', x1 + 1e-3, x1 FROM told WHERE seq % 199 = 0
  UNION ALL SELECT seq, 'item_id', item_id + 1, item_id FROM told WHERE seq % 193 = 0
  UNION ALL SELECT seq, 'latency_ns', 1000005, 1000000 FROM told WHERE seq % 223 = 0
  UNION ALL SELECT seq, 'pressure_sampled_ns', (event_ts_ns + 100001) / 1e9, (event_ts_ns + 100000) / 1e9 FROM told WHERE seq % 197 = 0)
SELECT seq, rule, """, R6.format("told"), " AS told, ", R6.format("due"), " AS due FROM x"),
    "diagnostic_replay": sql(FEATURES, " SELECT seq, 'x0' AS \"column\", " + R6.format("x0") + " AS a, " + R6.format("x0 + 1e-3") + " AS b FROM f WHERE seq % 211 = 0"),
    "paired_sign_flip": sql(COMPARED, r""",
m AS (
  SELECT row_number() OVER (ORDER BY group_id) - 1 AS i, sum(d) / count(*) AS d
  FROM pairs WHERE candidate = 'slow_static' AND base = 'exact_fresh' GROUP BY group_id),
zc AS (SELECT count(*) AS c FROM m),
k AS (SELECT s, abs(sum(CASE WHEN (s >> i) % 2 = 1 THEN -d ELSE d END) / any_value(c)) AS v FROM m, zc,
  range(65536) t(s) WHERE s < 1 << c GROUP BY s)
SELECT CAST((SELECT c FROM zc) AS INTEGER) AS n_clusters, """, R9.format("(SELECT avg(d) FROM m)"), r""" AS mean_difference,
  CAST(count(*) FILTER (WHERE v >= (SELECT abs(avg(d)) FROM m) * (1 - 1e-12)) AS DOUBLE) / (SELECT 1 << c
  FROM zc) AS p_value, true AS exact FROM k"""),
    "paired_groups": sql(COMPARED, r""",
x AS (

  SELECT *, (a - label) * (a - label) - (b - label) * (b - label) AS sq, CAST(a >= 0.5e0 AS INTEGER) AS ca, CAST(b >= 0.5e0 AS INTEGER) AS cb
  FROM pairs WHERE candidate = 'slow_static' AND base = 'exact_fresh'),
clusters AS (
  SELECT 'log_loss' AS candidate, 'x' AS base, group_id, -sum(d) AS d, count(*) AS n FROM x GROUP BY group_id
  UNION ALL SELECT 'brier', 'x', group_id, -sum(sq), count(*) FROM x GROUP BY group_id)""", SWAPPED, r""",
fc AS (
  SELECT row_number() OVER (ORDER BY group_id) - 1 AS i, sum(ca * label) AS ta, sum(ca) AS na, sum(cb * label) AS tb,
  sum(cb) AS nb, sum(label) AS pos
  FROM x GROUP BY group_id),
fs AS (
  SELECT p, sum(CASE WHEN (p >> i) % 2 = 1 THEN tb ELSE ta END) AS ta, sum(CASE WHEN (p >> i) % 2 = 1 THEN nb ELSE na END) AS na,
         sum(CASE WHEN (p >> i) % 2 = 1 THEN ta ELSE tb END) AS tb,
  sum(CASE WHEN (p >> i) % 2 = 1 THEN na ELSE nb END) AS nb, sum(pos) AS pos
  FROM fc, range(4096) r(p) WHERE p < 1 << (SELECT count(*) FROM fc) GROUP BY p),
fv AS (SELECT p, 2e0 * ta / greatest(1, na + pos) - 2e0 * tb / greatest(1, nb + pos) AS v FROM fs),
fo AS (SELECT v AS effect FROM fv WHERE p = 0),
gi AS (SELECT group_id, row_number() OVER (ORDER BY group_id) - 1 AS i FROM x GROUP BY group_id),
ce AS (
  SELECT i, label, 0 AS side, a AS s, count(*) AS n FROM x JOIN gi USING (group_id) GROUP BY ALL
  UNION ALL SELECT i, label, 1, b, count(*) FROM x JOIN gi USING (group_id) GROUP BY ALL),
ra AS (
  SELECT p, ((p >> i) + side) % 2 AS arm, s, CAST(sum(n * label) AS BIGINT) AS pos, CAST(sum(n) AS BIGINT) AS n
  FROM ce, range(4096) r(p) WHERE p < 1 << (SELECT count(*) FROM gi) GROUP BY ALL),
rb AS (
  SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen FROM ra
  WINDOW w AS (PARTITION BY p, arm ORDER BY s DESC ROWS UNBOUNDED PRECEDING)),
rc AS (
  SELECT p, arm, sum(pos) AS np, sum(n - pos) AS nq, sum(CAST(pos AS DOUBLE) * (2 * (seen - tp) - (n - pos))) AS lost,
         sum(pos * CAST(tp AS DOUBLE) / CAST(seen AS DOUBLE)) AS hit
  FROM rb GROUP BY p, arm),
rd AS (
  SELECT p, unnest([{'m': 'auroc', 'v': 1e0 - lost / (2e0 * CAST(np AS DOUBLE) * CAST(nq AS DOUBLE))},
    {'m': 'average_precision', 'v': hit / CAST(np AS DOUBLE)}], recursive := true), arm FROM rc),
rv AS (SELECT m, p, sum(CASE WHEN arm = 0 THEN v ELSE -v END) AS v FROM rd GROUP BY m, p),
ro AS (SELECT m, v AS effect FROM rv WHERE p = 0),
u AS (
  SELECT candidate AS metric, effect, p AS p_value, k AS n_clusters FROM pv
  UNION ALL SELECT 'f1',
  any_value(effect), CAST(count(*) FILTER (WHERE abs(v) >= abs(effect) * (1 - 1e-12) - 5e-324) AS DOUBLE) / count(*), (SELECT count(*)
  FROM fc) FROM fv, fo
  UNION ALL SELECT m, any_value(effect), CAST(count(*) FILTER (WHERE abs(v) >= abs(effect) * (1 - 1e-12) - 1e-15) AS DOUBLE) / count(*),
  (SELECT count(*) FROM gi) FROM rv JOIN ro USING (m) GROUP BY m)
SELECT metric, """, R9.format("effect"), " AS effect, p_value, CAST(n_clusters AS INTEGER) AS n_clusters, true AS exact, false AS stratified FROM u"),
    "config_metrics": sql(COMPARED, r""",
g AS (SELECT config, score AS s, CAST(sum(label) AS BIGINT) AS pos, count(*) AS n FROM te GROUP BY config, score),
g2 AS (
  SELECT *, coalesce(sum(n - pos) OVER (PARTITION BY config
  ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
         sum(pos) OVER (PARTITION BY config ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS tp,
  sum(n) OVER (PARTITION BY config ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS seen FROM g),
g3 AS (
  SELECT config, sum(pos) AS p, sum(n - pos) AS q, sum(pos * (2 * below + n - pos)) AS u2,
  sum(pos * CAST(tp AS DOUBLE) / CAST(seen AS DOUBLE)) AS a,
         CAST(sum(n) AS BIGINT) AS n FROM g2 GROUP BY config),
l AS (
  SELECT config, avg(loss - fresh_loss) AS mean_gap, quantile_cont(loss - fresh_loss, 0.95) AS p95_gap,
  max(loss - fresh_loss) AS max_gap FROM te GROUP BY config)
SELECT config, n, """, R9.format("CAST(u2 AS DOUBLE) / (2e0 * CAST(p AS DOUBLE) * CAST(q AS DOUBLE))"), " AS auroc, ", R9.format("a / CAST(p AS DOUBLE)"), " AS ap, ",
        ", ".join(f"{R9.format(x)} AS {x}" for x in ("mean_gap", "p95_gap", "max_gap")), " FROM g3 JOIN l USING (config)"),
    "comparative_suite": sql(COMPARED, r""",
clusters AS (
  SELECT candidate, base, group_id, -sum(d) AS d, count(*) AS n FROM pairs
  WHERE base = 'exact_fresh' OR candidate = 'slow_static' AND base = 'tuned_static' GROUP BY ALL)""", SWAPPED, r""",
e AS (SELECT candidate, base, count(*) AS n, avg(d) AS effect FROM pairs GROUP BY 1, 2),
tested AS (SELECT p.* FROM pairs p JOIN (SELECT DISTINCT candidate, base FROM clusters) c ON c.candidate = p.candidate AND c.base = p.base),
signs AS (SELECT DISTINCT seq, sha256('13:' || seq || ':0') AS hex FROM tested),
bits AS (
  SELECT seq, draw, ((strpos('0123456789abcdef', substr(hex, 1 + CAST(draw // 4 AS INTEGER), 1)) - 1) >> CAST(3 - draw % 4 AS INTEGER)) % 2 AS bit
  FROM signs CROSS JOIN range(200) r(draw)),
flipped AS (
  SELECT candidate, base, draw, sum(CASE WHEN bit = 1 THEN d ELSE -d END) AS v, sum(d) AS o
  FROM tested t JOIN bits b ON b.seq = t.seq GROUP BY 1, 2, 3),
rp AS (SELECT candidate, base, (count(*) FILTER (WHERE abs(v) >= abs(o) * (1 - 1e-12)) + 1) / 201e0 AS p FROM flipped GROUP BY 1, 2),
h AS (
  SELECT e.candidate, e.base, e.n, e.effect, pv.k, pv.p, rp.p AS p1,
         CASE WHEN e.base = 'tuned_static' THEN 2 WHEN e.candidate = 'tuned_static' THEN 0 ELSE 1 END AS id
  FROM pv JOIN e ON e.candidate = pv.candidate AND e.base = pv.base JOIN rp ON rp.candidate = pv.candidate AND rp.base = pv.base),
hr AS (
  SELECT *, least(1e0, p * (count(*) OVER () - row_number() OVER (ORDER BY p, id) + 1)) AS w,
         least(1e0, p1 * (count(*) OVER () - row_number() OVER (ORDER BY p1, id) + 1)) AS w1 FROM h),
j AS (
  SELECT *, max(w) OVER (ORDER BY p, id ROWS UNBOUNDED PRECEDING) AS adjusted,
         max(w1) OVER (ORDER BY p1, id ROWS UNBOUNDED PRECEDING) AS adjusted1 FROM hr)
SELECT candidate, base, n, """, R9.format("effect"), " AS effect, CAST(k AS INTEGER) AS n_clusters, ", R9.format("p"), " AS p_clusters, ", R9.format("adjusted"),
        " AS adjusted_clusters, adjusted <= 1e0 - 0.95e0 AS significant_clusters, ", R9.format("p1"), " AS p_rows, ", R9.format("adjusted1"),
        " AS adjusted_rows, adjusted1 <= 1e0 - 0.95e0 AS significant_rows FROM j"),
    "evaluated_with_default": sql(FEATURES, LABELS.removeprefix(RAW), SPLITS_ONLY, r"""
SELECT c.seq, c.user_id, c.label, CASE WHEN c.seq % 2 = 0 THEN sc.score ELSE 0.1225e0 END AS score FROM cohort c
  JOIN sc ON sc.seq = c.seq WHERE split = 'test'"""),
    "validation_events": sql(SPLITS, r"""
SELECT c.seq, c.user_id AS key, c.event_ts_ns FROM cohort c
  WHERE split = 'validation' AND event_ts_ns // 1000000000 BETWEEN 1705449600 AND 1705881599
  ORDER BY c.seq LIMIT 1000"""),
}
