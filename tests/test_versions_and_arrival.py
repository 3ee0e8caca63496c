"""The version store between runs and writers, order of arrival, groups that are null, sizes of clusters."""

import math

import pytest

from keyloom.functions import running
from keyloom.functions.columns import FEATURES
from keyloom.operators import inference, metrics
from keyloom.sources import events as src
from keyloom.sources import versions


def published(spark, rows):
    """(key, seq) pairs; features tell which one it was."""
    return spark.createDataFrame([(k, s, 10 * s, *[float(s + i) for i in range(7)]) for k, s in rows], "key long, seq long, event_ts_ns long, " + ", ".join(f"{x} double" for x in FEATURES))


def plain(batches):
    out = {}
    for batch in batches:
        for k, s in sorted(batch, key=lambda x: x[1]):
            out[k] = (out[k][0] + 1 if k in out else 1, s)
    return out


def held(store):
    return {r["key"]: (r["version_id"], r["latest_included_seq"]) for r in store.latest().collect()}


BATCHES = [[(1, 1), (2, 2), (1, 3)], [(2, 4), (3, 5)], [(1, 6), (1, 7), (4, 8)]]


def test_versions_go_on_from_run_to_run(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    assert versions.VersionStore(spark, path, 4).latest().count() == 0
    for i, b in enumerate(BATCHES):
        made = versions.VersionStore(spark, path, 4).commit(published(spark, b))
        assert made.number == i + 1 and made.total_publications == sum(map(len, BATCHES[: i + 1]))
    store = versions.VersionStore(spark, path, 4)
    assert held(store) == plain(BATCHES) and store.snapshot().size == 4
    before = store.snapshot()
    assert len(store.compact().parts) == 1 and held(store) == plain(BATCHES) and store.snapshot().total_publications == 8
    assert {r["key"]: r["version_id"] for r in store.latest(before).collect()} == {k: v for k, (v, _) in plain(BATCHES).items()}  # a reader of the old one
    assert store.commit(published(spark, [])) == store.snapshot()
    store.clear()
    assert held(store) == {} and store.snapshot().total_publications == 0
    store.commit(published(spark, [(1, 9)]))
    assert held(store) == {1: (1, 9)}


def test_many_keys_in_many_parts(spark, tmp_path):
    store = versions.VersionStore(spark, f"file://{tmp_path}/store", 4)
    for i in range(3):
        store.commit(published(spark, [(k, 1000 * i + k) for k in range(200)]))
    assert held(store) == {k: (3, 2000 + k) for k in range(200)}
    asked = {r["key"]: r["version_id"] for r in store.lookup(spark.range(0, 300, 1, 5).withColumnRenamed("id", "key")).collect()}
    assert asked == {k: 3 if k < 200 else None for k in range(300)}


def test_of_two_writers_none_is_lost(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    a, b = (versions.VersionStore(spark, path, 4) for _ in range(2))
    a.commit(published(spark, BATCHES[0]))
    write, late = a._write, [BATCHES[1]]

    def slow(rows):
        part = write(rows)
        if late:
            b.commit(published(spark, late.pop()))  # the other one commits while this one has yet to take its number
        return part

    a._write = slow
    a.commit(published(spark, BATCHES[2]))
    assert a.conflicts == 1 and held(a) == held(b) == plain(BATCHES) and a.snapshot().number == 3
    assert a.snapshot().size == 4 and a.snapshot().total_publications == 8


def test_a_budget_of_keys_keeps_nothing(spark, tmp_path):
    store = versions.VersionStore(spark, f"file://{tmp_path}/store", 4, max_keys=3)
    store.commit(published(spark, BATCHES[0]))
    with pytest.raises(versions.KeyBudget, match="4 keys"):
        store.commit(published(spark, [(5, 10), (6, 11)]))
    assert held(store) == plain(BATCHES[:1]) and store.snapshot().number == 1


def test_a_lookup_does_not_shuffle_the_store(spark, tmp_path):
    store = versions.VersionStore(spark, f"file://{tmp_path}/store", 4)
    for b in BATCHES[:2]:
        store.commit(published(spark, b))
    queries = spark.createDataFrame([(0, 1), (1, 9), (2, 2), (3, 2), (4, None)], "query_id long, key long")
    got = store.lookup(queries)
    want = plain(BATCHES[:2])
    assert {r["query_id"]: (r["cold_start"], r["version_id"], r["latest_included_seq"]) for r in got.collect()} == {0: (False, *want[1]), 1: (True, None, None), 2: (False, *want[2]), 3: (False, *want[2]), 4: (True, None, None)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("Exchange hashpartitioning") == 1 and final.count("SortMergeJoin") == 2  # the queries, once


def lines(path, rows, header="seq,event_ts_ns,key,item_id,category_id,behavior_code"):
    path.write_text("\n".join([header, *rows]) + "\n")
    return str(path)


@pytest.fixture
def splits(spark):
    """Files are read in splits of about a kilobyte."""
    names = {"spark.sql.files.maxPartitionBytes": "1000", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_order_of_arrival_over_splits(spark, splits, tmp_path):
    rows = [f"{i},{i // 3 * 1000},{i % 5},1,2,{i % 4}" for i in range(400)]
    good = src.read_events_csv(spark, lines(tmp_path / "good.csv", rows))
    assert good.rdd.getNumPartitions() > 3 and good.count() == 400
    for name, at in (("inside", 7), ("later", 333)):
        swapped = [*rows[:at], rows[at + 1], rows[at], *rows[at + 2 :]]
        with pytest.raises(ValueError, match="out of order"):
            src.read_events_csv(spark, lines(tmp_path / f"{name}.csv", swapped))
    assert src.read_events_csv(spark, str(tmp_path / "later.csv"), ordered=False).count() == 400
    for at in range(1, 400, 7):  # wherever the splits meet: the second half comes first
        turned = [*rows[at:], *rows[:at]]
        told = src.arrival_faults(spark.read.schema(src.EVENT).option("header", True).csv(lines(tmp_path / f"turned{at}.csv", turned))).first()
        assert told["seq_does_not_rise"] == 1 and told["time_falls"] <= 1
        if at > 60:
            break


def test_the_first_lines_of_a_raw_file(spark, splits, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text("".join(f"{(i * 37) % 101},{i},3,pv,{1_700_000_000 - i}\n" for i in range(300)))
    for n in (0, 1, 77, 300, 500):
        got = src.read_raw_csv(spark, str(path), n)
        assert sorted(r["item_id"] for r in got.collect()) == list(range(min(n, 300)))


def test_the_first_rows_need_no_single_task(spark):
    rows = spark.range(0, 5000, 1, 5).selectExpr("id * 7919 % 5003 as x", "id")
    want = sorted(r["x"] for r in rows.collect())
    for n in (0, 1, 1234, 5000, 9000):
        got = running.first(rows, ["x"], n)
        assert sorted(r["x"] for r in got.collect()) == want[:n]
    assert "SinglePartition" not in running.first(rows, ["x"], 1234)._jdf.queryExecution().executedPlan().toString()


def test_domains_of_an_event_file(spark, tmp_path):
    for i, row in enumerate(("0,0,1,1,1,9", "0,0,1,1,1,-1", "-1,0,1,1,1,1", "0,0,-1,1,1,1")):
        with pytest.raises(Exception, match="domain|out of order"):
            src.read_events_csv(spark, lines(tmp_path / f"bad{i}.csv", [row])).collect()
    equal = lines(tmp_path / "equal.csv", ["1,5,1,1,1,0", "1,6,1,1,1,0"])
    with pytest.raises(ValueError, match="seq_does_not_rise"):
        src.read_events_csv(spark, equal)
    assert src.read_events_csv(spark, lines(tmp_path / "none.csv", [])).count() == 0


def test_a_row_like_the_header_is_a_row(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b\n1,2\na,b\n3,4\n")
    assert sorted(tuple(r) for r in src.read_table_csv(spark, str(path), ["a", "b"]).collect()) == [("1", "2"), ("3", "4"), ("a", "b")]


def test_a_null_group_is_a_group(spark):
    rows = [(g, y, s) for g in ("a", None) for y, s in ((1, 0.9), (0, 0.2), (1, 0.4), (0, 0.5))]
    df = spark.createDataFrame(rows, "g string, label int, score double")
    assert {r["g"]: r["auroc"] for r in metrics.ranking(df, by=("g",)).collect()} == {"a": 0.75, None: 0.75}
    assert {r["g"]: r["m"] for r in metrics.quantiles(df, "score", {"m": 0.5}, ("g",)).collect()} == {"a": pytest.approx(0.45), None: pytest.approx(0.45)}
    assert {r["g"]: (r["n"], r["max"], r["p50"]) for r in metrics.summary(df, "score", ("g",)).collect()} == {g: (4, 0.9, pytest.approx(0.45)) for g in ("a", None)}
    assert {r["g"]: r["upper_median"] for r in metrics.upper_median(df, "score", ("g",)).collect()} == {"a": 0.5, None: 0.5}
    assert {r["g"]: r["n"] for r in metrics.loss_gap(df.withColumn("b", df.score), "score", "b", by=("g",)).collect()} == {"a": 4, None: 4}


def test_intervals_of_clusters_of_many_sizes(spark):
    rows = spark.range(1, 700).selectExpr("id as g", "explode(sequence(1, id)) as i").selectExpr("g", "(i * 7 % 11) / 10.0d as d")
    got = {r["g"]: r for r in inference.student_interval(rows, "d", by=("g",)).collect()}
    assert len(got) == 699 and got[1]["low"] == got[1]["high"] == got[1]["effect"]
    for n in (2, 5, 699):
        d = [i * 7 % 11 / 10 for i in range(1, n + 1)]
        mean = sum(d) / n
        sd = math.sqrt(sum((x - mean) ** 2 for x in d) / (n - 1))
        assert got[n]["high"] - mean == pytest.approx(inference.student_t_critical(0.05, n - 1) * sd / math.sqrt(n))
