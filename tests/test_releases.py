"""Releases: complete or none, conserved, never over another; loads of raw and canonical files; strings without folders."""

import json

import pytest
from pyspark.sql import functions as F

from keyloom.functions import columns as C
from keyloom.operators import canonical, releases, workload
from keyloom.sources import events as src

S = canonical.CAMPAIGN[0]
RAW = "event_ts_ns long, key long, item_id long, category_id long, behavior string"


def raw(spark, n=40):
    rows = [((S + i // 2) * C.NS, i % 3, 1, 1, ("pv", "buy")[i % 2]) for i in range(n)]
    return spark.createDataFrame([*rows, rows[0], (5, 1, 1, 1, "pv"), (S * C.NS, 1, 1, 1, None)], RAW)


def test_events(spark, tmp_path):
    path = f"file://{tmp_path}/events"
    told = releases.publish_events(raw(spark), path)
    assert told["ledger"]["emitted"] == 40 and told["ledger"]["duplicates"] == 1 and told["rows"] == {"events": 40} and releases.accounting(spark, path) == told
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(releases.events_of(spark, path)) == key(canonical.canonical(raw(spark)))
    with pytest.raises(Exception, match="exist"):
        releases.publish_events(raw(spark), path)
    (next((tmp_path / "events/events").glob("part-*.csv"))).unlink()
    with pytest.raises(releases.NotConserved):
        releases.events_of(spark, path)


def test_no_release_without_accounting(spark, tmp_path):
    path = f"file://{tmp_path}/half"
    raw(spark).write.csv(f"{path}/events")
    with pytest.raises(FileNotFoundError):
        releases.events_of(spark, path)
    empty = releases.publish_events(raw(spark).limit(0), f"file://{tmp_path}/empty")
    assert empty["rows"] == {"events": 0} and releases.events_of(spark, f"file://{tmp_path}/empty").count() == 0
    with pytest.raises(KeyError):
        releases.read_release(spark, f"file://{tmp_path}/empty", "labels")


def test_labels(spark, tmp_path):
    events = canonical.canonical(raw(spark))
    path, end = f"file://{tmp_path}/labels", (S + 19) * C.NS
    told = releases.publish_labels(events, path, 5 * C.NS, end)["manifest"]
    got = releases.labels_of(spark, path)
    assert told["total"] == 40 == told["evaluated"] + told["censored"] and told["censored"] == got.filter("label is null").count() > 0
    assert got.filter("label = 1").filter("positive_witness_seq is null").isEmpty()
    with pytest.raises(releases.NotConserved):
        releases.publish_labels(events.unionByName(events.limit(1)).withColumn("seq", F.rand()).withColumn("seq", F.lit(None).cast("long")), f"file://{tmp_path}/bad", 5 * C.NS, end)


def test_run(spark, tmp_path):
    made = spark.createDataFrame([(i, i % 2, 0.1 + 0.2, i % 4 == 3) for i in range(8)], "seq long, key long, score double, published boolean")
    asked = [("a", 100, 40, 1.0), ("b", 100, None, None), ("c", 100, 100, 9.0)]
    queries = lambda rows: spark.createDataFrame(rows, "query_id string, query_ts_ns long, feature_ts_ns long, latency_ms double")
    path = f"file://{tmp_path}/run"
    told = releases.publish_run(made, queries(asked), path, ["key", "seq", "score"], 8.0)
    assert told["telemetry"] == {"events_processed": 8, "writes_emitted": 2, "events_absorbed": 6, "queries_offered": 3, "queries_answered": 2}
    assert told["result"]["coverage"] == 2 / 3 and told["result"]["deadline_utility"] == 2 / 3 and told["result"]["write_work_ratio"] == 0.25
    rows = releases.read_release(spark, path, "predictions", "key long, seq long, score double")
    assert rows.columns == ["key", "seq", "score"] and {r["score"] for r in rows.collect()} == {0.1 + 0.2}
    with pytest.raises(releases.NotConserved, match="later feature"):
        releases.publish_run(made, queries([("a", 100, 101, 1.0)]), f"file://{tmp_path}/late", ["seq"], 8.0)


def test_tables(spark, tmp_path):
    path = f"file://{tmp_path}/report"
    releases.publish_tables(spark, path, {"b": spark.createDataFrame([(2, [1]), (1, None)], "i int, l array<int>"), "a": spark.range(0)})
    assert json.loads((tmp_path / "report/release.json").read_text()) == {"rows": {"a": 0, "b": 2}, "tables": {"a": [], "b": [{"i": 1, "l": None}, {"i": 2, "l": [1]}]}}
    with pytest.raises(ValueError, match="more than"):
        releases.publish_tables(spark, f"{path}2", {"x": spark.range(releases.MOST_ROWS + 1)})
    with pytest.raises(FileExistsError):
        releases.publish_tables(spark, path, {})


def test_load_by_the_first_line(spark, tmp_path):
    times = [S + i for i in range(10)]
    head = "seq,event_ts_ns,key,item_id,category_id,behavior_code\n"
    (tmp_path / "canonical.csv").write_text(head + "".join(f"{3 * i},{t * C.NS},{i % 2},7,8,{i % 4}\n" for i, t in enumerate(times)))
    (tmp_path / "raw.csv").write_text("".join(f"{i % 2},7,8,{('pv', 'cart', 'fav', 'buy')[i % 4]},{t}\n" for i, t in enumerate(times)))
    window = (S + 2, S + 5, S + 6)
    for name, numbers in (("canonical.csv", [6, 9, 12, 15]), ("raw.csv", [2, 3, 4, 5])):
        got = workload.validation_load(spark, str(tmp_path / name), *window, 6).orderBy("place").collect()
        assert [r["place"] for r in got] == list(range(6)) and [r["seq"] for r in got] == [*numbers, *numbers[:2]]
        assert [r["behavior_code"] for r in got] == [2, 3, 0, 1, 2, 3] and [r["event_ts_ns"] for r in got][:4] == [t * C.NS for t in times[2:6]]
        assert workload.validation_load(spark, str(tmp_path / name), *window, 3).count() == 3
        with pytest.raises(ValueError, match="no events"):
            workload.validation_load(spark, str(tmp_path / name), S + 20, S + 30, S + 40, 3)
    cohort = spark.createDataFrame([(9, "validation"), (12, "train"), (15, "validation")], "seq long, split string")
    assert [r["seq"] for r in workload.validation_load(spark, str(tmp_path / "canonical.csv"), *window, 3, cohort).orderBy("place").collect()] == [9, 15, 9]


def test_raw_lines_keep_their_place(spark, tmp_path):
    (tmp_path / "raw.csv").write_text("1,2,3,pv,10\n4,5,6,buy,9\n")
    got = src.read_raw_csv(spark, str(tmp_path / "raw.csv"), placed=True).orderBy("file", "block", "line")
    assert [r["user_id"] for r in got.collect()] == [1, 4] and src.read_raw_csv(spark, str(tmp_path / "raw.csv")).columns == [f.name for f in src.RAW]
    assert src.read_raw_csv(spark, str(tmp_path / "raw.csv"), 1, placed=True).count() == 1


def test_folders_go_from_every_depth(spark, tmp_path):
    record = {"a.b": "/x/y/z", "deep": [{"m": {"/k/l": "see /p/q/r.csv"}, "n": None}, None], "n": 3, "none": None}
    kind = "`a.b` string, deep array<struct<m:map<string,string>,n:string>>, n int, none string"
    got = C.redacted(spark.createDataFrame([tuple(record.values())], kind)).first().asDict(recursive=True)
    assert got == {"a.b": "z", "deep": [{"m": {"/k/l": "see r.csv"}, "n": None}, None], "n": 3, "none": None}
    (tmp_path / "x.json").write_text(json.dumps({"outer": {"inner": ["/home/me/file", "plain"]}}))
    assert C.redacted(spark.read.json(str(tmp_path / "x.json"))).first()["outer"]["inner"] == ["file", "plain"]
