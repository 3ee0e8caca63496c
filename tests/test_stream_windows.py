"""Windows of event time on a stream whose files come late, beside a batch."""

import random

from pyspark.sql import functions as F

from keyloom.sources import events as src
from keyloom.streaming import engine, windows

HOUR = 3_600_000_000_000


def test_late_rows_are_counted(spark, tmp_path):
    """Three files of growing time, then one of hours that are closed, then one that closes all but its own hour."""
    r = random.Random(61)
    base = tmp_path.as_uri()
    files = [[(h * HOUR + r.randrange(HOUR), r.randrange(4)) for h in hours for _ in range(20)] for hours in ((0, 1), (1, 2, 3), (4, 5), (0, 2, 5), (9,))]
    # What a file meets is the watermark of the files before it: their latest time less an hour, to the millisecond.
    want, held, latest, seq, rows = {}, {}, None, 0, []
    for k, file in enumerate(files):
        mark = 0 if latest is None else latest // 1_000_000 - 3_600_000
        for ns, code in file:
            to = want if (ns // HOUR + 1) * 3_600_000 <= mark else held
            to[(ns // HOUR * 3600, code)] = to.get((ns // HOUR * 3600, code), 0) + 1
            rows.append((k, seq, ns, seq % 3, 1, 1, code))
            seq += 1
        latest = max([ns for ns, _ in file] + ([] if latest is None else [latest]))
    table = spark.createDataFrame(rows, "file int, " + src.EVENT)
    for k in range(len(files)):
        table.filter(F.col("file") == k).drop("file").coalesce(1).write.mode("append").parquet(f"{base}/in")
        engine.replay(windows.counted(engine.event_stream(spark, f"{base}/in")), f"{base}/out", f"{base}/check")
    parts = spark.read.parquet(f"{base}/out")
    assert want and {(x["hour_s"], x["behavior_code"]): x["n"] for x in windows.late(parts).groupBy("hour_s", "behavior_code").agg(F.sum("n").alias("n")).collect()} == want
    open_ = windows.open_windows(spark, f"{base}/check")
    assert {x["hour_s"] for x in open_.collect()} == {9 * 3600}
    found = {(x["hour_s"], x["behavior_code"]): x["n"] for x in windows.closed(parts).unionByName(open_).collect()}
    assert found == held
    assert windows.conserved(seq, parts, open_) == {"read": seq, "closed": sum(v for (h, _), v in held.items() if h < 9 * 3600), "open": 20, "late": sum(want.values())}


def test_windows_in_order_are_the_batch(spark, tmp_path):
    rows = [(i, i * HOUR // 7, i % 5, 1, 1, i % 4) for i in range(100)]
    df = spark.createDataFrame(rows, src.EVENT)
    base = tmp_path.as_uri()
    for k in range(2):
        df.filter(F.expr(f"seq div 50 = {k}")).coalesce(1).write.mode("append").parquet(f"{base}/in")
        parts = engine.replay(windows.counted(engine.event_stream(spark, f"{base}/in"), "0 seconds"), f"{base}/out", f"{base}/check")
    open_ = windows.open_windows(spark, f"{base}/check")
    both = windows.closed(parts).unionByName(open_)
    key = lambda x: (x["hour_s"], x["behavior_code"], x["n"])
    assert sorted(map(key, both.collect())) == sorted(map(key, engine.hourly(df).collect())) and windows.late(parts).isEmpty()
