"""Keyed tables with a time to live on streams: equal to the batch, also when started again."""

import datetime as dt

from pyspark.sql import functions as F

from weft.session import table
from weft.streaming import keyed as KY
from weft.streaming import stream as ST

from conftest import SF_SMALL


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_restart_from_the_checkpoint_gives_the_batch_result(spark, tmp_path):
    ev = table(spark, SF_SMALL, "events").where("event_id % 7 > 0 or user_id > 5")
    # the first part of the month, then a restart, then the rest with an hour's disorder between files
    early, late = ev.where("ts < '2024-01-16'"), ev.where("ts >= '2024-01-16'")
    src, out, ck = (str(tmp_path / d) for d in ("in", "out", "ck"))
    early.withColumn("user_id", F.when(F.col("event_id") % 11 > 0, F.col("user_id"))).repartition(2).write.parquet(src)

    def go():
        s = ST.read_parquet_stream(spark, src, ev.schema, files_per_batch=1)
        return ST.run_available(KY.newest_changes(s, ["user_id"], "ts", 3, ["event_id"]), out, checkpoint=ck)

    go()
    first = spark.read.parquet(src)
    assert rows(KY.current(spark.read.parquet(out), ["user_id"], "ts", ["event_id"])) == rows(KY.live_rows(first, ["user_id"], "ts", 3, ["event_id"]))
    late.repartition(3).write.mode("append").parquet(src)
    go()
    changes = spark.read.parquet(out)
    assert rows(KY.current(changes, ["user_id"], "ts", ["event_id"])) == rows(KY.live_rows(spark.read.parquet(src), ["user_id"], "ts", 3, ["event_id"]))
    assert changes.columns == [*ev.columns, KY.GONE] and changes.where(KY.GONE).count() > 0
    n = changes.count()
    go()  # nothing new: nothing is written again
    assert spark.read.parquet(out).count() == n


def test_expiry_ties_nulls_and_late_rows(spark, tmp_path):
    day = lambda d, h=0: dt.datetime(2024, 1, d, h)
    schema = "k string, ts timestamp, v int, w string"
    batches = [[("a", day(1), 1, "x"), ("a", day(1), 2, "w"), ("a", day(1), 2, "y"), ("b", day(2), None, None), (None, day(2), 5, "n"), ("c", None, 1, "z")],
               [("d", day(9), 1, "d"), ("b", day(1), 9, "older")],  # the watermark moves to the second day
               [("a", day(1, 5), 9, "late"), ("e", day(9), 3, "e"), ("b", day(9), 4, "again")]]
    src, out, ck = (str(tmp_path / d) for d in ("in", "out", "ck"))
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(src)
        s = ST.read_parquet_stream(spark, src, schema)
        ST.run_available(KY.newest_changes(s, ["k"], "ts", 7, ["v"]), out, checkpoint=ck)
    changes = spark.read.parquet(out)
    want = [("b", day(9), 4, "again"), ("d", day(9), 1, "d"), ("e", day(9), 3, "e")]
    assert rows(KY.current(changes, ["k"], "ts", ["v"])) == rows(KY.live_rows(spark.read.parquet(src), ["k"], "ts", 7, ["v"])) == want
    assert ("a", day(1), 2, "y", True) in [tuple(r) for r in changes.collect()]
    assert KY.live_rows(spark.createDataFrame([], schema), ["k"], "ts").collect() == []
