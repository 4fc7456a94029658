"""Streaming forms agree with the batch results on a copy of events."""

from pyspark.sql import functions as F

from weft.operators import dirty as D
from weft.session import table
from weft.streaming import stream as ST

from conftest import SF_SMALL


def _events_dir(spark, tmp_path):
    ev = table(spark, SF_SMALL, "events")
    src = str(tmp_path / "events_in")
    ev.repartition(4).write.parquet(src)
    return ev, src


def test_row_local_operator_same_as_batch(spark, tmp_path):
    ev, src = _events_dir(spark, tmp_path)
    s = ST.read_parquet_stream(spark, src, ev.schema, files_per_batch=1)
    exprs = {"value": D.null_mcar_col("value", 0.1, 42, ["event_id"])}
    out = ST.run_available(ST.apply_columns(s, exprs), str(tmp_path / "out1"), checkpoint=str(tmp_path / "ck1"))
    got = sorted(map(tuple, spark.read.parquet(out).select("event_id", "value").collect()))
    want = sorted(map(tuple, ev.withColumns(exprs).select("event_id", "value").collect()))
    assert got == want


def test_windowed_counts_match_batch(spark, tmp_path):
    ev, src = _events_dir(spark, tmp_path)
    s = ST.read_parquet_stream(spark, src, ev.schema)
    q = ST.windowed_quality(s, "ts", "1 day", "365 days", ["props"], {"value": (0.0, 100.0)})
    name = ST.run_available(q, "windowed_quality_test", mode="complete", checkpoint=str(tmp_path / "ck2"), fmt="memory")
    got = spark.table(name).agg(F.sum("n_rows"), F.sum("range_value")).first()
    want = ev.agg(F.count("*"), F.count_if((F.col("value") < 0) | (F.col("value") > 100))).first()
    assert tuple(got) == tuple(want)


def test_dedupe_within_watermark(spark, tmp_path):
    ev, src = _events_dir(spark, tmp_path)
    ev.limit(50).write.mode("append").parquet(src)  # re-sent rows
    s = ST.read_parquet_stream(spark, src, ev.schema)
    out = ST.run_available(ST.dedupe_stream(s, ["event_id"], "ts", "365 days"), str(tmp_path / "out3"),
                           checkpoint=str(tmp_path / "ck3"))
    assert spark.read.parquet(out).count() == ev.count()
