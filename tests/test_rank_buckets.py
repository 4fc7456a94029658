"""The buckets of a distributed order follow the rows; ranks stay those of the plain window."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from weft.operators import rank as RK


def data(spark, n=6000):
    return spark.range(n).select("id", F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 17 > 0, (F.col("id") * 7919) % 2003).alias("v"))


def test_bucket_counts():
    assert [RK.buckets_for(n) for n in (0, 10**9, 1_024_000_001, 10**12, 10**14)] == [256, 256, 257, 250_000, 1 << 18]
    assert [RK.hash_bits_for(n) for n in (0, 10**9, 4 * 10**9, 10**12)] == [10, 10, 10, 18]


def test_more_rows_are_cut_more_finely(spark, monkeypatch):
    df = data(spark)
    w = Window.orderBy("v")
    plain = df.where("v is not null").withColumn("r", F.rank().over(w)).groupBy("v").agg(F.min("r").alias("r"), F.count("*").alias("n")).collect()
    want = {(r.v, r.n, r.r + (r.n - 1) / 2) for r in plain}
    few = RK._cuts_of(df, ["v", "id"])
    monkeypatch.setattr(RK, "BUCKETS", 8)
    monkeypatch.setattr(RK, "ROWS_A_BUCKET", 10)
    more = RK._cuts_of(df, ["v", "id"])
    n = df.where("v is not null").count()
    assert few["v"][1] == more["v"][1] == n and more["id"][1] == 6000
    assert len(more["id"][0]) == 599 and len(few["id"][0]) == 255 and len(more["v"][0]) > len(few["v"][0])
    assert RK.hash_bits_for(6000) == 10 and RK.hash_bits_for(6000, 2) == 10
    monkeypatch.setattr(RK, "HASH_BUCKETS", 1 << 5)
    assert {tuple(r) for r in RK.value_ranks(df, "v").select("v", "n", "rank").collect()} == want
    assert {tuple(r) for r in RK.multi_value_ranks(df, ["v", "id"])["v"].select("v", "n", "rank").collect()} == want
    one = [r["_idx"] for r in RK.dense_index(df, ["id"]).orderBy("id").collect()]
    monkeypatch.undo()
    assert one == [r["_idx"] for r in RK.dense_index(df, ["id"]).orderBy("id").collect()] and sorted(one) == list(range(6000))


def test_empty_and_null_columns(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "id long, v double")
    assert RK._cuts_of(df, ["v"]) == {"v": ([], 0)} and RK.value_ranks(df, "v").collect() == []
    assert RK.ordinal(df.limit(0), "v", ["id"]).collect() == []
