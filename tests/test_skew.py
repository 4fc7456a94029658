"""Hot keys: one key holding a third of all rows gives the same answers as a plain computation."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from weft.operators import lookup as LK
from weft.operators import privacy as PV
from weft.operators import rank as RK
from weft.operators import store as ST
from weft.session import spread


def _hot(spark, n=30000):
    # key 0 holds a third of the rows
    return spark.range(n).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 997 + 1).alias("k"),
        ((F.col("id") * 7919) % 10007).alias("t"))


def test_latest_by_key_hot_key(spark):
    df = _hot(spark)
    got = {r["k"]: (r["t"], r["id"]) for r in ST.latest_by_key(df, ["k"], ["t", "id"]).collect()}
    w = Window.partitionBy("k").orderBy(F.col("t").desc(), F.col("id").desc())
    want = {r["k"]: (r["t"], r["id"]) for r in
            df.withColumn("r", F.row_number().over(w)).where("r = 1").collect()}
    assert got == want


def test_top_k_per_group_hot_group(spark):
    df = _hot(spark)
    got = sorted((r["k"], r["id"]) for r in
                 LK.top_k_per_group(df, ["k"], [F.col("t").desc(), F.col("id")], 3, tie_cols=["id"]).collect())
    w = Window.partitionBy("k").orderBy(F.col("t").desc(), F.col("id"))
    want = sorted((r["k"], r["id"]) for r in df.withColumn("r", F.row_number().over(w)).where("r <= 3").collect())
    assert got == want


def test_ordinal_hot_value_matches_row_number(spark):
    df = _hot(spark).withColumn("v", F.when(F.col("k") == 0, F.lit(5.0)).otherwise(F.col("t").cast("double")))
    got = {r["id"]: r["_pos"] for r in RK.ordinal(df, "v", ["id"], "_pos", n_buckets=8).collect()}
    assert sorted(got.values()) == list(range(df.count()))
    # positions follow the value order
    vals = {r["id"]: r["v"] for r in df.select("id", "v").collect()}
    order = sorted(got, key=got.get)
    assert all(vals[a] <= vals[b] for a, b in zip(order, order[1:]))


def test_k_anonymity_hot_group(spark):
    df = _hot(spark).withColumn("q", F.when(F.col("k") == 0, F.lit("hot")).otherwise(F.lit("cold")))
    assert PV.k_anonymity(df, ["q"]).first()["k"] == 10000  # the hot group is the smaller one


def test_spread_only_when_few_files_and_without_a_job(spark, tmp_path):
    few = spark.read.parquet("/root/testdata/sf0.001/customer.parquet")
    assert spread(few).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    path = str(tmp_path / "many")
    spark.range(0, 100, 1, 16).write.parquet(path)
    many = spark.read.parquet(path)
    assert spread(many) is many
    rows = spark.range(10)
    assert spread(rows) is rows
