"""Shared helpers of the ``llm`` operators: scratch tables, batching, ordered prefix sums, components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.session import checkpoint_dir

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``)."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def as_row(df: DataFrame) -> DataFrame:
    """``df`` as one struct column ``row``, so that its column names cannot clash with an operator's own."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def md5_bytes(col: Column) -> Column:
    return F.unhex(F.md5(col))


def prefix_sums(df: DataFrame, order: list[str], value: str, out: str, name: str) -> tuple[DataFrame, int]:
    """(df with ``out`` = sum of ``value`` over all earlier rows in the order, total).

    Rows are range-partitioned by ``order`` (which must be unique, so no key can pile up in one
    partition) and written; the driver sees one subtotal per partition, never rows.
    """
    spark = df.sparkSession
    ranged = stored(df.repartitionByRange(n_parts(spark), *order).withColumn("_part", F.spark_partition_id()), name)
    totals = dict(ranged.groupBy("_part").agg(F.sum(value)).collect())
    base, run = [], 0
    for p in range(max(totals, default=-1) + 1):
        base.append(run)
        run += totals.get(p) or 0
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    bases = F.lit(base) if base else F.lit([0])
    summed = F.coalesce(F.sum(value).over(w), F.lit(0)) + F.get(bases, F.col("_part"))
    return ranged.withColumn(out, summed.cast("long")).drop("_part"), run


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node it can reach.

    Alternating large-star and small-star rounds, each written to the shared folder. Every step is a
    map-side combined ``min`` per node and an equi-join, so a hub's neighbours are never gathered.
    Stops when a round changes nothing.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
            low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
            return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        moved = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        return moved.unionByName(low.select("a", F.col("m").alias("b")))

    def mark(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    cur = stored(edges.select("a", "b").where("a <> b").distinct(), "cc")
    seen = mark(cur)
    for _ in range(max_rounds):
        cur = stored(star(star(cur, True), False).where("a <> b").distinct(), "cc")
        now = mark(cur)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        cur.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
