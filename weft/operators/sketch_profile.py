"""Mergeable column profiles: one stored row per part of a table and column, with sketches that add up.

A part (a day, a file set) is read once when it comes; a profile over any set of parts is a merge of their
rows and reads no data. Counts, extremes, sums and moments are exact; distinct values come from
HyperLogLog, ranks and quantiles from KLL, common values of two sets of parts from theta sketches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.operators.rank import as_double

HLL_BITS = 14  # relative standard error 1.04 / sqrt(2^14) = 0.8 %
KLL_K = 400  # rank error of about 0.7 %
THETA_BITS = 14  # relative standard error 1 / sqrt(2^14) = 0.8 % of the union

SCHEMA = ("part string, column_name string, data_type string, n_rows long, n_null long, min_value double, max_value double, "
          "total double, m2 double, hll binary, kll binary, theta binary")


def _ordered(t: T.DataType) -> bool:
    return isinstance(t, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType))


def part_rows(df: DataFrame, part: str, cols: list[str] | None = None) -> DataFrame:
    """The profile rows of one part: a single map-side combined aggregate over ``cols`` (default: all).

    Numbers, dates and timestamps (as seconds x 1e6, days) have extremes, sums and quantiles; all columns have distinct values,
    told apart by their text. NaN counts as null. An empty part has rows with zero counts.
    """
    aggs, rows = [F.count(F.lit(1)).alias("n")], []
    for i, c in enumerate(cols or df.columns):
        t = df.schema[c].dataType
        text = F.col(f"`{c}`").cast("string") if not isinstance(t, (T.ArrayType, T.MapType, T.StructType)) else F.to_json(F.col(f"`{c}`"))
        x = as_double(F.col(f"`{c}`"), t) if _ordered(t) else F.lit(None).cast("double")
        x = F.when(~F.isnan(x), x)
        some = F.when(x.isNotNull() | F.lit(not _ordered(t)), text)
        aggs += [F.count(some).alias(f"c{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"), F.sum(x).alias(f"s{i}"),
                 (F.var_pop(x) * F.count(x)).alias(f"m{i}"), F.hll_sketch_agg(some, HLL_BITS).alias(f"h{i}"), F.theta_sketch_agg(some, THETA_BITS).alias(f"t{i}")]
        if _ordered(t):
            aggs.append(F.kll_sketch_agg_double(x, KLL_K).alias(f"k{i}"))
        rows.append(F.struct(
            F.lit(part).alias("part"), F.lit(c).alias("column_name"), F.lit(t.simpleString()).alias("data_type"), F.col("n").alias("n_rows"),
            (F.col("n") - F.col(f"c{i}")).alias("n_null"), F.col(f"lo{i}").alias("min_value"), F.col(f"hi{i}").alias("max_value"), F.col(f"s{i}").alias("total"),
            F.coalesce(F.col(f"m{i}"), F.lit(None).cast("double")).alias("m2"), F.col(f"h{i}").alias("hll"),
            (F.col(f"k{i}") if _ordered(t) else F.lit(None).cast("binary")).alias("kll"), F.col(f"t{i}").alias("theta")))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def add_part(df: DataFrame, path: str, part: str, cols: list[str] | None = None) -> None:
    """Read one part and append its rows to the profile store at ``path``; a part that is there already is refused."""
    spark = df.sparkSession
    try:
        there = not stored_rows(spark, path).where(F.col("part") == part).isEmpty()
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        there = False
    if there:
        raise ValueError(f"part {part} is stored already")
    part_rows(df, part, cols).coalesce(1).write.mode("append").parquet(path)


def stored_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def _chosen(spark: SparkSession, path: str, parts: list[str] | None) -> DataFrame:
    rows = stored_rows(spark, path)
    return rows if parts is None else rows.where(F.col("part").isin(list(parts)))


def merged(spark: SparkSession, path: str, parts: list[str] | None = None, quantiles: tuple = (0.25, 0.5, 0.75)) -> DataFrame:
    """The profile over ``parts`` (default: all): column_name, data_type, n_rows, n_null, n_distinct (estimate), min_value, max_value, mean, std,
    and q<percent> for each of ``quantiles`` (estimates; null for unordered columns)."""
    g = _chosen(spark, path, parts).groupBy("column_name", "data_type").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_null").alias("n_null"), F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"), F.sum("total").alias("total"),
        F.collect_list(F.when(F.col("total").isNotNull(), F.struct((F.col("n_rows") - F.col("n_null")).alias("n"), "total", "m2"))).alias("moments"),
        F.hll_sketch_estimate(F.hll_union_agg("hll")).alias("n_distinct"), F.expr(f"kll_merge_agg_double(kll, {KLL_K})").alias("kll"))
    n = F.col("n_rows") - F.col("n_null")
    mean = F.when(n > 0, F.col("total") / n)
    # sums of squares about the part's own mean, moved to the common mean
    spread = F.aggregate("moments", F.lit(0.0), lambda a, m: a + m["m2"] + m["n"] * (m["total"] / m["n"] - mean) * (m["total"] / m["n"] - mean))
    counted = F.col("total").isNotNull() & (n > 0)
    qs = [F.when(counted, F.kll_sketch_get_quantile_double("kll", F.lit(float(q)))).alias(f"q{round(100 * q)}") for q in quantiles]
    return g.select("column_name", "data_type", "n_rows", "n_null", F.col("n_distinct").cast("long").alias("n_distinct"), "min_value", "max_value",
                    mean.alias("mean"), F.when(counted & (n > 1), F.sqrt(spread / (n - 1))).alias("std"), *qs)


def shared_values(spark: SparkSession, path: str, parts_a: list[str], parts_b: list[str]) -> DataFrame:
    """Per column: distinct values of both sets of parts, their common ones and the Jaccard similarity (estimates)."""
    side = [_chosen(spark, path, p).groupBy("column_name").agg(F.theta_union_agg("theta", THETA_BITS).alias(s)) for p, s in ((parts_a, "a"), (parts_b, "b"))]
    j = side[0].join(side[1], "column_name")
    both, either = F.theta_sketch_estimate(F.theta_intersection("a", "b")), F.theta_sketch_estimate(F.theta_union("a", "b", THETA_BITS))
    return j.select("column_name", F.theta_sketch_estimate("a").alias("n_a"), F.theta_sketch_estimate("b").alias("n_b"), both.alias("n_common"),
                    F.when(either > 0, both / either).alias("jaccard"))


def shift(spark: SparkSession, path: str, parts_a: list[str], parts_b: list[str], points: int = 199) -> DataFrame:
    """Per ordered column: the largest difference of the two distribution functions over ``points`` quantiles of either side (a KS distance, estimate)."""
    ranks = F.array(*[F.lit(k / (points + 1)) for k in range(1, points + 1)])
    side = [_chosen(spark, path, p).where("total is not null").groupBy("column_name").agg(F.expr(f"kll_merge_agg_double(kll, {KLL_K})").alias("k"))
            .select("column_name", F.kll_sketch_get_quantile_double("k", ranks).alias(s)) for p, s in ((parts_a, "a"), (parts_b, "b"))]
    j = side[0].join(side[1], "column_name").select("column_name", "a", "b", F.explode(F.concat("a", "b")).alias("v"))
    upto = [F.size(F.filter(c, lambda x: x <= F.col("v"))) for c in ("a", "b")]
    return j.groupBy("column_name").agg((F.max(F.abs(upto[0] - upto[1])) / F.lit(points + 1)).alias("distance"))
