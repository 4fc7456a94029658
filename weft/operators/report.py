"""Reports over tables: profiles, histograms, grouped statistics, distribution similarity,
cleaning (date unification, exact and near de-duplication) and the composite quality score.

Profiles are one wide aggregate turned into one row per column with ``inline``; similarity
tests aggregate by value first (map-side combine, so hot values cost one row), then need a
global running sum over the distinct values, which the bucketed ranking of
``weft.operators.rank`` provides without a single-partition window.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.operators.dirty import ALT_DATE_FORMATS, ISO_DATE
from weft.operators.rank import _bucketize, _cut_points, value_ranks

# fixed values: weights of the composite quality score (similarity, causal, privacy, temporal, dirty)
QUALITY_WEIGHTS = {"similarity_score": 0.30, "causal_score": 0.25, "privacy_score": 0.20,
                   "temporal_score": 0.15, "dirty_score": 0.10}


def _is_num(t) -> bool:
    return isinstance(t, T.NumericType) and not isinstance(t, T.BooleanType)


def profile(df: DataFrame, cols: list[str] | None = None, exact_distinct: bool = True,
            rsd: float = 0.01) -> DataFrame:
    """One row per column: column_name, data_type, n_rows, n_null, n_distinct, min/max/mean/std
    (numeric columns; null otherwise).  All columns are measured in a single aggregate job.

    Distinct values are counted by one grouped count per column over that column alone (several
    exact distinct counts in one aggregate would expand every row once per column). With
    ``exact_distinct=False`` they are HyperLogLog++ estimates (relative error ``rsd``).
    """
    cols = cols or df.columns
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(cols):
        x = F.col(c)
        num = _is_num(df.schema[c].dataType)
        aggs.append(F.count(x).alias(f"_nn{i}"))
        if not exact_distinct:
            aggs.append(F.approx_count_distinct(x, rsd).alias(f"_nd{i}"))
        if num:
            d = x.cast("double")
            d = F.when(~F.isnan(d), d)  # NaN is no number: left out of the four measures, as null is
            aggs += [F.min(d).alias(f"_mi{i}"), F.max(d).alias(f"_ma{i}"), F.avg(d).alias(f"_av{i}"),
                     F.stddev_samp(d).alias(f"_sd{i}")]
    wide = df.agg(*aggs)
    none = F.lit(None).cast("double")
    rows = []
    for i, c in enumerate(cols):
        num = _is_num(df.schema[c].dataType)
        rows.append(F.struct(
            F.lit(c).alias("column_name"), F.lit(df.schema[c].dataType.simpleString()).alias("data_type"),
            F.col("_n").alias("n_rows"), (F.col("_n") - F.col(f"_nn{i}")).alias("n_null"),
            (F.lit(0).cast("long") if exact_distinct else F.col(f"_nd{i}")).alias("n_distinct"),
            (F.col(f"_mi{i}") if num else none).alias("min_value"),
            (F.col(f"_ma{i}") if num else none).alias("max_value"),
            (F.col(f"_av{i}") if num else none).alias("mean"),
            (F.col(f"_sd{i}") if num else none).alias("std")))
    out = wide.select(F.inline(F.array(*rows)))
    if not exact_distinct:
        return out
    return out.drop("n_distinct").join(distinct_counts(df, cols), "column_name").select(*out.columns)


def distinct_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column_name, n_distinct): non-null distinct values of each column, one grouped count per column."""
    each = [df.select(c).where(F.col(c).isNotNull()).distinct().agg(F.lit(c).alias("column_name"), F.count(F.lit(1)).alias("n_distinct")) for c in cols]
    out = each[0]
    for x in each[1:]:
        out = out.unionByName(x)
    return out


def percentiles(df: DataFrame, col: str, probs: list[float]) -> DataFrame:
    """(column_name, p, value): exact percentiles, the smallest value whose rank reaches p of the non-null rows."""
    ranks = value_ranks(df, col).withColumn("_to", F.col("rank") + (F.col("n") - 1) / 2)
    n = df.agg(F.count(col)).first()[0]
    want = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("p"), F.lit(float(max(1, math.ceil(p * n)))).alias("_at")) for p in probs])).alias("w")
    hit = ranks.select("v", "rank", "n", "_to", want).where((F.col("_to") >= F.col("w._at")) & (F.col("_to") - F.col("n") < F.col("w._at")))
    return hit.select(F.lit(col).alias("column_name"), F.col("w.p").alias("p"), F.col("v").cast("double").alias("value"))


def samples(df: DataFrame, cols: list[str], n: int) -> DataFrame:
    """(column_name, samples): the ``n`` smallest distinct non-null values of each column, as text in the column's order."""
    each = []
    for c in cols:
        top = df.select(F.col(c).alias("v")).where(F.col("v").isNotNull()).distinct().orderBy("v").limit(n)
        each.append(top.agg(F.lit(c).alias("column_name"), F.transform(F.sort_array(F.collect_list("v")), lambda x: x.cast("string")).alias("samples")))
    out = each[0]
    for x in each[1:]:
        out = out.unionByName(x)
    return out


def histogram(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """Equal-width histogram between min and max: bin, lo, hi, n (empty bins are absent)."""
    lo, hi = df.agg(F.min(F.col(col).cast("double")), F.max(F.col(col).cast("double"))).first()
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, lo double, hi double, n bigint")
    width = (hi - lo) / bins if hi > lo else 1.0
    b = F.least(F.floor((F.col(col).cast("double") - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    out = df.where(F.col(col).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lo"),
                      (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("hi"), "n")


def grouped_stats(df: DataFrame, by: list[str], col: str) -> DataFrame:
    """"Average salary by department": n, mean, std, min, max of ``col`` per group."""
    x = F.col(col).cast("double")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"),
                               F.stddev_samp(x).alias("std"), F.min(x).alias("min_value"),
                               F.max(x).alias("max_value"))


def _running(counts: DataFrame, weight_cols: list[str], n_buckets: int | None = None) -> DataFrame:
    """Inclusive running sums of ``weight_cols`` over ``v`` order, without a global window."""
    b = _bucketize(counts, "v", _cut_points(counts, "v", n_buckets))
    totals = b.groupBy("_bkt").agg(*[F.sum(w).alias(f"_t_{w}") for w in weight_cols])
    before = Window.orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_bkt", *[F.coalesce(F.sum(f"_t_{w}").over(before), F.lit(0)).alias(f"_o_{w}")
                                      for w in weight_cols])  # one row a bucket
    w = Window.partitionBy("_bkt").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = b.select("_bkt", "v", *[F.sum(c).over(w).alias(f"_r_{c}") for c in weight_cols])
    return inner.join(F.broadcast(offsets), "_bkt").select(
        "v", *[(F.col(f"_o_{c}") + F.col(f"_r_{c}")).alias(f"cum_{c}") for c in weight_cols])


def _side_counts(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    sa = a.select(F.col(col).alias("v"), F.lit(1).alias("na"), F.lit(0).alias("nb"))
    sb = b.select(F.col(col).alias("v"), F.lit(0).alias("na"), F.lit(1).alias("nb"))
    return sa.unionByName(sb).where(F.col("v").isNotNull()).groupBy("v").agg(
        F.sum("na").cast("long").alias("na"), F.sum("nb").cast("long").alias("nb"))


def ks_statistic(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance of a numeric column (nulls ignored): one row ``ks``."""
    counts = _side_counts(a, b, col)
    tot = counts.agg(F.sum("na").alias("ta"), F.sum("nb").alias("tb")).first()
    ta, tb = max(int(tot["ta"] or 0), 1), max(int(tot["tb"] or 0), 1)
    cum = _running(counts, ["na", "nb"])
    gap = F.abs(F.col("cum_na") / F.lit(float(ta)) - F.col("cum_nb") / F.lit(float(tb)))
    return cum.agg(F.coalesce(F.max(gap), F.lit(0.0)).alias("ks"))


def tv_distance(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """Total variation distance between the value shares of a categorical column: one row ``tv``."""
    counts = _side_counts(a, b, col)
    t = counts.agg(F.sum("na").alias("ta"), F.sum("nb").alias("tb")).first()
    ta, tb = max(int(t["ta"] or 0), 1), max(int(t["tb"] or 0), 1)
    gap = F.abs(F.col("na") / F.lit(float(ta)) - F.col("nb") / F.lit(float(tb)))
    return counts.agg((F.coalesce(F.sum(gap), F.lit(0.0)) / F.lit(2.0)).alias("tv"))


def similarity(a: DataFrame, b: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Per column: 1 - KS (numeric) or 1 - TV (other types); rows (column_name, metric, similarity)."""
    cols = cols or [c for c in a.columns if c in b.columns]
    parts = []
    for c in cols:
        if _is_num(a.schema[c].dataType):
            d = ks_statistic(a, b, c).select(F.lit(c).alias("column_name"), F.lit("ks").alias("metric"),
                                             (F.lit(1.0) - F.col("ks")).alias("similarity"))
        else:
            d = tv_distance(a, b, c).select(F.lit(c).alias("column_name"), F.lit("tv").alias("metric"),
                                            (F.lit(1.0) - F.col("tv")).alias("similarity"))
        parts.append(d)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def compare_profiles(a: DataFrame, b: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Two profiles side by side, joined on column name (a few rows per side: broadcast)."""
    cols = cols or [c for c in a.columns if c in b.columns]
    pa = profile(a, cols).select("column_name", *[F.col(c).alias(f"{c}_a") for c in
                                                  ("n_rows", "n_null", "n_distinct", "mean", "std")])
    pb = profile(b, cols).select("column_name", *[F.col(c).alias(f"{c}_b") for c in
                                                  ("n_rows", "n_null", "n_distinct", "mean", "std")])
    return pa.join(F.broadcast(pb), "column_name").withColumn("mean_diff", F.col("mean_b") - F.col("mean_a"))


def unify_dates(df: DataFrame, cols: list[str], formats: list[str] | None = None) -> DataFrame:
    """Inverse of the date-format mix: parse each text with the known layouts, first that fits wins."""
    formats = formats or [ISO_DATE] + list(ALT_DATE_FORMATS)

    def parse(c: str) -> Column:
        tries = [F.try_to_timestamp(F.col(c), F.lit(f)) for f in formats]
        return F.coalesce(*tries).cast("date")

    return df.withColumns({c: parse(c) for c in cols})


def dedupe_exact(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def dedupe_near(df: DataFrame, block_cols: list[str], keep_order: list[str]) -> DataFrame:
    """Rows equal on ``block_cols`` are near copies; keep the first by ``keep_order``.

    ``min(struct)`` per block: map-side combined, so a block with a third of all rows is fine.
    """
    rest = [c for c in df.columns if c not in block_cols]
    first = [c for c in keep_order if c in rest] + [c for c in rest if c not in keep_order]
    best = df.groupBy(*block_cols).agg(F.min(F.struct(*[F.col(c) for c in first])).alias("_k"))
    return best.select(*block_cols, *[F.col("_k")[c].alias(c) for c in rest]).select(*df.columns)


def usage_trend(df: DataFrame, ts_col: str, unit: str = "month", value_col: str | None = None,
                user_col: str | None = None) -> DataFrame:
    """Counts (and distinct users, value totals) per time unit."""
    aggs = [F.count(F.lit(1)).alias("n_events")]
    if user_col:
        aggs.append(F.count_distinct(user_col).alias("n_users"))
    if value_col:
        aggs.append(F.sum(value_col).alias("total_value"))
    return df.groupBy(F.date_trunc(unit, F.col(ts_col)).alias("period")).agg(*aggs)


def quality_score(parts: DataFrame) -> DataFrame:
    """Composite 0..100 from a one-row frame holding the five 0..100 part scores."""
    total = sum(F.col(c) * F.lit(w) for c, w in QUALITY_WEIGHTS.items())
    return parts.select(*QUALITY_WEIGHTS, F.least(F.greatest(total, F.lit(0.0)), F.lit(100.0)).alias("overall_score"))
