"""Near duplicates by tolerance: rows of a block whose values are joined by steps of at most a tolerance.

Rounding parts neighbours (0.049 and 0.051 at one decimal), so values are binned only to find candidates:
a pair within the tolerance lies at most three bins of half a tolerance apart, and the extremes of those bins
decide exactly. Values of a bin are always one group, so rows collapse to bins by a map-side combined
aggregate; no pair of rows is ever made, and a value with a third of all rows is one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.operators.rank import as_double
from weft.session import cut_lineage

RUN = 1024  # bins ranked in one window
FURTHEST = float(1 << 50)  # bin numbers beyond this lose the difference of neighbours in a double


def binned(df: DataFrame, col: str, tolerance: float, block_cols: list[str]) -> DataFrame:
    """``df`` with ``_block`` (the block columns, nulls equal; null, NaN and infinite values are blocks of their own), ``_x`` and ``_bin``."""
    if not tolerance > 0:
        raise ValueError("the tolerance is a positive number")
    x = as_double(F.col(f"`{col}`"), df.schema[col].dataType)
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    half = F.floor(x / F.lit(tolerance / 2))
    exact = F.when(F.abs(x) < F.lit(FURTHEST * tolerance / 2), half).otherwise(F.raise_error(F.lit(f"{col}: a value is too large for a tolerance of {tolerance}")).cast("long"))
    block = F.struct(*[F.col(f"`{c}`").alias(f"b{i}") for i, c in enumerate(block_cols)], F.when(finite, F.lit(None)).otherwise(F.coalesce(x.cast("string"), F.lit("null"))).alias("odd"))
    return df.select("*", block.alias("_block"), F.when(finite, x).otherwise(F.lit(0.0)).alias("_x"), F.when(finite, exact).otherwise(F.lit(0)).cast("long").alias("_bin"))


def group_starts(bins: DataFrame, tolerance: float) -> DataFrame:
    """``_block``, ``_bin``, ``_root`` for bins with extremes ``_lo`` and ``_hi``: the first bin of the group a bin belongs to."""
    before = (bins.select("_block", F.explode(F.array(*[F.col("_bin") + F.lit(d) for d in (1, 2, 3)])).alias("_bin"), "_hi")
              .groupBy("_block", "_bin").agg(F.max("_hi").alias("_prev")))
    starts = bins.join(before, ["_block", "_bin"], "left").select(
        "_block", F.col("_bin").alias("_at"), F.when(F.col("_prev").isNull() | (F.col("_lo") - F.col("_prev") > F.lit(tolerance)), F.col("_bin")).alias("_start"))
    return _carried(cut_lineage(starts)).select("_block", F.col("_at").alias("_bin"), "_root")


def _carried(rows: DataFrame) -> DataFrame:
    """Each row's last ``_start`` at or before its ``_at`` in the block, as ``_root``.

    Windows span RUN positions. What begins without a start goes on from the run before it (which exists, as a group has no
    wide gaps), and only such runs are carried on, by the same method over runs: a chain shrinks to 1/RUN a level.
    """
    run = F.floor(F.col("_at") / F.lit(RUN)).cast("long")
    w = Window.partitionBy("_block", "_run").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = rows.withColumn("_run", run).withColumn("_root", F.max("_start").over(w))
    runs = x.groupBy("_block", "_run").agg(F.max("_root").alias("_start"), F.bool_or(F.col("_root").isNull()).alias("_open"))
    runs = cut_lineage(runs)
    asking = runs.where("_open")
    if asking.isEmpty():
        return x.drop("_run")
    wanted = asking.select("_block", F.explode(F.array(F.col("_run") - 1, F.col("_run"))).alias("_run")).distinct()
    chain = runs.join(wanted, ["_block", "_run"], "left_semi").select("_block", F.col("_run").alias("_at"), "_start")
    carry = _carried(chain).select("_block", (F.col("_at") + 1).alias("_run"), F.col("_root").alias("_from"))
    return x.join(carry, ["_block", "_run"], "left").withColumn("_root", F.coalesce("_root", "_from")).drop("_run", "_from")


def dedupe_tolerance(df: DataFrame, col: str, tolerance: float, block_cols: list[str] = (), keep_order: list[str] = (), count_col: str | None = None) -> DataFrame:
    """One row of every group: rows that agree on ``block_cols`` (nulls agree) and whose values of ``col`` (a number, date or
    timestamp in microseconds) are linked by steps of at most ``tolerance``. The first by ``keep_order``, then by the
    other columns, stays, whole; ``count_col`` adds the number of rows it stands for.

    Null, NaN and infinite values match only their like. An empty table stays empty; repeated rows are one group. Columns to be
    kept must be orderable (no maps). Values from tolerance x 2^49 on are refused with an error.
    """
    order = [c for c in keep_order] + [c for c in df.columns if c not in keep_order]
    rest = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(order)])
    bins = cut_lineage(binned(df, col, tolerance, list(block_cols)).groupBy("_block", "_bin").agg(
        F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.min(rest).alias("_first"), F.count(F.lit(1)).alias("_n")))
    joined = bins.join(group_starts(bins.select("_block", "_bin", "_lo", "_hi"), tolerance), ["_block", "_bin"])
    kept = joined.groupBy("_block", "_root").agg(F.min("_first").alias("_first"), F.sum("_n").alias("_n"))
    extra: list[Column] = [F.col("_n").alias(count_col)] if count_col else []
    return kept.select(*[F.col("_first")[f"c{order.index(c)}"].alias(c) for c in df.columns], *extra)


def tolerance_groups(df: DataFrame, col: str, tolerance: float, block_cols: list[str] = ()) -> DataFrame:
    """Every group: the block columns, ``low``, ``high`` (doubles; null where the value is null, NaN or infinite) and ``n_rows``."""
    bins = cut_lineage(binned(df, col, tolerance, list(block_cols)).groupBy("_block", "_bin").agg(
        F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.count(F.lit(1)).alias("_n")))
    joined = bins.join(group_starts(bins.select("_block", "_bin", "_lo", "_hi"), tolerance), ["_block", "_bin"])
    g = joined.groupBy("_block", "_root").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.sum("_n").alias("n_rows"))
    value = lambda c: F.when(F.col("_block.odd").isNull(), F.col(c))
    return g.select(*[F.col(f"_block.b{i}").alias(c) for i, c in enumerate(block_cols)], value("_lo").alias("low"), value("_hi").alias("high"), "n_rows")
