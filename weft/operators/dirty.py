"""Dirty-data injection: nulls (MCAR/MAR/MNAR), date-format mixing, outliers, typos, duplicates.

Every draw is keyed on (seed, tag, row key) -- see ``weft.functions.rand`` -- so the result
does not depend on partitioning, task retries or row order.  Row-local steps are single
projections (they also run unchanged on streaming DataFrames); fitted values (means,
standard deviations, row counts) come from one aggregate pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions import rand as R
from weft.functions.text import apply_typo, typo_kind_count
from weft.operators.copies import equal_rows, numbered
from weft.operators.rank import dense_index, ordinal, value_ranks
from weft.plans.spec import DirtyProfile, cols_of

# fixed values: the four alternative date layouts (day/month/year, month-day-year,
# day-abbreviated month-year, full month name) next to the ISO default
ISO_DATE = "yyyy-MM-dd"
ALT_DATE_FORMATS = ["dd/MM/yyyy", "MM-dd-yyyy", "dd-MMM-yyyy", "MMMM dd, yyyy"]


def cast_like(x: Column, dtype) -> Column:
    """Cast a double result to a column's type, rounding (not truncating) for integral types."""
    if isinstance(dtype, T.IntegralType):
        return F.round(x).cast(dtype)
    return x.cast(dtype)


def _clamp(rate: float) -> float:
    return min(1.0, max(0.0, float(rate)))


def null_mcar_col(c: str, rate: float, seed, keys) -> Column:
    return F.when(~R.below(seed, f"null:{c}", keys, _clamp(rate)), F.col(c))


def null_mcar(df: DataFrame, rates: dict, seed: int, key_cols: list[str]) -> DataFrame:
    """Each cell of column c becomes null with probability rates[c]; unknown columns are skipped."""
    sel = {c: null_mcar_col(c, r, seed, key_cols) for c, r in rates.items() if c in df.columns}
    return df.withColumns(sel) if sel else df


def null_mar(df: DataFrame, col: str, rate: float, condition_col: str, condition_value, seed: int,
             key_cols: list[str]) -> DataFrame:
    """Nulls at twice the rate where condition_col = condition_value and none elsewhere;
    falls back to MCAR when the condition column is absent."""
    if col not in df.columns:
        return df
    if condition_col not in df.columns:
        return null_mcar(df, {col: rate}, seed, key_cols)
    cond = F.col(condition_col).cast("string") == F.lit(str(condition_value))
    hit = F.coalesce(cond, F.lit(False)) & (R.uniform01(seed, f"null:{col}", key_cols) < F.lit(2.0 * _clamp(rate)))
    return df.withColumn(col, F.when(hit, F.lit(None)).otherwise(F.col(col)))


def null_mnar(df: DataFrame, col: str, rate: float, seed: int, key_cols: list[str]) -> DataFrame:
    """Missing-not-at-random: a value's null probability is ``2 * rate`` times its percentile (average
    rank, ties shared, over the number of non-null values), so the mean rate is about ``rate`` whatever
    the values' spread. Nulls stay null."""
    if col not in df.columns:
        return df
    ranks = value_ranks(df, col, rank_col="_rank")
    n = df.agg(F.count(col)).first()[0]
    share = F.col("_rank") / F.lit(float(max(1, n)))
    j = df.join(ranks.select(F.col("v").alias("_v"), "_rank"), df[col] == F.col("_v"), "left")
    hit = R.uniform01(seed, f"mnar:{col}", key_cols) < F.least(F.lit(1.0), F.lit(2.0 * _clamp(rate)) * share)
    return j.withColumn(col, F.when(F.coalesce(hit, F.lit(False)), F.lit(None)).otherwise(F.col(col))).drop("_v", "_rank")


def date_format_mix_col(c: str, rate: float, seed, keys) -> Column:
    """Text form of a date/timestamp: ISO by default, one of four other layouts with prob ``rate``;
    null becomes the empty string."""
    alt = R.below(seed, f"alt:{c}", keys, _clamp(rate))
    which = F.floor(R.uniform01(seed, f"fmt:{c}", keys) * F.lit(len(ALT_DATE_FORMATS)))
    x = F.col(c)
    chosen = F.lit(None).cast("string")
    for i, fmt in reversed(list(enumerate(ALT_DATE_FORMATS))):
        chosen = F.when(which == F.lit(i), F.date_format(x, fmt)).otherwise(chosen)
    return F.coalesce(F.when(alt, chosen).otherwise(F.date_format(x, ISO_DATE)), F.lit(""))


def date_format_mix(df: DataFrame, cols: list[str], rate: float, seed: int, key_cols: list[str]) -> DataFrame:
    sel = {c: date_format_mix_col(c, rate, seed, key_cols) for c in cols if c in df.columns}
    return df.withColumns(sel) if sel else df


def moments_of(df: DataFrame, cols: list[str]) -> dict:
    """{column: (mean, sample standard deviation)} from one aggregate."""
    row = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)],
                 *[F.stddev_samp(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    return {c: (row[f"m{i}"], row[f"s{i}"]) for i, c in enumerate(cols)}


def outliers(df: DataFrame, cols: list[str], rate: float, seed: int, key_cols: list[str],
             moments: dict | None = None) -> DataFrame:
    """Replace a ``rate`` share of cells (null cells included) by mean +/- k*std, k ~ U(5, 10).

    Mean and sample std of all columns come from one aggregate (std 0 or undefined -> 1);
    pass ``moments={col: (mean, std)}`` to reuse fitted values (e.g. on a stream)."""
    num = set(cols_of(df, "numeric"))
    cols = [c for c in cols if c in num]
    if not cols:
        return df
    if moments is None:
        moments = moments_of(df, cols)
    sel = {}
    for c in cols:
        mean, std = moments[c]
        if mean is None:
            continue
        std = float(std or 0.0) or 1.0
        hit = R.below(seed, f"out:{c}", key_cols, _clamp(rate))
        sign = F.when(R.uniform01(seed, f"dir:{c}", key_cols) < F.lit(0.5), F.lit(-1.0)).otherwise(F.lit(1.0))
        k = R.uniform(seed, f"mult:{c}", key_cols, 5.0, 10.0)
        val = F.lit(float(mean)) + sign * k * F.lit(std)
        sel[c] = F.when(hit, cast_like(val, df.schema[c].dataType)).otherwise(F.col(c))
    return df.withColumns(sel) if sel else df


def typos_col(c: str, rate: float, seed, keys) -> Column:
    """A ``rate`` share of non-null strings longer than 1 get one typo of a random kind."""
    x = F.col(c)
    hit = x.isNotNull() & (F.length(x) > 1) & R.below(seed, f"typo:{c}", keys, _clamp(rate))
    kind = F.floor(R.uniform01(seed, f"kind:{c}", keys) * F.lit(typo_kind_count()))
    mutated = apply_typo(x, kind, R.uniform01(seed, f"pos:{c}", keys), R.uniform01(seed, f"adj:{c}", keys))
    return F.when(hit, mutated).otherwise(x)


def typos(df: DataFrame, cols: list[str], rate: float, seed: int, key_cols: list[str]) -> DataFrame:
    sel = {c: typos_col(c, rate, seed, key_cols) for c in cols if c in df.columns}
    return df.withColumns(sel) if sel else df


def duplicate_draws(df: DataFrame, rate: float, seed: int, key_cols: list[str], tag: str = "dup",
                    n_rows: int | None = None, indexed: DataFrame | None = None) -> DataFrame:
    """``int(n * rate)`` rows drawn with replacement (draw j picks index floor(U(j) * n)).

    Only the (unique) keys are indexed; the few draws meet them by index and fetch their rows by key.
    Columns: the row, plus ``_draw``.
    """
    n = n_rows if n_rows is not None else df.count()
    m = int(n * rate)
    spark = df.sparkSession
    if m <= 0 or n == 0:
        return spark.createDataFrame([], T.StructType(df.schema.fields + [T.StructField("_draw", T.LongType())]))
    idx = indexed if indexed is not None else dense_index(df.select(*key_cols), key_cols, "_idx")
    draws = spark.range(m).select(
        F.col("id").alias("_draw"),
        F.floor(R.uniform01(seed, tag, [F.col("id")]) * F.lit(n)).cast("long").alias("_idx"))
    keys = idx.select(*[F.col(k).alias(f"_key_{k}") for k in key_cols], "_idx").join(draws, "_idx").drop("_idx")
    meet = F.lit(True)
    for k in key_cols:
        meet = meet & (df[k] == F.col(f"_key_{k}"))
    return df.join(keys, meet).select(*df.columns, "_draw")


def dup_exact(df: DataFrame, rate: float, seed: int, key_cols: list[str], mark: str | None = None) -> DataFrame:
    extra = duplicate_draws(df, rate, seed, key_cols, "dup")
    return _append(df, extra, mark)


def near_column(df: DataFrame, seed: int, exclude=()) -> str | None:
    num = [c for c in cols_of(df, "numeric") if c not in exclude]
    if not num:
        return None
    # deterministic choice of one column for the whole batch, keyed on the seed
    import hashlib

    h = int(hashlib.sha256(f"{seed}:nearcol".encode()).hexdigest()[:13], 16) / 2**52
    return num[int(h * len(num))]


def dup_near(df: DataFrame, rate: float, seed: int, key_cols: list[str], mark: str | None = None,
             column: str | None = None) -> DataFrame:
    """As exact duplicates, then one numeric column (the same for all copies) times U(0.95, 1.05)."""
    extra = duplicate_draws(df, rate, seed, key_cols, "near")
    col = column or near_column(df, seed, exclude=key_cols)
    if col is not None:
        f = R.uniform(seed, "nearmult", [F.col("_draw")], 0.95, 1.05)
        extra = extra.withColumn(col, cast_like(F.col(col) * f, df.schema[col].dataType))
    return _append(df, extra, mark)


def _append(df: DataFrame, extra: DataFrame, mark: str | None) -> DataFrame:
    if mark:
        return df.withColumn(mark, F.lit(None).cast("long")).unionByName(extra.withColumnRenamed("_draw", mark))
    return df.unionByName(extra.drop("_draw"))


def shuffle_rows(df: DataFrame, seed: int, cols: list[str] | None = None, position: str | None = None) -> DataFrame:
    """A keyed random order (for writing); Spark rows have no order otherwise.

    Copies of one row are numbered and keyed apart, so they do not end up next to each other; they are dealt
    to tasks before they are written out. ``position`` names a column for the row's place, from 0: then the
    rows come without a sort, in any order.
    """
    cols = cols or df.columns
    each = numbered(equal_rows(df, [])).withColumn("_key", R.uniform01(seed, "shuffle", [F.to_json(F.struct(*[F.col("_row")[c].alias(c) for c in cols])), F.col("_copy")]))
    if position:
        return ordinal(each, "_key", ["_digest", "_copy"], position).select("_row.*", position)
    return each.orderBy("_key", "_digest", "_copy").select("_row.*")


def dirty_profile(df: DataFrame, profile: DirtyProfile, seed: int, key_cols: list[str],
                  columns: list[str] | None = None, protect: list[str] | None = None) -> DataFrame:
    """nulls -> date mix -> outliers -> typos -> duplicates.

    Column kinds are fixed before step 1.  ``protect`` columns (default: the key) get no
    nulls or typos, so draws stay keyed; pass ``protect=[]`` to hit every column.
    """
    cols = [c for c in (columns or df.columns) if c in df.columns]
    protect = list(key_cols) if protect is None else list(protect)
    strings = [c for c in cols_of(df, "string") if c in cols and c not in protect]
    numeric = [c for c in cols_of(df, "numeric") if c in cols and c not in protect]
    dates = [c for c in cols_of(df, "date") if c in cols and c not in protect]

    def holed(x: DataFrame) -> DataFrame:
        x = null_mcar(x, {c: profile.null_rate for c in cols if c not in protect}, seed, key_cols) if profile.null_rate > 0 else x
        return date_format_mix(x, dates, profile.date_format_mix_rate, seed, key_cols) if profile.date_format_mix_rate >= 0 and dates else x

    fitted = moments_of(holed(df), numeric) if profile.outlier_rate > 0 and numeric else {}

    def soiled(x: DataFrame) -> DataFrame:
        x = holed(x)
        if profile.outlier_rate > 0 and numeric:
            x = outliers(x, numeric, profile.outlier_rate, seed, key_cols, fitted)
        return typos(x, strings, profile.typo_rate, seed, key_cols) if profile.typo_rate > 0 and strings else x

    out = soiled(df)
    if profile.duplicate_rate > 0 or profile.near_duplicate_rate > 0:
        n = df.count()
        clean_keys = set(key_cols) <= set(protect)
        idx = dense_index((df if clean_keys else out).select(*key_cols), key_cols, "_idx")

        def copies(rate: float, tag: str) -> DataFrame:
            """The drawn rows as they are in ``out``; where the keys are not changed, drawn first and soiled after, so
            that only the copies are made a second time."""
            if not clean_keys:
                return duplicate_draws(out, rate, seed, key_cols, tag, n, idx)
            return soiled(duplicate_draws(df, rate, seed, key_cols, tag, n, idx)).select(*out.columns, "_draw")

        parts = [out]
        if profile.duplicate_rate > 0:
            parts.append(copies(profile.duplicate_rate, "dup").drop("_draw"))
        if profile.near_duplicate_rate > 0:
            near = copies(profile.near_duplicate_rate, "near")
            col = near_column(out, seed, exclude=key_cols)
            if col is not None:
                f = R.uniform(seed, "nearmult", [F.col("_draw")], 0.95, 1.05)
                near = near.withColumn(col, cast_like(F.col(col) * f, out.schema[col].dataType))
            parts.append(near.drop("_draw"))
        res = parts[0]
        for p in parts[1:]:
            res = res.unionByName(p)
        out = res
    return out
