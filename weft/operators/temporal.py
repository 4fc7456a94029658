"""Time patterns: weekday / hour re-weighting, monthly seasonality, special events, trend induction.

T-01..T-05 are single projections keyed on the row key (they also run on streams);
T-06 uses the distributed ordinal primitive (no single-partition sort).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions import rand as R
from weft.operators.rank import ordinal
from weft.plans.spec import TemporalPatterns, cols_of


def timestamp_columns(df: DataFrame) -> list[str]:
    """Timestamp/date columns, or string columns whose name ends in ``_at``."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            out.append(f.name)
        elif f.name.endswith("_at") and isinstance(f.dataType, T.StringType):
            out.append(f.name)
    return out


def _to_weekday(x: Column, u: Column, weights) -> Column:
    """Move the timestamp forward 0..6 days onto a weekday drawn by ``weights`` (Monday first)."""
    target = R.index_by_cdf(u, R.cumulative(list(weights)))
    delta = F.pmod(target - F.weekday(x), F.lit(7))
    return F.when(x.isNull(), x).otherwise(x + F.make_dt_interval(delta))


def _to_hour(x: Column, u: Column, weights) -> Column:
    """Set the hour to one drawn by 24 weights; minutes and seconds become 0, microseconds stay."""
    hour = R.index_by_cdf(u, R.cumulative(list(weights)))
    frac = F.extract(F.lit("SECOND"), x) - F.floor(F.extract(F.lit("SECOND"), x))
    return F.when(x.isNull(), x).otherwise(F.date_trunc("DAY", x).cast("timestamp_ntz")
                                           + F.make_dt_interval(F.lit(0), hour, F.lit(0), frac))


def _reweight(df: DataFrame, cols: list[str], dow, hod, seed: int, key_cols: list[str]) -> DataFrame:
    """Weekday, then hour of ``cols``. Draws, shifted days and hours are projections of their own, one after the
    other: a draw is tested once for every level of its tree, and would be hashed anew for each test if it stood in it."""
    draws = {f"_u_{tag}{i}": R.uniform01(seed, f"{tag}:{c}", key_cols)
             for tag, w, n in (("dow", dow, 7), ("hod", hod, 24)) if w and len(w) == n for i, c in enumerate(cols)}
    out = df.withColumns(draws) if draws else df
    if dow and len(dow) == 7 and cols:
        out = out.withColumns({c: _to_weekday(F.col(c), F.col(f"_u_dow{i}"), dow) for i, c in enumerate(cols)})
    if hod and len(hod) == 24 and cols:
        out = out.withColumns({c: _to_hour(F.col(c), F.col(f"_u_hod{i}"), hod) for i, c in enumerate(cols)})
    return out.drop(*draws)


def monthly_col(value: Column, ts: Column, months: dict) -> Column:
    m = F.create_map(*[x for k, v in sorted(months.items()) for x in (F.lit(int(k)), F.lit(float(v)))])
    return value * F.coalesce(F.element_at(m, F.month(ts)), F.lit(1.0))


def monthly_seasonality(df: DataFrame, months: dict, ts_col: str | None = None,
                        columns: list[str] | None = None) -> DataFrame:
    """Multiply numeric columns by the factor of the month of ``ts_col`` (default: first timestamp column)."""
    ts_col = ts_col or next(iter(timestamp_columns(df)), None)
    if ts_col is None or not months:
        return df
    cols = columns if columns is not None else cols_of(df, "numeric")
    sel = {c: monthly_col(F.col(c), F.col(ts_col), months).cast(df.schema[c].dataType)
           if not isinstance(df.schema[c].dataType, T.IntegralType)
           else F.round(monthly_col(F.col(c), F.col(ts_col), months)).cast(df.schema[c].dataType)
           for c in cols if c in df.columns}
    return df.withColumns(sel) if sel else df


def special_events(df: DataFrame, events, ts_col: str | None = None) -> DataFrame:
    """Rows in an event's month (and days ``day .. day+duration-1`` if a day is given) have the
    event's columns multiplied; several events on one row multiply together."""
    ts_col = ts_col or next(iter(timestamp_columns(df)), None)
    if ts_col is None:
        return df
    ts = F.col(ts_col)
    factors: dict[str, Column] = {}
    for e in events:
        hit = F.month(ts) == F.lit(int(e.month))
        if e.day is not None:
            d = F.dayofmonth(ts)
            hit = hit & (d >= F.lit(int(e.day))) & (d < F.lit(int(e.day) + max(1, int(e.duration_days))))
        f = F.when(F.coalesce(hit, F.lit(False)), F.lit(float(e.multiplier))).otherwise(F.lit(1.0))
        for c in e.columns:
            if c in df.columns:
                factors[c] = factors[c] * f if c in factors else f
    sel = {}
    for c, f in factors.items():
        t = df.schema[c].dataType
        v = F.col(c) * f
        sel[c] = F.round(v).cast(t) if isinstance(t, T.IntegralType) else v.cast(t)
    return df.withColumns(sel) if sel else df


def temporal_patterns(df: DataFrame, p: TemporalPatterns, seed: int, key_cols: list[str],
                      ts_cols: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """Weekday then hour re-weighting per timestamp column, then monthly seasonality and events."""
    ts_cols = ts_cols if ts_cols is not None else [c for c in timestamp_columns(df)
                                                   if not isinstance(df.schema[c].dataType, T.StringType)]
    out = _reweight(df, ts_cols, p.weekday_weights, p.hour_weights, seed, key_cols)
    if p.month_multipliers and ts_cols:
        cols = columns if columns is not None else [c for c in cols_of(out, "numeric") if c not in key_cols]
        out = monthly_seasonality(out, p.month_multipliers, ts_cols[0], cols)
    if p.events and ts_cols:
        out = special_events(out, p.events, ts_cols[0])
    return out


def hour_reweight(df: DataFrame, c: str, weights, seed: int, key_cols: list[str]) -> DataFrame:
    return _reweight(df, [c], None, weights, seed, key_cols)


def weekday_reweight(df: DataFrame, c: str, weights, seed: int, key_cols: list[str]) -> DataFrame:
    return _reweight(df, [c], weights, None, seed, key_cols)


def autocorrelation(df: DataFrame, rho: float, ts_col: str, key_cols: list[str], seed: int,
                    columns: list[str] | None = None, shared: bool = False,
                    n_buckets: int | None = None) -> DataFrame:
    """Trend induction by rank re-ordering.

    Rows are ordered by time (position i of n); each numeric column gets the score
    ``rho * i / n + sqrt(1 - rho^2) * z`` with keyed normal noise z (one noise per column,
    or one shared by all columns with ``shared=True``), and receives its own sorted
    values in score order.  Each column keeps its multiset of values.  |rho| < 0.01 is a no-op.
    Rows with a null time or a null value keep their value.
    """
    if abs(rho) < 0.01:
        return df
    cols = columns if columns is not None else [c for c in cols_of(df, "numeric") if c not in key_cols]
    base = ordinal(df, ts_col, key_cols, "_ti", n_buckets).persist()
    n = base.count()
    out = base
    # each column is re-ordered independently of the others (same time ranks, own noise),
    # so the columns are separate rank jobs joined back on the key, not a growing chain
    for c in cols:
        tag = "ac:shared" if shared else f"ac:{c}"
        noise = R.std_normal(seed, tag, key_cols)
        have = base.where(F.col(c).isNotNull()).select(*key_cols, "_ti", c)
        scored = have.withColumn(
            "_score", F.lit(rho) * F.col("_ti") / F.lit(float(n)) + F.lit(math.sqrt(max(0.0, 1 - rho * rho))) * noise)
        pos = ordinal(scored.select(*key_cols, "_score"), "_score", key_cols, "_p", n_buckets).select(*key_cols, "_p")
        vals = ordinal(have.select(*key_cols, c), c, key_cols, "_p", n_buckets).select("_p", F.col(c).alias(f"_nv_{c}"))
        moved = pos.join(vals, "_p").drop("_p")
        out = out.join(moved, key_cols, "left").withColumn(c, F.coalesce(F.col(f"_nv_{c}"), F.col(c))) \
            .drop(f"_nv_{c}")
    rest = df.where(F.col(ts_col).isNull())
    return out.drop("_ti").select(*df.columns).unionByName(rest)
