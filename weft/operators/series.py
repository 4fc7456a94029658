"""First-order autoregressive series by a blocked linear recurrence.

``x = rho * x_before + noise`` looks sequential, but over a run of rows it is an affine map of the value
before the run. Rows are range-partitioned by (series, time, key) and written; one pass measures each
partition's map, the maps are composed (one entry a partition), and a second pass runs every partition from
its true start. A series longer than a partition goes on in the next one; no series is ever gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions import rand as R
from weft.functions.rand import hex52
from weft.operators.rank import ordinal
from weft.session import cut_lineage


def _runs(same: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of runs; ``same``: does a row continue the one before it."""
    start = np.flatnonzero(~same)
    return list(zip(start.tolist(), [*start[1:].tolist(), len(same)])) if len(same) else []


def _recur(noise: np.ndarray, rho: float, before: float) -> np.ndarray:
    return np.fromiter(accumulate(noise.tolist(), lambda x, e: rho * x + e, initial=before), np.float64, len(noise) + 1)[1:]


def linear_recurrence(df: DataFrame, rho: float, noise: str, order: list[str], group_cols: list[str] = (), out: str = "x") -> DataFrame:
    """``df`` with ``out``: ``rho`` times the value of the row before it in its group, plus ``noise``; the first row's value is its noise.

    ``order`` must order the rows of a group without ties. Null noise counts as 0; a null in a group column
    is a value. The result does not depend on the partitioning but for the last bits of rounding.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    group = F.xxhash64(*group_cols, F.concat_ws("", *[F.col(c).isNull().cast("string") for c in group_cols])) if group_cols else F.lit(0).cast("long")
    keys = [*[F.col(c) for c in group_cols], *[F.col(c) for c in order]]
    ranged = cut_lineage(df.withColumn("_g", group).withColumn("_e", F.coalesce(F.col(noise).cast("double"), F.lit(0.0)))
                         .repartitionByRange(n, "_g", *keys).withColumn("_part", F.spark_partition_id()))
    dealt = ranged.repartition(n, "_part").sortWithinPartitions("_part", "_g", *keys)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, list] = {}  # part -> first group, last group, is it one group, rows of it, last value from 0
        for b in batches:
            part, g, e = (b.column(c).to_numpy(zero_copy_only=False) for c in ("_part", "_g", "_e"))
            same = np.r_[False, (part[1:] == part[:-1]) & (g[1:] == g[:-1])] if len(g) else np.zeros(0, bool)
            for lo, hi in _runs(same):
                s = state.get(int(part[lo]))
                if s is None:
                    s = state[int(part[lo])] = [int(g[lo]), int(g[lo]), True, 0, 0.0]
                elif s[1] != g[lo]:
                    s[1:] = [int(g[lo]), False, 0, 0.0]
                s[3] += hi - lo
                s[4] = float(_recur(e[lo:hi], rho, s[4])[-1])
        rows = [(p, *s) for p, s in state.items()]
        cols = list(zip(*rows)) or [()] * 6
        types = [pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["part", "first", "last", "one", "n", "value"])

    maps = dealt.select("_part", "_g", "_e").mapInArrow(measure, "part int, first long, last long, one boolean, n long, value double").orderBy("part").collect()  # one row a partition
    carry, last, value = {}, None, 0.0
    for m in maps:
        carry[m["part"]] = value if m["first"] == last else 0.0
        value = m["value"] + (rho ** m["n"] * carry[m["part"]] if m["one"] else 0.0)
        last = m["last"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, series, value = None, None, 0.0
        for b in batches:
            part, g, e = (b.column(c).to_numpy(zero_copy_only=False) for c in ("_part", "_g", "_e"))
            same = np.r_[False, (part[1:] == part[:-1]) & (g[1:] == g[:-1])] if len(g) else np.zeros(0, bool)
            x = np.zeros(len(g))
            for lo, hi in _runs(same):
                if part[lo] != at:
                    value = carry[int(part[lo])]
                elif g[lo] != series:
                    value = 0.0
                x[lo:hi] = _recur(e[lo:hi], rho, value)
                at, series, value = part[lo], g[lo], float(x[hi - 1])
            names = [c for c in b.schema.names if c not in ("_part", "_g", "_e")]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(x)], names=[*names, out])

    schema = df.schema.add(out, "double") if out not in df.columns else None
    if schema is None:
        raise ValueError(f"the table already has a column {out}")
    return dealt.mapInArrow(run, schema)


def ar1_series(df: DataFrame, rho: float, ts_col: str, key_cols: list[str], seed: int, group_cols: list[str] = (), out: str = "x") -> DataFrame:
    """``df`` with a standard AR(1) series in time order (one for each group): variance 1, lag-1 correlation ``rho``.

    Noise is keyed on the row's key; equal times follow the key's hash, then the key. Rows without a time get null.
    """
    if not -1 < rho < 1:
        raise ValueError("rho must lie between -1 and 1")
    z = R.std_normal(seed, f"ar1:{out}", key_cols)
    have = df.where(F.col(ts_col).isNotNull()).withColumn("_h", hex52(F.concat_ws(":", *[F.col(k).cast("string") for k in key_cols])))
    # the first row of a series has the stationary variance 1, every later one adds noise of variance 1 - rho^2
    firsts = have.groupBy(*group_cols).agg(F.min(F.struct(ts_col, "_h", *key_cols)).alias("_first")) if group_cols else have.agg(F.min(F.struct(ts_col, "_h", *key_cols)).alias("_first"))
    firsts = firsts.select(*[F.col(f"_first.{k}").alias(f"_f_{k}") for k in key_cols]).withColumn("_is_first", F.lit(True))
    meet = [F.col(k) == F.col(f"_f_{k}") for k in key_cols]
    scaled = have.join(firsts, meet, "left").withColumn("_z", F.when(F.col("_is_first"), z).otherwise(z * F.lit((1 - rho * rho) ** 0.5))).select(*df.columns, "_h", "_z")
    done = linear_recurrence(scaled, rho, "_z", [ts_col, "_h", *key_cols], list(group_cols), out)
    return done.select(*df.columns, out).unionByName(df.where(F.col(ts_col).isNull()).withColumn(out, F.lit(None).cast("double")))


def autoregress(df: DataFrame, rho: float, ts_col: str, key_cols: list[str], seed: int, columns: list[str]) -> DataFrame:
    """Each column's own values re-ordered so that they follow an AR(1) series in time: its multiset is kept.

    Rows without a time or without a value keep theirs.
    """
    out = df
    for c in columns:
        have = df.where(F.col(ts_col).isNotNull() & F.col(c).isNotNull()).select(*key_cols, ts_col, c)
        score = cut_lineage(ar1_series(have, rho, ts_col, key_cols, seed, out=f"_ar_{c}").select(*key_cols, f"_ar_{c}"))
        place = ordinal(score, f"_ar_{c}", key_cols, "_p").select(*key_cols, "_p")
        values = ordinal(have.select(*key_cols, c), c, key_cols, "_p").select("_p", F.col(c).alias("_new"))
        moved = place.join(values, "_p").drop("_p").withColumn("_moved", F.lit(True))
        out = out.join(moved, key_cols, "left").withColumn(c, F.when(F.col("_moved"), F.col("_new")).otherwise(F.col(c))).select(*df.columns)
    return out
