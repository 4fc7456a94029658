"""Distributed ordering primitives: average ranks and dense row indexes.

A plain ``rank() over (order by x)`` has no partition and Spark plans it as
``Exchange SinglePartition`` -- one task sees every row.  Here we:

1. collapse equal values first (``groupBy(v).count()`` with map-side combine, so a
   hot value that holds a third of the rows becomes one row);
2. cut the distinct values into buckets at approximate quantiles (cut points are a
   bounded list, whose length follows the number of rows);
3. rank inside each bucket with a window ``partitionBy(bucket)``;
4. add each bucket's offset, computed from a table of ``n_buckets`` rows.

Ties share a bucket because the bucket is a monotone function of the value, so the
result equals the single-partition rank exactly.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.functions.rand import hex52

BUCKETS = 256  # buckets of a distributed order, up to BUCKETS x ROWS_A_BUCKET rows; does not follow the shuffle setting
ROWS_A_BUCKET = 4_000_000  # beyond that, one bucket for so many rows
MOST_BUCKETS = 1 << 18  # cut points are a list on the driver; past 10^12 rows buckets grow again, and their windows spill
HASH_BUCKETS = 1 << 16  # of orders over a uniform hash, which need no cut points


def buckets_for(rows: int) -> int:
    return min(max(BUCKETS, -(-rows // ROWS_A_BUCKET)), MOST_BUCKETS)


def hash_bits_for(rows: int, least: int = 10) -> int:
    """Bits of a key hash that part one value held by all ``rows`` into groups of about ROWS_A_BUCKET at most."""
    return max(least, (max(rows, 1) // ROWS_A_BUCKET).bit_length())


def _cut_points(vals: DataFrame, col: str, n_buckets: int | None = None) -> list[float]:
    return _cuts_of(vals, [col], n_buckets)[col][0]


def _cuts_of(df: DataFrame, cols: list[str], n_buckets: int | None = None) -> dict[str, tuple[list[float], int]]:
    """(increasing cut points as doubles, non-null rows) of several columns from one map-side combined aggregate.

    Without ``n_buckets`` the number of buckets follows the rows: a column with more than BUCKETS x ROWS_A_BUCKET of
    them is cut again, more finely, by a second aggregate.
    """
    def cut(todo: list[str], n: int) -> dict[str, tuple[list[float], int]]:
        if n <= 1:
            return {c: ([], 0) for c in todo}
        probs = F.split(F.lit(",".join(repr(i / n) for i in range(1, n))), ",").cast("array<double>")  # one literal, however many
        aggs = [F.percentile_approx(as_double(c, df.schema[c].dataType), probs, 4 * n).alias(f"_c{i}") for i, c in enumerate(todo)]
        row = df.agg(*aggs, *[F.count(c).alias(f"_n{i}") for i, c in enumerate(todo)]).first()
        return {c: (sorted({float(x) for x in row[f"_c{i}"] or () if x == x}), row[f"_n{i}"]) for i, c in enumerate(todo)}

    out = cut(cols, n_buckets or BUCKETS)
    if n_buckets is None:
        finer: dict[int, list[str]] = {}
        for c, (_, rows) in out.items():
            if buckets_for(rows) > BUCKETS:
                finer.setdefault(buckets_for(rows), []).append(c)
        for n, todo in finer.items():
            out.update(cut(todo, n))
    return out


def as_double(c, dtype) -> "F.Column":
    """Order-preserving double for numbers, timestamps (microseconds, time-zone free) and dates."""
    import datetime as _dt

    from pyspark.sql import types as T

    x = F.col(c) if isinstance(c, str) else c
    if isinstance(dtype, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit(_dt.datetime(1970, 1, 1)).cast("timestamp_ntz"), x).cast("double")
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(x).cast("double")
    if isinstance(dtype, T.DateType):
        return F.unix_date(x).cast("double")
    return x.cast("double")


def _bucketize(vals: DataFrame, col: str, cuts: list[float], out: str = "_bkt") -> DataFrame:
    if not cuts:
        return vals.withColumn(out, F.lit(0))
    splits = [float("-inf")] + cuts + [float("inf")]
    dcol = f"{out}_x"
    vals = vals.withColumn(dcol, as_double(col, vals.schema[col].dataType))
    b = Bucketizer(splits=splits, inputCol=dcol, outputCol=out, handleInvalid="keep")
    return b.transform(vals).drop(dcol).withColumn(out, F.col(out).cast("int"))


def value_ranks(df: DataFrame, col: str, n_buckets: int | None = None, rank_col: str = "rank",
                cuts: list[float] | None = None) -> DataFrame:
    """Distinct non-null values of ``col`` with their average rank (1-based, ties averaged).

    Columns: ``v`` (the value, in its own type), ``n`` (its multiplicity), ``rank_col``. Cut points
    are doubles, but values are counted and ordered in their own type, so large integers that share a
    double still rank apart.
    """
    cuts = cuts if cuts is not None else _cut_points(df, col, n_buckets)
    vc = (df.select(F.col(col).alias("v")).where(F.col("v").isNotNull())
          .groupBy("v").agg(F.count(F.lit(1)).alias("n")))
    b = _bucketize(vc, "v", cuts)
    totals = b.groupBy("_bkt").agg(F.sum("n").alias("_tot"))  # one row a bucket
    offsets = totals.select(
        "_bkt",
        (F.sum("_tot").over(Window.orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1))).alias("_off"),
    ).fillna(0, ["_off"])
    w = Window.partitionBy("_bkt").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = b.withColumn("_run", F.sum("n").over(w))
    ranked = inner.join(F.broadcast(offsets), "_bkt").select(
        "v", "n",
        (F.col("_off") + F.col("_run") - F.col("n") + (F.col("n") + F.lit(1)) / F.lit(2.0)).alias(rank_col),
    )
    return ranked


def exact_median(df: DataFrame, col: str) -> float | None:
    """Median of the non-null values (mean of the two middle ones), from distributed ranks; two values reach the driver."""
    ranks = value_ranks(df, col)
    n = df.agg(F.count(col)).first()[0]
    if not n:
        return None
    low, high = F.col("rank") - (F.col("n") - 1) / 2, F.col("rank") + (F.col("n") - 1) / 2
    middle = [(n + 1) // 2, n // 2 + 1]
    at = ranks.where(" OR ".join(f"({p} BETWEEN rank - (n - 1) / 2 AND rank + (n - 1) / 2)" for p in middle)).select("v", low.alias("a"), high.alias("b")).collect()
    found = [float(r["v"]) for p in middle for r in at if r["a"] <= p <= r["b"]]
    return sum(found) / len(found)


def dense_index(df: DataFrame, key_cols: list[str], out: str = "_idx", n_buckets: int | None = None) -> DataFrame:
    """0-based dense row index over a unique key, in (h(key), key) order.

    ``h`` is the 52-bit SHA-256 prefix of the key text; it spreads rows evenly over the
    buckets whatever the key distribution, and any SQL engine can reproduce the order.
    """
    n_buckets = n_buckets or HASH_BUCKETS
    h = "_h"
    x = df.withColumn(h, hex52(F.concat_ws(":", *[F.col(k).cast("string") for k in key_cols])))
    b = x.withColumn("_bkt", F.floor(F.col(h) / F.lit(float(1 << 52)) * F.lit(n_buckets)).cast("int"))  # h is uniform
    totals = b.groupBy("_bkt").agg(F.count(F.lit(1)).alias("_tot"))
    offsets = totals.select(
        "_bkt",
        F.coalesce(F.sum("_tot").over(Window.orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_off"),
    )
    w = Window.partitionBy("_bkt").orderBy(h, *key_cols)
    return (b.withColumn("_rn", F.row_number().over(w))
            .join(F.broadcast(offsets), "_bkt")
            .withColumn(out, (F.col("_off") + F.col("_rn") - F.lit(1)).cast("long"))
            .drop("_bkt", "_rn", "_off", h))


def key_hash(key_cols: list[str]) -> "F.Column":
    """52-bit SHA-256 prefix of the key text."""
    return hex52(F.concat_ws(":", *[F.col(k).cast("string") for k in key_cols]))


def ordinal(df: DataFrame, value_col: str, key_cols: list[str], out: str = "_pos",
            n_buckets: int | None = None, hash_bits: int | None = None, hashed: str | None = None,
            counted: DataFrame | None = None, ties: list[str] | tuple = ()) -> DataFrame:
    """0-based position of each row in (value, h(key), key) order, rows of one key by ``ties`` descending; null values are left out.

    ``hashed``: a column that holds ``h(key)`` already. ``counted``: a table with the same values and keys that is
    cheaper to read several times; cut points and group counts then come from it and ``df`` is read once.

    ``h`` is the 52-bit SHA-256 prefix of the key text (``weft.functions.rand.hex52``), so the
    same order can be reproduced by any SQL engine with sha256.

    Equal values are split further by the top ``hash_bits`` bits of the key hash (default: 10, more
    where the rows ask for it), so a value held by a third of all rows is spread over
    ``2**hash_bits`` window partitions instead of one.
    """
    counted = df if counted is None else counted
    cuts, rows = _cuts_of(counted, [value_col], n_buckets)[value_col]
    hash_bits = hash_bits or hash_bits_for(rows)
    h = F.col(hashed) if hashed else key_hash(key_cols)

    def parted(t: DataFrame) -> DataFrame:
        return t.where(F.col(value_col).isNotNull()).withColumn("_h", h).withColumn("_hb", F.shiftright(F.col("_h"), 52 - hash_bits))

    x = parted(df)
    g = parted(counted).groupBy(F.col(value_col).alias("_v"), "_hb").agg(F.count(F.lit(1)).alias("_c"))
    gb = _bucketize(g, "_v", cuts)
    totals = gb.groupBy("_bkt").agg(F.sum("_c").alias("_tot"))
    boff = totals.select(
        "_bkt",
        F.coalesce(F.sum("_tot").over(Window.orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_boff"),
    )
    w = Window.partitionBy("_bkt").orderBy("_v", "_hb").rowsBetween(Window.unboundedPreceding, -1)
    goff = (gb.withColumn("_inner", F.coalesce(F.sum("_c").over(w), F.lit(0)))
            .join(F.broadcast(boff), "_bkt")
            .select("_v", "_hb", (F.col("_boff") + F.col("_inner")).alias("_goff")))
    wr = Window.partitionBy(value_col, "_hb").orderBy("_h", *key_cols, *[F.desc(t) for t in ties])
    return (x.join(goff, (x[value_col].eqNullSafe(goff["_v"])) & (x["_hb"] == goff["_hb"]))
            .drop(goff["_hb"])
            .withColumn(out, (F.col("_goff") + F.row_number().over(wr) - F.lit(1)).cast("long"))
            .drop("_v", "_goff", "_h", "_hb"))


def multi_value_ranks(df: DataFrame, cols: list[str], n_buckets: int | None = None) -> dict[str, DataFrame]:
    """Average ranks of several columns: a table (v, n, rank) for each, values in their own type.

    One aggregate finds all cut points; each column is then counted on its own, so no row is expanded.
    """
    cuts = _cuts_of(df, cols, n_buckets)
    return {c: value_ranks(df, c, cuts=cuts[c][0]) for c in cols}


def attach_ranks(df: DataFrame, cols: list[str], ranks: dict[str, DataFrame], prefix: str = "_r_") -> DataFrame:
    """Each column's rank (``prefix + col``) joined onto the rows by value; Spark broadcasts what its size threshold allows."""
    out = df
    for c in cols:
        r = ranks[c].select(F.col("v").alias("_rv"), F.col("rank").alias(prefix + c))
        out = out.join(r, out[c] == r["_rv"], "left").drop("_rv")
    return out
