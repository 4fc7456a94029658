"""Rank correlation: distributed Spearman, drift against targets, rank nudging and a repair loop.

Spearman = Pearson correlation of average ranks, over the rows where both columns are
non-null.  Columns without nulls are ranked once and shared by all their pairs; a pair
with nulls in either column is ranked inside its own complete rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.operators.rank import attach_ranks, key_hash, multi_value_ranks, ordinal
from weft.plans.spec import CorrelationTarget
from weft.session import cut_lineage

PAIR_SCHEMA = "col_a string, col_b string, rho double, n bigint"


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def _ranked(df: DataFrame, cols: list[str], n_buckets=None) -> DataFrame:
    return attach_ranks(df.select(*cols), cols, multi_value_ranks(df, cols, n_buckets))


def spearman_pairs(df: DataFrame, pairs: list[tuple[str, str]], n_buckets: int | None = None,
                   min_rows: int = 3) -> DataFrame:
    """Spearman rho for each (a, b) pair, pairwise complete; pairs with < ``min_rows`` rows dropped."""
    spark = df.sparkSession
    pairs = [(a, b) for a, b in pairs if a != b]
    if not pairs:
        return spark.createDataFrame([], PAIR_SCHEMA)
    cols = sorted({c for p in pairs for c in p})
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first().asDict()
    complete = [c for c in cols if nulls[c] == 0]
    results = []
    shared_pairs = [(a, b) for a, b in pairs if a in complete and b in complete]
    if shared_pairs:
        need = sorted({c for p in shared_pairs for c in p})
        rk = _ranked(df, need, n_buckets)
        structs = [F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"),
                            F.corr(f"_r_{a}", f"_r_{b}").alias("rho"), F.count(F.lit(1)).alias("n"))
                   for a, b in shared_pairs]
        results.append(rk.agg(F.array(*structs).alias("x")).select(F.explode("x").alias("x")).select("x.*"))
    for a, b in pairs:
        if (a, b) in shared_pairs:
            continue
        sub = df.select(a, b).where(F.col(a).isNotNull() & F.col(b).isNotNull())
        rk = _ranked(sub, [a, b], n_buckets)
        results.append(rk.agg(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"),
                              F.corr(f"_r_{a}", f"_r_{b}").alias("rho"), F.count(F.lit(1)).alias("n")))
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out.where(F.col("n") >= min_rows).withColumn("n", F.col("n").cast("long"))


def spearman_matrix(df: DataFrame, cols: list[str] | None = None, n_buckets: int | None = None) -> DataFrame:
    """All pairs (i < j in column order) of the numeric columns."""
    cols = cols or numeric_columns(df)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    return spearman_pairs(df, pairs, n_buckets)


def targets_frame(spark, targets: list[CorrelationTarget]) -> DataFrame:
    return spark.createDataFrame([(t.col_a, t.col_b, float(t.strength)) for t in targets],
                                 "t_col_a string, t_col_b string, target double")


def drift(actual: DataFrame, targets: DataFrame, threshold: float = 0.15) -> DataFrame:
    """Pairs whose |actual - target| exceeds the threshold; a pair matches in either order.

    ``targets`` is a small table (t_col_a, t_col_b, target) of declared targets.
    """
    a = actual.select(F.least("col_a", "col_b").alias("_lo"), F.greatest("col_a", "col_b").alias("_hi"),
                      F.col("rho").alias("actual"))
    t = targets.select("t_col_a", "t_col_b", "target",
                       F.least("t_col_a", "t_col_b").alias("_lo"), F.greatest("t_col_a", "t_col_b").alias("_hi"))
    j = t.join(a, ["_lo", "_hi"])
    return (j.select(F.col("t_col_a").alias("col_a"), F.col("t_col_b").alias("col_b"), "actual", "target",
                     F.abs(F.col("actual") - F.col("target")).alias("delta"))
            .where(F.col("delta") > F.lit(threshold)))


def nudge(df: DataFrame, col_a: str, col_b: str, direction: float, iteration: int, key_cols: list[str],
          step0: float = 0.3, decay: float = 0.7, n_buckets: int | None = None) -> DataFrame:
    """Move b's rank order toward a's (direction > 0) or reversed a's (direction <= 0).

    Ordinal ranks (0-based, ties broken by key hash then key) are blended with weight
    ``step0 * decay**iteration``; b then receives its own sorted values in the blended order,
    so b's multiset of values is unchanged.  Rows with a null in a or b are left as they are.
    """
    step = step0 * decay**iteration
    both = df.where(F.col(col_a).isNotNull() & F.col(col_b).isNotNull()).withColumn("_kh", key_hash(key_cols))
    rest = df.where(F.col(col_a).isNull() | F.col(col_b).isNull())
    ra = ordinal(both, col_a, key_cols, "_ra", n_buckets, hashed="_kh")
    rab = cut_lineage(ordinal(ra, col_b, key_cols, "_rb", n_buckets, hashed="_kh", counted=both, ties=["_ra"]))  # rows of one key keep one order
    n = rab.count()
    other = F.col("_ra") if direction > 0 else F.lit(n - 1) - F.col("_ra")
    blended = rab.withColumn("_blend", F.lit(1.0 - step) * F.col("_rb") + F.lit(step) * other)
    pos = ordinal(blended, "_blend", key_cols, "_pos", n_buckets, hashed="_kh").drop("_ra", "_rb", "_blend")
    sorted_b = rab.select(F.col("_rb").alias("_pos"), F.col(col_b).alias("_newb"))
    moved = (pos.join(sorted_b, "_pos").withColumn(col_b, F.col("_newb")).drop("_newb", "_pos")
             .select(*df.columns))
    return moved.unionByName(rest)


def repair(df: DataFrame, targets: list[CorrelationTarget], key_cols: list[str], max_iter: int = 3,
           threshold: float = 0.15, n_buckets: int | None = None) -> DataFrame:
    """Up to ``max_iter`` rounds of nudging every drifted pair; lineage is cut after each round.

    The nudge direction is the sign of (target - actual), so a pair above its target moves down.
    """
    spark = df.sparkSession
    cur = df
    tdf = targets_frame(spark, targets)
    for it in range(max_iter):
        actual = spearman_pairs(cur, [(t.col_a, t.col_b) for t in targets], n_buckets)
        events = drift(actual, tdf, threshold).collect()  # at most len(targets) rows
        if not events:
            break
        for e in events:
            cur = nudge(cur, e["col_a"], e["col_b"], e["target"] - e["actual"], it, key_cols, n_buckets=n_buckets)
        cur = cut_lineage(cur)
    return cur
