"""Privacy: scan and mask personal data in all text columns, k-anonymity, l-diversity, score,
and the rows at risk (groups smaller than k) with suppression.

Scanning and masking is one projection; entity counts are one aggregate.  Group sizes use
``groupBy`` with map-side partial counts (a group holding a third of the rows is one
pre-aggregated row per task), never a window over the whole group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions import pii as P
from weft.plans.spec import cols_of
from weft.session import spread

# fixed values: column names never used as default quasi-identifiers
ID_NAMES = ("patient_id", "id", "uuid")


def scan_and_mask(df: DataFrame, columns: list[str] | None = None, seed: int = 0) -> DataFrame:
    """Every string column (or ``columns``) masked; shape and types unchanged."""
    cols = columns if columns is not None else cols_of(df, "string")
    sel = {c: P.mask_text(F.col(c), seed) for c in cols if c in df.columns}
    return spread(df).withColumns(sel) if sel else df


def entity_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows (entity, cells): number of cells holding at least one span of each type, over all
    scanned columns; one aggregate pass. Null cells count for nothing."""
    cols = [c for c in (columns if columns is not None else cols_of(df, "string")) if c in df.columns]
    # each column is scanned once (one projection), then all counts are one aggregate
    typed = spread(df).select(*[P.span_types(F.col(c)).alias(f"_t{i}") for i, c in enumerate(cols)])
    aggs = []
    for t in P.TYPES:
        acc = None
        for i in range(len(cols)):
            hit = F.count_if(F.coalesce(F.array_contains(F.col(f"_t{i}"), F.lit(t)), F.lit(False)))
            acc = hit if acc is None else acc + hit
        aggs.append(F.struct(F.lit(t).alias("entity"), (acc if acc is not None else F.lit(0)).cast("long").alias("cells")))
    return typed.agg(F.array(*aggs).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def default_quasi_ids(df: DataFrame) -> list[str]:
    return [c for c in cols_of(df, "string") if c not in ID_NAMES]


def group_sizes(df: DataFrame, quasi_ids: list[str]) -> DataFrame:
    return df.groupBy(*quasi_ids).agg(F.count(F.lit(1)).alias("_size"))


def k_anonymity(df: DataFrame, quasi_ids: list[str]) -> DataFrame:
    """Smallest group over the quasi-identifiers (null is a value); no quasi-ids -> 1."""
    q = [c for c in quasi_ids if c in df.columns]
    if not q:
        return df.sparkSession.range(1).select(F.lit(1).cast("long").alias("k"))
    return group_sizes(df, q).agg(F.min("_size").cast("long").alias("k"))


def l_diversity(df: DataFrame, quasi_ids: list[str], sensitive: str) -> DataFrame:
    """Smallest number of distinct non-null sensitive values in a group; the sensitive column
    is removed from the quasi-identifiers."""
    q = [c for c in quasi_ids if c in df.columns and c != sensitive]
    if not q or sensitive not in df.columns:
        return df.sparkSession.range(1).select(F.lit(1.0).alias("l"))
    # distinct (group, value) pairs first: partial aggregation keeps hot groups cheap
    pairs = df.select(*q, sensitive).distinct()
    per_group = pairs.groupBy(*q).agg(F.count(sensitive).alias("_d"))
    return per_group.agg(F.min("_d").cast("double").alias("l"))


def privacy_score(k: int | F.Column, l_div, pii_cells, total_cells, k_mode: str = "synthetic") -> F.Column:
    """0..100 = k part (40) + l part (20) + PII-density part (40).

    ``k_mode='synthetic'`` scores k=1 best (every row unique is what synthetic data wants);
    ``k_mode='risk'`` scores larger k better (min(40, 4k)) for real data.
    """
    k = F.lit(k) if not isinstance(k, F.Column) else k
    l_div = F.lit(float(l_div)) if not isinstance(l_div, F.Column) else l_div
    pii_cells = F.lit(pii_cells) if not isinstance(pii_cells, F.Column) else pii_cells
    total_cells = F.lit(total_cells) if not isinstance(total_cells, F.Column) else total_cells
    if k_mode == "risk":
        k_part = F.least(F.lit(40.0), F.lit(4.0) * k)
    else:
        k_part = F.when(k == 1, F.lit(40.0)).otherwise(F.least(F.lit(40.0), F.lit(40.0) / F.greatest(k, F.lit(1))))
    l_part = F.when(l_div < 2.0, F.least(F.lit(20.0), F.lit(20.0) * l_div / F.lit(2.0))).otherwise(F.lit(20.0))
    rate = pii_cells / F.greatest(total_cells, F.lit(1))
    pii_part = F.lit(40.0) * F.greatest(F.lit(0.0), F.lit(1.0) - rate * F.lit(10.0))
    return F.least(F.lit(100.0), k_part + l_part + pii_part)


def _small_groups(df: DataFrame, q: list[str], k: int) -> DataFrame:
    """Groups of fewer than ``k`` rows; Spark broadcasts them if their bytes stay under its threshold."""
    return group_sizes(df, q).where(F.col("_size") < F.lit(k))


def k_violators(df: DataFrame, quasi_ids: list[str], k: int) -> DataFrame:
    """Rows whose quasi-identifier group has fewer than k rows, with the group size."""
    q = [c for c in quasi_ids if c in df.columns]
    s = _small_groups(df, q, k).select(*[F.col(c).alias(f"_q_{c}") for c in q], "_size")
    cond = [df[c].eqNullSafe(s[f"_q_{c}"]) for c in q]
    return df.join(s, cond, "inner").drop(*[f"_q_{c}" for c in q]).withColumnRenamed("_size", "group_size")


def k_suppress(df: DataFrame, quasi_ids: list[str], k: int) -> DataFrame:
    """Quasi-identifiers set to null on rows of groups smaller than k (other columns kept)."""
    q = [c for c in quasi_ids if c in df.columns]
    s = _small_groups(df, q, k).select(*[F.col(c).alias(f"_q_{c}") for c in q], F.lit(True).alias("_risk"))
    cond = [df[c].eqNullSafe(s[f"_q_{c}"]) for c in q]
    j = df.join(s, cond, "left")
    out = j.withColumns({c: F.when(F.col("_risk"), F.lit(None).cast(df.schema[c].dataType)).otherwise(F.col(c))
                         for c in q})
    return out.select(*df.columns)


def privacy_report(df: DataFrame, quasi_ids: list[str] | None = None, sensitive: str | None = None,
                   columns: list[str] | None = None, k_mode: str = "synthetic") -> DataFrame:
    """One row: k, l, pii_cells, total_cells, privacy_score."""
    q = quasi_ids if quasi_ids is not None else default_quasi_ids(df)
    k = k_anonymity(df, q).first()["k"]
    l_div = l_diversity(df, q, sensitive).first()["l"] if sensitive else 1.0
    counts = entity_counts(df, columns).agg(F.sum("cells").alias("p")).first()["p"] or 0
    n = df.count()
    total = n * len(df.columns)
    spark = df.sparkSession
    return spark.range(1).select(
        F.lit(int(k)).cast("long").alias("k"), F.lit(float(l_div)).alias("l"),
        F.lit(int(counts)).cast("long").alias("pii_cells"), F.lit(int(total)).cast("long").alias("total_cells"),
        privacy_score(int(k), float(l_div), int(counts), int(total), k_mode).alias("privacy_score"))
