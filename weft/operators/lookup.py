"""Lookups over tables: per-group top-k (grounding), code repair, and request parsing over text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions import rand as R
from weft.functions import text as TX

BROADCAST_CODES = 1_000_000


def top_k_per_group(df: DataFrame, group_cols: list[str], order: list[Column], k: int,
                    tie_cols: list[str] = (), salts: int = 16) -> DataFrame:
    """The first k rows of each group by ``order`` (a top-k report: the limit is the feature).

    Two steps so that a hot group is not ranked in one task: rows are spread over
    ``salts`` sub-groups by a hash of the tie columns, each sub-group keeps its own top k,
    and the final ranking sees at most ``k * salts`` rows per group.
    """
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in (tie_cols or df.columns)]), F.lit(salts))
    w1 = Window.partitionBy(*group_cols, "_salt").orderBy(*order)
    local = (df.withColumn("_salt", salt).withColumn("_r1", F.row_number().over(w1))
             .where(F.col("_r1") <= k).drop("_r1"))
    w2 = Window.partitionBy(*group_cols).orderBy(*order)
    return local.withColumn("rank", F.row_number().over(w2)).where(F.col("rank") <= k).drop("_salt")


def code_guard(df: DataFrame, code_col: str, valid: DataFrame, valid_col: str, fallback: Column,
               out: str | None = None) -> DataFrame:
    """Codes not found in the valid list are replaced by ``fallback`` (e.g. INR for India, else USD).

    The code list is distinct-ed and broadcast only when its size is known to be small.
    """
    codes = valid.select(F.col(valid_col).alias("_code")).where(F.col("_code").isNotNull()).distinct().persist()
    n = codes.count()
    codes = codes.withColumn("_ok", F.lit(True))
    if n <= BROADCAST_CODES:
        codes = F.broadcast(codes)
    j = df.join(codes, df[code_col] == codes["_code"], "left")
    return j.withColumn(out or code_col, F.when(F.col("_ok"), F.col(code_col)).otherwise(fallback)) \
        .drop("_code", "_ok")


def parse_requests(df: DataFrame, text_col: str) -> DataFrame:
    """Request row per text without a model: domain, country, state, row count and seed. Row-local: callers
    with few large input files can ``spread`` them over all cores first."""
    staged = TX.with_row_count(TX.with_domain_and_region(df, text_col, "domain", "_region"), text_col, "row_count")
    return staged.select(
        *df.columns,
        "domain",
        F.col("_region.country").alias("country"),
        F.col("_region.state").alias("state"),
        "row_count",
        R.seed_of_text(F.col(text_col)).alias("seed"),
    )


def distribution_priors(columns: DataFrame, sem_col: str, priors: DataFrame, max_broadcast: int = 100_000) -> DataFrame:
    """Attach the prior distribution of each column's semantic type (left join; unknown types keep nulls).

    ``priors``: semantic_type, distribution_type, params (map or JSON text), clip_min, clip_max.
    The priors table is broadcast only when its row count is within ``max_broadcast``.
    """
    p = priors
    if "params" in p.columns and not isinstance(p.schema["params"].dataType, T.MapType):
        p = p.withColumn("params", F.from_json(F.col("params").cast("string"), "map<string,double>"))
    p = p.withColumnRenamed("semantic_type", "_sem")
    if p.count() <= max_broadcast:
        p = F.broadcast(p)
    return columns.join(p, F.lower(columns[sem_col]) == F.lower(p["_sem"]), "left").drop("_sem")


def cities_of(cities: DataFrame, country: str | None, limit: int,
              country_col: str = "country", order: list[Column] | None = None) -> DataFrame:
    """Up to ``limit`` cities of one country (most populous first), or of every country when
    ``country`` is None (a per-group top-k)."""
    order = order or [F.col("population").desc_nulls_last(), F.col("city")]
    if country is not None:
        return cities.where(F.lower(F.col(country_col)) == F.lit(country.lower())).orderBy(*order).limit(limit)
    return top_k_per_group(cities, [country_col], order, limit, tie_cols=["city"])
