"""Scaling a seed table to a target row count, keeping per-column distributions (and, with the
copula, the rank-correlation structure).

Fit = one aggregate job (moments, min/max, frequency tables); generate = one narrow stage on
``spark.range(target)``; resampling joins by a dense row index.  Nothing row-level goes
through the driver: only moments, category frequency tables of checked size and k x k
correlation matrices.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions import rand as R
from weft.operators.rank import dense_index, ordinal
from weft.plans.spec import TableSpec
from weft.session import cut_lineage

LITERAL_CATEGORIES = 1000  # above this, categorical draws are joined by position
LAYOUT_RUN = 4096


def column_kinds(df: DataFrame, spec: TableSpec | None = None, key_cols=()) -> dict[str, str]:
    """numerical / boolean / datetime / categorical / text / id for each column (booleans and
    enums are categorical, not numbers)."""
    out = {}
    for f in df.schema.fields:
        cs = spec.column(f.name) if spec else None
        t = f.dataType
        if f.name in key_cols or (cs is not None and cs.primary_key):
            out[f.name] = "id"
        elif isinstance(t, T.BooleanType) or (cs is not None and cs.enum_values):
            out[f.name] = "categorical"
        elif isinstance(t, T.NumericType):
            out[f.name] = "numerical"
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            out[f.name] = "datetime"
        elif isinstance(t, T.StringType):
            out[f.name] = "categorical"
        else:
            out[f.name] = "text"
    return out


SAMPLE_BINS = 1 << 20


def scale_down(df: DataFrame, n: int, seed: int, key_cols: list[str]) -> DataFrame:
    """Exactly n rows without replacement: the n smallest keyed uniforms (ties by key).

    Rows are counted per bin of the uniform (SAMPLE_BINS equal bins, map-side combined); whole bins
    below the boundary bin stay, and only the rows of the boundary bin are ranked. A table of
    fewer than n rows stays whole.
    """
    u = R.uniform01(seed, "sample", key_cols)
    binned = df.withColumn("_u", u).withColumn("_bin", F.floor(F.col("_u") * F.lit(float(SAMPLE_BINS))).cast("int"))
    groups = binned.groupBy(F.shiftright("_bin", 10).alias("g"), "_bin").agg(F.count(F.lit(1)).alias("c"))
    coarse = groups.groupBy("g").agg(F.sum("c")).collect()  # at most 1,024 rows
    before, g = _boundary(coarse, n)
    if g is None:
        return df
    before, edge = _boundary(groups.where(F.col("g") == g).groupBy("_bin").agg(F.sum("c")).collect(), n, before)
    inside = binned.where(F.col("_bin") == edge).withColumn("_nth", F.row_number().over(
        Window.partitionBy("_bin").orderBy("_u", *key_cols))).where(F.col("_nth") <= n - before).drop("_nth")
    return binned.where(F.col("_bin") < edge).unionByName(inside).drop("_u", "_bin")


def _boundary(counts, n: int, before: int = 0):
    """(rows before, bin) of the bin that holds the n-th row; bin None if there are fewer."""
    for b, c in sorted(map(tuple, counts)):
        if before + c >= n:
            return before, b
        before += c
    return before, None


def fit(df: DataFrame, kinds: dict[str, str]) -> dict:
    """One aggregate: mean/std for numerical, min/max for datetime, non-null counts, row count."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    for c, k in kinds.items():
        if k == "numerical":
            aggs += [F.avg(F.col(c).cast("double")).alias(f"{c}__m"), F.stddev_samp(F.col(c).cast("double")).alias(f"{c}__s")]
        elif k == "datetime":
            aggs += [F.min(c).alias(f"{c}__lo"), F.max(c).alias(f"{c}__hi")]
        aggs.append(F.count(F.col(c)).alias(f"{c}__nn"))
    return df.agg(*aggs).first().asDict()


def numeric_column(c: str, m: dict, seed, keys, dtype, low=None, high=None) -> Column:
    mean = m[f"{c}__m"]
    if mean is None:
        return F.lit(None).cast(dtype)
    std = max(float(m[f"{c}__s"] or 0.0), 1e-9)
    x = R.normal(seed, f"scale:{c}", keys, float(mean), std)
    if low is not None or high is not None:
        x = R.clip(x, low, high)
    return F.round(x).cast(dtype) if isinstance(dtype, T.IntegralType) else x.cast(dtype)


def datetime_column(c: str, m: dict, ratio: float, seed, keys, dtype) -> Column:
    lo, hi = m[f"{c}__lo"], m[f"{c}__hi"]
    if lo is None:
        return F.lit(None).cast(dtype)
    lo_c = F.lit(lo).cast("timestamp_ntz")
    span = F.timestamp_diff("MICROSECOND", lo_c, F.lit(hi).cast("timestamp_ntz")).cast("double") * F.lit(float(ratio))
    offset = F.floor(R.uniform01(seed, f"scale:{c}", keys) * span).cast("long")
    out = F.timestamp_add("MICROSECOND", offset, lo_c)
    return out.cast(dtype)


def category_table(df: DataFrame, c: str) -> DataFrame:
    """(value, count, cum_before, cum_after) in (h(value), value) order, h = SHA-256 prefix.

    Any fixed category order serves frequency sampling; a hash order lets the cumulative
    counts be computed in buckets (no single-partition window) and be reproduced elsewhere."""
    from pyspark.sql import Window

    from weft.operators.rank import _bucketize, _cut_points

    g = (df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("_v")).agg(F.count(F.lit(1)).alias("_cnt"))
         .withColumn("_h", R.hex52(F.col("_v").cast("string"))))
    cuts = _cut_points(g, "_h")
    b = _bucketize(g, "_h", cuts)
    tot = b.groupBy("_bkt").agg(F.sum("_cnt").alias("_t"))
    off = tot.select("_bkt", F.coalesce(F.sum("_t").over(Window.orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)),
                                        F.lit(0)).alias("_off"))
    w = Window.partitionBy("_bkt").orderBy("_h", "_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (b.withColumn("_run", F.sum("_cnt").over(w)).join(F.broadcast(off), "_bkt")
            .select("_v", "_cnt", "_h", (F.col("_off") + F.col("_run")).alias("_cum"))
            .withColumn("_before", F.col("_cum") - F.col("_cnt")))


def categorical_draws(spine: DataFrame, key: str, df: DataFrame, c: str, seed) -> DataFrame:
    """Adds column ``c`` to the spine, resampled by observed frequency (nulls not drawn).

    A draw is a position ``floor(U * n)`` among the n non-null values in category order. Up to
    LITERAL_CATEGORIES categories, the position is looked up in a literal array of cumulative counts;
    beyond, categories are laid out position by position and joined by position. Both give the same value.
    """
    cats = category_table(df, c)
    n_cat, total = cats.agg(F.count(F.lit(1)), F.max("_cum")).first()
    if n_cat == 0:
        return spine.withColumn(c, F.lit(None).cast(df.schema[c].dataType))
    r = F.floor(R.uniform01(seed, f"scale:{c}", [F.col(key)]) * F.lit(float(total)))
    if n_cat <= LITERAL_CATEGORIES:
        rows = cats.orderBy("_h", "_v").select("_v", "_cum").collect()
        idx = R.index_by_cdf(r, [int(x["_cum"]) for x in rows])
        vals = F.array(*[F.lit(x["_v"]) for x in rows])
        return spine.withColumn(c, F.element_at(vals, idx + 1))
    # a category's positions in runs of at most LAYOUT_RUN, dealt out before they are laid out one by one
    runs = cats.select("_v", "_before", "_cum", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_cnt") - 1) / LAYOUT_RUN))).alias("_run"))
    runs = runs.select("_v", (F.col("_before") + F.col("_run") * LAYOUT_RUN).alias("_from"), "_cum").repartition(F.col("_from"))
    each = runs.select("_v", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + LAYOUT_RUN, F.col("_cum")) - 1)).alias("_pos"))
    return spine.withColumn("_pos", r).join(each, "_pos").drop("_pos").withColumnRenamed("_v", c)


def bootstrap(spine: DataFrame, key: str, df: DataFrame, cols: list[str], key_cols: list[str], seed,
              n: int | None = None) -> DataFrame:
    """Columns resampled with replacement: spine row j takes row floor(U(j) * n) of the dense index."""
    n = n if n is not None else df.count()
    idx = dense_index(df.select(*key_cols, *cols), key_cols, "_idx").select("_idx", *cols)
    s = spine.withColumn("_idx", F.floor(R.uniform01(seed, "scale:boot", [F.col(key)]) * F.lit(n)).cast("long"))
    return s.join(idx, "_idx").drop("_idx")


def scale(df: DataFrame, target: int, seed: int, key_cols: list[str], spec: TableSpec | None = None) -> DataFrame:
    """Seed table -> ``target`` rows.  target <= rows: exact sample.  Otherwise per column:
    numerical ~ N(mean, std) (rounded for integers, clipped to the spec range), datetime uniform
    over the stretched span, categorical by frequency, other kinds resampled, keys fresh ids."""
    kinds = column_kinds(df, spec, key_cols)
    m = fit(df, kinds)
    n = int(m["_n"])
    if n == 0:
        return df
    if target <= n:
        return scale_down(df, target, seed, key_cols)
    spark = df.sparkSession
    spine = spark.range(target).withColumnRenamed("id", "_row")
    keys = [F.col("_row")]
    sel = {}
    for f in df.schema.fields:
        c, k = f.name, kinds[f.name]
        cs = spec.column(c) if spec else None
        if k == "id":
            sel[c] = (R.uuid_like(F.concat_ws(":", F.lit(str(seed)), F.lit(c), F.col("_row").cast("string")))
                      if isinstance(f.dataType, T.StringType) else (F.col("_row") + F.lit(1)).cast(f.dataType))
        elif k == "numerical":
            sel[c] = numeric_column(c, m, seed, keys, f.dataType, cs.min_value if cs else None, cs.max_value if cs else None)
        elif k == "datetime":
            sel[c] = datetime_column(c, m, target / n, seed, keys, f.dataType)
    out = spine.select("_row", *[v.alias(k) for k, v in sel.items()])
    for f in df.schema.fields:
        if kinds[f.name] == "categorical":
            out = categorical_draws(out, "_row", df, f.name, seed)
    other = [f.name for f in df.schema.fields if kinds[f.name] == "text"]
    if other:
        out = bootstrap(out, "_row", df, other, key_cols, seed, n)
    return out.select(*df.columns)


def reclip(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Re-apply range rules after scaling (numeric columns only; nulls stay null)."""
    sel = {}
    for c in spec.columns:
        if c.name in df.columns and (c.min_value is not None or c.max_value is not None) \
                and isinstance(df.schema[c.name].dataType, T.NumericType):
            sel[c.name] = R.clip(F.col(c.name), c.min_value, c.max_value).cast(df.schema[c.name].dataType)
    return df.withColumns(sel) if sel else df


# ------------------------------------------------------------------ copula


def normal_scores(df: DataFrame, cols: list[str], key_cols: list[str]) -> DataFrame:
    """Each numeric column replaced by the normal score of its ordinal rank, (pos + 0.5) / n."""
    from weft.operators.correlate import _ranked  # average ranks, one pass for all columns

    n = df.agg(*[F.count(c).alias(c) for c in cols]).first().asDict()  # a null has no rank and no score
    rk = _ranked(df.select(*key_cols, *cols), cols)
    return rk.select(*[R.phi_inv((F.col(f"_r_{c}") - F.lit(0.5)) / F.lit(float(max(1, n[c])))).alias(f"z_{c}") for c in cols])


def gaussian_copula_fit(df: DataFrame, cols: list[str], key_cols: list[str], n_quantiles: int = 1000):
    """Correlation of normal scores (k x k, one aggregate) and per-column quantile tables."""
    z = normal_scores(df, cols, key_cols)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    row = z.agg(*[F.corr(f"z_{a}", f"z_{b}").alias(f"{a}|{b}") for a, b in pairs]).first() if pairs else {}
    k = len(cols)
    corr = np.eye(k)
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if i < j:
                v = row[f"{a}|{b}"]
                corr[i, j] = corr[j, i] = 0.0 if v is None else float(v)
    probs = [(i + 0.5) / n_quantiles for i in range(n_quantiles)]
    qs = df.approxQuantile(cols, probs, 1.0 / (2 * n_quantiles))
    return corr, {c: [float(x) for x in q] for c, q in zip(cols, qs)}


def _inverse_marginals(df: DataFrame, qt: dict[str, list[float]]) -> DataFrame:
    """Probabilities in columns u_c to values x_c by piecewise-linear interpolation in c's quantile table.

    Place, index and value are projections of their own, so that no expression is computed more than once.
    """
    at = {c: F.col(f"u_{c}") * F.lit(float(len(q))) - F.lit(0.5) for c, q in qt.items()}
    df = df.withColumns({f"at_{c}": x for c, x in at.items()})
    df = df.withColumns({f"i_{c}": F.least(F.greatest(F.floor(f"at_{c}"), F.lit(0)), F.lit(len(q) - 2)).cast("int") for c, q in qt.items()})
    ends, value = {}, {}
    for c, q in qt.items():
        table = F.split(F.lit(",".join(map(repr, q))), ",").cast("array<double>")  # folded to one literal
        ends[f"lo_{c}"], ends[f"hi_{c}"] = F.get(table, F.col(f"i_{c}")), F.get(table, F.col(f"i_{c}") + 1)
        frac = F.least(F.greatest(F.col(f"at_{c}") - F.col(f"i_{c}"), F.lit(0.0)), F.lit(1.0))
        value[f"x_{c}"] = F.col(f"lo_{c}") + (F.col(f"hi_{c}") - F.col(f"lo_{c}")) * frac
    return df.withColumns(ends).withColumns(value)


def scale_copula(df: DataFrame, cols: list[str], key_cols: list[str], target: int, seed: int) -> DataFrame:
    """Target rows whose numeric columns follow the seed table's marginals and the correlation
    of its normal scores: correlated normals (driver-side Cholesky of a k x k matrix), mapped
    through the normal CDF and each column's quantile table."""
    corr, qt = gaussian_copula_fit(df, cols, key_cols)
    w, v = np.linalg.eigh(corr)
    corr_pd = (v * np.clip(w, 1e-9, None)) @ v.T
    chol = np.linalg.cholesky(corr_pd)
    spark = df.sparkSession
    spine = spark.range(target).withColumnRenamed("id", "_row")
    drawn = spine.withColumns({f"z_{c}": R.std_normal(seed, f"copula:{c}", [F.col("_row")]) for c in cols})
    mixed, u, sel = {}, {}, []
    for i, c in enumerate(cols):
        sum_ = F.lit(float(chol[i, 0])) * F.col(f"z_{cols[0]}")
        for j in range(1, i + 1):
            sum_ = sum_ + F.lit(float(chol[i, j])) * F.col(f"z_{cols[j]}")
        mixed[f"y_{c}"] = sum_
        u[f"u_{c}"] = R.phi(F.col(f"y_{c}"))
        x, t = F.col(f"x_{c}"), df.schema[c].dataType
        sel.append((F.round(x).cast(t) if isinstance(t, T.IntegralType) else x.cast(t)).alias(c))
    return _inverse_marginals(drawn.withColumns(mixed).withColumns(u), qt).select("_row", *sel)


def nearest_correlation(target: np.ndarray, rounds: int = 500, least: float = 1e-8) -> np.ndarray:
    """The correlation matrix nearest to ``target`` (Frobenius) with eigenvalues of at least ``least``: alternating projections
    onto matrices without negative eigenvalues and matrices with a diagonal of ones, corrected after Dykstra.

    A target that is one already comes back as it is.
    """
    a = np.asarray(target, dtype=float)
    if not np.allclose(a, a.T) or not np.allclose(np.diag(a), 1) or np.abs(a).max() > 1:
        raise ValueError("a correlation target is symmetric, with ones on its diagonal and values from -1 to 1")
    if np.linalg.eigvalsh(a).min() >= least:
        return a
    y, fix = a.copy(), np.zeros_like(a)
    for _ in range(rounds):
        r = y - fix
        w, v = np.linalg.eigh(r)
        x = (v * np.maximum(w, least)) @ v.T
        fix = x - r
        new = x.copy()
        np.fill_diagonal(new, 1.0)
        done = np.linalg.norm(new - y) <= 1e-12 * np.linalg.norm(new)
        y = new
        if done:
            break
    w, v = np.linalg.eigh(y)
    x = (v * np.maximum(w, least)) @ v.T
    d = np.sqrt(np.diag(x))
    return x / np.outer(d, d)


def iman_conover_report(df: DataFrame, cols: list[str], target: np.ndarray, key_cols: list[str], seed: int) -> tuple[DataFrame, DataFrame]:
    """(``iman_conover``'s rows, one row per pair: col_a, col_b, target, used, achieved): targets that no table can have are
    replaced by the nearest correlation matrix, and the report says by how much."""
    from weft.operators.correlate import spearman_pairs

    target, used = np.asarray(target, dtype=float), nearest_correlation(target)
    out = cut_lineage(iman_conover(df, cols, target, key_cols, seed))
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    asked = df.sparkSession.createDataFrame([(cols[i], cols[j], float(target[i, j]), float(used[i, j])) for i, j in pairs], "col_a string, col_b string, target double, used double")
    rho = spearman_pairs(out, [(cols[i], cols[j]) for i, j in pairs]).select("col_a", "col_b", F.col("rho").alias("achieved"))
    return out, asked.join(rho, ["col_a", "col_b"])


def iman_conover(df: DataFrame, cols: list[str], target: np.ndarray, key_cols: list[str], seed: int,
                 n_buckets: int | None = None) -> DataFrame:
    """Re-order each column's own values so that the rank correlation approaches ``target``:
    correlated normal scores per row (Cholesky of the target), then each column receives its
    sorted values in the order of its score.  Multisets of values are unchanged.  A target that no
    correlation matrix meets is replaced by the nearest one (``nearest_correlation``)."""
    chol = np.linalg.cholesky(nearest_correlation(target))
    zs = [R.std_normal(seed, f"ic:{c}", key_cols) for c in cols]
    out = df
    # the scores depend on the key alone, so the columns are separate rank jobs joined back on the key
    for i, c in enumerate(cols):
        score = None
        for j in range(i + 1):
            term = F.lit(float(chol[i, j])) * zs[j]
            score = term if score is None else score + term
        have = df.where(F.col(c).isNotNull()).select(*key_cols, c)
        pos = ordinal(have.withColumn("_s", score), "_s", key_cols, "_p", n_buckets).select(*key_cols, "_p")
        vals = ordinal(have, c, key_cols, "_p", n_buckets).select("_p", F.col(c).alias("_nv"))
        moved = cut_lineage(pos.join(vals, "_p").select(*key_cols, "_nv"))
        out = out.join(moved, key_cols, "left").withColumn(c, F.coalesce("_nv", F.col(c))).drop("_nv")
    return out.select(*df.columns)
