"""Queries for reports, cleaning, the quality score and the whole pipeline (Q-01..Q-09)."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import audit as A
from weft.operators import constraints as C
from weft.operators import dirty as D
from weft.operators import privacy as PV
from weft.operators import report as RP
from weft.operators import scale as SC
from weft.operators import sketch_profile as SP
from weft.plans.cat_audit import CUST_DAG, CUST_SPEC, _audit_report_sql, dirty_customer
from weft.plans.cat_dirty import _date_mix_sql, _dense_sql, _draws_sql
from weft.plans.cat_privacy import _types_sql
from weft.plans.registry import query
from weft.plans.spec import Rule
from weft.plans.sqlkit import u_sql
from weft.session import table
from weft.sources import files as FS

SEED = 42
LI_PROFILE = [("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"),
              ("l_returnflag", "string"), ("l_shipdate", "timestamp_ntz")]


def _r6(df, cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


# ------------------------------------------------------------------ Q-03 profile, histogram


def _profile_sql(tbl, cols):
    parts = []
    for c, t in cols:
        if t in ("double", "int", "bigint"):
            stats = (f"CAST(min({c}) AS DOUBLE) AS min_value, CAST(max({c}) AS DOUBLE) AS max_value, "
                     f"CAST(sum(CAST({c} AS DECIMAL(38, 10))) AS DOUBLE) / count({c}) AS mean, round(stddev_samp({c}), 6) AS std")
        else:
            stats = ", ".join(f"CAST(NULL AS DOUBLE) AS {n}" for n in ("min_value", "max_value", "mean", "std"))
        parts.append(f"SELECT '{c}' AS column_name, '{t}' AS data_type, CAST(count(*) AS BIGINT) AS n_rows, "
                     f"CAST(count(*) - count({c}) AS BIGINT) AS n_null, "
                     f"CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct, {stats} FROM {tbl}")
    return " UNION ALL ".join(parts)


@query("profile", _profile_sql("lineitem", LI_PROFILE))
def q_profile(spark, sf):
    li = table(spark, sf, "lineitem")
    return _r6(RP.profile(li, [c for c, _ in LI_PROFILE]), ["std"])


@query("profile_percentiles", " UNION ALL ".join(
    f"SELECT 'o_totalprice' AS column_name, CAST({p} AS DOUBLE) AS p, quantile_disc(o_totalprice, {p}) AS value FROM orders" for p in (0.25, 0.5, 0.75, 0.99)))
def q_profile_percentiles(spark, sf):
    return RP.percentiles(table(spark, sf, "orders"), "o_totalprice", [0.25, 0.5, 0.75, 0.99])


@query("profile_samples", """
SELECT 'o_orderstatus' AS column_name, list(v ORDER BY v) AS samples FROM (SELECT DISTINCT o_orderstatus AS v FROM orders WHERE o_orderstatus IS NOT NULL ORDER BY 1 LIMIT 3)
UNION ALL SELECT 'o_custkey', list(CAST(v AS VARCHAR) ORDER BY v) FROM (SELECT DISTINCT o_custkey AS v FROM orders WHERE o_custkey IS NOT NULL ORDER BY 1 LIMIT 3)""")
def q_profile_samples(spark, sf):
    """Three sample values per column: the number is the feature."""
    return RP.samples(table(spark, sf, "orders"), ["o_orderstatus", "o_custkey"], 3)


@query("histogram", """
WITH m AS (SELECT min(l_extendedprice) lo, max(l_extendedprice) hi FROM lineitem),
b AS (SELECT CAST(least(floor((l_extendedprice - lo) / ((hi - lo) / 10)), 9) AS INTEGER) AS bin, lo, hi
      FROM lineitem, m WHERE l_extendedprice IS NOT NULL)
SELECT bin, round(lo + bin * ((hi - lo) / 10), 4) AS lo, round(lo + (bin + 1) * ((hi - lo) / 10), 4) AS hi,
       CAST(count(*) AS BIGINT) AS n FROM b GROUP BY bin, lo, hi""")
def q_histogram(spark, sf):
    h = RP.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 10)
    return h.withColumns({"lo": F.round("lo", 4), "hi": F.round("hi", 4)})


# ------------------------------------------------------------------ Q-04 grouped questions


@query("grouped_stats", """
SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, round(avg(l_extendedprice), 6) AS mean,
       round(stddev_samp(l_extendedprice), 6) AS std, min(l_extendedprice) AS min_value, max(l_extendedprice) AS max_value
FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def q_grouped_stats(spark, sf):
    g = RP.grouped_stats(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice")
    return _r6(g, ["mean", "std"])


# ------------------------------------------------------------------ Q-02 similarity


def _ks_sql(a, b, col, digits=6):
    return f"""SELECT '{col}' AS column_name, 'ks' AS metric, round(1.0 - coalesce(max(abs(ca / ta - cb / tb)), 0.0), {digits}) AS similarity
FROM (SELECT sum(na) OVER (ORDER BY v) ca, sum(nb) OVER (ORDER BY v) cb
      FROM (SELECT v, sum(na) na, sum(nb) nb FROM (SELECT {col} v, 1 na, 0 nb FROM {a} UNION ALL SELECT {col}, 0, 1 FROM {b})
            WHERE v IS NOT NULL GROUP BY v)),
     (SELECT greatest(count({col}), 1) ta FROM {a}), (SELECT greatest(count({col}), 1) tb FROM {b})"""


def _tv_sql(a, b, col, digits=6):
    return f"""SELECT '{col}' AS column_name, 'tv' AS metric, round(1.0 - coalesce(sum(abs(na / ta - nb / tb)), 0.0) / 2.0, {digits}) AS similarity
FROM (SELECT v, sum(na) na, sum(nb) nb FROM (SELECT {col} v, 1 na, 0 nb FROM {a} UNION ALL SELECT {col}, 0, 1 FROM {b})
      WHERE v IS NOT NULL GROUP BY v),
     (SELECT greatest(count({col}), 1) ta FROM {a}), (SELECT greatest(count({col}), 1) tb FROM {b})"""


_OF = "(SELECT * FROM orders WHERE o_orderstatus = 'F')"
_OO = "(SELECT * FROM orders WHERE o_orderstatus IS DISTINCT FROM 'F')"


def _orders_by_status(spark, sf):
    o = table(spark, sf, "orders")
    done = F.col("o_orderstatus").eqNullSafe("F")
    return o.where(done), o.where(~done)


@query("similarity_ks", _ks_sql(_OF, _OO, "o_totalprice"))
def q_similarity_ks(spark, sf):
    a, b = _orders_by_status(spark, sf)
    return _r6(RP.similarity(a, b, ["o_totalprice"]), ["similarity"])


@query("similarity_tv", _tv_sql(_OF, _OO, "o_orderpriority"))
def q_similarity_tv(spark, sf):
    a, b = _orders_by_status(spark, sf)
    return _r6(RP.similarity(a, b, ["o_orderpriority"]), ["similarity"])


# ------------------------------------------------------------------ Q-07 compare profiles


def _cmp_side_sql(tbl, col, s):
    return (f"SELECT '{col}' AS column_name, CAST(count(*) AS BIGINT) AS n_rows_{s}, "
            f"CAST(count(*) - count({col}) AS BIGINT) AS n_null_{s}, CAST(count(DISTINCT {col}) AS BIGINT) AS n_distinct_{s}, "
            f"avg({col}) AS mean_{s}, stddev_samp({col}) AS std_{s} FROM {tbl}")


def _cmp_sql():
    cols = ["o_totalprice", "o_custkey"]
    a = " UNION ALL ".join(_cmp_side_sql(_OF, c, "a") for c in cols)
    b = " UNION ALL ".join(_cmp_side_sql(_OO, c, "b") for c in cols)
    return (f"SELECT column_name, n_rows_a, n_null_a, n_distinct_a, round(mean_a, 6) AS mean_a, round(std_a, 6) AS std_a, "
            f"n_rows_b, n_null_b, n_distinct_b, round(mean_b, 6) AS mean_b, round(std_b, 6) AS std_b, "
            f"round(mean_b - mean_a, 6) AS mean_diff FROM ({a}) JOIN ({b}) USING (column_name)")


@query("compare_profiles", _cmp_sql())
def q_compare_profiles(spark, sf):
    a, b = _orders_by_status(spark, sf)
    out = RP.compare_profiles(a, b, ["o_totalprice", "o_custkey"])
    return _r6(out, ["mean_a", "std_a", "mean_b", "std_b", "mean_diff"])


# ------------------------------------------------------------------ Q-06 cleaning


@query("fix_dates", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders")
def q_fix_dates(spark, sf):
    """Mixed date layouts (A-04 at 12%) parsed back: every date must come back unchanged."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    mixed = D.date_format_mix(o, ["o_orderdate"], 0.12, SEED, ["o_orderkey"])
    return RP.unify_dates(mixed, ["o_orderdate"])


@query("fix_dates_mixed", f"""
SELECT o_orderkey, {_date_mix_sql('o_orderdate', 'o_orderkey', 0.12)} AS mixed,
       CAST(o_orderdate AS DATE) AS fixed FROM orders""")
def q_fix_dates_mixed(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    mixed = D.date_format_mix(o, ["o_orderdate"], 0.12, SEED, ["o_orderkey"]).withColumnRenamed("o_orderdate", "mixed")
    return mixed.withColumn("fixed", F.col("mixed")).transform(lambda d: RP.unify_dates(d, ["fixed"]))


_CUST_COLS = "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment"


@query("dedupe_exact", f"""
WITH ix AS ({_dense_sql('customer', 'c_custkey')}),
d AS ({_draws_sql('customer', 'dup', 0.05)})
SELECT DISTINCT * FROM (SELECT {_CUST_COLS} FROM customer UNION ALL SELECT {_CUST_COLS} FROM ix JOIN d USING (_idx))""")
def q_dedupe_exact(spark, sf):
    c = table(spark, sf, "customer")
    return RP.dedupe_exact(D.dup_exact(c, 0.05, SEED, ["c_custkey"]))


@query("dedupe_near", f"""
WITH ix AS ({_dense_sql('customer', 'c_custkey')}),
d AS ({_draws_sql('customer', 'near', 0.05)}),
u AS (SELECT {_CUST_COLS} FROM customer UNION ALL
      SELECT c_custkey, c_name, c_nationkey, c_acctbal * (0.95 + 0.1 * {u_sql(SEED, 'nearmult', '_draw')}) AS c_acctbal,
             c_mktsegment FROM ix JOIN d USING (_idx))
SELECT c_custkey, c_name, c_nationkey, round(min(c_acctbal), 4) AS c_acctbal, c_mktsegment FROM u
GROUP BY c_custkey, c_name, c_nationkey, c_mktsegment""")
def q_dedupe_near(spark, sf):
    c = table(spark, sf, "customer")
    near = D.dup_near(c, 0.05, SEED, ["c_custkey"], column="c_acctbal")
    out = RP.dedupe_near(near, ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"], ["c_acctbal"])
    return out.withColumn("c_acctbal", F.round("c_acctbal", 4))


# ------------------------------------------------------------------ Q-08 usage trend


@query("usage_trend", """
SELECT date_trunc('day', ts) AS period, CAST(count(*) AS BIGINT) AS n_events, CAST(count(DISTINCT user_id) AS BIGINT) AS n_users,
       round(sum(value), 4) AS total_value FROM events GROUP BY 1""")
def q_usage_trend(spark, sf):
    u = RP.usage_trend(table(spark, sf, "events"), "ts", "day", "value", "user_id")
    return u.withColumn("total_value", F.round("total_value", 4))


@query("usage_trend_monthly", """
SELECT date_trunc('month', ts) AS period, event_type, CAST(count(*) AS BIGINT) AS n_events FROM events GROUP BY 1, 2""")
def q_usage_trend_monthly(spark, sf):
    ev = table(spark, sf, "events")
    return ev.groupBy(F.date_trunc("month", "ts").alias("period"), "event_type").agg(
        F.count(F.lit(1)).alias("n_events"))


# ------------------------------------------------------------------ Q-05 synthetic twin


@query("synthetic_twin", """
SELECT CAST(2 * count(*) AS BIGINT) AS n_rows, CAST(2 * count(*) AS BIGINT) AS n_keys,
       CAST(count(DISTINCT c_mktsegment) AS BIGINT) AS n_segments FROM customer""")
def q_synthetic_twin(spark, sf):
    """Twin of customer at twice its size from its fitted profile; invariants: size, unique keys, categories."""
    c = table(spark, sf, "customer")
    n = c.count()
    twin = SC.scale(c, 2 * n, SEED, ["c_custkey"])
    return twin.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("c_custkey").alias("n_keys"),
                    F.count_distinct("c_mktsegment").alias("n_segments"))


# ------------------------------------------------------------------ Q-01 quality score


def _quality_sql():
    extra = f"""
sim AS (SELECT avg(similarity) AS s FROM ({_ks_sql('customer', 'dc', 'c_acctbal', 15)}
        UNION ALL {_tv_sql('customer', 'dc', 'c_mktsegment', 15)})),
pk AS (SELECT min(n) AS k FROM (SELECT count(*) n FROM dc GROUP BY c_nationkey, c_mktsegment)),
pp AS (SELECT count(*) FILTER (WHERE len({_types_sql('c_name')}) > 0)
             + count(*) FILTER (WHERE len({_types_sql('c_mktsegment')}) > 0) AS pii, count(*) * 5 AS cells FROM dc),
pv AS (SELECT least(100.0, (CASE WHEN k = 1 THEN 40.0 ELSE least(40.0, 40.0 / greatest(k, 1)) END) + 10.0
              + 40.0 * greatest(0.0, 1.0 - pii / greatest(cells, 1) * 10.0)) AS p FROM pk, pp),"""
    return _audit_report_sql(extra) + """,
parts AS (SELECT 100.0 * (SELECT s FROM sim) AS similarity_score,
                 100.0 * (SELECT score FROM r WHERE check_name = 'causal_physics') AS causal_score,
                 (SELECT p FROM pv) AS privacy_score,
                 100.0 * (SELECT score FROM r WHERE check_name = 'temporal_ordering') AS temporal_score,
                 100.0 * (SELECT score FROM r WHERE check_name = 'null_policy') AS dirty_score)
SELECT round(similarity_score, 6) AS similarity_score, round(causal_score, 6) AS causal_score,
       round(privacy_score, 6) AS privacy_score, round(temporal_score, 6) AS temporal_score,
       round(dirty_score, 6) AS dirty_score,
       round(least(greatest(0.30 * similarity_score + 0.25 * causal_score + 0.20 * privacy_score
                            + 0.15 * temporal_score + 0.10 * dirty_score, 0.0), 100.0), 6) AS overall_score
FROM parts"""


@query("quality_score", _quality_sql())
def q_quality_score(spark, sf):
    """Composite score of the dirty customer table against the clean one (seed vs full)."""
    seed = table(spark, sf, "customer")
    full = dirty_customer(spark, sf).persist()
    sim = RP.similarity(seed, full, ["c_acctbal", "c_mktsegment"]).agg(F.avg("similarity").alias("s")).first()["s"]
    rep = {r["check_name"]: r["score"] for r in
           A.audit(full.withColumn("balance_amount", F.col("c_acctbal")), CUST_SPEC, dag=CUST_DAG).collect()}
    pv = PV.privacy_report(full, ["c_nationkey", "c_mktsegment"], None, ["c_name", "c_mktsegment"]).first()
    parts = spark.range(1).select(
        F.lit(100.0 * sim).alias("similarity_score"), F.lit(100.0 * rep["causal_physics"]).alias("causal_score"),
        F.lit(float(pv["privacy_score"])).alias("privacy_score"),
        F.lit(100.0 * rep["temporal_ordering"]).alias("temporal_score"),
        F.lit(100.0 * rep["null_policy"]).alias("dirty_score"))
    out = RP.quality_score(parts)
    return _r6(out, out.columns)


# ------------------------------------------------------------------ Q-09 pipeline (flagship)


def pipeline(spark, sf):
    """enhance (nulls, outliers) -> mask personal data -> enforce the range rule -> audit.

    Returns the masked, repaired table and its 10-row audit report.
    """
    dc = dirty_customer(spark, sf)
    masked = PV.scan_and_mask(dc, ["c_name", "c_mktsegment"], SEED)
    fixed = C.enforce(masked, [Rule("customer.c_acctbal_range", "range", ("c_acctbal",), "clip", "high", 0.0, 9000.0)]).persist()
    report = A.audit(fixed.withColumn("balance_amount", F.col("c_acctbal")), CUST_SPEC, dag=CUST_DAG)
    return fixed, report


_PIPE_EXTRA = """
dc2 AS (SELECT c_custkey, c_name, c_nationkey, least(greatest(c_acctbal, 0.0), 9000.0) AS c_acctbal, c_mktsegment FROM dc),"""


@query("table_pipeline", _audit_report_sql(_PIPE_EXTRA, "dc2") + """
SELECT check_id, check_name, CAST(weight AS DOUBLE) AS weight, round(score, 6) AS score, CAST(violations AS BIGINT) AS violations,
       CASE WHEN violations > 0 THEN sev ELSE 'low' END AS severity, violations = 0 AS passed FROM r""")
def q_table_pipeline(spark, sf):
    _, report = pipeline(spark, sf)
    return report.withColumn("score", F.round("score", 6))


# ------------------------------------------------------------------ Q-03, Q-07 profiles that add up


def _sketched(spark, sf):
    """A profile store of orders in three parts, each read once."""
    o = table(spark, sf, "orders").select("o_totalprice", "o_custkey", "o_orderstatus")
    path = FS.scratch_path(spark, "profiles")
    year = table(spark, sf, "orders").select("o_totalprice", "o_custkey", "o_orderstatus", F.year("o_orderdate").alias("y"))
    for part, rows in (("early", year.where("y < 1997")), ("middle", year.where("y between 1997 and 1998")), ("late", year.where("y > 1998 or y is null"))):
        SP.add_part(rows.drop("y"), path, part)
    return o, path


def _sketch_sql(c, number):
    n = f"CAST({c} AS DOUBLE)" if number else "NULL::DOUBLE"
    return (f"SELECT '{c}' AS column_name, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) - count({c}) AS BIGINT) AS n_null, round(min({n}), 4) AS min_value, round(max({n}), 4) AS max_value, "
            f"round(avg({n}), 4) AS mean, round(stddev_samp({n}), 4) AS std, true AS distinct_close, true AS median_close FROM orders")


@query("sketch_profile", " UNION ALL ".join(_sketch_sql(c, c != "o_orderstatus") for c in ("o_totalprice", "o_custkey", "o_orderstatus")))
def q_sketch_profile(spark, sf):
    """The profile of all orders merged from three stored parts: exact counts and moments; estimates checked against exact values."""
    o, path = _sketched(spark, sf)
    m = SP.merged(spark, path)
    exact = o.agg(*[F.count_distinct(c).alias(c) for c in o.columns]).select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n")) for c in o.columns])))
    medians = m.select("column_name", "q50")
    each = o.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in ("o_totalprice", "o_custkey")])))
    rank = each.join(medians, "column_name").groupBy("column_name").agg(F.avg((F.col("v") <= F.col("q50")).cast("double")).alias("at"), F.avg((F.col("v") < F.col("q50")).cast("double")).alias("under"))
    j = m.join(exact, "column_name").join(rank, "column_name", "left")
    near = (F.col("under") <= 0.52) & (F.col("at") >= 0.48)
    return j.select("column_name", "n_rows", "n_null", *[F.round(c, 4).alias(c) for c in ("min_value", "max_value", "mean", "std")],
                    (F.abs(F.col("n_distinct") - F.col("n")) <= 0.04 * F.col("n") + 1).alias("distinct_close"), F.coalesce(near, F.lit(True)).alias("median_close"))


@query("sketch_shift", """
WITH y AS (SELECT o_totalprice, o_custkey, year(o_orderdate) AS y FROM orders), c AS (
  SELECT 'o_custkey' AS column_name, (SELECT count(*) FROM (SELECT o_custkey FROM y WHERE y < 1997 INTERSECT SELECT o_custkey FROM y WHERE y > 1998)) /
         (SELECT count(DISTINCT o_custkey) FROM y WHERE y < 1997 OR y > 1998) AS j)
SELECT column_name, true AS jaccard_close, true AS distance_close FROM c""")
def q_sketch_shift(spark, sf):
    """Early against late orders from the stored parts alone: common customers and shift of their distribution, checked against exact values."""
    o, path = _sketched(spark, sf)
    y = table(spark, sf, "orders").select("o_custkey", F.year("o_orderdate").alias("y"))
    a, b = y.where("y < 1997").select("o_custkey"), y.where("y > 1998").select("o_custkey")
    both, either = a.intersect(b).count(), a.unionByName(b).distinct().count()
    ks = 1 - RP.similarity(a, b, ["o_custkey"]).first()["similarity"]
    j = SP.shared_values(spark, path, ["early"], ["late"]).where("column_name = 'o_custkey'").join(SP.shift(spark, path, ["early"], ["late"]), "column_name")
    return j.select("column_name", (F.abs(F.col("jaccard") - F.lit(both / max(1, either))) < 0.03).alias("jaccard_close"), (F.abs(F.col("distance") - F.lit(float(ks))) < 0.03).alias("distance_close"))
