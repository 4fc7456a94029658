"""Queries for scaling (G-26..G-33) and rank correlation (R-01..R-05) with DuckDB oracles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from weft.operators import correlate as CR
from weft.operators import scale as S
from weft.plans.registry import query
from weft.plans.spec import ColumnSpec, CorrelationTarget, TableSpec
from weft.plans.sqlkit import normal_sql, u_sql
from weft.session import cut_lineage, table

SEED = 42


def _h_sql(key):
    return f"CAST(('0x' || substr(sha256(CAST({key} AS VARCHAR)), 1, 13)) AS BIGINT)"


@query("scale_down", f"""
SELECT * FROM customer ORDER BY {u_sql(SEED, 'sample', 'c_custkey')}, c_custkey LIMIT 500""")
def q_scale_down(spark, sf):
    return S.scale_down(table(spark, sf, "customer"), 500, SEED, ["c_custkey"])


@query("scale_down_large", f"""
WITH n AS (SELECT count(*) // 2 AS n FROM lineitem),
r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
             row_number() OVER (ORDER BY {u_sql(SEED, 'sample', 'l_orderkey', 'l_linenumber', 'l_partkey', 'l_suppkey')},
                                l_orderkey, l_linenumber, l_partkey, l_suppkey) AS nth FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM r, n WHERE nth <= n""")
def q_scale_down_large(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return S.scale_down(li, li.count() // 2, SEED, li.columns)


def _spine10(spark, sf, name, factor=10):
    n = table(spark, sf, name).count()
    return spark.range(n * factor).withColumnRenamed("id", "_row"), n


@query("scale_numeric", f"""
WITH m AS (SELECT avg(c_acctbal) ma, greatest(stddev_samp(c_acctbal), 1e-9) sa,
                  avg(c_nationkey) mn, greatest(stddev_samp(c_nationkey), 1e-9) sn, count(*) n FROM customer)
SELECT range AS _row, round(ma + sa * {normal_sql(SEED, 'scale:c_acctbal', ['range'])}, 4) AS c_acctbal,
       CAST(round(least(greatest(mn + sn * {normal_sql(SEED, 'scale:c_nationkey', ['range'])}, 0.0), 24.0)) AS INTEGER)
         AS c_nationkey
FROM m, range((SELECT n * 10 FROM m))""")
def q_scale_numeric(spark, sf):
    c = table(spark, sf, "customer")
    spine, _ = _spine10(spark, sf, "customer")
    kinds = {"c_acctbal": "numerical", "c_nationkey": "numerical"}
    m = S.fit(c, kinds)
    keys = [F.col("_row")]
    return spine.select("_row",
                        F.round(S.numeric_column("c_acctbal", m, SEED, keys, c.schema["c_acctbal"].dataType), 4)
                        .alias("c_acctbal"),
                        S.numeric_column("c_nationkey", m, SEED, keys, c.schema["c_nationkey"].dataType, 0, 24)
                        .alias("c_nationkey"))


@query("scale_datetime", f"""
WITH m AS (SELECT min(o_orderdate) lo, max(o_orderdate) hi, count(*) n FROM orders)
SELECT range AS _row,
       lo + to_microseconds(CAST(floor({u_sql(SEED, 'scale:o_orderdate', 'range')}
            * (CAST(epoch_us(hi) - epoch_us(lo) AS DOUBLE) * 10.0)) AS BIGINT)) AS o_orderdate
FROM m, range((SELECT n * 10 FROM m))""")
def q_scale_datetime(spark, sf):
    o = table(spark, sf, "orders")
    spine, n = _spine10(spark, sf, "orders")
    m = S.fit(o.select("o_orderdate"), {"o_orderdate": "datetime"})
    return spine.select("_row", S.datetime_column("o_orderdate", m, 10.0, SEED, [F.col("_row")],
                                                  o.schema["o_orderdate"].dataType).alias("o_orderdate"))


@query("scale_categorical", f"""
WITH g AS (SELECT c_mktsegment AS v, count(*) cnt, {_h_sql('c_mktsegment')} AS h FROM customer
           WHERE c_mktsegment IS NOT NULL GROUP BY ALL),
c AS (SELECT v, h, sum(cnt) OVER (ORDER BY h, v) AS cum FROM g),
a AS (SELECT list(cum ORDER BY h, v) AS cums, list(v ORDER BY h, v) AS vals, max(cum) AS total FROM c)
SELECT range AS _row,
       vals[len(list_filter(cums, lambda x: x <= floor({u_sql(SEED, 'scale:c_mktsegment', 'range')} * total))) + 1]
         AS c_mktsegment
FROM a, range((SELECT count(*) * 10 FROM customer))""")
def q_scale_categorical(spark, sf):
    c = table(spark, sf, "customer")
    spine, _ = _spine10(spark, sf, "customer")
    return S.categorical_draws(spine, "_row", c, "c_mktsegment", SEED).select("_row", "c_mktsegment")


@query("scale_bootstrap", f"""
WITH ix AS (SELECT p_name, p_brand, row_number() OVER (ORDER BY {_h_sql('p_partkey')}, p_partkey) - 1 AS _idx FROM part),
d AS (SELECT range AS _row, CAST(floor({u_sql(SEED, 'scale:boot', 'range')} * (SELECT count(*) FROM part)) AS BIGINT) AS _idx
      FROM range((SELECT count(*) * 3 FROM part)))
SELECT _row, p_name, p_brand FROM d JOIN ix USING (_idx)""")
def q_scale_bootstrap(spark, sf):
    p = table(spark, sf, "part")
    spine, n = _spine10(spark, sf, "part", 3)
    return S.bootstrap(spine, "_row", p, ["p_name", "p_brand"], ["p_partkey"], SEED, n)


@query("scale_pk", """
SELECT CAST(count(*) * 10 AS BIGINT) AS n_rows, CAST(count(*) * 10 AS BIGINT) AS n_distinct_ids FROM customer""")
def q_scale_pk(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.col("c_custkey").cast("string").alias("cid"))
    n = c.count()
    spec = TableSpec("customer", (ColumnSpec("cid", "string", primary_key=True),))
    out = S.scale(c.select("cid", "c_mktsegment"), n * 10, SEED, ["cid"], spec)
    return out.agg(F.count(F.lit(1)).cast("long").alias("n_rows"),
                   F.countDistinct("cid").cast("long").alias("n_distinct_ids"))


def _drawn_sql(src, col, n):
    """Rows (_row, col): ``n`` draws of a categorical column by frequency, values in the order of their hash."""
    return f"""SELECT range AS _row, vals[len(list_filter(cums, lambda x: x <= floor({u_sql(SEED, 'scale:' + col, 'range')} * total))) + 1] AS {col}
FROM (SELECT list(cum ORDER BY h, v) AS cums, list(v ORDER BY h, v) AS vals, max(cum) AS total FROM (
  SELECT v, h, sum(cnt) OVER (ORDER BY h, v) AS cum FROM (
    SELECT {col} AS v, count(*) AS cnt, {_h_sql(col)} AS h FROM {src} WHERE {col} IS NOT NULL GROUP BY ALL))), range({n})"""


def _uuid_sql(text):
    h = f"sha256({text})"
    return "concat_ws('-', " + ", ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + ")"


@query("scale_pk_rows", f"""
SELECT {_uuid_sql(f"concat_ws(':', '{SEED}', 'cid', CAST(_row AS VARCHAR))")} AS cid, c_mktsegment
FROM ({_drawn_sql('customer', 'c_mktsegment', '(SELECT count(*) * 10 FROM customer)')})""")
def q_scale_pk_rows(spark, sf):
    """The rows that ``scale_pk`` counts: fresh text keys and drawn categories, value by value."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("cid"), "c_mktsegment")
    spec = TableSpec("customer", (ColumnSpec("cid", "string", primary_key=True),))
    return S.scale(c, c.count() * 10, SEED, ["cid"], spec)


@query("twin_rows", f"""
WITH m AS (SELECT avg(c_acctbal) ma, greatest(stddev_samp(c_acctbal), 1e-9) sa,
                  avg(c_nationkey) mn, greatest(stddev_samp(c_nationkey), 1e-9) sn FROM customer)
SELECT _row + 1 AS c_custkey, c_mktsegment, round(ma + sa * {normal_sql(SEED, 'scale:c_acctbal', ['_row'])}, 3) AS c_acctbal,
       CAST(round(mn + sn * {normal_sql(SEED, 'scale:c_nationkey', ['_row'])}) AS INTEGER) AS c_nationkey
FROM m, ({_drawn_sql('customer', 'c_mktsegment', '(SELECT count(*) * 2 FROM customer)')})""")
def q_twin_rows(spark, sf):
    """The twin that ``synthetic_twin`` counts, value by value (names left out)."""
    c = table(spark, sf, "customer").drop("c_name")
    return S.scale(c, 2 * c.count(), SEED, ["c_custkey"]).withColumn("c_acctbal", F.round("c_acctbal", 3))


RECLIP = TableSpec("customer", (ColumnSpec("c_acctbal", "float", min_value=0.0, max_value=5000.0),))


@query("scale_reclip", f"""
WITH m AS (SELECT avg(c_acctbal) ma, greatest(stddev_samp(c_acctbal), 1e-9) sa, count(*) n FROM customer)
SELECT range AS _row, round(least(greatest(ma + sa * {normal_sql(SEED, 'scale:c_acctbal', ['range'])}, 0.0), 5000.0), 4)
       AS c_acctbal
FROM m, range((SELECT n * 10 FROM m))""")
def q_scale_reclip(spark, sf):
    c = table(spark, sf, "customer")
    spine, _ = _spine10(spark, sf, "customer")
    m = S.fit(c, {"c_acctbal": "numerical"})
    raw = spine.select("_row", S.numeric_column("c_acctbal", m, SEED, [F.col("_row")], c.schema["c_acctbal"].dataType)
                       .alias("c_acctbal"))
    return S.reclip(raw, RECLIP).withColumn("c_acctbal", F.round("c_acctbal", 4))


@query("scale_copula", """
SELECT CAST(count(*) * 10 AS BIGINT) AS n_rows, CAST(count(*) * 10 AS BIGINT) AS n_size, CAST(count(*) * 10 AS BIGINT) AS n_price
FROM part""")
def q_scale_copula(spark, sf):
    p = table(spark, sf, "part")
    n = p.count()
    out = S.scale_copula(p, ["p_size", "p_retailprice"], ["p_partkey"], n * 10, SEED)
    return out.agg(F.count(F.lit(1)).cast("long").alias("n_rows"), F.count("p_size").cast("long").alias("n_size"),
                   F.count("p_retailprice").cast("long").alias("n_price"))


_MIXED = "SELECT p_partkey, p_size, p_size * 10.0 + p_retailprice AS p_cost FROM part"


@query("scale_copula_shape", f"""
WITH s AS ({_MIXED}),
r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS ra,
             rank() OVER (ORDER BY p_cost) + (count(*) OVER (PARTITION BY p_cost) - 1) / 2.0 AS rb FROM s)
SELECT CAST((SELECT count(*) * 10 FROM part) AS BIGINT) AS n_rows, round(corr(ra, rb), 6) AS rho_seed, TRUE AS rho_kept,
       min((SELECT min(p_size) FROM part)) AS least_size, max((SELECT max(p_size) FROM part)) AS most_size, TRUE AS marginals_kept FROM r""")
def q_scale_copula_shape(spark, sf):
    """The scaled table against its seed: rank correlation within 0.05, every decile of both columns at its place within 0.03.

    p_cost depends on p_size, so independent columns fail.
    """
    p = table(spark, sf, "part").select("p_partkey", "p_size", (F.col("p_size") * 10.0 + F.col("p_retailprice")).alias("p_cost"))
    cols = ["p_size", "p_cost"]
    out = cut_lineage(S.scale_copula(p, cols, ["p_partkey"], p.count() * 10, SEED))  # drawn once, measured twice
    tenths = [k / 10 for k in range(1, 10)]
    marks = p.agg(*[F.percentile(c, F.array(*[F.lit(t) for t in tenths])).alias(c) for c in cols]).first()
    spots = [(c, k, x) for c in cols for k, x in enumerate(marks[c] or [])]

    def below(df, tag):  # share of the rows below each of the seed's deciles, equal ones half
        return df.agg(F.count(F.lit(1)).alias(f"{tag}_n"), F.min("p_size").alias(f"{tag}_least"), F.max("p_size").alias(f"{tag}_most"),
                      *[F.avg((F.col(c) < x).cast("double") + (F.col(c) == x).cast("double") / 2).alias(f"{tag}_{c}_{k}") for c, k, x in spots])

    one = below(p, "a")  # rows of one table each, put beside each other
    for part in (below(out, "b"), CR.spearman_matrix(p, cols).select(F.col("rho").alias("a_rho")),
                 CR.spearman_matrix(out, cols).select(F.col("rho").alias("b_rho"))):
        one = one.unionByName(part, allowMissingColumns=True)
    one = one.agg(*[F.max(c).alias(c) for c in one.columns])
    apart = F.greatest(F.lit(0.0), F.lit(0.0), *[F.abs(F.col(f"a_{c}_{k}") - F.col(f"b_{c}_{k}")) for c, k, _ in spots])
    return one.select(F.col("b_n").alias("n_rows"), F.round("a_rho", 6).alias("rho_seed"), (F.abs(F.col("b_rho") - F.col("a_rho")) <= 0.05).alias("rho_kept"),
                      F.col("b_least").alias("least_size"), F.col("b_most").alias("most_size"), (apart <= 0.03).alias("marginals_kept"))


# ------------------------------------------------------------ correlation

LI_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _rho_sql(src, a, b):
    return (f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr(ra, rb), 6) AS rho, CAST(count(*) AS BIGINT) AS n FROM ("
            f"SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS ra, "
            f"rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS rb "
            f"FROM {src} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)")


@query("spearman_matrix", " UNION ALL ".join(_rho_sql("lineitem", a, b) for i, a in enumerate(LI_COLS)
                                              for b in LI_COLS[i + 1:]))
def q_spearman_matrix(spark, sf):
    li = table(spark, sf, "lineitem")
    return CR.spearman_matrix(li, LI_COLS).withColumn("rho", F.round("rho", 6))


TARGETS = [CorrelationTarget("l_quantity", "l_extendedprice", 0.9), CorrelationTarget("l_tax", "l_discount", 0.5),
           CorrelationTarget("l_quantity", "l_tax", 0.05)]


@query("correlation_drift", f"""
WITH a AS ({_rho_sql('lineitem', 'l_quantity', 'l_extendedprice')} UNION ALL {_rho_sql('lineitem', 'l_tax', 'l_discount')}
           UNION ALL {_rho_sql('lineitem', 'l_quantity', 'l_tax')}),
t AS (SELECT * FROM (VALUES ('l_quantity', 'l_extendedprice', 0.9), ('l_tax', 'l_discount', 0.5),
                            ('l_quantity', 'l_tax', 0.05)) AS t(t_a, t_b, target))
SELECT t_a AS col_a, t_b AS col_b, round(rho, 6) AS actual, CAST(target AS DOUBLE) AS target,
       round(abs(rho - target), 6) AS delta
FROM t JOIN a ON least(t_a, t_b) = least(a.col_a, a.col_b) AND greatest(t_a, t_b) = greatest(a.col_a, a.col_b)
WHERE abs(rho - target) > 0.15""")
def q_correlation_drift(spark, sf):
    li = table(spark, sf, "lineitem")
    actual = CR.spearman_pairs(li, [(t.col_a, t.col_b) for t in TARGETS])
    d = CR.drift(actual, CR.targets_frame(spark, TARGETS), 0.15)
    return d.select("col_a", "col_b", F.round("actual", 6).alias("actual"), "target", F.round("delta", 6).alias("delta"))


_W = repr(1.0 - 0.3)


@query("rank_nudge", f"""
WITH b AS (SELECT p_partkey, p_size, p_retailprice, {_h_sql('p_partkey')} AS h FROM part
           WHERE p_size IS NOT NULL AND p_retailprice IS NOT NULL),
r AS (SELECT *, row_number() OVER (ORDER BY p_size, h, p_partkey) - 1 AS ra,
                row_number() OVER (ORDER BY p_retailprice, h, p_partkey) - 1 AS rb FROM b),
bl AS (SELECT *, CAST({_W} AS DOUBLE) * rb + CAST(0.3 AS DOUBLE) * ra AS blend FROM r),
p AS (SELECT p_partkey, row_number() OVER (ORDER BY blend, h, p_partkey) - 1 AS pos FROM bl),
s AS (SELECT p_retailprice, row_number() OVER (ORDER BY p_retailprice, h, p_partkey) - 1 AS pos FROM b)
SELECT p_partkey, p_retailprice FROM p JOIN s USING (pos)""")
def q_rank_nudge(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    return CR.nudge(p, "p_size", "p_retailprice", 0.8, 0, ["p_partkey"]).select("p_partkey", "p_retailprice")


def _multiset_sql(col, src="part"):
    return (f"SELECT '{col}' AS col, CAST(count({col}) AS BIGINT) AS n, round(sum({col}), 4) AS total, "
            f"CAST(min({col}) AS DOUBLE) AS lo, CAST(max({col}) AS DOUBLE) AS hi FROM {src}")


def _multiset(df, cols):
    out = None
    for c in cols:
        part = df.agg(F.lit(c).alias("col"), F.count(c).cast("long").alias("n"),
                      F.round(F.sum(c), 4).alias("total"), F.min(c).cast("double").alias("lo"),
                      F.max(c).cast("double").alias("hi"))
        out = part if out is None else out.unionByName(part)
    return out


@query("drift_repair", _multiset_sql("p_retailprice") + " UNION ALL " + _multiset_sql("p_size"))
def q_drift_repair(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    fixed = CR.repair(p, [CorrelationTarget("p_size", "p_retailprice", 0.6)], ["p_partkey"], max_iter=3)
    return _multiset(fixed, ["p_retailprice", "p_size"])


@query("drift_repair_rho", """
WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS ra,
                  rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS rb FROM part)
SELECT round(corr(ra, rb), 6) AS rho_before, true AS closer, true AS same_direction FROM r""")
def q_drift_repair_rho(spark, sf):
    """Rank correlation before the repair, and whether the repair moved it towards its target of 0.6."""
    p = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    rho = lambda df: CR.spearman_pairs(df, [("p_size", "p_retailprice")]).select("rho")
    fixed = CR.repair(p, [CorrelationTarget("p_size", "p_retailprice", 0.6)], ["p_partkey"], max_iter=3)
    both = rho(p).withColumnRenamed("rho", "a").withColumn("one", F.lit(1)).join(rho(fixed).withColumnRenamed("rho", "b").withColumn("one", F.lit(1)), "one")
    return both.select(F.round("a", 6).alias("rho_before"), (F.abs(F.col("b") - 0.6) < F.abs(F.col("a") - 0.6) - 0.1).alias("closer"),
                       (F.signum(F.col("b") - F.col("a")) == F.signum(0.6 - F.col("a"))).alias("same_direction"))


def _reorder_sql(col, score):
    """Each row's new value: the sorted values (value, h(key), key) dealt in the order of the score."""
    h = _h_sql("p_partkey")
    return (f"SELECT a.p_partkey, b.{col} FROM (SELECT p_partkey, row_number() OVER (ORDER BY {score}, {h}, p_partkey) AS p FROM part WHERE {col} IS NOT NULL) a "
            f"JOIN (SELECT {col}, row_number() OVER (ORDER BY {col}, {h}, p_partkey) AS p FROM part WHERE {col} IS NOT NULL) b USING (p)")


_IC = np.linalg.cholesky(np.array([[1.0, 0.7], [0.7, 1.0]]))
_Z = [normal_sql(SEED, f"ic:{c}", ["p_partkey"]) for c in ("p_size", "p_retailprice")]


@query("iman_conover", f"""
WITH s AS ({_reorder_sql('p_size', f"{float(_IC[0, 0])!r} * {_Z[0]}")}),
r AS ({_reorder_sql('p_retailprice', f"{float(_IC[1, 0])!r} * {_Z[0]} + {float(_IC[1, 1])!r} * {_Z[1]}")})
SELECT p_partkey, p_size, p_retailprice FROM s JOIN r USING (p_partkey)""")
def q_iman_conover(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    return S.iman_conover(p, ["p_size", "p_retailprice"], np.array([[1.0, 0.7], [0.7, 1.0]]), ["p_partkey"], SEED)
