"""Queries for the ten-check audit (V-01..V-12) with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import audit as A
from weft.operators import constraints as C
from weft.operators import dirty as D
from weft.plans.registry import query
from weft.plans.spec import ColumnSpec, CorrelationTarget, DagRule, Rule, TableSpec
from weft.plans.sqlkit import u_sql
from weft.session import table

SEED = 42
SEGMENTS = ("BUILDING", "AUTOMOBILE", "MACHINERY", "HOUSEHOLD")

CUST_SPEC = TableSpec("customer", (
    ColumnSpec("c_custkey", "integer", nullable=False, primary_key=True),
    ColumnSpec("c_name", "string", nullable=False),
    ColumnSpec("c_nationkey", "integer", min_value=0, max_value=20),
    ColumnSpec("c_acctbal", "float", min_value=0.0, max_value=9000.0),
    ColumnSpec("c_mktsegment", "string", nullable=False, enum_values=SEGMENTS),
    ColumnSpec("c_phone", "string"),
))
CUST_DAG = [DagRule("c_nationkey", "balance_amount", "c_acctbal")]
LI_TARGETS = [CorrelationTarget("l_quantity", "l_extendedprice", 0.9),
              CorrelationTarget("l_discount", "l_tax", 0.5),
              CorrelationTarget("l_partkey", "l_suppkey", 0.0)]


def _one(report, name):
    return report.where(F.col("check_name") == name).select(
        "check_name", F.round("score", 6).alias("score"), "violations")


def dirty_customer(spark, sf):
    """customer with nulls (c_name 2%, c_mktsegment 5%, c_acctbal 5%) and 1% outliers on c_acctbal."""
    c = table(spark, sf, "customer")
    c = D.null_mcar(c, {"c_name": 0.02, "c_mktsegment": 0.05, "c_acctbal": 0.05}, SEED, ["c_custkey"])
    return D.outliers(c, ["c_acctbal"], 0.01, SEED, ["c_custkey"])


def _dirty_customer_sql():
    k = "c_custkey"
    u = lambda t: u_sql(SEED, t, k)
    s1 = (f"SELECT c_custkey, CASE WHEN {u('null:c_name')} >= 0.02 THEN c_name END AS c_name, c_nationkey, "
          f"CASE WHEN {u('null:c_acctbal')} >= 0.05 THEN c_acctbal END AS c_acctbal, "
          f"CASE WHEN {u('null:c_mktsegment')} >= 0.05 THEN c_mktsegment END AS c_mktsegment FROM customer")
    mom = "SELECT avg(c_acctbal) mu, coalesce(nullif(stddev_samp(c_acctbal), 0), 1.0) sd FROM s1"
    s2 = (f"SELECT c_custkey, c_name, c_nationkey, CASE WHEN {u('out:c_acctbal')} < 0.01 THEN mu + "
          f"(CASE WHEN {u('dir:c_acctbal')} < 0.5 THEN -1.0 ELSE 1.0 END) * (5.0 + 5.0 * {u('mult:c_acctbal')}) * sd "
          f"ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM s1, mom")
    return f"s1 AS ({s1}), mom AS ({mom}), dc AS ({s2})"


_SEG_SQL = "('BUILDING','AUTOMOBILE','MACHINERY','HOUSEHOLD')"


def _avg_rank_sql(src, a, b):
    return (f"SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS ra, "
            f"rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS rb "
            f"FROM {src} WHERE {a} IS NOT NULL AND {b} IS NOT NULL")


def _corr_check_sql():
    parts = []
    for t in LI_TARGETS:
        parts.append(f"SELECT CASE WHEN abs(corr(ra, rb) - {t.strength}) > 0.3 THEN 1 ELSE 0 END AS bad "
                     f"FROM ({_avg_rank_sql('lineitem', t.col_a, t.col_b)})")
    return " UNION ALL ".join(parts)


@query("check_schema", f"""
WITH want AS (SELECT unnest({[c.name for c in CUST_SPEC.columns]}) AS c),
have AS (SELECT column_name AS c FROM (DESCRIBE customer)),
gone AS (SELECT count(*) FILTER (WHERE c NOT IN (SELECT c FROM have)) AS n, count(*) AS m FROM want)
SELECT 'schema_completeness' AS check_name, round(1.0 - n / m, 6) AS score, CAST(n AS BIGINT) AS violations FROM gone""")
def q_check_schema(spark, sf):
    c = table(spark, sf, "customer")
    return _one(A.audit(c, CUST_SPEC, only={"schema_completeness"}), "schema_completeness")


TYPE_SPEC = TableSpec("orders_text", (
    ColumnSpec("o_orderkey", "integer"), ColumnSpec("o_orderstatus", "boolean"),
    ColumnSpec("o_orderdate_txt", "date"), ColumnSpec("o_totalprice_txt", "float"),
    ColumnSpec("o_orderpriority", "integer"),
))


@query("check_types", """
WITH t AS (SELECT o_orderkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate_txt,
                  CAST(o_totalprice AS VARCHAR) AS o_totalprice_txt, o_orderpriority FROM orders),
b AS (SELECT
  (count(*) FILTER (WHERE o_orderstatus IS NOT NULL AND o_orderstatus NOT IN ('True','False','0','1','true','false')) > 0)::INT
  + (count(*) FILTER (WHERE o_orderdate_txt IS NOT NULL AND try_cast(o_orderdate_txt AS TIMESTAMP) IS NULL) > 0)::INT
  + (count(*) FILTER (WHERE o_totalprice_txt IS NOT NULL AND try_cast(o_totalprice_txt AS DOUBLE) IS NULL) > 0)::INT
  + (count(*) FILTER (WHERE o_orderpriority IS NOT NULL AND try_cast(o_orderpriority AS DOUBLE) IS NULL) > 0)::INT AS v
  FROM t)
SELECT 'type_conformance' AS check_name, round(greatest(0.0, 1.0 - v / 5.0), 6) AS score, CAST(v AS BIGINT) AS violations
FROM b""")
def q_check_types(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate_txt"),
        F.col("o_totalprice").cast("string").alias("o_totalprice_txt"), "o_orderpriority")
    return _one(A.audit(o, TYPE_SPEC, only={"type_conformance"}), "type_conformance")


@query("check_nulls", f"""
WITH {_dirty_customer_sql()},
b AS (SELECT count(*) n, count(*) FILTER (WHERE c_custkey IS NULL) + count(*) FILTER (WHERE c_name IS NULL)
              + count(*) FILTER (WHERE c_mktsegment IS NULL) AS v FROM dc)
SELECT 'null_policy' AS check_name, round(greatest(0.0, 1.0 - v / (n * 6.0)), 6) AS score, CAST(v AS BIGINT) AS violations
FROM b""")
def q_check_nulls(spark, sf):
    return _one(A.audit(dirty_customer(spark, sf), CUST_SPEC, only={"null_policy"}), "null_policy")


@query("check_range", """
WITH b AS (SELECT count(*) n,
  count(*) FILTER (WHERE c_nationkey < 0) + count(*) FILTER (WHERE c_nationkey > 20)
  + count(*) FILTER (WHERE c_acctbal < 0) + count(*) FILTER (WHERE c_acctbal > 9000) AS v FROM customer)
SELECT 'range_validity' AS check_name, round(greatest(0.0, 1.0 - v / n), 6) AS score, CAST(v AS BIGINT) AS violations
FROM b""")
def q_check_range(spark, sf):
    return _one(A.audit(table(spark, sf, "customer"), CUST_SPEC, only={"range_validity"}), "range_validity")


@query("check_enum", f"""
WITH b AS (SELECT count(*) n, count(*) FILTER (WHERE c_mktsegment IS NOT NULL AND c_mktsegment NOT IN {_SEG_SQL}) AS v
           FROM customer)
SELECT 'enum_validity' AS check_name, round(greatest(0.0, 1.0 - v / n), 6) AS score, CAST(v AS BIGINT) AS violations
FROM b""")
def q_check_enum(spark, sf):
    return _one(A.audit(table(spark, sf, "customer"), CUST_SPEC, only={"enum_validity"}), "enum_validity")


LI_SPEC = TableSpec("lineitem", (ColumnSpec("l_orderkey", "integer", primary_key=True, nullable=False),
                                 ColumnSpec("l_partkey", "integer", unique=True)))


@query("check_unique", """
WITH b AS (SELECT (count(l_orderkey) - count(DISTINCT l_orderkey)) + (count(l_partkey) - count(DISTINCT l_partkey)) AS v
           FROM lineitem)
SELECT 'uniqueness' AS check_name, CASE WHEN v > 0 THEN 0.0 ELSE 1.0 END AS score, CAST(v AS BIGINT) AS violations
FROM b""")
def q_check_unique(spark, sf):
    return _one(A.audit(table(spark, sf, "lineitem"), LI_SPEC, only={"uniqueness"}), "uniqueness")


def _order_delivery(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").alias("delivery_date"))
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").alias("order_date"))
    return li.join(o, li.l_orderkey == o.o_orderkey)


@query("check_temporal", """
WITH j AS (SELECT l_shipdate AS delivery_date, o_orderdate AS order_date FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
b AS (SELECT count(*) n, count(*) FILTER (WHERE delivery_date < order_date) v FROM j)
SELECT 'temporal_ordering' AS check_name, round(greatest(0.0, 1.0 - v / n), 6) AS score, CAST(v AS BIGINT) AS violations
FROM b""")
def q_check_temporal(spark, sf):
    j = _order_delivery(spark, sf)
    rules = [Rule("li.order_before_delivery", "temporal", ("order_date", "delivery_date"))]
    return _one(A.audit(j, None, rules=rules, only={"temporal_ordering"}), "temporal_ordering")


@query("check_causal", """
WITH b AS (SELECT count(*) n, count(*) FILTER (WHERE c_acctbal < 0) v FROM customer)
SELECT 'causal_physics' AS check_name, round(greatest(0.0, 1.0 - v / n), 6) AS score, CAST(v AS BIGINT) AS violations
FROM b""")
def q_check_causal(spark, sf):
    c = table(spark, sf, "customer").withColumn("balance_amount", F.col("c_acctbal"))
    return _one(A.audit(c, None, dag=CUST_DAG, only={"causal_physics"}), "causal_physics")


_LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _stats_sql(k, share):
    mom = ", ".join(f"count({c}) c_{c}, avg({c}) m_{c}, coalesce(nullif(stddev_samp({c}), 0), 1.0) s_{c}" for c in _LI_NUM)
    flags = " + ".join(
        f"(CASE WHEN c_{c} >= 10 AND (SELECT count(*) FROM lineitem WHERE abs({c} - m_{c}) > {k} * s_{c}) "
        f"> c_{c} * {share} THEN 1 ELSE 0 END)" for c in _LI_NUM)
    return (f"WITH m AS (SELECT {mom} FROM lineitem), b AS (SELECT {flags} AS v FROM m) "
            f"SELECT 'statistical_sanity' AS check_name, round(greatest(0.0, 1.0 - v / {len(_LI_NUM)}.0), 6) AS score, "
            f"CAST(v AS BIGINT) AS violations FROM b")


@query("check_stats", _stats_sql(3.0, 0.001))
def q_check_stats(spark, sf):
    return _one(A.audit(table(spark, sf, "lineitem"), None, stats_k=3.0, stats_share=0.001, only={"statistical_sanity"}), "statistical_sanity")


@query("check_correlation", f"""
WITH b AS (SELECT sum(bad) v FROM ({_corr_check_sql()}))
SELECT 'correlation_consistency' AS check_name, round(greatest(0.0, 1.0 - v / 3.0), 6) AS score,
       CAST(v AS BIGINT) AS violations FROM b""")
def q_check_correlation(spark, sf):
    return _one(A.audit(table(spark, sf, "lineitem"), None, correlations=LI_TARGETS, only={"correlation_consistency"}), "correlation_consistency")


def _audit_report_sql(extra: str = "", src: str = "dc"):
    """The 10 check rows as CTE ``r``; ``extra`` CTEs may derive ``src`` from ``dc`` first."""
    return f"""
WITH {_dirty_customer_sql()},{extra}
dcx AS (SELECT *, c_acctbal AS balance_amount FROM {src}),
a AS (SELECT count(*) n,
  count(*) FILTER (WHERE c_custkey IS NULL) + count(*) FILTER (WHERE c_name IS NULL)
    + count(*) FILTER (WHERE c_mktsegment IS NULL) AS v_null,
  count(*) FILTER (WHERE c_nationkey < 0) + count(*) FILTER (WHERE c_nationkey > 20)
    + count(*) FILTER (WHERE c_acctbal < 0) + count(*) FILTER (WHERE c_acctbal > 9000) AS v_range,
  count(*) FILTER (WHERE c_mktsegment IS NOT NULL AND c_mktsegment NOT IN {_SEG_SQL}) AS v_enum,
  count(c_custkey) - count(DISTINCT c_custkey) AS v_uniq,
  count(*) FILTER (WHERE balance_amount < 0) AS v_phys
  FROM dcx),
m AS (SELECT {", ".join(f"count({c}) c_{c}, avg({c}) m_{c}, coalesce(nullif(stddev_samp({c}), 0), 1.0) s_{c}"
                        for c in ["c_custkey", "c_nationkey", "c_acctbal", "balance_amount"])} FROM dcx),
st AS (SELECT {" + ".join(f"(CASE WHEN c_{c} >= 10 AND (SELECT count(*) FROM dcx WHERE abs({c} - m_{c}) > 10.0 * s_{c}) "
                          f"> c_{c} * 0.05 THEN 1 ELSE 0 END)" for c in ["c_custkey", "c_nationkey", "c_acctbal", "balance_amount"])}
       AS v_stat FROM m),
r AS (
  SELECT 1 AS check_id, 'schema_completeness' AS check_name, 0.15 AS weight, 1.0 - 1.0 / 6 AS score, 1 AS violations, 'high' AS sev FROM a
  UNION ALL SELECT 2, 'type_conformance', 0.15, 1.0, 0, 'high' FROM a
  UNION ALL SELECT 3, 'null_policy', 0.10, greatest(0.0, 1.0 - v_null / (n * 6.0)), v_null, 'high' FROM a
  UNION ALL SELECT 4, 'range_validity', 0.12, greatest(0.0, 1.0 - v_range / n), v_range, 'medium' FROM a
  UNION ALL SELECT 5, 'enum_validity', 0.10, greatest(0.0, 1.0 - v_enum / n), v_enum, 'medium' FROM a
  UNION ALL SELECT 6, 'uniqueness', 0.10, CASE WHEN v_uniq > 0 THEN 0.0 ELSE 1.0 END, v_uniq, 'critical' FROM a
  UNION ALL SELECT 7, 'temporal_ordering', 0.08, 1.0, 0, 'high' FROM a
  UNION ALL SELECT 8, 'causal_physics', 0.08, greatest(0.0, 1.0 - v_phys / n), v_phys, 'medium' FROM a
  UNION ALL SELECT 9, 'statistical_sanity', 0.07, greatest(0.0, 1.0 - v_stat / 4.0), v_stat, 'low' FROM st
  UNION ALL SELECT 10, 'correlation_consistency', 0.05, 1.0, 0, 'low' FROM a)"""


@query("audit_report", _audit_report_sql() + """
SELECT check_id, check_name, CAST(weight AS DOUBLE) AS weight, round(score, 6) AS score, CAST(violations AS BIGINT) AS violations,
       CASE WHEN violations > 0 THEN sev ELSE 'low' END AS severity, violations = 0 AS passed FROM r""")
def q_audit_report(spark, sf):
    dc = dirty_customer(spark, sf).withColumn("balance_amount", F.col("c_acctbal"))
    rep = A.audit(dc, CUST_SPEC, dag=CUST_DAG)
    return rep.withColumn("score", F.round("score", 6))


@query("audit_score", _audit_report_sql() + """
SELECT round(least(greatest(sum(weight * score * 100.0), 0.0), 100.0), 6) AS overall_score,
       CAST(count(*) AS BIGINT) AS n_checks, CAST(sum(CASE WHEN violations = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_passed
FROM r""")
def q_audit_score(spark, sf):
    dc = dirty_customer(spark, sf).withColumn("balance_amount", F.col("c_acctbal"))
    s = A.audit_score(A.audit(dc, CUST_SPEC, dag=CUST_DAG))
    return s.withColumn("overall_score", F.round("overall_score", 6))


@query("check_referential", """
SELECT CAST(count(*) AS BIGINT) AS orphans FROM orders
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')""")
def q_check_referential(spark, sf):
    o = table(spark, sf, "orders")
    c = table(spark, sf, "customer").where(F.col("c_mktsegment") != "BUILDING")
    return C.referential_orphans(o, "o_custkey", c, "c_custkey").agg(F.count(F.lit(1)).cast("long").alias("orphans"))
