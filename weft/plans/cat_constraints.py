"""Queries for constraints (C-03, C-05..C-10) with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import cascade as CA
from weft.operators import constraints as C
from weft.operators import guard as GD
from weft.plans.registry import query
from weft.plans.spec import Relationship, Rule
from weft.session import table

CUST_RULES = [
    Rule("customer.c_acctbal_range", "range", ("c_acctbal",), "clip", "high", 0.0, 9000.0),
    Rule("customer.c_mktsegment_enum", "enum", ("c_mktsegment",), "flag", "medium",
         values=("BUILDING", "AUTOMOBILE", "MACHINERY", "HOUSEHOLD")),
    Rule("customer.c_nationkey_expr", "expression", ("c_nationkey",), "flag", "medium",
         expression="c_nationkey < 20"),
    Rule("customer.c_missing_range", "range", ("c_missing",), "clip", "high", 0.0, 1.0),
]


@query("enforce_range", """
SELECT c_custkey, CASE WHEN c_acctbal IS NULL THEN NULL ELSE least(greatest(c_acctbal, 0.0), 9000.0) END AS c_acctbal
FROM customer""")
def q_enforce_range(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return C.enforce(c, [CUST_RULES[0]])


@query("enforce_enum", """
SELECT 'orders.o_orderstatus_enum' AS rule, 'o_orderstatus' AS "column", count(*) AS "count", 'flag' AS action
FROM orders WHERE o_orderstatus IS NULL OR o_orderstatus NOT IN ('O', 'F')
HAVING count(*) > 0""")
def q_enforce_enum(spark, sf):
    o = table(spark, sf, "orders")
    r = Rule("orders.o_orderstatus_enum", "enum", ("o_orderstatus",), "flag", values=("O", "F"))
    return C.violation_log(o, [r])


@query("enforce_expression", """
SELECT o_orderkey, CASE WHEN o_totalprice > 50000 THEN [] ELSE ['orders.big_enough'] END AS _violations
FROM orders""")
def q_enforce_expression(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    r = Rule("orders.big_enough", "expression", ("o_totalprice",), "flag", expression="o_totalprice > 50000")
    return C.enforce(o, [r]).select("o_orderkey", "_violations")


@query("violation_log", """
SELECT * FROM (
  SELECT 'customer.c_acctbal_range' AS rule, 'c_acctbal' AS "column",
         count(*) FILTER (WHERE c_acctbal < 0 OR c_acctbal > 9000) AS "count", 'clip' AS action FROM customer
  UNION ALL
  SELECT 'customer.c_mktsegment_enum', 'c_mktsegment',
         count(*) FILTER (WHERE c_mktsegment IS NULL OR c_mktsegment NOT IN ('BUILDING','AUTOMOBILE','MACHINERY','HOUSEHOLD')),
         'flag' FROM customer
  UNION ALL
  SELECT 'customer.c_nationkey_expr', 'c_nationkey', count(*) FILTER (WHERE NOT (c_nationkey < 20)), 'flag' FROM customer
) WHERE "count" > 0""")
def q_violation_log(spark, sf):
    return C.violation_log(table(spark, sf, "customer"), CUST_RULES)


@query("action_reject", """
SELECT * FROM customer WHERE NOT (c_acctbal < 0 OR c_acctbal > 9000)""")
def q_action_reject(spark, sf):
    r = Rule("customer.c_acctbal_reject", "range", ("c_acctbal",), "reject", "high", 0.0, 9000.0)
    return C.enforce(table(spark, sf, "customer"), [r])


@query("action_impute", """
WITH mm AS (SELECT c_mktsegment AS md FROM customer WHERE c_mktsegment IN ('BUILDING','AUTOMOBILE','MACHINERY') GROUP BY 1
       ORDER BY count(*) DESC, c_mktsegment ASC LIMIT 1)
SELECT c_custkey, CASE WHEN c_mktsegment IS NULL OR c_mktsegment NOT IN ('BUILDING','AUTOMOBILE','MACHINERY')
                  THEN (SELECT md FROM mm) ELSE c_mktsegment END AS c_mktsegment
FROM customer""")
def q_action_impute(spark, sf):
    r = Rule("customer.seg_impute", "enum", ("c_mktsegment",), "impute", values=("BUILDING", "AUTOMOBILE", "MACHINERY"))
    return C.enforce(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), [r])


@query("action_flag", """
SELECT c_custkey, list_filter([CASE WHEN c_acctbal < 0 OR c_acctbal > 9000 THEN 'customer.bal' END,
                               CASE WHEN c_nationkey >= 20 THEN 'customer.nat' END], lambda x: x IS NOT NULL) AS _violations
FROM customer""")
def q_action_flag(spark, sf):
    rules = [Rule("customer.bal", "range", ("c_acctbal",), "flag", min_value=0.0, max_value=9000.0),
             Rule("customer.nat", "expression", ("c_nationkey",), "flag", expression="c_nationkey < 20")]
    return C.enforce(table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_nationkey"), rules) \
        .select("c_custkey", "_violations")


@query("action_impute_numeric", """
WITH g AS (SELECT median(c_acctbal) AS md FROM customer WHERE c_acctbal BETWEEN 0 AND 9000)
SELECT c_custkey, round(CASE WHEN c_acctbal < 0 OR c_acctbal > 9000 THEN (SELECT md FROM g) ELSE c_acctbal END, 6) AS c_acctbal
FROM customer""")
def q_action_impute_numeric(spark, sf):
    r = Rule("customer.bal_impute", "range", ("c_acctbal",), "impute", min_value=0.0, max_value=9000.0)
    out = C.enforce(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), [r])
    return out.withColumn("c_acctbal", F.round("c_acctbal", 6))


_LI5 = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]


@query("enforce_unique", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
         row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) AS rn
  FROM lineitem) WHERE rn = 1""")
def q_enforce_unique(spark, sf):
    r = Rule("lineitem.key_unique", "unique", ("l_orderkey", "l_linenumber"), "reject", "critical")
    return C.enforce(table(spark, sf, "lineitem").select(*_LI5), [r])


@query("enforce_not_null", """
SELECT event_id, CASE WHEN user_id % 7 = 0 THEN ['events.device_not_null'] ELSE [] END AS _violations FROM events""")
def q_enforce_not_null(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.when(F.col("user_id") % 7 != 0, F.col("event_type")).alias("device"))
    r = Rule("events.device_not_null", "not_null", ("device",), "flag", "high")
    return C.enforce(e, [r]).select("event_id", "_violations")


@query("enforce_temporal", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, o_orderdate
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE NOT (l_shipdate < o_orderdate)""")
def q_enforce_temporal(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    j = li.join(o, li.l_orderkey == o.o_orderkey).drop("o_orderkey")
    return C.enforce(j, [Rule("li.ship_after_order", "temporal", ("o_orderdate", "l_shipdate"), "reject", "high")])


@query("enforce_referential", """
SELECT o_orderkey, CASE WHEN o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')
                   THEN ['orders.customer'] ELSE [] END AS _violations FROM orders""")
def q_enforce_referential(spark, sf):
    r = Rule("orders.customer", "referential", ("o_custkey",), "flag", "high", ref_table="customer", ref_column="c_custkey")
    parents = {"customer": table(spark, sf, "customer").where(F.col("c_mktsegment") != "BUILDING")}
    return C.enforce(table(spark, sf, "orders"), [r], parents).select("o_orderkey", "_violations")


@query("enforce_causal", """
SELECT o_orderkey, CASE WHEN abs(o_totalprice - (o_custkey * 100.0)) > 50000 THEN ['orders.price'] ELSE [] END AS _violations FROM orders""")
def q_enforce_causal(spark, sf):
    r = Rule("orders.price", "causal", ("o_totalprice", "o_custkey"), "flag", "high", expression="o_custkey * 100.0", tolerance=50000.0)
    return C.enforce(table(spark, sf, "orders"), [r]).select("o_orderkey", "_violations")


@query("violation_log_all_kinds", """
SELECT * FROM (
  SELECT 'u' AS rule, 'o_custkey' AS "column", CAST(count(*) - count(DISTINCT o_custkey) AS BIGINT) AS "count", 'reject' AS action FROM orders
  UNION ALL SELECT 'r', 'o_custkey', count(*) FILTER (WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12)), 'flag' FROM orders
  UNION ALL SELECT 'g', 'o_totalprice', count(*) FILTER (WHERE o_totalprice > 100000), 'clip' FROM orders
  UNION ALL SELECT 'n', 'o_orderstatus', count(*) FILTER (WHERE o_orderstatus IS NULL), 'reject' FROM orders) WHERE "count" > 0""")
def q_violation_log_all_kinds(spark, sf):
    rules = [Rule("u", "unique", ("o_custkey",), "reject"), Rule("r", "referential", ("o_custkey",), "flag", ref_table="customer", ref_column="c_custkey"),
             Rule("g", "range", ("o_totalprice",), "clip", max_value=100000.0), Rule("n", "not_null", ("o_orderstatus",), "reject")]
    parents = {"customer": table(spark, sf, "customer").where("c_nationkey < 12")}
    return C.violation_log(table(spark, sf, "orders"), rules, parents)


@query("rule_unique", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
         row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                            ORDER BY l_partkey NULLS FIRST, l_suppkey NULLS FIRST, l_quantity NULLS FIRST) AS rn
  FROM lineitem) WHERE rn > 1""")
def q_rule_unique(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return C.rule_unique(li, ["l_orderkey", "l_linenumber"])


@query("rule_temporal", """
SELECT l_orderkey, l_linenumber, o_orderdate, l_shipdate
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate""")
def q_rule_temporal(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    j = li.join(o, li.l_orderkey == o.o_orderkey).drop("o_orderkey")
    bad = C.violation(j, Rule("li.ship_after_order", "temporal", ("o_orderdate", "l_shipdate")))
    return j.where(bad)


@query("rule_referential", """
SELECT o_orderkey, o_custkey FROM orders
WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')""")
def q_rule_referential(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf, "customer").where(F.col("c_mktsegment") != "BUILDING")
    return C.referential_orphans(o, "o_custkey", c, "c_custkey")


@query("rule_causal", """
SELECT count(*) FILTER (WHERE abs(l_extendedprice - l_quantity * 900.0) > 0.5
                        OR (l_extendedprice IS NULL AND l_quantity IS NOT NULL)) AS violations,
       count(*) AS n_rows
FROM lineitem""")
def q_rule_causal(spark, sf):
    li = table(spark, sf, "lineitem")
    r = Rule("lineitem.price_causal", "causal", ("l_extendedprice", "l_quantity"), expression="l_quantity * 900.0",
             tolerance=0.5)
    return li.agg(F.count_if(C.violation(li, r)).cast("long").alias("violations"),
                  F.count(F.lit(1)).cast("long").alias("n_rows"))


@query("rules_from_json", """
WITH raw AS (
  SELECT e.event_type AS name,
         CASE WHEN e.value > 50 THEN 'range' WHEN e.value > 20 THEN 'Enum' ELSE 'weird' END AS type,
         CASE WHEN e.value > 5 THEN [e.event_type] ELSE [] END AS columns,
         CASE WHEN e.user_id % 3 = 0 THEN 'HIGH' WHEN e.user_id % 3 = 1 THEN 'bogus' ELSE NULL END AS severity
  FROM events e)
SELECT name,
       CASE WHEN lower(trim(type)) IN ('range','enum','unique','not_null','expression','temporal','referential','causal')
            THEN lower(trim(type)) ELSE 'expression' END AS kind,
       columns,
       CASE WHEN lower(trim(severity)) IN ('low','medium','high','critical') THEN lower(trim(severity)) ELSE 'medium' END
         AS severity
FROM raw WHERE name IS NOT NULL AND trim(name) <> '' AND columns IS NOT NULL AND len(columns) > 0""")
def q_rules_from_json(spark, sf):
    e = table(spark, sf, "events")
    raw = e.select(
        F.col("event_type").alias("name"),
        F.when(F.col("value") > 50, "range").when(F.col("value") > 20, "Enum").otherwise("weird").alias("type"),
        F.when(F.col("value") > 5, F.array("event_type")).otherwise(F.array().cast("array<string>")).alias("columns"),
        F.when(F.col("user_id") % 3 == 0, "HIGH").when(F.col("user_id") % 3 == 1, "bogus").alias("severity"),
    )
    # the rule items travel as JSON text, as a model or a file would hand them over
    as_json = raw.select(F.to_json(F.struct("*")).alias("j"))
    parsed = as_json.select(F.from_json("j", "name string, type string, columns array<string>, severity string")
                            .alias("r")).select("r.*")
    return C.rules_from_json_frame(parsed)


# ------------------------------------------------------------------ rejects across tables


@query("cascade_chain", """
WITH c AS (SELECT c_custkey FROM customer WHERE NOT coalesce(c_acctbal < 0, false)),
o AS (SELECT o_orderkey FROM orders WHERE o_custkey IS NULL OR o_custkey IN (SELECT c_custkey FROM c))
SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice, 4) AS l_extendedprice FROM lineitem WHERE l_orderkey IS NULL OR l_orderkey IN (SELECT o_orderkey FROM o)""")
def q_cascade_chain(spark, sf):
    """Customers in debt are rejected, with their orders, and the lines of those."""
    tables = {t: table(spark, sf, t) for t in ("customer", "orders", "lineitem")}
    rules = {"customer": [Rule("solvent", "range", ("c_acctbal",), "reject", min_value=0.0)]}
    out = CA.cascade_reject(tables, [Relationship("customer", "c_custkey", "orders", "o_custkey"), Relationship("orders", "o_orderkey", "lineitem", "l_orderkey")], rules)
    return out["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey", F.round("l_extendedprice", 4).alias("l_extendedprice"))


@query("cascade_cycle", """
WITH RECURSIVE c AS (SELECT c_custkey, c_acctbal, CASE WHEN c_custkey % 3 = 0 THEN (c_custkey * 13 + 5) % (SELECT max(o_orderkey) FROM orders) END AS favourite FROM customer),
refs AS (SELECT 'customer' AS src, o_custkey AS ref, 'orders' AS t, o_orderkey AS k FROM orders UNION ALL SELECT 'orders', favourite, 'customer', c_custkey FROM c),
gone AS (SELECT 'customer' AS t, c_custkey AS k FROM c WHERE c_acctbal < -800 UNION SELECT refs.t, refs.k FROM gone g JOIN refs ON refs.src = g.t AND refs.ref = g.k)
SELECT 'customer' AS kind, c_custkey AS k FROM c WHERE c_custkey NOT IN (SELECT k FROM gone WHERE t = 'customer')
UNION ALL SELECT 'orders', o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT k FROM gone WHERE t = 'orders')""")
def q_cascade_cycle(spark, sf):
    """Orders refer to customers, and some customers to an order: rejects run round the cycle until none is left to follow."""
    o = table(spark, sf, "orders")
    top = o.agg(F.max("o_orderkey")).first()[0]
    c = table(spark, sf, "customer").withColumn("favourite", F.when(F.col("c_custkey") % 3 == 0, (F.col("c_custkey") * 13 + 5) % F.lit(top)))
    rules = {"customer": [Rule("debt", "range", ("c_acctbal",), "reject", min_value=-800.0)]}
    out = CA.cascade_reject({"customer": c, "orders": o}, [Relationship("customer", "c_custkey", "orders", "o_custkey"), Relationship("orders", "o_orderkey", "customer", "favourite")],
                            rules, orphans=False)
    return out["customer"].select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("k")).unionByName(out["orders"].select(F.lit("orders").alias("kind"), F.col("o_orderkey").alias("k")))


# ------------------------------------------------------------------ rules from JSON, put to use

RULE_ITEMS = """[
 {"name": "price", "type": "Range", "columns": ["o_totalprice"], "severity": "HIGH", "action": "clip", "parameters": {"min": 2000, "max": 200000}},
 {"name": "status", "type": "enum", "columns": ["o_orderstatus"], "action": "flag", "parameters": {"values": ["F", "O"]}},
 {"name": "urgent_is_dear", "type": "odd", "columns": ["o_orderpriority"], "action": "flag", "parameters": {"expression": "o_orderpriority <> '1-URGENT' OR o_totalprice >= 50000"}},
 {"name": "known_customer", "type": "expression", "columns": ["o_custkey"], "action": "reject", "parameters": {"expression": "o_custkey % 11 <> 4"}},
 {"name": "spy", "type": "expression", "columns": ["o_custkey"], "parameters": {"expression": "o_custkey IN (SELECT c_custkey FROM customer)"}},
 {"name": "dice", "type": "expression", "columns": ["o_custkey"], "parameters": {"expression": "rand() > 0.5"}},
 {"name": "", "type": "range", "columns": ["o_totalprice"]}]"""


@query("rules_from_json_enforced", """
SELECT o_orderkey, round(least(greatest(o_totalprice, 2000.0), 200000.0), 4) AS o_totalprice,
       array_to_string(list_filter([CASE WHEN o_orderstatus IS NULL OR o_orderstatus NOT IN ('F', 'O') THEN 'status' END,
         CASE WHEN NOT (o_orderpriority <> '1-URGENT' OR o_totalprice >= 50000) THEN 'urgent_is_dear' END], lambda x: x IS NOT NULL), ',') AS broken
FROM orders WHERE o_custkey % 11 <> 4""")
def q_rules_from_json_enforced(spark, sf):
    """Rule items from JSON: the guard refuses three of them, the others are enforced."""
    o = table(spark, sf, "orders")
    rules, _ = GD.rules_of_json(o, RULE_ITEMS)
    out = C.enforce(o, rules)
    return out.select("o_orderkey", F.round("o_totalprice", 4).alias("o_totalprice"), F.array_join("_violations", ",").alias("broken"))
