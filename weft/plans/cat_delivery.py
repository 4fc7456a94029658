"""Queries of the whole delivery run (Q-09): the delivered rows and the reports gathered while they are written."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import delivery as DL
from weft.plans.cat_dirty import _PROFILE, dirty_orders_ctes
from weft.plans.cat_privacy import _mask_text_sql, _types_sql
from weft.plans.cat_scale import _h_sql
from weft.plans.cat_temporal import DOW, HOD, MONTHS, _dow_sql, _hod_sql, _month_sql
from weft.plans.registry import query
from weft.plans.spec import ColumnSpec, CorrelationTarget, Rule, Scenario, SpecialEvent, TableSpec, TemporalPatterns
from weft.session import table
from weft.sources import files as FS

SEED = 42
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
PLAN = DL.DeliveryPlan(
    spec=TableSpec("orders", (
        ColumnSpec("o_orderkey", "integer", nullable=False, primary_key=True), ColumnSpec("o_custkey", "integer", nullable=False),
        ColumnSpec("o_orderstatus", "string", nullable=False, enum_values=("F", "O", "P")),
        ColumnSpec("o_totalprice", "float", min_value=1000.0, max_value=250000.0), ColumnSpec("o_orderdate", "string"),
        ColumnSpec("o_orderpriority", "string"), ColumnSpec("o_comment", "string"))),
    key_cols=("o_orderkey",), measures=("o_totalprice",),
    patterns=TemporalPatterns(tuple(DOW), tuple(HOD), MONTHS, (SpecialEvent("spike", 3, 10, 3.0, ("o_totalprice",), duration_days=2),)),
    scenario=Scenario("boom", {"o_totalprice": 2.0}, {"o_totalprice": -50.0}),
    targets=(CorrelationTarget("o_totalprice", "o_custkey", 0.5),), repair_rounds=1,
    dirt=_PROFILE,
    rules=(Rule("price_range", "range", ("o_totalprice",), "clip", min_value=0.0, max_value=300000.0),
           Rule("status_known", "enum", ("o_orderstatus",), "flag", values=("F", "O", "P")),
           Rule("customer_given", "not_null", ("o_custkey",), "reject"),
           Rule("priority_given", "not_null", ("o_orderpriority",), "flag")),
    mask=("o_orderpriority",), quasi_ids=("o_orderstatus", "o_orderpriority"))

_CTES = f"""
WITH t1 AS (SELECT * REPLACE ({_dow_sql('o_orderdate', 'o_orderkey')} AS o_orderdate) FROM orders),
t2 AS (SELECT * REPLACE ({_hod_sql('o_orderdate', 'o_orderkey')} AS o_orderdate) FROM t1),
t3 AS (SELECT * REPLACE (({_month_sql('o_totalprice', 'o_orderdate')} *
       (CASE WHEN month(o_orderdate) = 3 AND day(o_orderdate) >= 10 AND day(o_orderdate) < 12 THEN 3.0 ELSE 1.0 END)) * 2.0 + -50.0 AS o_totalprice) FROM t2),
b AS (SELECT o_orderkey, o_totalprice, o_custkey, {_h_sql('o_orderkey')} AS h FROM t3 WHERE o_totalprice IS NOT NULL AND o_custkey IS NOT NULL),
r0 AS (SELECT *, row_number() OVER (ORDER BY o_totalprice, h, o_orderkey) - 1 AS ra, row_number() OVER (ORDER BY o_custkey, h, o_orderkey) - 1 AS rb FROM b),
bl AS (SELECT *, CAST({1.0 - 0.3!r} AS DOUBLE) * rb + CAST(0.3 AS DOUBLE) * ra AS blend FROM r0),
ps AS (SELECT o_orderkey, row_number() OVER (ORDER BY blend, h, o_orderkey) - 1 AS pos FROM bl),
sv AS (SELECT o_custkey AS newb, row_number() OVER (ORDER BY o_custkey, h, o_orderkey) - 1 AS pos FROM b),
t4 AS (SELECT * REPLACE (coalesce(newb, o_custkey) AS o_custkey) FROM (
       SELECT t3.*, newb FROM t3 LEFT JOIN (SELECT o_orderkey, newb FROM ps JOIN sv USING (pos)) USING (o_orderkey))),
{dirty_orders_ctes('t4')},
judged AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority,
       coalesce(o_totalprice < 0 OR o_totalprice > 300000, false) AS b0, o_orderstatus IS NULL OR o_orderstatus NOT IN ('F', 'O', 'P') AS b1,
       o_custkey IS NULL AS b2, o_orderpriority IS NULL AS b3 FROM u),
kept AS (SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_totalprice IS NOT NULL THEN least(greatest(o_totalprice, 0.0), 300000.0) END AS o_totalprice, o_orderdate, o_orderpriority, b1, b3
         FROM judged WHERE NOT b2),
done AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
         {_mask_text_sql('o_orderpriority')} AS o_orderpriority,
         array_to_string(list_filter([CASE WHEN b1 THEN 'status_known' END, CASE WHEN b3 THEN 'priority_given' END], lambda x: x IS NOT NULL), ',') AS broken FROM kept)"""


def _delivered(spark, sf):
    path = FS.scratch_path(spark, "delivery")
    DL.deliver(table(spark, sf, "orders"), PLAN, SEED, path)
    return path


@query("delivery_data", _CTES + """
SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 4) AS o_totalprice, o_orderdate, o_orderpriority, broken FROM done""")
def q_delivery_data(spark, sf):
    """orders through every phase: patterns, scenario, correlation nudge, dirt, rules, masking, written and read back."""
    d = DL.read_data(spark, _delivered(spark, sf))
    return d.withColumn("o_totalprice", F.round("o_totalprice", 4)).withColumn("broken", F.array_join("_violations", ",")).drop("_violations")


def _reports_sql():
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
    rows = [("enhance", "rows", "(SELECT count(*) FROM u)"), *[("enhance", f"nulls:{c}", f"(SELECT count(*) - count({c}) FROM u)") for c in cols],
            *[("rules", r.name, f"(SELECT count(*) FILTER (WHERE b{i}) FROM judged)") for i, r in enumerate(PLAN.rules)],
            ("privacy", "pii_cells", f"(SELECT count(*) FILTER (WHERE len({_types_sql('o_orderpriority')}) > 0) FROM kept)"),
            ("privacy", "k", "(SELECT k FROM pk)"), ("privacy", "score", "(SELECT least(100.0, (CASE WHEN k = 1 THEN 40.0 ELSE least(40.0, 40.0 / k) END) + 10.0 + 40.0) FROM pk)"),
            ("delivery", "rows", "(SELECT count(*) FROM done)"), ("audit", "overall_score", "(SELECT sum(w * score * 100.0) FROM checks)")]
    far = " + ".join(f"(CASE WHEN (SELECT count(*) FROM done, m WHERE abs({c} - m_{c}) > 10.0 * s_{c}) > (SELECT count({c}) FROM done) * 0.05 THEN 1 ELSE 0 END)"
                     for c in ("o_orderkey", "o_custkey", "o_totalprice"))
    mom = ", ".join(f"avg({c}) m_{c}, coalesce(nullif(stddev_samp({c}), 0), 1.0) s_{c}" for c in ("o_orderkey", "o_custkey", "o_totalprice"))
    checks = [("schema_completeness", 0.15, "1.0 - 1.0 / 7", "1"), ("type_conformance", 0.15, "1.0", "0"), ("null_policy", 0.10, "greatest(0.0, 1.0 - v_null / (n * 7.0))", "v_null"),
              ("range_validity", 0.12, "greatest(0.0, 1.0 - v_range / n)", "v_range"), ("enum_validity", 0.10, "greatest(0.0, 1.0 - v_enum / n)", "v_enum"),
              ("uniqueness", 0.10, "CASE WHEN v_uniq > 0 THEN 0.0 ELSE 1.0 END", "v_uniq"), ("temporal_ordering", 0.08, "1.0", "0"), ("causal_physics", 0.08, "1.0", "0"),
              ("statistical_sanity", 0.07, f"1.0 - ({far}) / 3.0", far), ("correlation_consistency", 0.05, "1.0", "0")]
    parts = " UNION ALL ".join(f"SELECT '{c}' AS name, CAST({w} AS DOUBLE) AS w, CAST({s} AS DOUBLE) AS score, CAST({v} AS DOUBLE) AS v FROM a" for c, w, s, v in checks)
    out = " UNION ALL ".join(f"SELECT '{s}' AS section, '{n}' AS name, round(CAST({v} AS DOUBLE), 6) AS value" for s, n, v in rows)
    return _CTES + f""",
a AS (SELECT count(*) n, count(*) - count(o_orderkey) + count(*) - count(o_custkey) + count(*) - count(o_orderstatus) AS v_null,
      count(*) FILTER (WHERE o_totalprice < 1000) + count(*) FILTER (WHERE o_totalprice > 250000) AS v_range,
      count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O', 'P')) AS v_enum, count(o_orderkey) - count(DISTINCT o_orderkey) AS v_uniq FROM done),
m AS (SELECT {mom} FROM done), pk AS (SELECT min(n) AS k FROM (SELECT count(*) n FROM done GROUP BY o_orderstatus, o_orderpriority)),
checks AS ({parts})
{out}
UNION ALL SELECT 'audit', name, round(score, 6) FROM checks UNION ALL SELECT 'audit', name || ':violations', v FROM checks"""


@query("delivery_reports", _reports_sql())
def q_delivery_reports(spark, sf):
    """The reports of the same run: observed while writing, plus one scan of the written data."""
    return DL.read_reports(spark, _delivered(spark, sf)).withColumn("value", F.round("value", 6))
