"""Queries for temporal patterns (T-01..T-06) and scenarios (X-01..X-06) with DuckDB oracles."""

from __future__ import annotations

import dataclasses
import math

from pyspark.sql import functions as F

from weft.operators import correlate as CR
from weft.operators import scenario as X
from weft.operators import series as SR
from weft.operators import temporal as TP
from weft.operators.rank import ordinal
from weft.plans.registry import query
from weft.plans.spec import Scenario, SpecialEvent, TemporalPatterns
from weft.plans.sqlkit import cdf_index_sql, cumulative, normal_sql, u_sql
from weft.session import cut_lineage, table

SEED = 42
DOW = [1, 1, 1, 1, 1, 0.5, 0.3]
HOD = [0.2, 0.1, 0.1, 0.1, 0.1, 0.2, 0.5, 1, 2, 3, 3, 3, 2.5, 3, 3, 3, 2.5, 2, 1.5, 1, 0.8, 0.6, 0.4, 0.3]
MONTHS = {1: 0.9, 2: 0.85, 3: 1.0, 4: 1.0, 5: 1.05, 6: 1.1, 7: 1.1, 8: 1.0, 9: 0.95, 10: 1.05, 11: 1.2, 12: 1.3}
EVENTS = (SpecialEvent("festival", 11, None, 1.5, ("o_totalprice",)),
          SpecialEvent("new_year", 1, 1, 2.0, ("o_totalprice",), duration_days=3),
          SpecialEvent("mid_year", 6, 15, 1.25, ("o_totalprice", "o_custkey")))


def _dow_sql(col, key):
    target = cdf_index_sql(u_sql(SEED, f"dow:{col}", key), cumulative(DOW))
    return f"({col} + to_days(CAST(((({target}) - (isodow({col}) - 1)) % 7 + 7) % 7 AS INTEGER)))"


def _hod_sql(col, key):
    hour = cdf_index_sql(u_sql(SEED, f"hod:{col}", key), cumulative(HOD))
    return (f"(date_trunc('day', {col}) + to_hours(CAST({hour} AS BIGINT)) "
            f"+ to_microseconds(CAST(microsecond({col}) % 1000000 AS BIGINT)))")


@query("dow_reweight", f"SELECT o_orderkey, {_dow_sql('o_orderdate', 'o_orderkey')} AS o_orderdate FROM orders")
def q_dow_reweight(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return TP.weekday_reweight(o, "o_orderdate", DOW, SEED, ["o_orderkey"])


@query("hod_reweight", f"SELECT event_id, {_hod_sql('ts', 'event_id')} AS ts FROM events")
def q_hod_reweight(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts")
    return TP.hour_reweight(e, "ts", HOD, SEED, ["event_id"])


def _month_sql(value, ts):
    cases = " ".join(f"WHEN {k} THEN {v}" for k, v in sorted(MONTHS.items()))
    return f"({value} * coalesce(CASE month({ts}) {cases} END, 1.0))"


@query("monthly_seasonality", f"""
SELECT o_orderkey, round({_month_sql('o_totalprice', 'o_orderdate')}, 6) AS o_totalprice FROM orders""")
def q_monthly(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    out = TP.monthly_seasonality(o, MONTHS, "o_orderdate", ["o_totalprice"])
    return out.select("o_orderkey", F.round("o_totalprice", 6).alias("o_totalprice"))


def _event_factor_sql(col, ts):
    fs = []
    for e in EVENTS:
        if col not in e.columns:
            continue
        hit = f"month({ts}) = {e.month}"
        if e.day is not None:
            hit += f" AND day({ts}) >= {e.day} AND day({ts}) < {e.day + e.duration_days}"
        fs.append(f"(CASE WHEN {hit} THEN {e.multiplier} ELSE 1.0 END)")
    return " * ".join(fs) if fs else "1.0"


@query("special_events", f"""
SELECT o_orderkey, round(o_totalprice * {_event_factor_sql('o_totalprice', 'o_orderdate')}, 6) AS o_totalprice,
       CAST(round(o_custkey * {_event_factor_sql('o_custkey', 'o_orderdate')}) AS BIGINT) AS o_custkey
FROM orders""")
def q_special_events(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice", "o_custkey")
    out = TP.special_events(o, EVENTS, "o_orderdate")
    return out.select("o_orderkey", F.round("o_totalprice", 6).alias("o_totalprice"), "o_custkey")


PATTERNS = TemporalPatterns(tuple(DOW), tuple(HOD), MONTHS,
                            (SpecialEvent("spike", 3, 10, 3.0, ("value",), duration_days=2),))


def _patterns_sql():
    ts1 = _dow_sql("ts", "event_id")
    ts2 = _hod_sql("ts1", "event_id").replace("hod:ts1", "hod:ts")
    ev = "(CASE WHEN month(ts2) = 3 AND day(ts2) >= 10 AND day(ts2) < 12 THEN 3.0 ELSE 1.0 END)"
    return f"""
WITH a AS (SELECT event_id, {ts1} AS ts1, user_id, value FROM events),
b AS (SELECT event_id, {ts2} AS ts2, user_id, value FROM a)
SELECT event_id, ts2 AS ts, CAST(round({_month_sql('user_id', 'ts2')}) AS BIGINT) AS user_id,
       round({_month_sql('value', 'ts2')} * {ev}, 6) AS value FROM b"""


@query("temporal_patterns", _patterns_sql())
def q_temporal_patterns(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts", "user_id", "value")
    out = TP.temporal_patterns(e, PATTERNS, SEED, ["event_id"])
    return out.withColumn("value", F.round("value", 6))


_H_EV = "CAST(('0x' || substr(sha256(CAST(event_id AS VARCHAR)), 1, 13)) AS BIGINT)"


def _ac_sql(c):
    score = f"0.8 * ti / CAST(n AS DOUBLE) + {math.sqrt(1 - 0.8 * 0.8)!r} * {normal_sql(SEED, f'ac:{c}', ['event_id'])}"
    return (f"SELECT a.event_id, b.{c} FROM (SELECT event_id, row_number() OVER (ORDER BY {score}, {_H_EV}, event_id) AS p FROM t) a "
            f"JOIN (SELECT {c}, row_number() OVER (ORDER BY {c}, {_H_EV}, event_id) AS p FROM events) b USING (p)")


@query("autocorrelation", f"""
WITH t AS (SELECT event_id, row_number() OVER (ORDER BY ts, {_H_EV}, event_id) - 1 AS ti, count(*) OVER () AS n FROM events),
v AS ({_ac_sql('value')}), u AS ({_ac_sql('user_id')})
SELECT e.event_id, e.ts, u.user_id, v.value FROM events e JOIN v ON v.event_id = e.event_id JOIN u ON u.event_id = e.event_id""")
def q_autocorrelation(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts", "user_id", "value")
    return TP.autocorrelation(e, 0.8, "ts", ["event_id"], SEED, columns=["value", "user_id"])


_AR = 0.7


@query("ar1_series", f"""
WITH RECURSIVE t AS (SELECT event_id, user_id, {normal_sql(SEED, 'ar1:x', ['event_id'])} AS z,
       row_number() OVER (PARTITION BY user_id ORDER BY ts, {_H_EV}, event_id) AS k FROM events WHERE ts IS NOT NULL),
r AS (SELECT event_id, user_id, k, z AS x FROM t WHERE k = 1
      UNION ALL SELECT t.event_id, t.user_id, t.k, {_AR} * r.x + {math.sqrt(1 - _AR * _AR)!r} * t.z FROM r JOIN t ON t.user_id = r.user_id AND t.k = r.k + 1)
SELECT event_id, user_id, round(x, 6) AS x FROM r""")
def q_ar1_series(spark, sf):
    """An autoregressive series over each user's events."""
    e = table(spark, sf, "events").select("event_id", "ts", "user_id")
    return SR.ar1_series(e, _AR, "ts", ["event_id"], SEED, ["user_id"]).select("event_id", "user_id", F.round("x", 6).alias("x"))


@query("autoregress", """
SELECT round(value, 6) AS value, CAST(count(*) AS BIGINT) AS n, true AS correlated FROM events GROUP BY 1""")
def q_autoregress(spark, sf):
    """Event values re-ordered along an AR(1) series: the multiset is kept, and the lag-1 rank correlation comes near rho."""
    e = table(spark, sf, "events").select("event_id", "ts", "value")
    out = cut_lineage(SR.autoregress(e, _AR, "ts", ["event_id"], SEED, ["value"]))
    place = ordinal(out, "ts", ["event_id"], "i")
    both = place.select("i", "event_id", "value").join(place.select((F.col("i") + 1).alias("i"), F.col("value").alias("before")), "i")
    rho = CR.spearman_pairs(both, [("value", "before")]).first()["rho"]
    return out.groupBy(F.round("value", 6).alias("value")).agg(F.count(F.lit(1)).alias("n")).withColumn("correlated", F.lit(bool(abs(rho - _AR) < 0.1)))


# ------------------------------------------------------------------ scenarios


def _scenario_base(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", "o_orderpriority", F.col("o_totalprice").alias("revenue"),
                    (F.col("o_totalprice") / 10).alias("consumer_spending_usd"),
                    F.col("o_custkey").alias("unemployment_rate_x100"), F.col("o_orderstatus"))


_BASE_SQL = ("SELECT o_orderkey, o_orderpriority, o_totalprice AS revenue, o_totalprice / 10 AS consumer_spending_usd, "
             "o_custkey AS unemployment_rate_x100, o_orderstatus FROM orders")


@query("scenario_apply", f"""
WITH b AS ({_BASE_SQL})
SELECT o_orderkey, round(revenue * 0.78, 6) AS revenue, round(consumer_spending_usd * 0.72, 6) AS consumer_spending_usd,
       CAST(round(unemployment_rate_x100 * 0.92 + 3.5) AS BIGINT) AS unemployment_rate_x100
FROM b""")
def q_scenario_apply(spark, sf):
    out = X.apply(_scenario_base(spark, sf), X.template("recession"))
    return out.select("o_orderkey", F.round("revenue", 6).alias("revenue"),
                      F.round("consumer_spending_usd", 6).alias("consumer_spending_usd"), "unemployment_rate_x100")


def _tpl_sql():
    parts = []
    for name, s in X.TEMPLATES.items():
        rev = "revenue"
        csp = "consumer_spending_usd"
        une = "unemployment_rate_x100"
        if "revenue" in s.multipliers:
            rev = f"revenue * {s.multipliers['revenue']}"
        if "consumer_spending" in s.multipliers:
            csp = f"consumer_spending_usd * {s.multipliers['consumer_spending']}"
        if "employment" in s.multipliers:  # 'employment' is contained in the column name too
            une = f"{une} * {s.multipliers['employment']}"
        if "unemployment_rate" in s.shifts:
            une = f"{une} + {s.shifts['unemployment_rate']}"
        une = f"round({une})"
        parts.append(f"SELECT '{name}' AS scenario, round(sum({rev}), 4) AS sum_revenue, "
                     f"round(sum({csp}), 4) AS sum_consumer_spending_usd, CAST(sum({une}) AS BIGINT) AS sum_unemployment_rate_x100 "
                     f"FROM b")
    return "WITH b AS (" + _BASE_SQL + ") " + " UNION ALL ".join(parts)


@query("scenario_templates", _tpl_sql())
def q_scenario_templates(spark, sf):
    base = _scenario_base(spark, sf)
    out = X.compare(base, [dataclasses.replace(s, name=n) for n, s in X.TEMPLATES.items()],
                    ["revenue", "consumer_spending_usd", "unemployment_rate_x100"])
    return out.where("scenario <> 'baseline'").select(
        "scenario", F.round("sum_revenue", 4).alias("sum_revenue"),
        F.round("sum_consumer_spending_usd", 4).alias("sum_consumer_spending_usd"),
        F.col("sum_unemployment_rate_x100").cast("long").alias("sum_unemployment_rate_x100"))


_KW_SQL = " ".join(f"WHEN contains(lower(trim(text)), '{k}') THEN '{v}'" for k, v in X.KEYWORDS)
_EXACT_SQL = " ".join(f"WHEN lower(trim(text)) = '{n}' THEN '{n}'" for n in X.TEMPLATES)


@query("scenario_match", f"""
SELECT conv_id, turn, coalesce(CASE {_EXACT_SQL} END, CASE {_KW_SQL} END) AS scenario FROM conversations""")
def q_scenario_match(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", X.match_scenario(F.col("text")).alias("scenario"))


@query("scenario_compare", f"""
WITH b AS ({_BASE_SQL}),
u AS (SELECT 'baseline' AS scenario, o_orderpriority, revenue, consumer_spending_usd FROM b
      UNION ALL SELECT 'recession', o_orderpriority, revenue * 0.78, consumer_spending_usd * 0.72 FROM b
      UNION ALL SELECT 'boom', o_orderpriority, revenue * 1.35, consumer_spending_usd * 1.25 FROM b
      UNION ALL SELECT 'custom', o_orderpriority, revenue * 1.1 - 100.0, consumer_spending_usd FROM b)
SELECT scenario, o_orderpriority, round(sum(revenue), 4) AS sum_revenue,
       round(sum(consumer_spending_usd), 4) AS sum_consumer_spending_usd, CAST(count(*) AS BIGINT) AS n_rows
FROM u GROUP BY ALL""")
def q_scenario_compare(spark, sf):
    base = _scenario_base(spark, sf)
    custom = Scenario("custom", {"revenue": 1.1}, {"revenue": -100.0})
    out = X.compare(base, [X.template("recession"), X.template("boom"), custom],
                    ["revenue", "consumer_spending_usd"], ["o_orderpriority"])
    return out.select("scenario", "o_orderpriority", F.round("sum_revenue", 4).alias("sum_revenue"),
                      F.round("sum_consumer_spending_usd", 4).alias("sum_consumer_spending_usd"), "n_rows")
