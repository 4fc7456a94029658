"""Queries of fitted distributions (Q-05, G-27) and near duplicates by tolerance (Q-06)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from weft.operators import fitting as FT
from weft.operators import tolerance as TL
from weft.plans.registry import query
from weft.plans.sqlkit import u_sql
from weft.session import table

SEED = 42
FITTED = [("events", "value"), ("customer", "c_acctbal"), ("orders", "o_totalprice"), ("part", "p_size"), ("lineitem", "l_extendedprice")]
CLOSED = ("poisson", "exponential", "uniform", "normal", "lognormal")  # families whose likelihood SQL can state


def _score_sql(t: str, c: str) -> str:
    n, pi2 = "n", repr(math.log(2 * math.pi))
    logs = f"""
      ('uniform', 2, -{n} * ln(hi - lo + whole), true), ('normal', 2, -{n} / 2 * ({pi2} + ln(v) + 1), true), ('exponential', 1, -{n} * (ln(m) + 1), lo >= 0),
      ('lognormal', 2, -{n} / 2 * ({pi2} + ln(lv) + 1) - {n} * lm, lo > 0), ('poisson', 1, {n} * (m * ln(m) - m - lf), lo >= 0 AND whole = 1)"""
    return f"""SELECT '{t}' AS table_name, '{c}' AS column_name, family, n_rows, round((k * ln({n}) - 2 * ll) / {n}, 6) AS bic_per_row
FROM (SELECT CAST(count(x) AS BIGINT) AS n_rows, CAST(count(x) AS DOUBLE) AS n, min(x) AS lo, max(x) AS hi, avg(x) AS m, var_pop(x) AS v, CASE WHEN bool_and(x = floor(x)) THEN 1 ELSE 0 END AS whole,
       avg(CASE WHEN x > 0 THEN ln(x) END) AS lm, var_pop(CASE WHEN x > 0 THEN ln(x) END) AS lv, avg(CASE WHEN x >= 0 THEN lgamma(x + 1) END) AS lf
FROM (SELECT CAST({c} AS DOUBLE) AS x FROM {t})), LATERAL (SELECT * FROM (VALUES {logs}) f(family, k, ll, fits)) WHERE fits"""


def _scores_oracle() -> str:
    # CASE guards: a family that does not apply must not evaluate the logarithm of a negative number
    return "\nUNION ALL\n".join(_score_sql(t, c).replace("ln(m)", "ln(CASE WHEN m > 0 THEN m END)") for t, c in FITTED)


@query("family_scores", _scores_oracle())
def q_family_scores(spark, sf):
    """BIC a row of every closed-form family for five columns, each from one aggregate of its whole table."""
    rows = []
    for t, c in FITTED:
        _, s = FT.summaries(table(spark, sf, t), [c])
        n = s[c]["n"]
        rows += [(t, c, f, n, round((len(p) * math.log(n) - 2 * ll) / n, 6)) for f, (p, ll) in FT.likelihoods(s[c]).items() if f in CLOSED]
    return spark.createDataFrame(rows, "table_name string, column_name string, family string, n_rows long, bic_per_row double")


@query("fitted_twin", f"""
WITH m AS (SELECT count(*) AS n, avg(value) AS scale, min(value) AS vlo, max(value) AS vhi, min(user_id) AS ulo, max(user_id) AS uhi FROM events),
s AS (SELECT CAST(unnest(range(2 * (SELECT n FROM m))) AS BIGINT) AS r)
SELECT r + 1 AS event_id, least(greatest(-scale * ln(1.0 - {u_sql(SEED, 'fit:value', 'r')}), vlo), vhi) AS value,
       CAST(least(greatest(round(ulo - 0.5 + (uhi - ulo + 1) * {u_sql(SEED, 'fit:user_id', 'r')}), ulo), uhi) AS BIGINT) AS user_id
FROM s, m""")
def q_fitted_twin(spark, sf):
    """A twin of the events' numbers at twice their rows: values are found exponential, users uniform whole numbers."""
    ev = table(spark, sf, "events").select("event_id", "value", "user_id")
    return FT.fitted_twin(ev, 2 * ev.count(), SEED, ["event_id"])


# ------------------------------------------------------------------ Q-06 near duplicates by tolerance


def _islands(cols: str, t: str, block: str, x: str, tol: float) -> str:
    return f"""WITH g AS (SELECT *, CASE WHEN {x} - lag({x}) OVER w > {tol} THEN 1 ELSE 0 END AS jump FROM {t} WINDOW w AS (PARTITION BY {block} ORDER BY {x})),
i AS (SELECT *, sum(jump) OVER (PARTITION BY {block} ORDER BY {x} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM g)
{cols}"""


@query("dedupe_tolerance", _islands("""
SELECT event_id, ts, user_id, event_type, value, props, n_rows FROM (
  SELECT *, CAST(count(*) OVER (PARTITION BY user_id, event_type, island) AS BIGINT) AS n_rows,
         row_number() OVER (PARTITION BY user_id, event_type, island ORDER BY event_id) AS nth FROM i) WHERE nth = 1""",
    "events", "user_id, event_type", "value", 0.3))
def q_dedupe_tolerance(spark, sf):
    """Events of a user and type whose values lie within steps of 0.3: the first event of each group stays."""
    return TL.dedupe_tolerance(table(spark, sf, "events"), "value", 0.3, ["user_id", "event_type"], ["event_id"], "n_rows")


@query("tolerance_groups", _islands("""
SELECT min(l_extendedprice) AS low, max(l_extendedprice) AS high, CAST(count(*) AS BIGINT) AS n_rows FROM i GROUP BY island""",
    "lineitem", "1", "l_extendedprice", 0.51))
def q_tolerance_groups(spark, sf):
    """All line items in one block: groups of prices joined by steps of at most 0.51 (no single-task order)."""
    return TL.tolerance_groups(table(spark, sf, "lineitem"), "l_extendedprice", 0.51)
