"""Queries for generation (S-06, G-02..G-25) with DuckDB oracles.

The row spine is the key of a given table (``orders.o_orderkey``), so the work grows with
the data.  Transcendental results are rounded to 6 decimals (4 for large magnitudes) in both
engines: the last bits of ln/exp/cos differ between the JVM and C libraries.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from weft.functions import rand as R
from weft.operators import generate as G
from weft.operators.rank import dense_index
from weft.plans.registry import query
from weft.plans.spec import ColumnSpec, DagRule, Dist, Relationship, TableSpec
from weft.plans.sqlkit import EPS_53, cdf_index_sql, cumulative, normal_sql, u_sql
from weft.session import table

SEED = 42
K = "o_orderkey"


def _spine(spark, sf):
    return table(spark, sf, "orders").select(K)


def _u(tag):
    return u_sql(SEED, tag, K)


def _n(tag, mean=0.0, std=1.0):
    return normal_sql(SEED, tag, [K], mean, std)


def _one(name, sql_expr, col_fn, digits=6, cast=None):
    sql_val = f"round({sql_expr}, {digits})" if digits is not None else sql_expr
    if cast:
        sql_val = f"CAST({sql_val} AS {cast})"
    sql = f"SELECT {K}, {sql_val} AS value FROM orders"

    def fn(spark, sf):
        x = col_fn([F.col(K)])
        x = F.round(x, digits) if digits is not None else x
        if cast:
            x = x.cast({"BIGINT": "long", "DOUBLE": "double"}[cast])
        return _spine(spark, sf).select(K, x.alias("value"))

    query(name, sql)(fn)


# ------------------------------------------------------------ samplers (SQL side)


def _horner_sql(x, coefs):
    acc = repr(coefs[0])
    for c in coefs[1:]:
        acc = f"({acc} * {x} + {c!r})"
    return acc


def _phi_inv_sql(p):
    ql = f"sqrt(-2.0 * ln({p}))"
    lo = f"({_horner_sql(ql, R._ACK_C)} / ({_horner_sql(ql, R._ACK_D)} * {ql} + 1.0))"
    q = f"({p} - 0.5)"
    r = f"({q} * {q})"
    mid = f"({_horner_sql(r, R._ACK_A)} * {q} / ({_horner_sql(r, R._ACK_B)} * {r} + 1.0))"
    qh = f"sqrt(-2.0 * ln(1.0 - {p}))"
    hi = f"(-{_horner_sql(qh, R._ACK_C)} / ({_horner_sql(qh, R._ACK_D)} * {qh} + 1.0))"
    return f"(CASE WHEN {p} < {R._ACK_LOW} THEN {lo} WHEN {p} > {1 - R._ACK_LOW!r} THEN {hi} ELSE {mid} END)"


def _truncnorm_sql(tag, mean, std, low, high):
    pa, pb = R._phi_py((low - mean) / std), R._phi_py((high - mean) / std)
    p = f"({pa!r} + ({pb!r} - {pa!r}) * ({_u(tag)} + {EPS_53}))"
    x = f"({float(mean)!r} + {float(std)!r} * {_phi_inv_sql(p)})"
    return f"least(greatest({x}, {float(low)!r}), {float(high)!r})"


def _gamma_ge1_sql(tag, shape, n=12):
    d = shape - 1.0 / 3.0
    c = 1.0 / math.sqrt(9.0 * d)
    out = repr(d)
    for i in reversed(range(n)):
        z = _n(f"{tag}#z{i}")
        u = f"({_u(f'{tag}#u{i}')} + {EPS_53})"
        v = f"pow(1.0 + {c!r} * {z}, 3.0)"
        ok = f"({v} > 0 AND ln({u}) < 0.5 * {z} * {z} + {d!r} - {d!r} * {v} + {d!r} * ln({v}))"
        out = f"(CASE WHEN {ok} THEN {d!r} * {v} ELSE {out} END)"
    return out


def _gamma_sql(tag, shape, scale):
    if shape == int(shape) and shape <= 8:
        terms = " + ".join(f"(-ln(1.0 - {_u(f'{tag}#e{i}')}))" for i in range(int(shape)))
        return f"({float(scale)!r} * ({terms}))"
    return f"({float(scale)!r} * {_gamma_ge1_sql(tag, shape)})"


def _poisson_sql(tag, mu):
    # the CDF is DuckDB's own, from lgamma
    lo, hi = max(0, int(mu - 12 * math.sqrt(mu) - 20)), int(mu + 12 * math.sqrt(mu) + 40)
    cdf = (f"(SELECT list(c ORDER BY k) FROM (SELECT k, sum(exp(k * ln({float(mu)!r}) - {float(mu)!r} - lgamma(k + 1))) "
           f"OVER (ORDER BY k) AS c FROM range({lo}, {hi}) t(k)) WHERE c < 1.0 - 1e-13)")
    return f"CAST({lo} + len(list_filter({cdf}, lambda c: c <= {_u(tag)})) AS DOUBLE)"


def _categorical_sql(tag, values, weights=None):
    weights = weights or [1.0] * len(values)
    idx = cdf_index_sql(_u(tag), cumulative(weights))
    vals = "[" + ", ".join(f"'{v}'" for v in values) + "]"
    return f"({vals})[{idx} + 1]"


# ------------------------------------------------------------------ queries


@query("gen_spine", "SELECT o_orderkey AS row_id FROM orders")
def q_gen_spine(spark, sf):
    return _spine(spark, sf).select(F.col(K).alias("row_id"))


_one("cell_uniform", _u("age"), lambda k: R.uniform01(SEED, "age", k), digits=None)
_one("gen_enum", _categorical_sql("gender", ["Male", "Female", "Other"]),
     lambda k: R.categorical(SEED, "gender", k, ["Male", "Female", "Other"]), digits=None)
_one("gen_boolean", f"({_u('flag')} < 0.5)", lambda k: R.uniform01(SEED, "flag", k) < F.lit(0.5), digits=None)
_one("dist_normal", _n("n", 50.0, 15.0), lambda k: R.normal(SEED, "n", k, 50.0, 15.0))
_one("dist_lognormal", f"exp({_n('ln', 10.5, 0.8)})", lambda k: R.lognormal(SEED, "ln", k, 10.5, 0.8), digits=4)
_one("dist_truncnorm", _truncnorm_sql("tn", 40.0, 15.0, 0.0, 120.0),
     lambda k: R.truncnorm(SEED, "tn", k, 40.0, 15.0, 0.0, 120.0))
_one("dist_uniform", f"(10.0 + 10.0 * {_u('un')})", lambda k: R.uniform(SEED, "un", k, 10.0, 20.0))
_one("dist_exponential", f"(-2.0 * ln(1.0 - {_u('ex')}))", lambda k: R.exponential(SEED, "ex", k, 2.0))
_one("dist_poisson", _poisson_sql("po", 4.5), lambda k: R.poisson(SEED, "po", k, 4.5), digits=None)
_one("dist_poisson_800", _poisson_sql("po8", 800.0), lambda k: R.poisson(SEED, "po8", k, 800.0), digits=None)
_one("dist_poisson_5000", _poisson_sql("po5", 5000.0), lambda k: R.poisson(SEED, "po5", k, 5000.0), digits=None)
_one("dist_bernoulli", f"(CASE WHEN {_u('be')} < 0.3 THEN 1.0 ELSE 0.0 END)", lambda k: R.bernoulli(SEED, "be", k, 0.3),
     digits=None)
_one("dist_gamma", _gamma_sql("ga", 2.5, 2.0), lambda k: R.gamma(SEED, "ga", k, 2.5, 2.0))
_one("dist_beta",
     f"({_gamma_sql('bt#x', 2.0, 1.0)} / ({_gamma_sql('bt#x', 2.0, 1.0)} + {_gamma_sql('bt#y', 5.0, 1.0)}))",
     lambda k: R.beta(SEED, "bt", k, 2.0, 5.0))
_one("dist_weibull", f"(2.0 * pow(-ln(1.0 - {_u('wb')}), {1.0 / 1.5!r}))", lambda k: R.weibull(SEED, "wb", k, 1.5, 2.0))
_one("dist_clip", f"least(greatest({_n('cl', 50.0, 30.0)}, 0.0), 100.0)",
     lambda k: R.clip(R.normal(SEED, "cl", k, 50.0, 30.0), 0.0, 100.0))
_one("dist_categorical", _categorical_sql("ct", ["low", "mid", "high"], [0.5, 0.3, 0.2]),
     lambda k: R.categorical(SEED, "ct", k, ["low", "mid", "high"], [0.5, 0.3, 0.2]), digits=None)

MIX = Dist("mixture", weights=(0.7, 0.3), components=(Dist("normal", {"mean": 30.0, "std": 5.0}),
                                                     Dist("normal", {"mean": 70.0, "std": 10.0})))
_one("dist_mixture",
     f"(CASE WHEN {cdf_index_sql(_u('mx#mix'), cumulative([0.7, 0.3]))} = 0 THEN {_n('mx#c0', 30.0, 5.0)} "
     f"WHEN {cdf_index_sql(_u('mx#mix'), cumulative([0.7, 0.3]))} = 1 THEN {_n('mx#c1', 70.0, 10.0)} END)",
     lambda k: G.sample(MIX, SEED, "mx", k))


@query("gen_numeric", f"""
SELECT {K}, CAST(round(least(greatest({_poisson_sql('visits', 10.0)}, 0.0), 30.0)) AS BIGINT) AS visits,
       round({_gamma_sql('score#x', 2.0, 1.0)} / ({_gamma_sql('score#x', 2.0, 1.0)} + {_gamma_sql('score#y', 5.0, 1.0)}), 6) AS score,
       round({_n('drift')}, 6) AS drift
FROM orders""")
def q_gen_numeric(spark, sf):
    spec_i = ColumnSpec("visits", "integer", min_value=0, max_value=30)
    spec_f, spec_z = ColumnSpec("score", "float"), ColumnSpec("drift", "float")  # a score is meant to be beta; nothing decides drift
    idx = F.col(K)
    return _spine(spark, sf).select(K, G.spec_column(spec_i, "t", SEED, idx, [idx]).alias("visits"),
                                    F.round(G.spec_column(spec_f, "t", SEED, idx, [idx]), 6).alias("score"),
                                    F.round(G.spec_column(spec_z, "t", SEED, idx, [idx]), 6).alias("drift"))


DEFAULT_SPEC = TableSpec("patients", (
    ColumnSpec("patient_id", "string", primary_key=True), ColumnSpec("gender", "string", enum_values=("Male", "Female", "Other")),
    ColumnSpec("age", "integer"), ColumnSpec("bill", "float"), ColumnSpec("insured", "boolean"),
    ColumnSpec("admitted", "date"), ColumnSpec("diagnosis", "string"),
))


def _uuid_sql(text):
    h = f"sha256({text})"
    return f"concat_ws('-', substr({h}, 1, 8), substr({h}, 9, 4), substr({h}, 13, 4), substr({h}, 17, 4), substr({h}, 21, 12))"


@query("gen_default_table", f"""
SELECT {_uuid_sql(f"concat_ws(':', '{SEED}', 'patients', 'patient_id', CAST({K} AS VARCHAR))")} AS patient_id,
       {_categorical_sql('gender', ['Male', 'Female', 'Other'])} AS gender,
       CAST(1 + floor({_u('age')} * 999) AS BIGINT) AS age,
       round({_n('bill', 50.0, 15.0)}, 6) AS bill,
       ({_u('insured')} < 0.5) AS insured,
       CAST(DATE '2020-01-01' + CAST({K} AS INTEGER) AS DATE) AS admitted,
       concat('diagnosis_', CAST({K} AS VARCHAR)) AS diagnosis
FROM orders""")
def q_gen_default_table(spark, sf):
    out = G.generate_table(_spine(spark, sf), K, DEFAULT_SPEC, SEED, default_only=True)
    return out.withColumn("bill", F.round("bill", 6))


TABLE_SPEC = TableSpec("patients", (
    ColumnSpec("patient_id", "string", primary_key=True),
    ColumnSpec("gender", "string", enum_values=("Male", "Female", "Other"), null_rate=0.05),
    ColumnSpec("age", "integer", min_value=0, max_value=120, semantic_type="age",
               distribution=Dist("normal", {"mean": 40.0, "std": 15.0})),
    ColumnSpec("bill_amount", "float", min_value=0.0, semantic_type="amount",
               distribution=Dist("lognormal", {"mean": 8.0, "sigma": 0.5}), null_rate=0.1),
))
TABLE_DAG = [DagRule("age", "is_senior", "age >= 60"), DagRule("age", "birth_year", "2024 - age")]


@query("gen_table", f"""
WITH b AS (SELECT {K},
  {_uuid_sql(f"concat_ws(':', '{SEED}', 'patients', 'patient_id', CAST({K} AS VARCHAR))")} AS patient_id,
  {_categorical_sql('gender', ['Male', 'Female', 'Other'])} AS gender,
  CAST(round(least(greatest({_truncnorm_sql('age', 40.0, 15.0, 0.0, 120.0)}, 0.0), 120.0)) AS BIGINT) AS age,
  greatest(exp({_n('bill_amount', 8.0, 0.5)}), 0.0) AS bill_amount
  FROM orders)
SELECT patient_id, CASE WHEN {_u('null:gender')} >= 0.05 THEN gender END AS gender, age,
       round(CASE WHEN {_u('null:bill_amount')} >= 0.1 THEN bill_amount END, 4) AS bill_amount,
       2024 - age AS birth_year, age >= 60 AS is_senior
FROM b""")
def q_gen_table(spark, sf):
    out = G.generate_table(_spine(spark, sf), K, TABLE_SPEC, SEED, dag=TABLE_DAG)
    return out.withColumn("bill_amount", F.round("bill_amount", 4))


@query("gen_fk_child", f"""
WITH p AS (SELECT c_custkey, row_number() OVER (ORDER BY CAST(('0x' || substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 13)) AS BIGINT),
                                                c_custkey) - 1 AS pidx FROM customer),
n AS (SELECT count(*) AS n FROM customer),
d AS (SELECT {K}, CAST(floor({u_sql(SEED, 'fk:buyer', K)} * n) AS BIGINT) AS pidx FROM orders, n)
SELECT d.{K}, p.c_custkey AS buyer FROM d JOIN p USING (pidx)""")
def q_gen_fk_child(spark, sf):
    cust = table(spark, sf, "customer").select("c_custkey")
    n = cust.count()
    idx = dense_index(cust, ["c_custkey"], "_idx")
    return G.fk_child(_spine(spark, sf), K, idx, "_idx", "c_custkey", n, SEED, "buyer")


_DENSE = ("row_number() OVER (ORDER BY CAST(('0x' || substr(sha256(CAST({k} AS VARCHAR)), 1, 13)) AS BIGINT), {k}) - 1")


@query("gen_one_to_one", f"""
WITH s AS (SELECT s_suppkey, {_DENSE.format(k='s_suppkey')} AS i FROM supplier),
c AS (SELECT c_custkey, {_DENSE.format(k='c_custkey')} AS i FROM customer)
SELECT s.s_suppkey, c.c_custkey AS contact FROM s LEFT JOIN c USING (i)""")
def q_gen_one_to_one(spark, sf):
    rel = Relationship("customer", "c_custkey", "supplier", "contact", "1:1")
    return G.related(table(spark, sf, "supplier").select("s_suppkey"), ["s_suppkey"], table(spark, sf, "customer"), rel, SEED)


@query("gen_many_to_many", f"""
WITH p AS (SELECT p_partkey, {_DENSE.format(k='p_partkey')} AS a FROM part), s AS (SELECT s_suppkey, {_DENSE.format(k='s_suppkey')} AS b FROM supplier),
n AS (SELECT (SELECT count(*) FROM part) AS np, (SELECT count(*) FROM supplier) AS ns),
d AS (SELECT DISTINCT CAST(floor({u_sql(SEED, 'link:part:supplier:a', 'id')} * np) AS BIGINT) AS a,
                      CAST(floor({u_sql(SEED, 'link:part:supplier:b', 'id')} * ns) AS BIGINT) AS b FROM n, range(0, (SELECT count(*) FROM part)) t(id))
SELECT p_partkey, s_suppkey FROM d JOIN p USING (a) JOIN s USING (b)""")
def q_gen_many_to_many(spark, sf):
    rel = Relationship("supplier", "s_suppkey", "part", "s_suppkey", "N:M")
    return G.related(table(spark, sf, "part").select("p_partkey"), ["p_partkey"], table(spark, sf, "supplier"), rel, SEED)


_KW_SQL = " ".join(f"WHEN starts_with(lower(name), '{k}') OR ends_with(lower(name), '{k}') THEN '{dict(G.SEMANTIC_RULES)[m]}'" for k, m in G.NAME_KEYWORDS)
_SEM_SQL = " ".join(f"WHEN lower(coalesce(semantic_type, '')) = '{k}' THEN '{d}'" for k, d in G.SEMANTIC_RULES)
_TYPE_SQL = " ".join(f"WHEN data_type = '{k}' THEN '{d}'" for k, d in G.TYPE_DISTRIBUTIONS)


@query("distribution_model", f"""
WITH c AS (SELECT p_partkey, split_part(lower(p_type), ' ', 1) || ['_age', '_rate', '_qty', '_code', ''][p_size % 5 + 1] AS name,
                  ['integer', 'float', 'string', 'date', 'boolean', 'json'][p_size % 6 + 1] AS data_type,
                  [NULL, 'Salary', 'duration', 'nothing'][p_partkey % 4 + 1] AS semantic_type, p_partkey % 11 = 0 AS has_enum FROM part)
SELECT p_partkey, name, CASE WHEN has_enum THEN 'categorical' WHEN data_type = 'boolean' THEN 'bernoulli' {_SEM_SQL} {_KW_SQL} {_TYPE_SQL} ELSE 'normal' END AS distribution
FROM c""")
def q_distribution_model(spark, sf):
    """A distribution for every column description; the descriptions are derived from the part table."""
    pick = lambda xs, i: F.get(F.array(*[F.lit(x) for x in xs]), i)
    p = table(spark, sf, "part")
    name = F.concat(F.split_part(F.lower("p_type"), F.lit(" "), F.lit(1)), pick(["_age", "_rate", "_qty", "_code", ""], F.col("p_size") % 5))
    kind = pick(["integer", "float", "string", "date", "boolean", "json"], F.col("p_size") % 6)
    sem = pick([None, "Salary", "duration", "nothing"], (F.col("p_partkey") % 4).cast("int"))
    return p.select("p_partkey", name.alias("name"), G.choose_distribution(name, kind, sem, F.col("p_partkey") % 11 == 0).alias("distribution"))


@query("schema_complete", f"""
SELECT position, column_name, CAST(n AS BIGINT) AS n_rows FROM (SELECT count(*) AS n FROM customer),
  (VALUES (1, 't_id'), (2, 'category'), (3, 'external_id'), (4, 'is_active'), (5, 'notes'), (6, 'priority'), (7, 'region'),
          (8, 'source'), (9, 'sub_category'), (10, 'updated_at'), (11, 'c_acctbal'), (12, 'c_balance_x')) v(position, column_name)""")
def q_schema_complete(spark, sf):
    """A two-column spec completed to twelve, generated over the customers; the result's columns and row count."""
    spec = G.complete_schema(TableSpec("t", (ColumnSpec("c_balance_x", "float"), ColumnSpec("c_acctbal", "float"))), [DagRule("c_acctbal", "c_balance_x", "c_acctbal * 2")])
    made = G.generate_table(table(spark, sf, "customer").select("c_custkey"), "c_custkey", spec, SEED)
    rows = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("position"), F.lit(c).alias("column_name")) for i, c in enumerate(made.columns)]))
    return made.agg(F.count(F.lit(1)).alias("n_rows")).select(rows.alias("x"), "n_rows").select("x.*", "n_rows")


CAUSAL_RULES = [DagRule("age", "is_senior", "age >= 60"), DagRule("age", "age_months", "age * 12"),
                DagRule("c_nationkey", "age", "20 + c_nationkey * 2"),
                DagRule("c_acctbal", "bal_k", "try_divide(c_acctbal, c_nationkey)"),
                DagRule("missing_col", "ghost", "missing_col + 1")]


@query("causal_derive", """
SELECT c_custkey, 20 + c_nationkey * 2 AS age, (20 + c_nationkey * 2) >= 60 AS is_senior,
       (20 + c_nationkey * 2) * 12 AS age_months,
       round(CASE WHEN c_nationkey = 0 THEN NULL ELSE c_acctbal / c_nationkey END, 6) AS bal_k
FROM customer""")
def q_causal_derive(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    out = G.causal_derive(c, CAUSAL_RULES)
    return out.select("c_custkey", "age", "is_senior", "age_months", F.round("bal_k", 6).alias("bal_k"))


@query("conditional_params", """
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debtor' WHEN c_nationkey > 20 THEN 'far'
                       WHEN c_mktsegment = 'BUILDING' THEN 'builder' ELSE 'regular' END AS tier
FROM customer""")
def q_conditional_params(spark, sf):
    c = table(spark, sf, "customer")
    tier = G.conditional([("c_nationkey > 20", "far", 2), ("c_acctbal < 0", "debtor", 3),
                          ("c_mktsegment = 'BUILDING'", "builder", 2)], "regular")
    # equal priorities keep list order: 'far' was listed before 'builder'
    return c.select("c_custkey", tier.alias("tier"))


_SEM_SQL = ("CASE event_type WHEN 'click' THEN 'salary' WHEN 'view' THEN 'Age' WHEN 'error' THEN 'count' "
            "WHEN 'purchase' THEN 'rate' ELSE event_type END")
_RULES_SQL = " ".join(f"WHEN lower(semantic_type) = '{s}' THEN '{d}'" for s, d in G.SEMANTIC_RULES)


@query("distribution_override", f"""
WITH s AS (SELECT event_id, {_SEM_SQL} AS semantic_type, CASE WHEN value > 50 THEN 'normal' ELSE 'uniform' END AS proposed
           FROM events)
SELECT event_id, semantic_type, proposed, coalesce(CASE {_RULES_SQL} END, proposed) AS distribution FROM s""")
def q_distribution_override(spark, sf):
    e = table(spark, sf, "events")
    sem = (F.when(F.col("event_type") == "click", "salary").when(F.col("event_type") == "view", "Age")
           .when(F.col("event_type") == "error", "count").when(F.col("event_type") == "purchase", "rate")
           .otherwise(F.col("event_type")))
    s = e.select("event_id", sem.alias("semantic_type"),
                 F.when(F.col("value") > 50, "normal").otherwise("uniform").alias("proposed"))
    return G.distribution_override(s, "semantic_type", "proposed", G.override_frame(spark))
