"""Queries for dirty-data injection (A-01..A-15) with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import text as TX
from weft.operators import dirty as D
from weft.plans.registry import query
from weft.plans.spec import DirtyProfile
from weft.plans.sqlkit import u_sql
from weft.session import table

SEED = 42


def _u(tag, *keys):
    return u_sql(SEED, tag, *keys)


@query("null_mcar", f"""
SELECT c_custkey, c_name,
  CASE WHEN {_u('null:c_acctbal', 'c_custkey')} >= 0.1 THEN c_acctbal END AS c_acctbal,
  CASE WHEN {_u('null:c_mktsegment', 'c_custkey')} >= 0.05 THEN c_mktsegment END AS c_mktsegment
FROM customer""")
def q_null_mcar(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    return D.null_mcar(c, {"c_acctbal": 0.1, "c_mktsegment": 0.05, "no_such_column": 0.5}, SEED, ["c_custkey"])


@query("null_mar", f"""
SELECT c_custkey, c_mktsegment,
  CASE WHEN c_mktsegment = 'BUILDING' AND {_u('null:c_acctbal', 'c_custkey')} < 0.2 THEN NULL
       ELSE c_acctbal END AS c_acctbal
FROM customer""")
def q_null_mar(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return D.null_mar(c, "c_acctbal", 0.1, "c_mktsegment", "BUILDING", SEED, ["c_custkey"])


@query("null_mnar", f"""
WITH r AS (SELECT c_custkey, c_acctbal, rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2.0 AS rk,
                  count(c_acctbal) OVER () AS n FROM customer WHERE c_acctbal IS NOT NULL)
SELECT c_custkey, CASE WHEN {_u('mnar:c_acctbal', 'c_custkey')} < least(1.0, 0.2 * (rk / CAST(n AS DOUBLE))) THEN NULL
       ELSE c_acctbal END AS c_acctbal FROM r
UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal IS NULL""")
def q_null_mnar(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return D.null_mnar(c, "c_acctbal", 0.1, SEED, ["c_custkey"])


_ALT_SQL = ["%d/%m/%Y", "%m-%d-%Y", "%d-%b-%Y", "%B %d, %Y"]


def _date_mix_sql(col, key, rate):
    which = f"floor({_u('fmt:' + col, key)} * 4)"
    alts = " ".join(f"WHEN {which} = {i} THEN strftime({col}, '{f}')" for i, f in enumerate(_ALT_SQL))
    return (f"coalesce(CASE WHEN {_u('alt:' + col, key)} < {rate} THEN (CASE {alts} END) "
            f"ELSE strftime({col}, '%Y-%m-%d') END, '')")


@query("date_format_mix", f"""
SELECT o_orderkey, {_date_mix_sql('o_orderdate', 'o_orderkey', 0.12)} AS o_orderdate
FROM orders""")
def q_date_format_mix(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return D.date_format_mix(o, ["o_orderdate"], 0.12, SEED, ["o_orderkey"])


@query("outliers", f"""
WITH m AS (SELECT avg(c_acctbal) mu, coalesce(nullif(stddev_samp(c_acctbal), 0), 1.0) sd FROM customer)
SELECT c_custkey, round(CASE WHEN {_u('out:c_acctbal', 'c_custkey')} < 0.05
   THEN mu + (CASE WHEN {_u('dir:c_acctbal', 'c_custkey')} < 0.5 THEN -1.0 ELSE 1.0 END)
             * (5.0 + 5.0 * {_u('mult:c_acctbal', 'c_custkey')}) * sd
   ELSE c_acctbal END, 4) AS c_acctbal
FROM customer, m""")
def q_outliers(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    out = D.outliers(c, ["c_acctbal", "c_custkey_missing"], 0.05, SEED, ["c_custkey"])
    return out.select("c_custkey", F.round("c_acctbal", 4).alias("c_acctbal"))


# ------------------------------------------------------------------ typos


def _nb_map_sql():
    nb = TX.keyboard_neighbours()
    return "MAP {" + ", ".join(f"'{k}': [" + ", ".join(f"'{v}'" for v in nb[k]) + "]" for k in sorted(nb)) + "}"


def _adjacent_sql(x, up, ua):
    cand = (f"list_filter(range(1, greatest(length({x}), 1) + 1), "
            f"lambda i: regexp_matches(lower(substr({x}, i, 1)), '^[a-z]$'))")
    idx = f"({cand})[CAST(floor({up} * len({cand})) AS BIGINT) + 1]"
    ch = f"substr({x}, {idx}, 1)"
    nbs = f"({_nb_map_sql()})[lower({ch})]"
    rep = f"({nbs})[CAST(floor({ua} * len({nbs})) AS BIGINT) + 1]"
    rep = f"(CASE WHEN {ch} <> lower({ch}) THEN upper({rep}) ELSE {rep} END)"
    return (f"(CASE WHEN len({cand}) = 0 THEN {x} ELSE "
            f"concat(substr({x}, 1, {idx} - 1), {rep}, substr({x}, {idx} + 1)) END)")


def _transpose_sql(x, u):
    i = f"CAST(floor({u} * (length({x}) - 1)) AS BIGINT)"
    return (f"(CASE WHEN length({x}) < 2 THEN {x} ELSE concat(substr({x}, 1, {i}), substr({x}, {i} + 2, 1), "
            f"substr({x}, {i} + 1, 1), substr({x}, {i} + 3)) END)")


def _repeat_sql(x, u):
    i = f"CAST(floor({u} * length({x})) AS BIGINT)"
    return (f"(CASE WHEN length({x}) < 1 THEN {x} ELSE concat(substr({x}, 1, {i} + 1), substr({x}, {i} + 1, 1), "
            f"substr({x}, {i} + 2)) END)")


def _delete_sql(x, u):
    i = f"CAST(floor({u} * length({x})) AS BIGINT)"
    return f"(CASE WHEN length({x}) <= 1 THEN {x} ELSE concat(substr({x}, 1, {i}), substr({x}, {i} + 2)) END)"


def _typo_query(kind):
    def fn(spark, sf):
        p = table(spark, sf, "part").select("p_partkey", "p_name")
        from weft.functions.rand import uniform01

        up = uniform01(SEED, "pos:p_name", ["p_partkey"])
        ua = uniform01(SEED, "adj:p_name", ["p_partkey"])
        x = F.col("p_name")
        expr = {"adjacent": TX.typo_adjacent(x, up, ua), "transpose": TX.typo_transpose(x, up),
                "repeat": TX.typo_repeat(x, up), "delete": TX.typo_delete(x, up), "case": TX.typo_case(x)}[kind]
        return p.select("p_partkey", expr.alias("p_name"))

    return fn


_UP = _u("pos:p_name", "p_partkey")
_UA = _u("adj:p_name", "p_partkey")
query("typo_adjacent", f"SELECT p_partkey, {_adjacent_sql('p_name', _UP, _UA)} AS p_name FROM part")(_typo_query("adjacent"))
query("typo_transpose", f"SELECT p_partkey, {_transpose_sql('p_name', _UP)} AS p_name FROM part")(_typo_query("transpose"))
query("typo_repeat", f"SELECT p_partkey, {_repeat_sql('p_name', _UP)} AS p_name FROM part")(_typo_query("repeat"))
query("typo_delete", f"SELECT p_partkey, {_delete_sql('p_name', _UP)} AS p_name FROM part")(_typo_query("delete"))
query("typo_case", "SELECT p_partkey, lower(p_name) AS p_name FROM part")(_typo_query("case"))


def _typos_sql(col, key, rate):
    up, ua = _u(f"pos:{col}", key), _u(f"adj:{col}", key)
    kind = f"floor({_u('kind:' + col, key)} * 5)"
    mut = (f"(CASE WHEN {kind} = 0 THEN {_adjacent_sql(col, up, ua)} WHEN {kind} = 1 THEN {_transpose_sql(col, up)} "
           f"WHEN {kind} = 2 THEN {_repeat_sql(col, up)} WHEN {kind} = 3 THEN {_delete_sql(col, up)} "
           f"ELSE lower({col}) END)")
    return (f"(CASE WHEN {col} IS NOT NULL AND length({col}) > 1 AND {_u('typo:' + col, key)} < {rate} "
            f"THEN {mut} ELSE {col} END)")


@query("typos", f"""
SELECT p_partkey, {_typos_sql('p_name', 'p_partkey', 0.3)} AS p_name, {_typos_sql('p_type', 'p_partkey', 0.3)} AS p_type
FROM part""")
def q_typos(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_type")
    return D.typos(p, ["p_name", "p_type"], 0.3, SEED, ["p_partkey"])


# ------------------------------------------------------------- duplicates


def _dense_sql(tbl, key):
    h = f"CAST(('0x' || substr(sha256(CAST({key} AS VARCHAR)), 1, 13)) AS BIGINT)"
    return f"SELECT *, row_number() OVER (ORDER BY {h}, {key}) - 1 AS _idx FROM {tbl}"


def _draws_sql(tbl, tag, rate):
    return (f"SELECT range AS _draw, CAST(floor({u_sql(SEED, tag, 'range')} * (SELECT count(*) FROM {tbl})) AS BIGINT) AS _idx "
            f"FROM range(CAST(floor((SELECT count(*) FROM {tbl}) * {rate}) AS BIGINT))")


@query("dup_exact", f"""
WITH ix AS ({_dense_sql('customer', 'c_custkey')}),
d AS ({_draws_sql('customer', 'dup', 0.05)})
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer
UNION ALL
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM ix JOIN d USING (_idx)""")
def q_dup_exact(spark, sf):
    c = table(spark, sf, "customer")
    return D.dup_exact(c, 0.05, SEED, ["c_custkey"])


@query("dup_near", f"""
WITH ix AS ({_dense_sql('customer', 'c_custkey')}),
d AS ({_draws_sql('customer', 'near', 0.05)})
SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 4) AS c_acctbal, c_mktsegment FROM customer
UNION ALL
SELECT c_custkey, c_name, c_nationkey, round(c_acctbal * (0.95 + 0.1 * {u_sql(SEED, 'nearmult', '_draw')}), 4) AS c_acctbal,
       c_mktsegment FROM ix JOIN d USING (_idx)""")
def q_dup_near(spark, sf):
    c = table(spark, sf, "customer")
    out = D.dup_near(c, 0.05, SEED, ["c_custkey"], column="c_acctbal")
    return out.withColumn("c_acctbal", F.round("c_acctbal", 4))


@query("shuffle_rows")
def q_shuffle_rows(spark, sf):
    c = table(spark, sf, "customer")
    return D.shuffle_rows(D.dup_exact(c, 0.05, SEED, ["c_custkey"]), SEED)


_SHUFFLE_KEY = f"""concat_ws(':', '{SEED}', 'shuffle', '{{"c_custkey":' || c_custkey || '}}', copy)"""


@query("shuffle_positions", f"""
WITH ix AS ({_dense_sql('customer', 'c_custkey')}),
d AS ({_draws_sql('customer', 'dup', 0.05)}),
u AS (SELECT * FROM customer UNION ALL SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM ix JOIN d USING (_idx)),
n AS (SELECT *, row_number() OVER (PARTITION BY c_custkey) AS copy FROM u)
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment,
       row_number() OVER (ORDER BY substr(sha256({_SHUFFLE_KEY}), 1, 13)) - 1 AS position FROM n""")
def q_shuffle_positions(spark, sf):
    """Every row's place in the shuffled order, copies placed apart."""
    c = table(spark, sf, "customer")
    return D.shuffle_rows(D.dup_exact(c, 0.05, SEED, ["c_custkey"]), SEED, cols=["c_custkey"], position="position")


_PROFILE = DirtyProfile(null_rate=0.05, typo_rate=0.1, outlier_rate=0.02, date_format_mix_rate=0.12,
                        duplicate_rate=0.02, near_duplicate_rate=0.0)


def dirty_orders_ctes(src="orders"):
    """CTEs s1 to s4 and u: the dirty profile over a table with the columns of orders."""
    key = "o_orderkey"
    nul = lambda c: f"(CASE WHEN {_u('null:' + c, key)} >= 0.05 THEN {c} END)"
    step1 = (f"SELECT o_orderkey, {nul('o_custkey')} AS o_custkey, {nul('o_orderstatus')} AS o_orderstatus, "
             f"{nul('o_totalprice')} AS o_totalprice, {nul('o_orderdate')} AS o_orderdate, "
             f"{nul('o_orderpriority')} AS o_orderpriority FROM {src}")
    step2 = f"SELECT * REPLACE ({_date_mix_sql('o_orderdate', key, 0.12)} AS o_orderdate) FROM s1"

    def outl(c, cast):
        return (f"CAST(CASE WHEN {_u('out:' + c, key)} < 0.02 THEN m_{c} + (CASE WHEN {_u('dir:' + c, key)} < 0.5 "
                f"THEN -1.0 ELSE 1.0 END) * (5.0 + 5.0 * {_u('mult:' + c, key)}) * s_{c} ELSE {c} END AS {cast})")
    mom = ("SELECT avg(o_custkey) m_o_custkey, coalesce(nullif(stddev_samp(o_custkey), 0), 1.0) s_o_custkey, "
           "avg(o_totalprice) m_o_totalprice, coalesce(nullif(stddev_samp(o_totalprice), 0), 1.0) s_o_totalprice FROM s2")
    step3 = (f"SELECT o_orderkey, {outl('o_custkey', 'BIGINT')} AS o_custkey, o_orderstatus, "
             f"{outl('o_totalprice', 'DOUBLE')} AS o_totalprice, o_orderdate, o_orderpriority FROM s2, mom")
    step4 = (f"SELECT o_orderkey, o_custkey, {_typos_sql('o_orderstatus', key, 0.1)} AS o_orderstatus, o_totalprice, "
             f"o_orderdate, {_typos_sql('o_orderpriority', key, 0.1)} AS o_orderpriority FROM s3")
    return f"""s1 AS ({step1}), s2 AS ({step2}), mom AS ({mom}), s3 AS ({step3}), s4 AS ({step4}),
ix AS ({_dense_sql('s4', key)}), d AS ({_draws_sql('s4', 'dup', 0.02)}),
u AS (SELECT * FROM s4 UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
      FROM ix JOIN d USING (_idx))"""


def _dirty_sql():
    return f"""
WITH {dirty_orders_ctes()}
SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 4) AS o_totalprice, o_orderdate, o_orderpriority FROM u"""


@query("dirty_profile", _dirty_sql())
def q_dirty_profile(spark, sf):
    o = table(spark, sf, "orders")
    out = D.dirty_profile(o, _PROFILE, SEED, ["o_orderkey"])
    return out.withColumn("o_totalprice", F.round("o_totalprice", 4))
