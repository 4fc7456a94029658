"""Queries for text operators and lookups (G-01, L-01, L-04..L-13) with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import rand as R
from weft.functions import text as TX
from weft.operators import lookup as LK
from weft.plans.registry import query
from weft.session import spread, table


def _sqlstr(s):
    return "'" + s.replace("'", "''") + "'"


def prompts(spark, sf):
    """Texts to parse: documents, conversation turns and one request sentence per part."""
    d = table(spark, sf, "documents").select(F.lit("doc").alias("src"), F.col("doc_id").alias("id"), "text")
    c = table(spark, sf, "conversations").select(F.lit("conv").alias("src"),
                                                  (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    p = table(spark, sf, "part")
    n = table(spark, sf, "nation")  # 25 rows at every scale factor: safe to broadcast
    req = p.join(F.broadcast(n), F.pmod(p.p_partkey, F.lit(25)) == n.n_nationkey).select(
        F.lit("req").alias("src"), F.col("p_partkey").alias("id"),
        F.concat(F.lit("Generate "), F.format_number(F.col("p_size") * 1000, 0), F.lit(" rows of "), F.col("p_type"),
                 F.lit(" "), F.col("p_name"), F.lit(" sales data for a store in "), F.initcap("n_name")).alias("text"))
    return spread(d.unionByName(c).unionByName(req))


PROMPTS_SQL = ("SELECT 'doc' AS src, doc_id AS id, text FROM documents UNION ALL "
               "SELECT 'conv', conv_id * 1000 + turn, text FROM conversations UNION ALL "
               "SELECT 'req', p_partkey, concat('Generate ', format('{:,d}', p_size * 1000), ' rows of ', p_type, ' ', "
               "p_name, ' sales data for a store in ', upper(left(n_name, 1)) || lower(substr(n_name, 2))) "
               "FROM part JOIN nation ON p_partkey % 25 = n_nationkey")


def _domain_sql(t):
    low = f"lower({t})"
    hits = {d: " + ".join(f"(CASE WHEN contains({low}, {_sqlstr(k)}) THEN 1 ELSE 0 END)" for k in kws)
            for d, kws in TX.DOMAIN_KEYWORDS.items()}
    best = "greatest(" + ", ".join(f"({h})" for h in hits.values()) + ")"
    cases = " ".join(f"WHEN ({h}) = {best} AND {best} > 0 THEN '{d}'" for d, h in hits.items())
    return f"(CASE {cases} ELSE 'general' END)"


def _rowcount_sql(t):
    out = str(TX.ROW_COUNT_DEFAULT)
    for pat in reversed(TX.ROW_COUNT_PATTERNS):
        raw = f"regexp_extract({t}, {_sqlstr('(?i)' + pat)}, 1)"
        val = f"try_cast(replace({raw}, ',', '') AS BIGINT)"
        out = f"(CASE WHEN {val} IS NOT NULL AND {val} >= 1 THEN {val} ELSE {out} END)"
    return out


def _region_sql(t):
    low = f"lower({t})"
    country = "NULL"
    for kw, c in reversed(TX.COUNTRY_KEYWORDS):
        country = (f"(CASE WHEN regexp_matches({low}, {_sqlstr(TX.WORD_EDGE_L + kw + TX.WORD_EDGE_R)}) "
                   f"THEN '{c}' ELSE {country} END)")
    st = " ".join(f"WHEN contains({low}, '{kw}') THEN '{s}'" for kw, s, _ in TX.STATE_KEYWORDS)
    sc = " ".join(f"WHEN contains({low}, '{kw}') THEN '{c}'" for kw, _, c in TX.STATE_KEYWORDS)
    return f"(CASE {st} END)", f"coalesce(CASE {sc} END, {country})"


def _seed_sql(t):
    return f"(CAST(('0x' || right(sha256({t}), 8)) AS BIGINT) % 2147483648)"


@query("seed_of_text", f"SELECT src, id, {_seed_sql('text')} AS seed FROM ({PROMPTS_SQL})")
def q_seed_of_text(spark, sf):
    return prompts(spark, sf).select("src", "id", R.seed_of_text(F.col("text")).alias("seed"))


@query("classify_domain", f"SELECT src, id, {_domain_sql('text')} AS domain FROM ({PROMPTS_SQL})")
def q_classify_domain(spark, sf):
    return TX.with_domain(prompts(spark, sf), "text").select("src", "id", "domain")


@query("extract_row_count", f"SELECT src, id, {_rowcount_sql('text')} AS row_count FROM ({PROMPTS_SQL})")
def q_extract_row_count(spark, sf):
    return TX.with_row_count(prompts(spark, sf), "text").select("src", "id", "row_count")


_ST, _CO = _region_sql("text")


@query("extract_region", f"SELECT src, id, {_CO} AS country, {_ST} AS state FROM ({PROMPTS_SQL})")
def q_extract_region(spark, sf):
    r = TX.extract_region(F.col("text"))
    return prompts(spark, sf).select("src", "id", r["country"].alias("country"), r["state"].alias("state"))


@query("parse_requests", f"""
SELECT src, id, {_domain_sql('text')} AS domain, {_CO} AS country, {_ST} AS state,
       {_rowcount_sql('text')} AS row_count, {_seed_sql('text')} AS seed
FROM ({PROMPTS_SQL})""")
def q_parse_requests(spark, sf):
    return LK.parse_requests(prompts(spark, sf), "text").drop("text")


@query("text_md5", "SELECT doc_id, md5(text) AS text_md5 FROM documents")
def q_text_md5(spark, sf):
    return table(spark, sf, "documents").select("doc_id", TX.text_md5(F.col("text")).alias("text_md5"))


# ------------------------------------------------------------------- JSON


def _wrapped(spark, sf):
    e = table(spark, sf, "events").select("event_id", "props")
    k = F.pmod(F.col("event_id"), F.lit(6))
    p = F.col("props")
    txt = (F.when(k == 0, p)
           .when(k == 1, F.concat(F.lit("```json\n"), p, F.lit("\n```")))
           .when(k == 2, F.concat(F.lit("Here you go: ```"), p, F.lit("``` done")))
           .when(k == 3, F.concat(F.lit("The answer is "), p, F.lit(" as requested.")))
           .when(k == 4, F.concat(F.lit("list: ["), p, F.lit("] end")))
           .otherwise(F.concat(F.lit("no json here "), F.col("event_id").cast("string"))))
    return e.select("event_id", txt.alias("raw"))


_WRAPPED_SQL = """SELECT event_id, CASE event_id % 6
  WHEN 0 THEN props WHEN 1 THEN concat('```json' || chr(10), props, chr(10) || '```')
  WHEN 2 THEN concat('Here you go: ```', props, '``` done') WHEN 3 THEN concat('The answer is ', props, ' as requested.')
  WHEN 4 THEN concat('list: [', props, '] end') ELSE concat('no json here ', CAST(event_id AS VARCHAR)) END AS raw
FROM events"""


def _salvage_sql(x):
    s = f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    cands = [s,
             f"regexp_extract({s}, '```json\\s*([\\s\\S]*?)\\s*```', 1)",
             f"regexp_extract({s}, '```\\s*([\\s\\S]*?)\\s*```', 1)",
             f"regexp_extract({s}, '\\{{[\\s\\S]*\\}}', 0)",
             f"regexp_extract({s}, '\\[[\\s\\S]*\\]', 0)"]
    strat = " ".join(f"WHEN {c} <> '' AND json_valid({c}) THEN {i + 1}" for i, c in enumerate(cands))
    text = " ".join(f"WHEN {c} <> '' AND json_valid({c}) THEN {c}" for c in cands)
    return f"(CASE {strat} END)", f"(CASE {text} END)"


_S, _T = _salvage_sql("raw")


@query("json_salvage", f"""
SELECT event_id, {_S} AS strategy, {_T} AS json_text,
       CAST(json_extract({_T}, '$.k') AS BIGINT) AS k_value
FROM ({_WRAPPED_SQL})""")
def q_json_salvage(spark, sf):
    w = _wrapped(spark, sf).select("event_id", TX.json_salvage(F.col("raw")).alias("j"))
    return w.select("event_id", "j.strategy", "j.json_text",
                    F.try_variant_get("j.value", "$.k", "bigint").alias("k_value"))


# ------------------------------------------------------------------ numbers


def _indian_sql(x):
    s = f"format('{{:.2f}}', abs({x}))"
    ip = f"split_part({s}, '.', 1)"
    dp = f"split_part({s}, '.', 2)"
    head = f"left({ip}, length({ip}) - 3)"
    grouped = f"ltrim(reverse(regexp_replace(reverse({head}), '(\\d\\d)', '\\1,', 'g')), ',')"
    body = f"(CASE WHEN length({ip}) <= 3 THEN {ip} ELSE concat({grouped}, ',', right({ip}, 3)) END)"
    return f"(CASE WHEN {x} IS NULL THEN NULL ELSE concat(CASE WHEN {x} < 0 THEN '-' ELSE '' END, {body}, '.', {dp}) END)"


@query("format_indian", f"SELECT o_orderkey, {_indian_sql('o_totalprice * 37.5')} AS amount FROM orders")
def q_format_indian(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", TX.format_indian(F.col("o_totalprice") * 37.5).alias("amount"))


@query("format_western", "SELECT c_custkey, format('{:,.2f}', c_acctbal * 1000) AS amount FROM customer")
def q_format_western(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", TX.format_western(F.col("c_acctbal") * 1000).alias("amount"))


@query("format_money", f"""
SELECT c_custkey, CASE WHEN n_name = 'INDIA' THEN {_indian_sql('c_acctbal * 100')}
                       ELSE format('{{:,.2f}}', c_acctbal * 100) END AS amount
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def q_format_money(spark, sf):
    c = table(spark, sf, "customer")
    n = table(spark, sf, "nation")  # 25 rows at every scale factor: safe to broadcast
    j = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
    style = F.when(F.col("n_name") == "INDIA", F.lit("indian")).otherwise(F.lit("western"))
    return j.select("c_custkey", TX.format_money(F.col("c_acctbal") * 100, style).alias("amount"))


# ------------------------------------------------------------------ lookups


@query("ground_region", """
SELECT r_name, n_name, c_custkey, c_acctbal, CAST(rk AS INTEGER) AS rank FROM (
  SELECT r_name, n_name, c_custkey, c_acctbal,
         row_number() OVER (PARTITION BY n_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rk
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
WHERE rk <= 10""")
def q_ground_region(spark, sf):
    c = table(spark, sf, "customer")
    n = table(spark, sf, "nation")
    r = table(spark, sf, "region")
    geo = F.broadcast(n.join(r, n.n_regionkey == r.r_regionkey))  # 25 x 5 rows: fixed small dimension
    j = c.join(geo, c.c_nationkey == geo.n_nationkey).select("n_nationkey", "r_name", "n_name", "c_custkey", "c_acctbal")
    top = LK.top_k_per_group(j, ["n_nationkey"], [F.desc("c_acctbal"), F.asc("c_custkey")], 10, ["c_custkey"])
    return top.select("r_name", "n_name", "c_custkey", "c_acctbal", "rank")


@query("code_guard", """
WITH t AS (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 7 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS seg
           FROM customer),
v AS (SELECT DISTINCT c_mktsegment AS code FROM customer WHERE c_mktsegment <> 'FURNITURE')
SELECT c_custkey, CASE WHEN seg IN (SELECT code FROM v) THEN seg
                       WHEN c_nationkey = 8 THEN 'HOUSEHOLD' ELSE 'BUILDING' END AS seg FROM t""")
def q_code_guard(spark, sf):
    c = table(spark, sf, "customer")
    t = c.select("c_custkey", "c_nationkey",
                 F.when(F.col("c_custkey") % 7 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")).alias("seg"))
    valid = c.where(F.col("c_mktsegment") != "FURNITURE")
    fallback = F.when(F.col("c_nationkey") == 8, F.lit("HOUSEHOLD")).otherwise(F.lit("BUILDING"))
    return LK.code_guard(t, "seg", valid, "c_mktsegment", fallback).select("c_custkey", "seg")


@query("distribution_priors", """
WITH p AS (SELECT c_mktsegment AS sem, round(avg(c_acctbal), 4) AS mean, round(stddev_samp(c_acctbal), 4) AS sd, min(c_acctbal) AS lo FROM customer
           WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') GROUP BY 1)
SELECT c_custkey, p.sem IS NOT NULL AS known, mean, sd, lo AS clip_min FROM customer LEFT JOIN p ON p.sem = c_mktsegment""")
def q_distribution_priors(spark, sf):
    """Priors fitted per market segment, attached to every customer by its segment; params travel as JSON text."""
    c = table(spark, sf, "customer")
    fit = c.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "HOUSEHOLD")).groupBy("c_mktsegment").agg(
        F.round(F.avg("c_acctbal"), 4).alias("mean"), F.round(F.stddev_samp("c_acctbal"), 4).alias("sd"), F.min("c_acctbal").alias("clip_min"))
    priors = fit.select(F.lower("c_mktsegment").alias("semantic_type"), F.lit("normal").alias("distribution_type"),
                        F.to_json(F.struct("mean", "sd")).alias("params"), "clip_min")
    got = LK.distribution_priors(c.select("c_custkey", "c_mktsegment"), "c_mktsegment", priors)
    return got.select("c_custkey", F.col("distribution_type").isNotNull().alias("known"), F.col("params")["mean"].alias("mean"), F.col("params")["sd"].alias("sd"), "clip_min")


@query("cities_of_country", """
SELECT country, city, population FROM (
  SELECT n_name AS country, c_name AS city, CAST(floor(c_acctbal) AS BIGINT) AS population,
         row_number() OVER (PARTITION BY n_name ORDER BY floor(c_acctbal) DESC, c_name) AS nth
  FROM customer JOIN nation ON c_nationkey = n_nationkey) WHERE nth <= 20""")
def q_cities_of_country(spark, sf):
    """The twenty largest "cities" (customers by balance) of every country: the limit is the feature."""
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    cities = c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("n_name").alias("country"), F.col("c_name").alias("city"), F.floor("c_acctbal").alias("population"))
    return LK.cities_of(cities, None, 20).select("country", "city", "population")
