"""Queries for personal-data detection, masking, k-anonymity, l-diversity and score (P-01..P-16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import pii as P
from weft.operators import generalise as G
from weft.operators import privacy as PV
from weft.plans.registry import query
from weft.session import table

SEED = 7


# ------------------------------------------------------------------ corpus


def _profile_spark(c):
    k = F.col("c_custkey")

    def lp(x, n):
        return F.lpad(x.cast("string"), n, "0")

    return F.concat_ws(
        " ",
        F.lit("pan"), F.concat(F.lit("ABCDE"), lp(k % 10000, 4), F.lit("F")),
        F.lit("aadhaar"), F.concat((F.lit(2) + k % 8).cast("string"), lp(k % 1000, 3), F.lit(" "), lp(k % 10000, 4),
                                   F.lit(" 5678")),
        F.lit("gst"), F.concat(F.lit("27ABCDE"), lp(k % 10000, 4), F.lit("F1Z5")),
        F.lit("ssn"), F.concat(lp(k % 1000, 3), F.lit("-"), lp(k % 100, 2), F.lit("-"), lp(k % 10000, 4)),
        F.lit("nhs"), F.concat(lp(k % 1000, 3), F.lit(" 123 "), lp(k % 10000, 4)),
        F.lit("iban"), F.concat(F.lit("GB"), lp(k % 100, 2), F.lit("WEST"), lp(k, 8)),
        F.lit("cpf"), F.concat(lp(k % 1000, 3), F.lit(".456.789-"), lp(k % 100, 2)),
        F.lit("mail"), F.concat(F.lower(F.regexp_replace(F.col("c_name"), "#", ".")), F.lit("@example.com")),
        F.lit("phone"), F.concat(F.lit("+91 9"), lp(k, 9)),
        F.lit("card"), F.lit("4111111111111111"),
    )


def _profile_sql():
    def lp(x, n):
        return f"lpad(CAST({x} AS VARCHAR), {n}, '0')"

    k = "c_custkey"
    return ("concat_ws(' ', 'pan', concat('ABCDE', " + lp(f"{k} % 10000", 4) + ", 'F'), "
            "'aadhaar', concat(CAST(2 + " + k + " % 8 AS VARCHAR), " + lp(f"{k} % 1000", 3) + ", ' ', "
            + lp(f"{k} % 10000", 4) + ", ' 5678'), "
            "'gst', concat('27ABCDE', " + lp(f"{k} % 10000", 4) + ", 'F1Z5'), "
            "'ssn', concat(" + lp(f"{k} % 1000", 3) + ", '-', " + lp(f"{k} % 100", 2) + ", '-', " + lp(f"{k} % 10000", 4) + "), "
            "'nhs', concat(" + lp(f"{k} % 1000", 3) + ", ' 123 ', " + lp(f"{k} % 10000", 4) + "), "
            "'iban', concat('GB', " + lp(f"{k} % 100", 2) + ", 'WEST', " + lp(k, 8) + "), "
            "'cpf', concat(" + lp(f"{k} % 1000", 3) + ", '.456.789-', " + lp(f"{k} % 100", 2) + "), "
            "'mail', concat(lower(replace(c_name, '#', '.')), '@example.com'), "
            "'phone', concat('+91 9', " + lp(k, 9) + "), "
            "'card', '4111111111111111')")


def corpus(spark, sf):
    """Texts to scan: documents, conversation turns, and one profile text per customer."""
    d = table(spark, sf, "documents").select(F.lit("doc").alias("src"), F.col("doc_id").alias("id"), "text")
    c = table(spark, sf, "conversations").select(F.lit("conv").alias("src"),
                                                  (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    p = table(spark, sf, "customer").select(F.lit("cust").alias("src"), F.col("c_custkey").alias("id"),
                                            _profile_spark(None).alias("text"))
    return d.unionByName(c).unionByName(p)


CORPUS_SQL = ("SELECT 'doc' AS src, doc_id AS id, text FROM documents UNION ALL "
              "SELECT 'conv', conv_id * 1000 + turn, text FROM conversations UNION ALL "
              f"SELECT 'cust', c_custkey, {_profile_sql()} FROM customer")


def _sqlstr(s):
    return "'" + s.replace("'", "''") + "'"


def _count_query(entity):
    sql = (f"WITH c AS ({CORPUS_SQL}) SELECT src, id, CAST(len(regexp_extract_all(text, {_sqlstr(P.PATTERN[entity])})) "
           f"AS BIGINT) AS n FROM c WHERE len(regexp_extract_all(text, {_sqlstr(P.PATTERN[entity])})) > 0")

    def fn(spark, sf):
        c = corpus(spark, sf)
        return c.select("src", "id", P.count(F.col("text"), entity).cast("long").alias("n")).where(F.col("n") > 0)

    return sql, fn


for _key, _entity in [("pii_pan", "IN_PAN"), ("pii_aadhaar", "IN_AADHAR"), ("pii_gst", "IN_GST"),
                      ("pii_ssn", "US_SSN"), ("pii_nhs", "UK_NHS"), ("pii_iban", "IBAN"),
                      ("pii_card", "CREDIT_CARD"), ("pii_phone", "IN_PHONE"), ("pii_cpf", "BR_CPF"),
                      ("pii_email", "EMAIL")]:
    _sql, _fn = _count_query(_entity)
    query(_key, _sql)(_fn)


# ------------------------------------------------------------- SQL masks


def _h(entity, m):
    return f"sha256(concat_ws(':', '{SEED}', '{entity}', {m}))"


def _byte_sql(h, i):
    return f"CAST(('0x' || substr({h}, {2 * i + 1}, 2)) AS INTEGER)"


def _digit_sql(h, i, lo=0, span=10):
    return f"CAST({lo} + {_byte_sql(h, i)} % {span} AS VARCHAR)"


def _digits_sql(h, start, n):
    return "concat(" + ", ".join(_digit_sql(h, start + k) for k in range(n)) + ")"


def _letter_sql(h, i):
    return f"substr('{P.LETTERS}', {_byte_sql(h, i)} % 26 + 1, 1)"


def _luhn_digit_sql(body):
    ds = f"list_transform(string_split(reverse({body}), ''), lambda d: CAST(d AS INTEGER))"
    doubled = (f"list_transform({ds}, lambda d, i: CASE WHEN (i - 1) % 2 = 0 THEN "
               f"(CASE WHEN d * 2 > 9 THEN d * 2 - 9 ELSE d * 2 END) ELSE d END)")
    return f"CAST((10 - list_sum({doubled}) % 10) % 10 AS VARCHAR)"


def mask_sql(m, entity):
    h = _h(entity, m)
    if entity == "EMAIL":
        return (f"concat('user', CAST(CAST(('0x' || substr({h}, 1, 13)) AS BIGINT) % 10000 AS VARCHAR), '@', "
                f"split_part({m}, '@', -1))")
    if entity == "IN_PAN":
        return "concat(" + ", ".join([_letter_sql(h, i) for i in range(5)] + [_digits_sql(h, 5, 4), _letter_sql(h, 9)]) + ")"
    if entity == "IN_AADHAR":
        return (f"concat({_digit_sql(h, 0, 2, 8)}, {_digits_sql(h, 1, 3)}, ' ', {_digits_sql(h, 4, 4)}, ' ', "
                f"{_digits_sql(h, 8, 4)})")
    if entity == "CREDIT_CARD":
        body = f"concat('4', {_digits_sql(h, 0, 14)})"
        return f"concat({body}, {_luhn_digit_sql(body)})"
    if entity == "IN_PHONE":
        return f"concat('+91-', {_digit_sql(h, 0, 6, 4)}, {_digits_sql(h, 1, 9)})"
    if entity == "US_SSN":
        area = f"(100 + CAST(('0x' || substr({h}, 1, 4)) AS INTEGER) % 566)"
        group = f"(10 + {_byte_sql(h, 2)} % 90)"
        serial = f"(1000 + CAST(('0x' || substr({h}, 7, 4)) AS INTEGER) % 9000)"
        return f"concat_ws('-', CAST({area} AS VARCHAR), CAST({group} AS VARCHAR), CAST({serial} AS VARCHAR))"
    if entity == "UK_NHS":
        return f"concat({_digits_sql(h, 0, 3)}, ' ', {_digits_sql(h, 3, 3)}, ' ', {_digits_sql(h, 6, 4)})"
    return f"concat('[{entity}:', substr(sha256({m}), 1, 8), ']')"


def _classify_sql(s):
    return "CASE " + " ".join(f"WHEN regexp_full_match({s}, {_sqlstr(p)}) THEN '{t}'" for t, p in P.RECOGNISERS) + " END"


def _mask_any_sql(s):
    t = _classify_sql(s)
    return "CASE " + " ".join(f"WHEN ({t}) = '{e}' THEN {mask_sql(s, e)}" for e in P.TYPES) + f" ELSE {s} END"


def _segments_sql(text):
    clean = f"regexp_replace({text}, '[{P.OPEN}{P.CLOSE}]', '', 'g')"
    tagged = f"regexp_replace({clean}, {_sqlstr(P.COMBINED)}, '{P.OPEN}\\0{P.CLOSE}', 'g')"
    return f"string_split_regex({tagged}, '[{P.OPEN}{P.CLOSE}]')"


def _mask_text_sql(text):
    parts = _segments_sql(text)
    return (f"array_to_string(list_transform({parts}, lambda s, i: CASE WHEN i % 2 = 0 THEN {_mask_any_sql('s')} "
            f"ELSE s END), '')")


def _types_sql(text):
    parts = _segments_sql(text)
    return (f"list_filter(list_transform({parts}, lambda s, i: CASE WHEN i % 2 = 0 THEN {_classify_sql('s')} END), "
            f"lambda x: x IS NOT NULL)")


# ------------------------------------------------------------- mask queries


def _mask_query(entity, key):
    pat = P.PATTERN[entity]
    sql = (f"WITH c AS ({CORPUS_SQL}), m AS (SELECT src, id, unnest(regexp_extract_all(text, {_sqlstr(pat)})) AS original "
           f"FROM c) SELECT src, id, original, {mask_sql('original', entity)} AS masked FROM m")

    def fn(spark, sf):
        c = corpus(spark, sf)
        m = c.select("src", "id", F.explode(F.regexp_extract_all("text", F.lit(pat), 0)).alias("original"))
        return m.select("src", "id", "original", P.mask_value(F.col("original"), entity, SEED).alias("masked"))

    query(key, sql)(fn)


for _entity, _key in [("EMAIL", "mask_email"), ("IN_PAN", "mask_pan"), ("IN_AADHAR", "mask_aadhaar"),
                      ("IN_PHONE", "mask_phone"), ("US_SSN", "mask_ssn"), ("UK_NHS", "mask_nhs")]:
    _mask_query(_entity, _key)


def _luhn_ok_sql(x):
    ds = f"list_transform(string_split(reverse({x}), ''), lambda d: CAST(d AS INTEGER))"
    s = (f"list_sum(list_transform({ds}, lambda d, i: CASE WHEN (i - 1) % 2 = 1 THEN "
         f"(CASE WHEN d * 2 > 9 THEN d * 2 - 9 ELSE d * 2 END) ELSE d END))")
    return f"({s} % 10 = 0)"


@query("mask_card", f"""
WITH c AS ({CORPUS_SQL}),
m AS (SELECT src, id, unnest(regexp_extract_all(text, {_sqlstr(P.PATTERN['CREDIT_CARD'])})) AS original FROM c),
k AS (SELECT src, id, original, {mask_sql('original', 'CREDIT_CARD')} AS masked FROM m)
SELECT src, id, original, masked, {_luhn_ok_sql('masked')} AS masked_luhn_ok FROM k""")
def q_mask_card(spark, sf):
    c = corpus(spark, sf)
    m = c.select("src", "id", F.explode(F.regexp_extract_all("text", F.lit(P.PATTERN["CREDIT_CARD"]), 0))
                 .alias("original"))
    k = m.select("src", "id", "original", P.mask_value(F.col("original"), "CREDIT_CARD", SEED).alias("masked"))
    return k.withColumn("masked_luhn_ok", F.call_function("luhn_check", F.col("masked")))


@query("mask_generic", f"""
WITH c AS ({CORPUS_SQL}),
m AS (SELECT src, id, 'IN_GST' AS entity, unnest(regexp_extract_all(text, {_sqlstr(P.PATTERN['IN_GST'])})) AS original FROM c
      UNION ALL SELECT src, id, 'IBAN', unnest(regexp_extract_all(text, {_sqlstr(P.PATTERN['IBAN'])})) FROM c
      UNION ALL SELECT src, id, 'BR_CPF', unnest(regexp_extract_all(text, {_sqlstr(P.PATTERN['BR_CPF'])})) FROM c)
SELECT src, id, entity, original, concat('[', entity, ':', substr(sha256(original), 1, 8), ']') AS masked FROM m""")
def q_mask_generic(spark, sf):
    c = corpus(spark, sf)
    out = None
    for e in ("IN_GST", "IBAN", "BR_CPF"):
        m = c.select("src", "id", F.lit(e).alias("entity"),
                     F.explode(F.regexp_extract_all("text", F.lit(P.PATTERN[e]), 0)).alias("original"))
        m = m.withColumn("masked", P.mask_value(F.col("original"), e, SEED))
        out = m if out is None else out.unionByName(m)
    return out


@query("luhn_valid", f"""
WITH c AS ({CORPUS_SQL}),
m AS (SELECT src, id, unnest(regexp_extract_all(text, '[0-9]{{13,19}}')) AS digits FROM c)
SELECT src, id, digits, {_luhn_ok_sql('digits')} AS luhn_ok FROM m""")
def q_luhn_valid(spark, sf):
    c = corpus(spark, sf)
    m = c.select("src", "id", F.explode(F.regexp_extract_all("text", F.lit("[0-9]{13,19}"), 0)).alias("digits"))
    return m.withColumn("luhn_ok", F.call_function("luhn_check", F.col("digits")))


@query("pii_counts", f"""
WITH c AS ({CORPUS_SQL}), t AS (SELECT {_types_sql('text')} AS types FROM c),
e AS (SELECT unnest([{", ".join(f"'{x}'" for x in P.TYPES)}]) AS entity)
SELECT entity, CAST((SELECT count(*) FROM t WHERE list_contains(types, entity)) AS BIGINT) AS cells FROM e""")
def q_pii_counts(spark, sf):
    return PV.entity_counts(corpus(spark, sf), ["text"])


@query("scan_and_mask", f"WITH c AS ({CORPUS_SQL}) SELECT src, id, {_mask_text_sql('text')} AS text FROM c")
def q_scan_and_mask(spark, sf):
    return PV.scan_and_mask(corpus(spark, sf), ["text"], SEED)


# ------------------------------------------------------- k / l / score


@query("k_anonymity", """
SELECT CAST(min(n) AS BIGINT) AS k FROM (SELECT count(*) n FROM customer GROUP BY c_nationkey, c_mktsegment)""")
def q_k_anonymity(spark, sf):
    return PV.k_anonymity(table(spark, sf, "customer"), ["c_nationkey", "c_mktsegment"])


_CUST_RISK = ("SELECT *, CASE WHEN c_acctbal < 0 THEN 'negative' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END "
              "AS balance_band FROM customer")


def _cust_risk(spark, sf):
    c = table(spark, sf, "customer")
    return c.withColumn("balance_band", F.when(F.col("c_acctbal") < 0, "negative")
                        .when(F.col("c_acctbal") < 5000, "low").otherwise("high"))


@query("l_diversity", f"""
WITH c AS ({_CUST_RISK})
SELECT CAST(min(d) AS DOUBLE) AS l FROM (SELECT count(DISTINCT balance_band) d FROM c GROUP BY c_nationkey, c_mktsegment)""")
def q_l_diversity(spark, sf):
    return PV.l_diversity(_cust_risk(spark, sf), ["c_nationkey", "c_mktsegment", "balance_band"], "balance_band")


@query("privacy_score", f"""
WITH c AS ({_CUST_RISK}),
k AS (SELECT min(n) k FROM (SELECT count(*) n FROM c GROUP BY c_mktsegment, balance_band)),
l AS (SELECT CAST(min(d) AS DOUBLE) l FROM (SELECT count(DISTINCT c_nationkey) d FROM c GROUP BY c_mktsegment, balance_band)),
p AS (SELECT count(*) FILTER (WHERE len({_types_sql('c_name')}) > 0)
             + count(*) FILTER (WHERE len({_types_sql('c_mktsegment')}) > 0)
             + count(*) FILTER (WHERE len({_types_sql('balance_band')}) > 0) AS pii, count(*) * 6 AS cells FROM c)
SELECT CAST(k AS BIGINT) AS k, l, CAST(pii AS BIGINT) AS pii_cells, CAST(cells AS BIGINT) AS total_cells,
       round(least(100.0, (CASE WHEN k = 1 THEN 40.0 ELSE least(40.0, 40.0 / greatest(k, 1)) END)
             + (CASE WHEN l < 2.0 THEN least(20.0, 20.0 * l / 2.0) ELSE 20.0 END)
             + 40.0 * greatest(0.0, 1.0 - pii / greatest(cells, 1) * 10.0)), 6) AS privacy_score
FROM k, l, p""")
def q_privacy_score(spark, sf):
    c = _cust_risk(spark, sf)
    rep = PV.privacy_report(c, ["c_mktsegment", "balance_band"], "c_nationkey", ["c_name", "c_mktsegment", "balance_band"])
    return rep.withColumn("privacy_score", F.round("privacy_score", 6))


@query("pii_report", f"""
WITH c AS ({CORPUS_SQL}), t AS (SELECT src, {_types_sql('text')} AS types FROM c)
SELECT src, CAST(count(*) AS BIGINT) AS n_texts, CAST(count(*) FILTER (WHERE len(types) > 0) AS BIGINT) AS texts_with_pii,
       CAST(sum(len(types)) AS BIGINT) AS spans FROM t GROUP BY src""")
def q_pii_report(spark, sf):
    t = corpus(spark, sf).select("src", P.span_types(F.col("text")).alias("types"))
    return t.groupBy("src").agg(F.count(F.lit(1)).alias("n_texts"),
                                F.count_if(F.size("types") > 0).alias("texts_with_pii"),
                                F.sum(F.size("types")).cast("long").alias("spans"))


@query("k_violators", """
WITH g AS (SELECT c_nationkey, c_mktsegment, count(*) AS group_size FROM customer GROUP BY ALL)
SELECT c.c_custkey, c.c_nationkey, c.c_mktsegment, g.group_size FROM customer c
JOIN g ON c.c_nationkey IS NOT DISTINCT FROM g.c_nationkey AND c.c_mktsegment IS NOT DISTINCT FROM g.c_mktsegment
WHERE g.group_size < 10""")
def q_k_violators(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return PV.k_violators(c, ["c_nationkey", "c_mktsegment"], 10)


@query("k_suppress", """
WITH g AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL)
SELECT c.c_custkey, CASE WHEN g.n < 10 THEN NULL ELSE c.c_nationkey END AS c_nationkey,
       CASE WHEN g.n < 10 THEN NULL ELSE c.c_mktsegment END AS c_mktsegment, c.c_acctbal
FROM customer c JOIN g ON c.c_nationkey IS NOT DISTINCT FROM g.c_nationkey
                      AND c.c_mktsegment IS NOT DISTINCT FROM g.c_mktsegment""")
def q_k_suppress(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    return PV.k_suppress(c, ["c_nationkey", "c_mktsegment"], 10)


# ------------------------------------------------------------------ P-16 generalisation

_MONDRIAN = """
WITH RECURSIVE c AS (SELECT c_custkey, c_mktsegment, c_nationkey, c_acctbal, count(*) OVER (PARTITION BY c_mktsegment) AS seg_n FROM customer),
base AS (SELECT c_custkey, CASE WHEN seg_n >= 25 THEN c_mktsegment END AS seg, CAST(c_nationkey AS DOUBLE) AS a, c_acctbal AS b FROM c),
g AS (SELECT max(a) - min(a) AS ga, max(b) - min(b) AS gb FROM base),
r AS (
  SELECT c_custkey, seg, a, b, coalesce('v' || seg, '*') || '/' AS pid, false AS done FROM base
  UNION ALL
  SELECT c_custkey, seg, a, b, CASE pick WHEN 1 THEN pid || (CASE WHEN a <= ma THEN '0' ELSE '1' END) WHEN 2 THEN pid || (CASE WHEN b <= mb THEN '0' ELSE '1' END) ELSE pid END,
         pick = 0
  FROM (SELECT *, CASE WHEN oka AND (NOT okb OR wa / ga >= wb / gb) THEN 1 WHEN okb THEN 2 ELSE 0 END AS pick
        FROM (SELECT *, la >= 25 AND n - la >= 25 AS oka, lb >= 25 AND n - lb >= 25 AS okb
              FROM (SELECT *, count(*) FILTER (WHERE a <= ma) OVER (PARTITION BY pid) AS la, count(*) FILTER (WHERE b <= mb) OVER (PARTITION BY pid) AS lb
                    FROM (SELECT *, count(*) OVER (PARTITION BY pid) AS n, quantile_disc(a, 0.5) OVER (PARTITION BY pid) AS ma, quantile_disc(b, 0.5) OVER (PARTITION BY pid) AS mb,
                                 max(a) OVER (PARTITION BY pid) - min(a) OVER (PARTITION BY pid) AS wa, max(b) OVER (PARTITION BY pid) - min(b) OVER (PARTITION BY pid) AS wb
                          FROM r WHERE NOT done))) , g))
SELECT c_custkey, seg AS c_mktsegment, CAST(min(a) OVER (PARTITION BY pid) AS INTEGER) AS c_nationkey_low, CAST(max(a) OVER (PARTITION BY pid) AS INTEGER) AS c_nationkey_high,
       min(b) OVER (PARTITION BY pid) AS c_acctbal_low, max(b) OVER (PARTITION BY pid) AS c_acctbal_high, CAST(count(*) OVER (PARTITION BY pid) AS BIGINT) AS group_size
FROM r WHERE done"""


@query("k_generalise", _MONDRIAN)
def q_k_generalise(spark, sf):
    """Nation and balance of customers as ranges, by segment, so that every group has 25 rows or more."""
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal")
    return G.generalise(c, ["c_mktsegment", "c_nationkey", "c_acctbal"], 25).drop("group_id", "n_suppressed")
