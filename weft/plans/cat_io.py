"""Queries for file sources and sinks (S-03, S-05)."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.plans.registry import query
from weft.session import table
from weft.sources import files as FS


@query("parquet_roundtrip", "SELECT * FROM orders")
def q_parquet_roundtrip(spark, sf):
    return FS.parquet_roundtrip(table(spark, sf, "orders"))


@query("schema_detect", """
SELECT * FROM (VALUES (1, 'o_orderkey', 'int'), (2, 'o_custkey', 'int'), (3, 'o_orderstatus', 'string'),
                      (4, 'o_totalprice', 'double'), (5, 'o_orderdate', 'timestamp'), (6, 'o_orderpriority', 'string'))
         t(position, column_name, data_type)
JOIN (SELECT 'o_orderkey' AS column_name, CAST(count(*) - count(o_orderkey) AS BIGINT) AS n_null,
             CAST(count(DISTINCT o_orderkey) AS BIGINT) AS n_distinct FROM orders
      UNION ALL SELECT 'o_custkey', count(*) - count(o_custkey), count(DISTINCT o_custkey) FROM orders
      UNION ALL SELECT 'o_orderstatus', count(*) - count(o_orderstatus), count(DISTINCT o_orderstatus) FROM orders
      UNION ALL SELECT 'o_totalprice', count(*) - count(o_totalprice), count(DISTINCT o_totalprice) FROM orders
      UNION ALL SELECT 'o_orderdate', count(*) - count(o_orderdate), count(DISTINCT o_orderdate) FROM orders
      UNION ALL SELECT 'o_orderpriority', count(*) - count(o_orderpriority), count(DISTINCT o_orderpriority) FROM orders)
USING (column_name)""")
def q_schema_detect(spark, sf):
    """An uploaded CSV (orders written with a header) read back with type inference and profiled."""
    path = FS.scratch_path(spark, "upload")
    FS.write(table(spark, sf, "orders"), path, "csv")
    return FS.detect_schema(FS.read(spark, path, "csv"))


_ORDERS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


@query("schema_samples", "\nUNION ALL\n".join(f"""
SELECT {i + 1} AS position, '{c}' AS column_name, (SELECT CAST(count(*) - count({c}) AS BIGINT) FROM orders) AS n_null,
       (SELECT CAST(count(DISTINCT {c}) AS BIGINT) FROM orders) AS n_distinct, list(CAST(v AS VARCHAR) ORDER BY v) AS samples
FROM (SELECT DISTINCT {c} AS v FROM orders WHERE {c} IS NOT NULL ORDER BY 1 LIMIT 3)""" for i, c in enumerate(_ORDERS)))
def q_schema_samples(spark, sf):
    """An uploaded CSV with its detected columns and three sample values of each: the number is the feature."""
    path = FS.scratch_path(spark, "upload")
    FS.write(table(spark, sf, "orders"), path, "csv")
    return FS.detect_schema(FS.read(spark, path, "csv"), 3).drop("data_type")


@query("json_table", "SELECT n_nationkey, n_name, n_regionkey, r_name FROM nation JOIN region ON r_regionkey = n_regionkey")
def q_json_table(spark, sf):
    """The nations as one JSON document under a root key, read back as a typed table (25 rows, nested region as JSON)."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    rows = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "n_regionkey", F.struct("r_name").alias("region"))
    doc = rows.agg(F.to_json(F.struct(F.collect_list(F.struct("*")).alias("nations"))).alias("value"))
    path = FS.scratch_path(spark, "nations")
    doc.write.text(path)
    got = FS.load_json_table(spark, path, "nations", "n_nationkey int, n_name string, n_regionkey int, region string")
    return got.select("n_nationkey", "n_name", "n_regionkey", F.get_json_object("region", "$.r_name").alias("r_name"))


@query("output_formats", """
SELECT f.fmt, CAST(count(*) AS BIGINT) AS n_rows, CAST(sum(o_orderkey) AS BIGINT) AS keys, round(sum(o_totalprice), 4) AS total
FROM orders, (VALUES ('csv'), ('json'), ('parquet')) f(fmt) GROUP BY f.fmt""")
def q_output_formats(spark, sf):
    """Orders written in every output format and read back."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    parts = []
    for fmt in FS.FORMATS:
        path = FS.scratch_path(spark, fmt)
        FS.write(orders, path, fmt)
        back = FS.read(spark, path, fmt, orders.schema)
        parts.append(back.agg(F.lit(fmt).alias("fmt"), F.count(F.lit(1)).alias("n_rows"), F.sum("o_orderkey").alias("keys"), F.round(F.sum("o_totalprice"), 4).alias("total")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
