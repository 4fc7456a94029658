"""Queries for keyed tables with history and the similarity store (K-01..K-05, K-07)."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import constraints as C
from weft.operators import store as ST
from weft.operators import vector_index as VI
from weft.plans.registry import ORACLES, query
from weft.plans.spec import Rule
from weft.session import table
from weft.sources import files as FS

EV = ["event_id", "ts", "user_id", "event_type", "value", "props"]
EV_SQL = ", ".join(EV)


@query("upsert_latest", """
SELECT user_id, ts, event_id, event_type, value, props FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
WHERE rn = 1""")
def q_upsert_latest(spark, sf):
    """events as an upsert log keyed by user_id: the newest row per user wins."""
    return ST.latest_by_key(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"])


@query("ttl_lookup", """
SELECT user_id, ts, event_id, event_type, value, props FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events
  WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY)
WHERE rn = 1""")
def q_ttl_lookup(spark, sf):
    """Newest row per user among rows younger than 7 days before the newest event."""
    ev = ST.within_ttl(table(spark, sf, "events"), "ts", 7)
    return ST.latest_by_key(ev, ["user_id"], ["ts", "event_id"])


@query("insert_if_absent", f"""
SELECT {EV_SQL} FROM events WHERE ts < TIMESTAMP '2024-01-20 00:00:00'
UNION ALL
SELECT n.event_id, n.ts, n.user_id, n.event_type, n.value + 1000.0 AS value, n.props
FROM events n WHERE n.ts >= TIMESTAMP '2024-01-10 00:00:00'
  AND NOT EXISTS (SELECT 1 FROM events o WHERE o.ts < TIMESTAMP '2024-01-20 00:00:00' AND o.event_id = n.event_id)""")
def q_insert_if_absent(spark, sf):
    """Events up to Jan 20 exist; a re-sent batch from Jan 10 with new values only adds unseen keys."""
    ev = table(spark, sf, "events")
    existing = ev.where(F.col("ts") < F.lit("2024-01-20 00:00:00").cast("timestamp"))
    incoming = ev.where(F.col("ts") >= F.lit("2024-01-10 00:00:00").cast("timestamp")) \
        .withColumn("value", F.col("value") + F.lit(1000.0))
    return ST.insert_if_absent(existing, incoming, ["event_id"], ["ts"])


@query("latest_n", f"""
SELECT {EV_SQL} FROM events ORDER BY ts DESC, event_id DESC LIMIT 50""")
def q_latest_n(spark, sf):
    return ST.latest_n(table(spark, sf, "events"), [F.col("ts").desc(), F.col("event_id").desc()], 50)


@query("point_lookup", f"SELECT {EV_SQL} FROM events WHERE event_id = 4242")
def q_point_lookup(spark, sf):
    return table(spark, sf, "events").where(F.col("event_id") == 4242)


@query("delete_by_key", f"""
SELECT {EV_SQL} FROM events WHERE user_id NOT IN (SELECT DISTINCT user_id FROM events WHERE event_type = 'error'
                                                  AND value > 200)""")
def q_delete_by_key(spark, sf):
    """Delete every event of the users named by a key table (users with a costly error)."""
    ev = table(spark, sf, "events")
    gone = ev.where((F.col("event_type") == "error") & (F.col("value") > 200)).select("user_id")
    return ST.delete_by_key(ev, "user_id", gone)


def _nearest_sql(t):
    return f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
p AS (SELECT a.vec_id, b.vec_id AS match_id,
             list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) AS s
      FROM v a JOIN v b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, match_id) AS rn FROM p WHERE s > {t})
SELECT vec_id, match_id, round(s, 6) AS similarity FROM r WHERE rn = 1"""


def _nearest(spark, sf, t):
    e = table(spark, sf, "embeddings")
    out = ST.nearest_vector(e, e, "vec_id", "vec_id", "embedding", threshold=t, exclude_self=True)
    return out.select("vec_id", "match_id", F.round("similarity", 6).alias("similarity"))


@query("nearest_vector", _nearest_sql(0.92))
def q_nearest_vector(spark, sf):
    """Semantic cache hit: nearest other vector with cosine above 0.92 (none in this data)."""
    return _nearest(spark, sf, 0.92)


@query("nearest_vector_t30", _nearest_sql(0.3))
def q_nearest_vector_t30(spark, sf):
    """Same lookup at threshold 0.3, where the random vectors do have neighbours."""
    return _nearest(spark, sf, 0.3)


@query("nearest_vector_planted", """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
q AS (SELECT vec_id + 1000000 AS id, list_transform(e, lambda x, i: x + 0.02 * ((i - 1) % 3)) AS e FROM v),
p AS (SELECT a.id, b.vec_id AS match_id, list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) AS s
      FROM q a, v b),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, match_id) AS rn FROM p WHERE s > 0.92)
SELECT id, match_id, round(s, 6) AS similarity FROM r WHERE rn = 1""")
def q_nearest_vector_planted(spark, sf):
    """Queries that are shifted copies of the stored vectors: threshold 0.92 finds their originals."""
    e = table(spark, sf, "embeddings")
    q = e.select((F.col("vec_id") + 1000000).alias("id"), F.transform("embedding", lambda x, i: x.cast("double") + 0.02 * (i % 3)).alias("embedding"))
    out = ST.nearest_vector(q, e, "id", "vec_id", "embedding", threshold=0.92)
    return out.select("id", "match_id", F.round("similarity", 6).alias("similarity"))


@query("event_log", """
SELECT 's1' AS session_id, 'violation' AS kind, 'price' AS rule, CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_totalprice > 50000 HAVING count(*) > 0
UNION ALL SELECT 's1', 'violation', 'status', count(*) FROM orders WHERE o_orderstatus IS NULL OR o_orderstatus NOT IN ('O', 'F') HAVING count(*) > 0
UNION ALL SELECT 's2', 'heal', o_orderstatus, count(*) FROM orders GROUP BY o_orderstatus""")
def q_event_log(spark, sf):
    """Two reports appended to one event log and read back."""
    o = table(spark, sf, "orders")
    path = FS.scratch_path(spark, "event-log")
    rules = [Rule("price", "range", ("o_totalprice",), "flag", max_value=50000.0), Rule("status", "enum", ("o_orderstatus",), "flag", values=("O", "F"))]
    ST.append_log(path, C.violation_log(o, rules), "s1", "violation")
    ST.append_log(path, o.groupBy(F.col("o_orderstatus").alias("rule")).count(), "s2", "heal")
    log = spark.read.parquet(path)
    return log.select("session_id", "kind", F.get_json_object("payload", "$.rule").alias("rule"), F.get_json_object("payload", "$.count").cast("long").alias("n"))


@query("vector_store_add", "SELECT vec_id, label, CAST(len(embedding) AS INTEGER) AS dim FROM embeddings")
def q_vector_store_add(spark, sf):
    """Vectors added to the store in two appends."""
    v = table(spark, sf, "embeddings")
    path = FS.scratch_path(spark, "vectors")
    ST.add_vectors(path, v.where("vec_id % 2 = 0"))
    ST.add_vectors(path, v.where("vec_id % 2 <> 0"))
    return spark.read.parquet(path).select("vec_id", "label", F.size("embedding").alias("dim"))


def _indexed(spark, sf):
    """An index over a part of the vectors, grown by two appends."""
    v = table(spark, sf, "embeddings")
    path = FS.scratch_path(spark, "vector-index")
    VI.build(v.where("vec_id % 3 = 0"), path, "vec_id", "embedding")
    VI.add(v.where("vec_id % 3 = 1"), path, "vec_id", "embedding")
    VI.add(v.where("vec_id % 3 = 2"), path, "vec_id", "embedding")
    return v, path


@query("vector_index_lookup", _nearest_sql(0.3))
def q_vector_index_lookup(spark, sf):
    """The nearest other vector over cosine 0.3 from a stored index that was built, then appended to twice."""
    v, path = _indexed(spark, sf)
    return VI.lookup(v, path, "vec_id", "embedding", 0.3, exclude_self=True).select("vec_id", "match_id", F.round("similarity", 6).alias("similarity"))


@query("vector_index_planted", ORACLES["nearest_vector_planted"])
def q_vector_index_planted(spark, sf):
    """Shifted copies of the stored vectors find their originals in the index at cosine 0.92."""
    v, path = _indexed(spark, sf)
    q = v.select((F.col("vec_id") + 1000000).alias("id"), F.transform("embedding", lambda x, i: x.cast("double") + 0.02 * (i % 3)).alias("embedding"))
    return VI.lookup(q, path, "id", "embedding", 0.92).select("id", "match_id", F.round("similarity", 6).alias("similarity"))
