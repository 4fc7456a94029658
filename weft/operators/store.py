"""Keyed tables with history: newest row per key, time-to-live reads, insert-if-absent,
newest n, delete by key, appends to event logs, and nearest-vector lookups.

Every read here is an aggregate or a join that Spark plans itself.  The newest row per key
is ``max(struct(order..., payload...))`` rather than a ranking window: the aggregate combines
map-side, so a key holding a third of the table costs one partial row per task, not one task
sorting the whole key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _struct_of(df: DataFrame, first: list[str]) -> Column:
    rest = [c for c in df.columns if c not in first]
    return F.struct(*[F.col(c) for c in first + rest])


def latest_by_key(df: DataFrame, key_cols: list[str], order_cols: list[str]) -> DataFrame:
    """Upsert semantics on read: for each key, the row with the greatest ``order_cols`` wins."""
    payload = [c for c in df.columns if c not in key_cols]
    best = df.groupBy(*key_cols).agg(F.max(_struct_of(df.select(*payload), order_cols)).alias("_best"))
    return best.select(*key_cols, *[F.col("_best")[c].alias(c) for c in payload])


def within_ttl(df: DataFrame, ts_col: str, ttl_days: int = 7, now: Column | None = None) -> DataFrame:
    """Rows newer than ``now - ttl_days``; ``now`` defaults to the newest time in the table."""
    if now is None:
        now = F.lit(df.agg(F.max(ts_col)).first()[0])
    return df.where(F.col(ts_col) > now - F.make_dt_interval(F.lit(ttl_days)))


def insert_if_absent(existing: DataFrame, incoming: DataFrame, key_cols: list[str],
                     order_cols: list[str] = ()) -> DataFrame:
    """Existing rows stay; an incoming row is added only when its key is new.

    Among incoming rows sharing a new key the first by ``order_cols``, then by the other columns, is kept.
    """
    new = incoming.join(existing.select(*key_cols), key_cols, "left_anti")
    payload = [c for c in new.columns if c not in key_cols]
    first = new.groupBy(*key_cols).agg(F.min(_struct_of(new.select(*payload), list(order_cols))).alias("_f")) if payload else new.distinct()
    new = first.select(*key_cols, *[F.col("_f")[c].alias(c) for c in payload])
    return existing.unionByName(new.select(*existing.columns))


def latest_n(df: DataFrame, order: list[Column], n: int = 50) -> DataFrame:
    """The newest ``n`` rows (a top-n listing: the limit is the feature; planned as TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(n)


def delete_by_key(df: DataFrame, key_col: str, keys) -> DataFrame:
    """The table without the rows whose key is in ``keys`` (a list, or a DataFrame of keys)."""
    if isinstance(keys, DataFrame):
        return df.join(keys.select(F.col(keys.columns[0]).alias(key_col)).distinct(), key_col, "left_anti")
    return df.where(~F.col(key_col).isin(list(keys)))


def append_log(path: str, report: DataFrame, session_id: str, kind: str, at: Column | None = None) -> None:
    """Append a report (drift pairs, violations, heal attempts) to an event log table at ``path``."""
    out = report.select(F.lit(session_id).alias("session_id"), F.lit(kind).alias("kind"),
                        (at if at is not None else F.current_timestamp()).alias("logged_at"),
                        F.to_json(F.struct(*report.columns)).alias("payload"))
    out.write.mode("append").parquet(path)


def add_vectors(path: str, docs: DataFrame) -> None:
    """Add documents with their vectors and metadata to the similarity store at ``path``."""
    docs.write.mode("append").parquet(path)


def _norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(a, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0),
                              lambda s, x: s + x))


BLOCK_ROWS = 16_384  # stored vectors held by a task at once
TILE = 1 << 20  # similarities computed at once
PROBE, DENSE = 8, 1 / 16  # queries of a tile that are tried first; share of pairs from which one product is cheaper than picked ones


def principal_axes(unit: DataFrame, col: str, dim: int):
    """Orthonormal axes (dim x dim, columns) by falling variance; the driver gets one dim x dim matrix of sums."""
    import numpy as np
    import pandas as pd

    def grams(batches):
        total = np.zeros((dim, dim))
        for b in batches:
            if len(b):
                x = np.stack(b[col].to_numpy())
                total += x.T @ x
        yield pd.DataFrame({"i": np.repeat(np.arange(dim), dim), "j": np.tile(np.arange(dim), dim), "g": total.ravel()})

    sums = unit.select(col).mapInPandas(grams, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g")).collect()
    gram = np.zeros((dim, dim))
    for r in sums:
        gram[r["i"], r["j"]] = r["g"]
    return np.linalg.eigh(gram)[1][:, ::-1]


def best_above(q, x, threshold: float, lead: int, own=None):
    """(query row, stored row, similarity, candidate share): the best stored row above ``threshold`` per query, the first on ties.

    With unit rows, q.x <= lead part + |rest of q| |rest of x|; only pairs whose bound passes get the
    rest of their product. Where a probe of a tile's queries says that the bound keeps more than DENSE of the
    pairs, the whole tile is one matrix product instead. Either way only pairs that may be a query's best
    are summed in one fixed order, so equal vectors tie. ``own``: stored row that a query may not take (-1: none).
    """
    import numpy as np

    rest_q, rest_x = np.sqrt(np.maximum(0, 1 - (q[:, :lead] ** 2).sum(axis=1))), np.sqrt(np.maximum(0, 1 - (x[:, :lead] ** 2).sum(axis=1)))
    best, who, met = np.full(len(q), threshold), np.full(len(q), -1), 0
    step = max(1, TILE // max(1, len(x)))

    def passing(sl):
        return q[sl, :lead] @ x[:, :lead].T + rest_q[sl, None] * rest_x > threshold - 1e-9

    for lo in range(0, len(q), step):
        sl = slice(lo, min(lo + step, len(q)))
        probe = passing(slice(lo, min(lo + PROBE, sl.stop)))
        if np.count_nonzero(probe) > DENSE * probe.size:
            sim = q[sl] @ x.T
            met += sim.size
            if own is not None:
                has = np.flatnonzero(own[sl] >= 0)
                sim[has, own[sl][has]] = -np.inf
            near = sim >= np.maximum(sim.max(axis=1), threshold)[:, None] - 1e-9
        else:
            near = passing(sl)
            met += np.count_nonzero(near)
            if own is not None:
                has = np.flatnonzero(own[sl] >= 0)
                near[has, own[sl][has]] = False
        r, c = np.nonzero(near)
        for at in range(0, len(r), TILE // 8):
            rr, cc = r[at: at + TILE // 8], c[at: at + TILE // 8]
            sim = np.einsum("ij,ij->i", q[sl][rr], x[cc])
            order = np.lexsort((cc, -sim, rr))  # best first within each query
            first = order[np.r_[True, rr[order][1:] != rr[order][:-1]]] if len(order) else order
            better = sim[first] > best[lo + rr[first]]
            k = first[better]
            best[lo + rr[k]], who[lo + rr[k]] = sim[k], cc[k]
    hit = np.flatnonzero(who >= 0)
    return hit, who[hit], best[hit], met / max(1, len(q) * len(x))


def unit_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, u): vectors of length 1; null and zero vectors and null ids are left out."""
    n = _norm(F.col(vec_col))
    return df.where(F.col(id_col).isNotNull() & (n > 0)).select(
        F.col(id_col).cast("long").alias("id"), F.transform(F.col(vec_col), lambda x: x.cast("double") / n).alias("u"))


def match_blocks(stored: DataFrame, asking: DataFrame, parts: int, axes, lead: int, threshold: float, exclude_self: bool, q_id: str) -> DataFrame:
    """(q_id, match_id, similarity): the best stored row above ``threshold`` in each block that a query is sent to.

    Both sides have (b, side, id, u), side 0 the stored rows. A task holds the stored rows of one block and streams its queries past them.
    """
    import numpy as np
    import pyarrow as pa

    dealt = stored.unionByName(asking).repartition(parts, "b").sortWithinPartitions("b", "side", "id")

    def run(batches):
        now, ids, held, x = None, [], [], None
        for b in batches:
            block, side, key = (b.column(c).to_numpy(zero_copy_only=False) for c in ("b", "side", "id"))
            u = b.column("u").flatten().to_numpy(zero_copy_only=False).reshape(len(key), -1) if len(key) else None
            edge = np.flatnonzero((block[1:] != block[:-1]) | (side[1:] != side[:-1])) + 1
            for lo, hi in zip([0, *edge], [*edge, len(key)]):
                if lo == hi:
                    continue
                if block[lo] != now:
                    now, ids, held, x = block[lo], [], [], None
                if side[lo] == 0:
                    ids.append(key[lo:hi])
                    held.append(u[lo:hi] @ axes)
                    continue
                if not held:
                    continue
                if x is None:
                    x, names = np.concatenate(held), np.concatenate(ids)
                own = None
                if exclude_self:
                    spot = np.minimum(np.searchsorted(names, key[lo:hi]), len(names) - 1)
                    own = np.where(names[spot] == key[lo:hi], spot, -1)
                row, who, sim, _ = best_above(u[lo:hi] @ axes, x, threshold, lead, own)
                yield pa.RecordBatch.from_arrays([pa.array(key[lo:hi][row]), pa.array(names[who]), pa.array(sim)], names=[q_id, "match_id", "similarity"])

    return dealt.mapInArrow(run, f"{q_id} long, match_id long, similarity double")


def nearest_vector(queries: DataFrame, store: DataFrame, q_id: str, s_id: str, vec_col: str,
                   threshold: float = 0.92, exclude_self: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """For each query the most similar stored vector with cosine > ``threshold`` (ties: smaller id).

    Queries with no such vector are absent. Returns (``q_id``, ``match_id``, ``similarity``). Ids must be
    integers; vectors must have one length; null and zero vectors match nothing.

    The store is read once and never copied: a task holds one block of ``block_rows`` stored vectors and
    streams all queries past it. All vectors are rotated to the store's principal axes, where the first
    quarter of the coordinates and the norms of the rest bound a cosine from above; only pairs
    whose bound passes the threshold are multiplied out.
    """
    s, q = unit_vectors(store, s_id, vec_col), unit_vectors(queries, q_id, vec_col)
    dim, rows = s.agg(F.max(F.size("u")), F.count(F.lit(1))).first()
    out = f"{q_id} long, match_id long, similarity double"
    if not rows:
        return queries.sparkSession.createDataFrame([], out)
    axes, lead = principal_axes(s, "u", dim), max(1, dim // 4)
    blocks = -(-rows // block_rows)
    stored = s.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("b"), F.lit(0).alias("side"), "id", "u")
    asking = q.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("b"), F.lit(1).alias("side"), "id", "u")
    parts = max(blocks, int(s.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = match_blocks(stored, asking, parts, axes, lead, threshold, exclude_self, q_id)
    best = found.groupBy(q_id).agg(F.max(F.struct("similarity", (-F.col("match_id")).alias("neg"))).alias("_b"))
    return best.select(q_id, (-F.col("_b.neg")).alias("match_id"), F.col("_b.similarity").alias("similarity"))
