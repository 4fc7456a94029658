"""Keyed tables kept on a stream: the newest row of every key in state, gone after its time to live.

The state holds one row a key and one event-time timer; what leaves is a log of changes, each of them written
once (file sinks commit whole batches). The current table is the newest change of a key, read as a batch.
The watermark runs one time to live behind the newest row, so the rows it calls late are exactly those
that would have expired already: the result does not depend on how rows are dealt to batches, and a query started
again from its checkpoint ends where one that never stopped ends.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from weft.operators import store as ST
from weft.streaming.stream import event_time

GONE = "_gone"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_on_disk(spark: SparkSession) -> None:
    """State with timers needs the RocksDB store: working files on the executor, committed versions in the checkpoint folder."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def _rank(values: tuple) -> tuple:
    return tuple((v is not None, v) for v in values)  # nulls first, as in Spark's ordering of structs


class _Newest(StatefulProcessor):
    """State: the newest row's payload, order columns first, and its time in milliseconds."""

    def __init__(self, payload: list[str], stored: T.StructType, out: list[str]) -> None:
        self.payload, self.stored, self.out = payload, stored, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", self.stored)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        old = tuple(self.best.get()) if self.best.exists() else None
        new = old
        for r in rows:
            x = tuple(r[c] for c in self.payload) + (r["_ms"],)
            if new is None or _rank(x[:-1]) > _rank(new[:-1]):
                new = x
        if new is not None and new != old:
            if old is not None:
                self.handle.deleteTimer(old[-1])
            self.best.update(new)
            self.handle.registerTimer(new[-1])
            yield Row(**dict(zip(self.out, (*key, *new[:-1], False))))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.best.exists():
            last = tuple(self.best.get())
            self.best.clear()
            yield Row(**dict(zip(self.out, (*key, *last[:-1], True))))

    def close(self) -> None:
        pass


def newest_changes(stream: DataFrame, key_cols: list[str], ts_col: str, ttl_days: int = 7, order_cols: list[str] = ()) -> DataFrame:
    """The change log of a keyed table on a stream: a key's row whenever a newer one comes, and again with ``_gone`` once it expires.

    Newest is by ``ts_col``, then ``order_cols``, then the other columns, as in ``latest_by_key``. A row lives
    until the stream's newest time is ``ttl_days`` ahead of it (to the millisecond). Null keys are a key; rows
    without a time cannot expire and are left out. Timestamps inside structs or arrays are not supported. A key's rows of one batch are read one by one by one task and
    nothing of them is held but the newest, so a hot key costs time, never memory.
    """
    spark = stream.sparkSession
    state_on_disk(spark)
    ts_type = stream.schema[ts_col].dataType
    timed = event_time(stream, ts_col).where(F.col(ts_col).isNotNull())
    first = [ts_col, *[c for c in order_cols if c != ts_col]]
    payload = first + [c for c in stream.columns if c not in key_cols and c not in first]
    marked = timed.withWatermark(ts_col, f"{ttl_days} days")
    instants = [f.name for f in marked.schema.fields if isinstance(f.dataType, T.TimestampType)]  # as microseconds, the same in rows and in state
    packed = lambda c: F.unix_micros(F.col(c)).alias(c) if c in instants else F.col(c)
    unpacked = lambda c: F.timestamp_micros(c).alias(c) if c in instants else F.col(c)
    ready = marked.select(F.col(ts_col).alias("_event"), *[packed(c) for c in [*key_cols, *payload]], F.unix_millis(ts_col).alias("_ms"))
    fields = {f.name: f for f in ready.schema.fields}
    plain = lambda names: [T.StructField(c, fields[c].dataType, True) for c in names]
    stored = T.StructType(plain(payload) + [T.StructField("_ms", T.LongType())])
    out = T.StructType(plain(key_cols) + plain(payload) + [T.StructField(GONE, T.BooleanType())])
    changes = ready.groupBy(*key_cols).transformWithState(
        statefulProcessor=_Newest(payload, stored, out.fieldNames()), outputStructType=out, outputMode="Append", timeMode="EventTime")
    return changes.select(*[unpacked(c).cast(ts_type).alias(c) if c == ts_col else unpacked(c) for c in stream.columns], GONE)


def current(changes: DataFrame, key_cols: list[str], ts_col: str, order_cols: list[str] = ()) -> DataFrame:
    """The live table of a change log read as a batch: the newest change of every key, unless it is the row's expiry."""
    rest = [c for c in changes.columns if c not in key_cols and c not in (ts_col, GONE, *order_cols)]
    newest = ST.latest_by_key(changes, key_cols, [ts_col, *[c for c in order_cols if c != ts_col], *rest, GONE])
    return newest.where(~F.col(GONE)).drop(GONE)


def live_rows(df: DataFrame, key_cols: list[str], ts_col: str, ttl_days: int = 7, order_cols: list[str] = ()) -> DataFrame:
    """The same table from a batch: newest row per key among those that have not expired by the table's newest time (milliseconds)."""
    instant = F.unix_millis(F.col(ts_col).cast("timestamp"))
    now = df.agg(F.max(instant)).first()[0]
    alive = df.where(instant > F.lit(now) - F.lit(ttl_days * 86_400_000)) if now is not None else df.limit(0)
    rest = [c for c in df.columns if c not in key_cols and c != ts_col and c not in order_cols]
    return ST.latest_by_key(alive, key_cols, [ts_col, *[c for c in order_cols if c != ts_col], *rest])
