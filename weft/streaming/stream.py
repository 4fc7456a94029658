"""Structured Streaming forms of the row-local and windowed operators.

Row-local operators (nulls, date mix, typos, masking, range clipping, scenarios, temporal
re-weighting) are plain Column expressions with keyed randomness, so they run unchanged on a
streaming DataFrame and give the same rows as in batch.  Stateful forms:

* uniqueness -> ``dropDuplicatesWithinWatermark`` on the key;
* audit counts and personal-data counts -> tumbling ``window(ts, ..)`` aggregates with a watermark
  (state is bounded by the watermark; late rows beyond it are dropped);
* usage -> session windows per user.

Queries write with a checkpoint under the shared checkpoint folder so a restarted driver or lost
executor resumes from the last committed batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions import pii as P
from weft.sources.files import scratch_path


def read_parquet_stream(spark: SparkSession, path: str, schema: T.StructType | str,
                        files_per_batch: int = 64) -> DataFrame:
    """Files arriving in ``path`` as a stream (schema must be given for file streams)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def event_time(stream: DataFrame, ts_col: str) -> DataFrame:
    """Watermarks need TIMESTAMP; wall-clock (NTZ) columns are read as session-time-zone instants."""
    if isinstance(stream.schema[ts_col].dataType, T.TimestampNTZType):
        return stream.withColumn(ts_col, F.col(ts_col).cast("timestamp"))
    return stream


def windowed_quality(stream: DataFrame, ts_col: str, window: str, watermark: str,
                     null_cols: list[str] = (), range_rules: dict | None = None) -> DataFrame:
    """Per event-time window: rows, nulls per column and range violations per column."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for c in null_cols:
        aggs.append(F.count_if(F.col(c).isNull()).alias(f"null_{c}"))
    for c, (lo, hi) in (range_rules or {}).items():
        bad = F.col(c).isNotNull() & ((F.col(c) < F.lit(lo)) | (F.col(c) > F.lit(hi)))
        aggs.append(F.count_if(bad).alias(f"range_{c}"))
    return (event_time(stream, ts_col).withWatermark(ts_col, watermark)
            .groupBy(F.window(ts_col, window).alias("w")).agg(*aggs)
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    *[a for a in ["n_rows"] + [f"null_{c}" for c in null_cols]
                      + [f"range_{c}" for c in (range_rules or {})]]))


def windowed_pii_counts(stream: DataFrame, ts_col: str, text_cols: list[str], window: str,
                        watermark: str) -> DataFrame:
    """Per window and entity type: number of cells holding that type of personal data."""
    types = F.array_distinct(F.flatten(F.array(*[F.coalesce(P.span_types(F.col(c)), F.array().cast("array<string>"))
                                                 for c in text_cols])))
    return (event_time(stream, ts_col).withWatermark(ts_col, watermark)
            .select(ts_col, F.explode(types).alias("entity"))
            .groupBy(F.window(ts_col, window).alias("w"), "entity").agg(F.count(F.lit(1)).alias("cells"))
            .select(F.col("w.start").alias("window_start"), "entity", "cells"))


def dedupe_stream(stream: DataFrame, key_cols: list[str], ts_col: str, watermark: str) -> DataFrame:
    """Drop repeated keys seen within the watermark delay (bounded state)."""
    return event_time(stream, ts_col).withWatermark(ts_col, watermark).dropDuplicatesWithinWatermark(key_cols)


def sessions(stream: DataFrame, user_col: str, ts_col: str, gap: str, watermark: str,
             value_col: str | None = None) -> DataFrame:
    """Usage sessions: events of a user separated by less than ``gap`` form one session."""
    aggs = [F.count(F.lit(1)).alias("n_events")]
    if value_col:
        aggs.append(F.sum(value_col).alias("total_value"))
    return (event_time(stream, ts_col).withWatermark(ts_col, watermark)
            .groupBy(user_col, F.session_window(ts_col, gap).alias("s")).agg(*aggs)
            .select(user_col, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), *[
                a for a in ["n_events"] + (["total_value"] if value_col else [])]))


def run_available(df: DataFrame, out_path: str, mode: str = "append", checkpoint: str | None = None,
                  fmt: str = "parquet") -> str:
    """Process everything available now into ``out_path`` and stop (restartable via the checkpoint).

    Windowed aggregates in append mode emit a window once the watermark passes its end; use
    ``mode="complete"`` (memory sink) or ``"update"`` to see open windows.
    """
    spark = df.sparkSession
    ck = checkpoint or scratch_path(spark, "stream-ckpt")
    w = df.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", ck).trigger(availableNow=True)
    # the memory sink (tests, small monitoring tables) is addressed by query name, files by path
    w = w.queryName(out_path) if fmt == "memory" else w.option("path", out_path)
    w.start().awaitTermination()
    return out_path


def apply_columns(stream: DataFrame, exprs: dict[str, Column]) -> DataFrame:
    """Row-local operators on a stream: the same Column expressions as in batch."""
    return stream.withColumns(exprs)
