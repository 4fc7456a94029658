"""File sources and sinks: JSON documents under a root key, Parquet round trips, format choice,
and schema detection for uploaded CSV / JSON / Parquet files.

Scratch output goes under the cluster's shared checkpoint folder (``spark.checkpoint.dir``),
never a machine-local temporary folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.session import checkpoint_dir

FORMATS = ("csv", "json", "parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/weft-io/{name}-{uuid.uuid4().hex}"


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write in one of the supported output formats (csv with a header row)."""
    if fmt not in FORMATS:
        raise ValueError(f"unsupported output format {fmt!r}; choose one of {FORMATS}")
    w = df.write.mode(mode)
    if fmt == "csv":
        w = w.option("header", True)
    w.format(fmt).save(path)


def read(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | str | None = None) -> DataFrame:
    """Read a file set; CSV and JSON infer their schema unless one is given."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    if fmt == "csv":
        r = r.option("header", True).option("inferSchema", schema is None)
    return r.format(fmt).load(path)


def parquet_roundtrip(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet and read it back (the result every later step sees)."""
    path = path or scratch_path(df.sparkSession, "roundtrip")
    write(df, path, "parquet")
    return read(df.sparkSession, path, "parquet")


def load_json_table(spark: SparkSession, path: str, root_key: str, schema: T.StructType | str) -> DataFrame:
    """Rows of the JSON array under ``root_key`` (one multi-line document per file).

    ``schema`` is the row type; nested values not in it stay as JSON text. A missing path
    gives an empty table with that schema.
    """
    row_type = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    doc_type = T.StructType([T.StructField(root_key, T.ArrayType(row_type))])
    try:
        doc = spark.read.schema(doc_type).option("multiLine", True).json(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            return spark.createDataFrame([], row_type)
        raise
    return doc.select(F.explode(root_key).alias("_r")).select("_r.*")


def detect_schema(df: DataFrame, n_samples: int = 0) -> DataFrame:
    """Detected schema of an uploaded table: name, type, nulls, distinct values (one grouped count per column).

    With ``n_samples`` also ``samples``: the so many smallest distinct values of each column as text (none for a column of nulls).
    """
    from weft.operators.report import distinct_counts, samples

    wide = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(F.col(c)).alias(f"_nn{i}") for i, c in enumerate(df.columns)])
    rows = [F.struct(F.lit(i + 1).alias("position"), F.lit(c).alias("column_name"),
                     F.lit(df.schema[c].dataType.simpleString()).alias("data_type"),
                     (F.col("_n") - F.col(f"_nn{i}")).alias("n_null"))
            for i, c in enumerate(df.columns)]
    found = wide.select(F.inline(F.array(*rows))).join(distinct_counts(df, df.columns), "column_name")
    return found.join(samples(df, df.columns, n_samples), "column_name") if n_samples else found
