"""Equal rows counted and numbered without grouping by the rows themselves.

A row is told apart by a digest of its JSON text, so tables with map columns work, -0.0 stays apart from
0.0 and only one representative of equal rows is shuffled (map-side combined).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUN = 4096  # copies that one task writes out in one go
_AS_JSON = {"ignoreNullFields": "false", "timeZone": "UTC", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
            "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def row_digest(cols: list[str]) -> Column:
    """128-bit digest of the row's values, nulls included; maps are equal if their entries come in the same order."""
    return F.md5(F.to_json(F.struct(*cols), _AS_JSON))


def ordered(value: Column, t: T.DataType) -> Column:
    """``value`` in a form that can be ordered: maps, and values that hold one, as their JSON text."""
    return F.to_json(F.struct(value), _AS_JSON) if has_map(t) else value


def has_map(t: T.DataType) -> bool:
    if isinstance(t, T.StructType):
        return any(has_map(f.dataType) for f in t.fields)
    if isinstance(t, T.ArrayType):
        return has_map(t.elementType)
    return isinstance(t, (T.MapType, T.VariantType))


def equal_rows(df: DataFrame, by: list[Column]) -> DataFrame:
    """One row for all equal rows of ``df``: the columns ``by``, _digest, _row (the row as a struct), _n (how many there are)."""
    return (df.groupBy(*by, row_digest(df.columns).alias("_digest"))
            .agg(F.count(F.lit(1)).alias("_n"), F.any_value(F.struct(*df.columns)).alias("_row")))


def numbered(counted: DataFrame, n: str = "_n", out: str = "_copy") -> DataFrame:
    """Every row ``n`` times, numbered from 1 in ``out``. Runs of RUN copies are dealt to tasks before they are written out, so
    a row with any number of copies does not stay in one task. Needs the column _digest."""
    runs = counted.withColumn("_run", F.explode(F.sequence(F.lit(1).cast("long"), F.col(n), F.lit(RUN).cast("long"))))
    dealt = runs.repartition("_digest", "_run")
    return dealt.withColumn(out, F.explode(F.sequence(F.col("_run"), F.least(F.col("_run") + F.lit(RUN - 1), F.col(n))))).drop("_run")
