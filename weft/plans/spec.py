"""Declarative specs.  Small driver-side objects; they compile to Column expressions.

Nothing here holds data rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

NUMERIC_TYPES = {"integer", "int", "float", "numeric", "decimal", "double", "long"}
STRING_TYPES = {"string", "text", "varchar", "char", "uuid", "json"}
BOOL_TYPES = {"boolean", "bool"}
DATE_TYPES = {"date", "datetime", "timestamp"}


def type_family(data_type: str) -> str:
    t = (data_type or "string").lower()
    if t in NUMERIC_TYPES:
        return "numeric"
    if t in BOOL_TYPES:
        return "boolean"
    if t in DATE_TYPES:
        return "date"
    return "string"


@dataclass(frozen=True)
class Dist:
    """A distribution: ``kind`` in normal, lognormal, truncnorm, uniform, exponential, poisson,
    beta, bernoulli, gamma, weibull, categorical, mixture."""

    kind: str
    params: dict = field(default_factory=dict)
    clip_min: float | None = None
    clip_max: float | None = None
    values: tuple = ()
    weights: tuple = ()
    components: tuple = ()  # of Dist, for mixtures (weights in ``weights``)

    def __hash__(self):  # params is a dict
        return hash((self.kind, tuple(sorted(self.params.items())), self.clip_min, self.clip_max,
                     self.values, self.weights, self.components))


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    data_type: str = "string"
    nullable: bool = True
    primary_key: bool = False
    unique: bool = False
    enum_values: tuple = ()
    min_value: float | None = None
    max_value: float | None = None
    semantic_type: str | None = None
    distribution: Dist | None = None
    null_rate: float = 0.0


@dataclass(frozen=True)
class TableSpec:
    name: str
    columns: tuple[ColumnSpec, ...]
    row_count: int = 1000

    def column(self, name: str) -> ColumnSpec | None:
        for c in self.columns:
            if c.name == name:
                return c
        return None

    @property
    def primary_key(self) -> list[str]:
        return [c.name for c in self.columns if c.primary_key]


@dataclass(frozen=True)
class Relationship:
    parent_table: str
    parent_column: str
    child_table: str
    child_column: str
    kind: str = "1:N"


@dataclass(frozen=True)
class Rule:
    """A constraint.  kind: range, enum, unique, not_null, expression, temporal, referential, causal.
    action: clip, reject, impute, flag.  severity: low, medium, high, critical."""

    name: str
    kind: str
    columns: tuple = ()
    action: str = "flag"
    severity: str = "medium"
    min_value: float | None = None
    max_value: float | None = None
    values: tuple = ()
    expression: str | None = None
    tolerance: float = 1e-9
    ref_table: str | None = None  # referential: parent table and its key column
    ref_column: str | None = None


@dataclass(frozen=True)
class DagRule:
    """child := expression (Spark SQL text over the parent columns)."""

    parent: str
    child: str
    expression: str
    parents: tuple = ()

    @property
    def all_parents(self) -> tuple:
        return self.parents or (self.parent,)


@dataclass(frozen=True)
class CorrelationTarget:
    col_a: str
    col_b: str
    strength: float


@dataclass(frozen=True)
class DirtyProfile:
    null_rate: float = 0.0
    typo_rate: float = 0.0
    outlier_rate: float = 0.0
    date_format_mix_rate: float = 0.0
    duplicate_rate: float = 0.0
    near_duplicate_rate: float = 0.0


@dataclass(frozen=True)
class SpecialEvent:
    name: str
    month: int
    day: int | None = None
    multiplier: float = 1.0
    columns: tuple = ()
    duration_days: int = 1


@dataclass(frozen=True)
class TemporalPatterns:
    weekday_weights: tuple = ()  # 7, Monday first
    hour_weights: tuple = ()  # 24
    month_multipliers: dict = field(default_factory=dict)  # month (1..12) -> factor
    events: tuple = ()  # SpecialEvent
    autocorrelation: float = 0.0

    def __hash__(self):
        return hash((self.weekday_weights, self.hour_weights, tuple(sorted(self.month_multipliers.items())),
                     self.events, self.autocorrelation))


@dataclass(frozen=True)
class Scenario:
    name: str
    multipliers: dict = field(default_factory=dict)
    shifts: dict = field(default_factory=dict)

    def __hash__(self):
        return hash((self.name, tuple(sorted(self.multipliers.items())), tuple(sorted(self.shifts.items()))))


def cols_of(df: DataFrame, kind: str) -> list[str]:
    """Columns of a DataFrame by kind: string, numeric, date, boolean."""
    out = []
    for f in df.schema.fields:
        t = f.dataType
        if kind == "string" and isinstance(t, T.StringType):
            out.append(f.name)
        elif kind == "numeric" and isinstance(t, T.NumericType):
            out.append(f.name)
        elif kind == "date" and isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            out.append(f.name)
        elif kind == "boolean" and isinstance(t, T.BooleanType):
            out.append(f.name)
    return out


def spec_from_df(df: DataFrame, name: str = "t", primary_key: tuple = ()) -> TableSpec:
    """A TableSpec that mirrors a DataFrame's schema (types only, no facts beyond the key)."""
    cols = []
    for f in df.schema.fields:
        t = f.dataType
        if isinstance(t, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
            dt = "integer"
        elif isinstance(t, T.NumericType):
            dt = "float"
        elif isinstance(t, T.BooleanType):
            dt = "boolean"
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            dt = "datetime"
        elif isinstance(t, T.DateType):
            dt = "date"
        else:
            dt = "string"
        pk = f.name in primary_key
        cols.append(ColumnSpec(f.name, dt, nullable=not pk, primary_key=pk))
    return TableSpec(name, tuple(cols))
