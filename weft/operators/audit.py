"""Ten-check weighted audit.

All row-level checks are fused into one aggregate pass; statistical sanity needs the
moments from that pass and runs a second aggregate; uniqueness is a grouped count per
key column (map-side combined, so it survives hot keys); correlation uses the
distributed Spearman of ``weft.operators.correlate``.  The report is 10 rows.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.operators.constraints import unique_violations
from weft.plans.spec import CorrelationTarget, DagRule, Rule, TableSpec, type_family

# fixed values: check order, weights and severities of the audit
CHECKS = [
    ("schema_completeness", 0.15, "high"),
    ("type_conformance", 0.15, "high"),
    ("null_policy", 0.10, "high"),
    ("range_validity", 0.12, "medium"),
    ("enum_validity", 0.10, "medium"),
    ("uniqueness", 0.10, "critical"),
    ("temporal_ordering", 0.08, "high"),
    ("causal_physics", 0.08, "medium"),
    ("statistical_sanity", 0.07, "low"),
    ("correlation_consistency", 0.05, "low"),
]

# fixed values: well-known (start, end) column pairs checked for ordering
TEMPORAL_PAIRS = [
    ("admission_date", "discharge_date"),
    ("start_date", "end_date"),
    ("created_at", "updated_at"),
    ("birth_date", "death_date"),
    ("order_date", "delivery_date"),
]

# fixed values: textual forms accepted as booleans
BOOL_TEXT = ["True", "False", "0", "1", "true", "false"]

REPORT_SCHEMA = ("check_id int, check_name string, weight double, score double, "
                 "violations bigint, severity string, passed boolean")


def _is_numeric(t) -> bool:
    return isinstance(t, T.NumericType)


def _is_time(t) -> bool:
    return isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType))


def _as_ts(df: DataFrame, c: str):
    if _is_time(df.schema[c].dataType):
        return F.col(c).cast("timestamp_ntz")
    return F.try_to_timestamp(F.col(c).cast("string")).cast("timestamp_ntz")


def _tokens(name: str) -> set[str]:
    return set(t for t in re.split(r"[^a-z0-9]+", name.lower()) if t)


def temporal_pairs(df: DataFrame, rules: list[Rule]) -> list[tuple[str, str]]:
    pairs = []
    for r in rules:
        if r.kind == "temporal" and len(r.columns) >= 2:
            pairs.append((r.columns[0], r.columns[1]))
    pairs += TEMPORAL_PAIRS
    out = []
    for s, e in pairs:
        if s in df.columns and e in df.columns and (s, e) not in out:
            out.append((s, e))
    return out


#: the check that a measure of the one big aggregate belongs to, by the first two letters of its name
MEASURES = {"_t": "type_conformance", "_n": "null_policy", "_r": "range_validity", "_e": "enum_validity",
            "_o": "temporal_ordering", "_p": "causal_physics", "_m": "statistical_sanity"}


@dataclass
class Measures:
    """The aggregates of the row-level checks by key, and which keys belong to which check."""

    columns: dict
    present: list
    numeric: list
    aggs: dict
    keys: dict


def audit_measures(df: DataFrame, spec: TableSpec | None, rules: list[Rule] = (), dag: list[DagRule] = ()) -> Measures:
    """Everything that one pass over ``df`` has to count for V-02 to V-05 and V-07 to V-09."""
    cols = {c.name: c for c in (spec.columns if spec else ())}
    present = [c for c in cols.values() if c.name in df.columns]
    schema = {f.name: f.dataType for f in df.schema.fields}
    aggs = {"_rows": F.count(F.lit(1))}

    # V-02 type conformance: a column is bad if any non-null value does not fit its declared family
    type_keys = []
    for c in present:
        fam, t = type_family(c.data_type), schema[c.name]
        bad = None
        if fam == "numeric" and not _is_numeric(t):
            bad = F.col(c.name).isNotNull() & F.col(c.name).cast("string").try_cast("double").isNull()
        elif fam == "boolean" and not isinstance(t, T.BooleanType):
            bad = F.col(c.name).isNotNull() & ~F.col(c.name).cast("string").isin(BOOL_TEXT)
        elif fam == "date" and not _is_time(t):
            bad = F.col(c.name).isNotNull() & F.try_to_timestamp(F.col(c.name).cast("string")).isNull()
        if bad is not None:
            k = f"_t{len(type_keys)}"
            aggs[k] = F.count_if(bad)
            type_keys.append(k)
    # V-03 nulls in non-nullable columns
    null_keys = []
    for c in present:
        if not c.nullable:
            k = f"_n{len(null_keys)}"
            aggs[k] = F.count_if(F.col(c.name).isNull())
            null_keys.append(k)
    # V-04 range, numeric columns only, nulls ignored
    range_keys = []
    for c in present:
        if not _is_numeric(schema[c.name]):
            continue
        for bound, op in ((c.min_value, "lt"), (c.max_value, "gt")):
            if bound is None:
                continue
            k = f"_r{len(range_keys)}"
            x = F.col(c.name)
            aggs[k] = F.count_if(x < F.lit(float(bound)) if op == "lt" else x > F.lit(float(bound)))
            range_keys.append(k)
    # V-05 enum, compared as text, nulls ignored
    enum_keys = []
    for c in present:
        if c.enum_values:
            k = f"_e{len(enum_keys)}"
            aggs[k] = F.count_if(F.col(c.name).isNotNull()
                                 & ~F.col(c.name).cast("string").isin([str(v) for v in c.enum_values]))
            enum_keys.append(k)
    # V-07 temporal ordering
    temp_keys = []
    for s, e in temporal_pairs(df, list(rules)):
        k = f"_o{len(temp_keys)}"
        aggs[k] = F.count_if(_as_ts(df, e) < _as_ts(df, s))
        temp_keys.append(k)
    # V-08 causal physics: negative values in children named like age / salary / amount / income
    phys_keys = []
    for d in dag:
        if d.child not in df.columns or any(p not in df.columns for p in d.all_parents):
            continue
        if not _is_numeric(schema[d.child]):
            continue
        toks = _tokens(d.child)
        hits = int("age" in toks) + int(bool(toks & {"salary", "amount", "income"}))
        for _ in range(hits):
            k = f"_p{len(phys_keys)}"
            aggs[k] = F.count_if(F.col(d.child) < 0)
            phys_keys.append(k)
    # V-09 moments of every numeric column
    numeric = [f.name for f in df.schema.fields if _is_numeric(f.dataType)]
    for i, c in enumerate(numeric):
        aggs[f"_mc{i}"] = F.count(F.col(c))
        aggs[f"_mm{i}"] = F.avg(F.col(c).cast("double"))
        aggs[f"_ms{i}"] = F.stddev_samp(F.col(c).cast("double"))

    keys = {"type": type_keys, "null": null_keys, "range": range_keys, "enum": enum_keys, "temporal": temp_keys, "physics": phys_keys}
    return Measures(cols, present, numeric, aggs, keys)


def extreme_measures(m: Measures, row, stats_k: float, min_stat_rows: int) -> dict:
    """Counts of values far from their column's mean, by the column's place, once ``row`` has the moments."""
    out = {}
    for i, c in enumerate(m.numeric):
        if int(row[f"_mc{i}"] or 0) < min_stat_rows:
            continue
        mean = float(row[f"_mm{i}"])
        std = float(row[f"_ms{i}"] or 0.0) or 1.0
        out[i] = F.count_if(F.abs(F.col(c).cast("double") - F.lit(mean)) > F.lit(stats_k * std))
    return out


def audit_parts(df: DataFrame, spec: TableSpec | None, rules: list[Rule] = (), dag: list[DagRule] = (),
                stats_k: float = 10.0, stats_share: float = 0.05, min_stat_rows: int = 10, only: set[str] | None = None):
    """Compute the per-check (score, violations) numbers; returns a list of 9 tuples.

    With ``only``, just the named checks are computed (the others count as clean): a check that needs no
    rows runs no job, and the aggregate holds no measure of another check.
    """
    m = audit_measures(df, spec, rules, dag)
    aggs = m.aggs
    asked = lambda name: only is None or name in only
    aggs = {k: v for k, v in aggs.items() if k == "_rows" or asked(MEASURES[k[:2]])}
    if only is not None and not only & {*MEASURES.values()}:
        aggs = {}
    row = defaultdict(int, df.agg(*[v.alias(k) for k, v in aggs.items()]).first().asDict() if aggs else {})
    extreme = extreme_measures(m, row, stats_k, min_stat_rows) if asked("statistical_sanity") else {}
    far = df.agg(*[v.alias(f"_x{i}") for i, v in extreme.items()]).first().asDict() if extreme else {}
    repeats = sum(int(unique_violations(df, [c.name]).first()["violations"]) for c in m.present if (c.primary_key or c.unique) and asked("uniqueness"))
    return audit_scores(m, df.columns, row, far, repeats, stats_share)


def audit_scores(m: Measures, columns: list[str], row, far: dict, repeats: int, stats_share: float = 0.05):
    """(score, violations) of V-01 to V-09 from the measured numbers: ``row`` by key of ``m.aggs``, ``far`` the counts of
    ``extreme_measures`` (as ``_x`` and the place), ``repeats`` the repeated key values."""
    n, cols = int(row["_rows"]), m.columns
    type_keys, null_keys, range_keys, enum_keys, temp_keys, phys_keys = (m.keys[k] for k in ("type", "null", "range", "enum", "temporal", "physics"))
    stat_viol = sum(1 for k, v in far.items() if int(v) > int(row[f"_mc{k[2:]}"]) * stats_share)

    results = []
    # V-01
    if not cols:
        results.append((1.0, 0))
    else:
        missing = [c for c in cols if c not in columns]
        results.append((max(0.0, 1.0 - len(missing) / max(1, len(cols))), len(missing)))
    # V-02
    bad_cols = sum(1 for k in type_keys if int(row[k]) > 0)
    results.append((max(0.0, 1.0 - bad_cols / max(1, len(cols))), bad_cols))
    # V-03
    v = sum(int(row[k]) for k in null_keys)
    results.append((max(0.0, 1.0 - v / max(1, n * max(1, len(cols)))), v))
    # V-04
    v = sum(int(row[k]) for k in range_keys)
    results.append((max(0.0, 1.0 - v / max(1, n)), v))
    # V-05
    v = sum(int(row[k]) for k in enum_keys)
    results.append((max(0.0, 1.0 - v / max(1, n)), v))
    # V-06
    results.append((0.0 if repeats > 0 else 1.0, repeats))
    # V-07
    v = sum(int(row[k]) for k in temp_keys)
    results.append((max(0.0, 1.0 - v / max(1, n)), v))
    # V-08
    v = sum(int(row[k]) for k in phys_keys)
    results.append((max(0.0, 1.0 - v / max(1, n)), v))
    # V-09
    results.append((max(0.0, 1.0 - stat_viol / max(1, len(m.numeric))), stat_viol))
    return results


def correlation_check(df: DataFrame, targets: list[CorrelationTarget], tolerance: float = 0.3):
    """V-10: targets whose pairwise-complete Spearman differs from the target by more than tolerance."""
    if not targets:
        return (1.0, 0)
    from weft.operators.correlate import spearman_pairs

    tg = list(targets)
    numeric = {f.name for f in df.schema.fields if _is_numeric(f.dataType)}
    pairs = [(t.col_a, t.col_b) for t in tg if t.col_a in numeric and t.col_b in numeric]
    rho = {}
    if pairs:
        for r in spearman_pairs(df, pairs).collect():
            rho[(r["col_a"], r["col_b"])] = r["rho"]
    v = 0
    for t in tg:
        r = rho.get((t.col_a, t.col_b))
        if r is not None and abs(r - t.strength) > tolerance:
            v += 1
    return (max(0.0, 1.0 - v / max(1, len(targets))), v)


def audit(df: DataFrame, spec: TableSpec | None = None, rules: list[Rule] = (), dag: list[DagRule] = (),
          correlations: list[CorrelationTarget] = (), only: set[str] | None = None, **kw) -> DataFrame:
    """The 10-row audit report: check_id, check_name, weight, score, violations, severity, passed.

    ``only`` names the checks to compute; the report then has their rows alone.
    """
    if unknown := (only or set()) - {c[0] for c in CHECKS}:
        raise ValueError(f"unknown checks: {sorted(unknown)}")
    parts = audit_parts(df, spec, rules, dag, only=only, **kw)
    parts.append(correlation_check(df, list(correlations)) if only is None or CHECKS[9][0] in only else (1.0, 0))
    return df.sparkSession.createDataFrame(report_rows(parts, only), REPORT_SCHEMA)


def report_rows(parts, only: set[str] | None = None) -> list[tuple]:
    rows = []
    for i, ((name, w, sev), (score, v)) in enumerate(zip(CHECKS, parts)):
        if only is not None and name not in only:
            continue
        rows.append((i + 1, name, w, float(score), int(v), sev if v > 0 else "low", v == 0))
    return rows


def audit_score(report: DataFrame) -> DataFrame:
    """Weighted total 0..100 of a 10-row report."""
    return report.agg(
        F.least(F.greatest(F.sum(F.col("weight") * F.col("score") * F.lit(100.0)), F.lit(0.0)), F.lit(100.0))
        .alias("overall_score"),
        F.count(F.lit(1)).cast("long").alias("n_checks"),
        F.sum(F.col("passed").cast("int")).cast("long").alias("n_passed"),
    )
