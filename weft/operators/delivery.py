"""Phases 6 to 9 of a run as one job: time patterns, scenario, correlation repair, dirt, rules, masking, delivery, audit.

The table is written once. What the reports need of the rows on their way (nulls, broken rules, personal
data, ranges, moments) is counted by ``DataFrame.observe`` inside that write; what needs the whole table
(repeated keys, the smallest group over the quasi-identifiers, values far from the mean) comes from one
scan of the written files by grouping sets. The manifest row is committed last, so a reader that finds
it finds data and reports whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from weft.functions import pii as P
from weft.operators import audit as A
from weft.operators import constraints as C
from weft.operators import correlate as CR
from weft.operators import dirty as D
from weft.operators import privacy as PV
from weft.operators import scenario as X
from weft.operators import temporal as TP
from weft.plans.spec import DirtyProfile, Scenario, TableSpec, TemporalPatterns
from weft.session import cut_lineage

REPORT = "section string, name string, value double"
MANIFEST = "data string, reports string, n_rows long, overall_score double"


@dataclass(frozen=True)
class DeliveryPlan:
    """What to do to a table; every part may be left out. ``measures``: the columns that time patterns scale."""

    spec: TableSpec
    key_cols: tuple
    measures: tuple = ()
    patterns: TemporalPatterns | None = None
    scenario: Scenario | None = None
    targets: tuple = ()  # of CorrelationTarget
    repair_rounds: int = 3
    dirt: DirtyProfile | None = None
    rules: tuple = ()
    mask: tuple = ()
    dag: tuple = ()
    quasi_ids: tuple = ()


def enhance(df: DataFrame, plan: DeliveryPlan, seed: int) -> DataFrame:
    """Phase 6: time patterns, scenario, correlation repair, dirt, in this order."""
    keys, out = list(plan.key_cols), df
    if plan.patterns is not None:
        out = TP.temporal_patterns(out, plan.patterns, seed, keys, columns=list(plan.measures))
    if plan.scenario is not None:
        out = X.apply(out, plan.scenario)
    if plan.targets:
        out = CR.repair(cut_lineage(out), list(plan.targets), keys, plan.repair_rounds)  # it reads the rows several times
    return D.dirty_profile(out, plan.dirt, seed, keys) if plan.dirt is not None else out


def _observed(name: str, df: DataFrame, aggs: dict[str, Column]) -> tuple[DataFrame, Observation]:
    seen = Observation(name)
    return df.observe(seen, *[v.alias(k) for k, v in aggs.items()]), seen


def _whole_table(data: DataFrame, keys: list[str], quasi_ids: list[str], far: dict[int, Column]) -> dict:
    """Repeated values of each of ``keys``, smallest group over ``quasi_ids`` and the counts ``far``: one scan, combined map-side.

    Grouping sets: one for each key column, one for the quasi-identifiers, which also sums the counts.
    """
    names = [*dict.fromkeys(keys + quasi_ids)]
    g = data.select(*[F.col(c).alias(f"g{i}") for i, c in enumerate(names)], "*")
    sets = [[f"g{names.index(k)}"] for k in keys] + [[f"g{names.index(c)}" for c in quasi_ids]]
    within = F.grouping_id()
    # a bit of grouping_id is 0 where the column belongs to the row's set, the first column in the highest bit
    code = [sum(1 << (len(names) - 1 - i) for i in range(len(names)) if f"g{i}" not in s) for s in sets]
    groups = g.groupingSets(sets, *[f"g{i}" for i in range(len(names))]).agg(
        within.alias("id"), F.count(F.lit(1)).alias("n"), *[v.alias(f"_x{i}") for i, v in far.items()])
    last = F.col("id") == code[-1]
    out = [F.min(F.when(last, F.col("n"))).alias("k"), *[F.sum(F.when(last, F.col(f"_x{i}"))).alias(f"_x{i}") for i in far]]
    for j, k in enumerate(keys):
        mine = (F.col("id") == code[j]) & F.col(f"g{names.index(k)}").isNotNull()
        out.append(F.sum(F.when(mine, F.col("n") - 1)).alias(f"repeats{j}"))
    return groups.agg(*out).first().asDict()


def deliver(df: DataFrame, plan: DeliveryPlan, seed: int, path: str, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """Run ``plan`` on ``df``, write ``path``/data, ``path``/reports and last ``path``/manifest; returns the manifest row.

    Reports are rows (section, name, value): ``enhance`` (rows and nulls by column after the dirt), ``rules``
    (rows that break each rule, as they come in), ``privacy`` (cells with personal data before masking,
    smallest group k, score), ``audit`` (the scores of V-01 to V-09, violations as ``<check>:violations``,
    overall_score) and ``delivery`` (rows written). Correlations (V-10) are repaired, not audited, here:
    that check counts as passed. A run that fails leaves no manifest.
    """
    spark = df.sparkSession
    dirty, after = enhance(df, plan, seed), {}
    after["rows"] = F.count(F.lit(1))
    for i, c in enumerate(dirty.columns):
        after[f"null{i}"] = F.count_if(F.col(c).isNull())
    marked, judged = C.with_violations(dirty, list(plan.rules), tables)
    for i, (_, name) in enumerate(judged):
        after[f"rule{i}"] = F.count_if(F.col(name))
    watched, on_entry = _observed("entry", marked, after)
    fixed = C.apply_actions(watched, judged, fills_from=marked)
    cells = {f"pii{i}": F.count_if(F.size(P.span_types(F.col(c))) > 0) for i, c in enumerate(plan.mask)} or {"none": F.count(F.lit(1))}
    seen, on_mask = _observed("mask", fixed, cells)
    masked = seen.withColumns({c: P.mask_text(F.col(c), seed) for c in plan.mask}) if plan.mask else seen
    measures = A.audit_measures(masked, plan.spec, list(plan.rules), list(plan.dag))
    out, on_exit = _observed("exit", masked, measures.aggs)
    out.write.parquet(f"{path}/data")
    entry, pii, row = on_entry.get, on_mask.get, on_exit.get

    data = spark.read.schema(out.schema).parquet(f"{path}/data")
    unique = [c.name for c in measures.present if c.primary_key or c.unique]
    whole = _whole_table(data, unique, list(plan.quasi_ids), A.extreme_measures(measures, row, 10.0, 10))
    far = {k: v or 0 for k, v in whole.items() if k.startswith("_x")}
    repeats = sum(int(whole[f"repeats{j}"] or 0) for j in range(len(unique)))
    audit = A.report_rows([*A.audit_scores(measures, out.columns, row, far, repeats), (1.0, 0)])
    overall = sum(r[2] * r[3] * 100.0 for r in audit)
    n, found = int(row["_rows"]), sum(v for k, v in pii.items() if k.startswith("pii"))
    k = int(whole["k"] or 0) if plan.quasi_ids else 1
    privacy = spark.range(1).select(PV.privacy_score(k, 1.0, int(found), n * len(out.columns))).first()[0]

    rows = [("enhance", "rows", entry["rows"]), *[("enhance", f"nulls:{c}", entry[f"null{i}"]) for i, c in enumerate(dirty.columns)],
            *[("rules", r.name, entry[f"rule{i}"]) for i, (r, _) in enumerate(judged)],
            ("privacy", "pii_cells", found), ("privacy", "k", k), ("privacy", "score", privacy),
            *[("audit", r[1], r[3]) for r in audit], *[("audit", f"{r[1]}:violations", r[4]) for r in audit],
            ("audit", "overall_score", overall), ("delivery", "rows", n)]
    spark.createDataFrame([(s, m, float(v)) for s, m, v in rows], REPORT).coalesce(1).write.parquet(f"{path}/reports")
    manifest = spark.createDataFrame([(f"{path}/data", f"{path}/reports", n, float(overall))], MANIFEST)
    manifest.coalesce(1).write.parquet(f"{path}/manifest")
    return read_manifest(spark, path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """The reports of a finished delivery; fails where there is no manifest."""
    return spark.read.schema(REPORT).parquet(read_manifest(spark, path).first()["reports"])


def read_data(spark: SparkSession, path: str) -> DataFrame:
    """The delivered table; fails where there is no manifest."""
    return spark.read.parquet(read_manifest(spark, path).first()["data"])

