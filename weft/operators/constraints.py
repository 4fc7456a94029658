"""Constraint rules compiled to boolean Columns; enforcement in one projection plus one aggregate.

Kinds: range, enum, not_null, expression, unique, temporal, referential, causal.
Actions: clip (range only rewrites), reject (drop violating rows), impute (replace by the
column's median / mode), flag (array column of violated rule names).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.operators.copies import equal_rows, numbered, ordered
from weft.operators.rank import exact_median
from weft.plans.spec import DagRule, Rule, TableSpec
from weft.sources.files import scratch_path

SEVERITIES = ("low", "medium", "high", "critical")
KINDS = ("range", "enum", "unique", "not_null", "expression", "temporal", "referential", "causal")


def _num(c: str) -> Column:
    return F.col(c).cast("string").try_cast("double")


def _ts(df: DataFrame, c: str) -> Column:
    t = df.schema[c].dataType
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.col(c).cast("timestamp_ntz")
    return F.try_to_timestamp(F.col(c).cast("string")).cast("timestamp_ntz")


def violation(df: DataFrame, rule: Rule) -> Column | None:
    """Boolean Column true where a row breaks the rule (never null); None if not applicable."""
    cols = [c for c in rule.columns if c in df.columns]
    if not rule.columns or len(cols) < len(rule.columns) and rule.kind not in ("expression",):
        return None
    c = rule.columns[0]
    if rule.kind == "range":
        v = _num(c)
        cond = F.lit(False)
        if rule.min_value is not None:
            cond = cond | (v < F.lit(float(rule.min_value)))
        if rule.max_value is not None:
            cond = cond | (v > F.lit(float(rule.max_value)))
        return F.coalesce(cond, F.lit(False))
    if rule.kind == "enum":
        allowed = [str(x) for x in rule.values]
        if not allowed:
            return None
        # a null is a violation here (its text form is not an allowed value)
        return F.coalesce(~F.col(c).cast("string").isin(allowed), F.lit(True))
    if rule.kind == "not_null":
        return F.col(c).isNull()
    if rule.kind == "expression":
        if not rule.expression:
            return None
        return F.coalesce(~F.expr(rule.expression), F.lit(False))
    if rule.kind == "temporal":
        if len(rule.columns) < 2:
            return None
        return F.coalesce(_ts(df, rule.columns[1]) < _ts(df, rule.columns[0]), F.lit(False))
    if rule.kind == "causal":
        if not rule.expression:
            return None
        want = F.expr(rule.expression).cast("double")
        got = F.col(c).cast("double")
        return F.coalesce(F.abs(got - want) > F.lit(rule.tolerance), F.lit(False)) | (got.isNull() & want.isNotNull())
    return None


def with_violations(df: DataFrame, rules: list[Rule], tables: dict[str, DataFrame] | None = None):
    """(df plus one boolean column per applicable rule, [(rule, column)]), all judged on the incoming values.

    unique: every row of a key but the first by the remaining columns; keys with a null are not judged.
    referential: a non-null key without a row in ``tables[rule.ref_table]``.
    """
    out, judged = df, []
    for r in rules:
        name = f"_b{len(judged)}"
        if r.kind == "unique":
            if not r.columns or any(c not in df.columns for c in r.columns):
                continue
            out = mark_repeats(out, list(r.columns), df.columns, name)
        elif r.kind == "referential":
            if not r.columns or r.columns[0] not in df.columns:
                continue
            if r.ref_table not in (tables or {}):
                raise ValueError(f"rule {r.name}: table {r.ref_table} is not given")
            parent = tables[r.ref_table].select(F.col(r.ref_column or r.columns[0]).alias("_pk")).where("_pk IS NOT NULL").distinct()
            parent = parent.withColumn("_at", F.pmod(F.hash("_pk"), F.lit(1)))  # 0 as a value of the key, so that it stays a join key
            fk = F.col(r.columns[0])
            out = out.withColumn("_spread", _spread(fk.isNull())).join(parent, (fk == F.col("_pk")) & (F.col("_spread") == F.col("_at")), "left")
            out = out.withColumn(name, fk.isNotNull() & F.col("_at").isNull()).drop("_pk", "_at", "_spread")
        else:
            bad = violation(df, r)
            if bad is None:
                continue
            out = out.withColumn(name, bad)
        judged.append((r, name))
    return out, judged


def mark_repeats(df: DataFrame, cols: list[str], order: list[str], mark: str) -> DataFrame:
    """Boolean ``mark``: true for every row of a non-null key but the first by the other columns of ``order``.

    A first pass over the key columns alone finds the keys that repeat, a table that is written and whose size
    Spark then knows; only rows of such keys go on to an exchange, each distinct one once, with a digest that
    tells equal rows apart. Maps are ordered by their text; copies of a row are dealt to tasks before they are
    written out again. An empty table gives an empty one; the values of rows are never changed.
    """
    keys = [f"_k{i}" for i in range(len(cols))]
    no_key = F.greatest(F.lit(False), F.lit(False), *[F.col(c).isNull() for c in cols])
    counts = df.where(~no_key).groupBy(*[F.col(c).alias(k) for c, k in zip(cols, keys)]).agg(F.count(F.lit(1)).alias("_n"))
    path = scratch_path(df.sparkSession, "repeated")
    counts.where("_n > 1").select(*keys, F.lit(0).alias("_at")).write.parquet(path)
    again = df.sparkSession.read.parquet(path)

    meet = F.col("_spread") == F.col("_at")
    for c, k in zip(cols, keys):
        meet = meet & (F.col(c) == F.col(k))
    met = df.withColumn("_spread", _spread(no_key)).join(again, meet, "left")
    once = met.where(F.col("_at").isNull()).select(*df.columns, F.lit(False).alias(mark))

    row = F.col("_row")
    others = [ordered(row[c], df.schema[c].dataType) for c in order if c not in cols]
    same = equal_rows(met.where(F.col("_at").isNotNull()).select(*df.columns), [F.col(c).alias(k) for c, k in zip(cols, keys)])
    firsts = same.groupBy(*keys).agg(F.min(F.struct(*others, "_digest"))["_digest"].alias("_first"))
    each = numbered(same.join(firsts.select("_first"), F.col("_digest") == F.col("_first"), "left"))
    repeats = each.select("_row.*", (F.col("_first").isNull() | (F.col("_copy") > 1)).alias(mark))
    return once.unionByName(repeats)


def _spread(absent: Column) -> Column:
    """0, but for rows whose key is absent a number of their input partition: as part of a join key it keeps such rows, which
    meet nothing, from gathering in one task."""
    return F.when(absent, F.spark_partition_id() + 1).otherwise(F.lit(0))


def enforce(df: DataFrame, rules: list[Rule], tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """Rule effects of all eight kinds applied to the rows.

    Every rule is judged on the incoming values, then:
    * clip (range): value coerced to double and clipped; unparseable text becomes null.
    * reject: violating rows removed.
    * impute: violating cells replaced by the median (numeric) or mode (others) of the cells that
      break no impute rule of their column.
    * flag: ``_violations`` array column names the rules a row breaks.

    ``tables`` holds the parents of referential rules.
    """
    return apply_actions(*with_violations(df, rules, tables))


def apply_actions(out: DataFrame, judged: list, fills_from: DataFrame | None = None) -> DataFrame:
    """The actions of rules already judged (``with_violations``); imputed values come from ``fills_from`` (default: the rows)."""
    fills_from = out if fills_from is None else fills_from
    rewrites, flags, rejects = {}, [], []
    for r, name in judged:
        c = r.columns[0]
        cur = rewrites.get(c, F.col(c))
        if r.action == "clip" and r.kind == "range":
            v = cur.cast("string").try_cast("double")
            if r.min_value is not None:
                v = F.when(v.isNull(), v).otherwise(F.greatest(v, F.lit(float(r.min_value))))
            if r.max_value is not None:
                v = F.when(v.isNull(), v).otherwise(F.least(v, F.lit(float(r.max_value))))
            rewrites[c] = v
        elif r.action == "reject":
            rejects.append(F.col(name))
        elif r.action == "impute":
            bad = [n for q, n in judged if q.action == "impute" and q.columns[0] == c]
            fill = _impute_value(fills_from.where(~F.greatest(*[F.col(n) for n in bad], F.lit(False))), c)
            rewrites[c] = F.when(F.col(name), F.lit(fill).cast(out.schema[c].dataType)).otherwise(cur)
        elif r.action == "flag":
            flags.append(F.when(F.col(name), F.lit(r.name)))
    if rejects:
        out = out.where(~F.greatest(*rejects) if len(rejects) > 1 else ~rejects[0])
    if rewrites:
        out = out.withColumns(rewrites)
    if flags:
        out = out.withColumn("_violations", F.array_compact(F.array(*flags)))
    return out.drop(*[name for _, name in judged])


def _impute_value(df: DataFrame, c: str):
    if isinstance(df.schema[c].dataType, T.NumericType):
        return exact_median(df, c)
    row = (df.where(F.col(c).isNotNull()).groupBy(c).count()
           .orderBy(F.desc("count"), F.asc(c)).limit(1).first())
    return row[c] if row else None


def violation_log(df: DataFrame, rules: list[Rule], tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """One aggregate over all rules; rows (rule, column, count, action) for count > 0."""
    marked, judged = with_violations(df, rules, tables)
    if not judged:
        return df.sparkSession.createDataFrame([], "rule string, column string, count bigint, action string")
    agg = marked.agg(*[F.count_if(F.col(n)).cast("long").alias(n) for _, n in judged])
    structs = [F.struct(F.lit(r.name).alias("rule"), F.lit(r.columns[0]).alias("column"),
                        F.col(n).alias("count"), F.lit(r.action).alias("action")) for r, n in judged]
    return (agg.select(F.explode(F.array(*structs)).alias("x")).select("x.*").where(F.col("count") > 0))


def rule_unique(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows whose key appears more than once (all copies after the first by the remaining columns)."""
    return mark_repeats(df, cols, df.columns, "_rep").where("_rep").drop("_rep")


def unique_violations(df: DataFrame, cols: list[str]) -> DataFrame:
    """Non-null rows minus distinct non-null keys, one row; aggregated per key with map-side combine."""
    nn = df.where(F.greatest(*[F.col(c).isNull() for c in cols]) == F.lit(False)) if len(cols) > 1 \
        else df.where(F.col(cols[0]).isNotNull())
    return (nn.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
            .agg(F.coalesce(F.sum(F.col("_n") - F.lit(1)), F.lit(0)).cast("long").alias("violations")))


def referential_orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Child rows whose non-null foreign key has no parent (left-anti join)."""
    p = parent.select(F.col(pk).alias("_pk")).distinct()
    return child.where(F.col(fk).isNotNull()).join(p, F.col(fk) == F.col("_pk"), "left_anti")


# ----------------------------------------------------------------- rule sources


def rules_from_schema(spec: TableSpec) -> list[Rule]:
    """range -> clip/high, enum -> flag/medium, unique or PK -> reject/critical, non-nullable -> flag/high."""
    out = []
    for c in spec.columns:
        q = f"{spec.name}.{c.name}"
        if c.min_value is not None or c.max_value is not None:
            out.append(Rule(f"{q}_range", "range", (c.name,), "clip", "high", c.min_value, c.max_value))
        if c.enum_values:
            out.append(Rule(f"{q}_enum", "enum", (c.name,), "flag", "medium", values=tuple(c.enum_values)))
        if c.unique or c.primary_key:
            out.append(Rule(f"{q}_unique", "unique", (c.name,), "reject", "critical"))
        if not c.nullable:
            out.append(Rule(f"{q}_not_null", "not_null", (c.name,), "flag", "high"))
    return out


def rules_from_dag(dag: list[DagRule], table: str = "t") -> list[Rule]:
    return [Rule(f"{table}.{d.child}_causal", "causal", (d.child, *d.all_parents), "flag", "high",
                 expression=d.expression) for d in dag]


def merge_rules(*sources: list[Rule]) -> list[Rule]:
    """Ordered merge; the first rule of a name wins."""
    seen, out = set(), []
    for src in sources:
        for r in src:
            if r.name not in seen:
                seen.add(r.name)
                out.append(r)
    return out


def rules_from_json_frame(raw: DataFrame) -> DataFrame:
    """Clean a table of rule items (name, type, columns, severity, action, parameters/expression).

    Unknown kind -> expression; unknown severity -> medium; no name or no columns -> dropped.
    """
    kinds = F.array(*[F.lit(k) for k in KINDS])
    sev = F.array(*[F.lit(s) for s in SEVERITIES])
    kind = F.lower(F.trim(F.col("type")))
    s = F.lower(F.trim(F.col("severity")))
    return (raw.where(F.col("name").isNotNull() & (F.trim(F.col("name")) != "")
                      & F.col("columns").isNotNull() & (F.size("columns") > 0))
            .select(
                F.col("name"),
                F.when(F.array_contains(kinds, kind), kind).otherwise(F.lit("expression")).alias("kind"),
                F.col("columns"),
                F.when(F.array_contains(sev, s), s).otherwise(F.lit("medium")).alias("severity"),
            ))
