"""Generation from specs: samplers, typed defaults, whole tables, foreign keys, causal rules.

A spec compiles to Column expressions over a row spine (a key column of an existing
table or a ``spark.range``); generation is one narrow stage -- no shuffle, no Python per row.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence
from contextlib import contextmanager, nullcontext

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions import rand as R
from weft.operators.guard import null_on_failure
from weft.operators.rank import dense_index
from weft.plans.spec import ColumnSpec, DagRule, Dist, Relationship, TableSpec

# fixed values: default parameters per distribution
DEFAULT_PARAMS = {
    "normal": {"mean": 0.0, "std": 1.0},
    "lognormal": {"mean": 10.5, "sigma": 0.8},
    "truncated_normal": {"mean": 40.0, "std": 15.0, "low": 0.0, "high": 120.0},
    "uniform": {"low": 0.0, "high": 1.0},
    "exponential": {"scale": 1.0},
    "poisson": {"mu": 5.0},
    "beta": {"a": 2.0, "b": 5.0},
    "bernoulli": {"p": 0.5},
    "gamma": {"a": 2.0, "scale": 1.0},
    "weibull": {"a": 1.5},
}

# fixed values: distribution required by a semantic type (others are accepted as given)
SEMANTIC_RULES = [
    ("salary", "lognormal"), ("income", "lognormal"), ("wage", "lognormal"), ("revenue", "lognormal"),
    ("price", "lognormal"), ("cost", "lognormal"), ("amount", "lognormal"), ("age", "truncated_normal"),
    ("years", "truncated_normal"), ("duration", "exponential"), ("tenure", "exponential"), ("count", "poisson"),
    ("quantity", "poisson"), ("number", "poisson"), ("probability", "beta"), ("rate", "beta"),
    ("proportion", "beta"), ("boolean", "bernoulli"), ("flag", "bernoulli"), ("credit_score", "beta"),
    ("score", "beta"),
]


def _p(d: Dist, name: str):
    base = DEFAULT_PARAMS.get(_kind(d.kind), {})
    return d.params.get(name, base.get(name))


def _kind(k: str) -> str:
    return {"truncnorm": "truncated_normal"}.get(k, k)


def sample(d: Dist, seed, tag: str, keys: Sequence) -> Column:
    """Column drawing one value of distribution ``d`` per row, keyed on (seed, tag, keys)."""
    k = _kind(d.kind)
    if k == "normal":
        x = R.normal(seed, tag, keys, _p(d, "mean"), _p(d, "std"))
    elif k == "lognormal":
        x = R.lognormal(seed, tag, keys, _p(d, "mean"), _p(d, "sigma"))
    elif k == "truncated_normal":
        x = R.truncnorm(seed, tag, keys, _p(d, "mean"), _p(d, "std"), _p(d, "low"), _p(d, "high"))
    elif k == "uniform":
        x = R.uniform(seed, tag, keys, _p(d, "low"), _p(d, "high"))
    elif k == "exponential":
        x = R.exponential(seed, tag, keys, _p(d, "scale"))
    elif k == "poisson":
        x = R.poisson(seed, tag, keys, _p(d, "mu"))
    elif k == "beta":
        x = R.beta(seed, tag, keys, _p(d, "a"), _p(d, "b"))
    elif k == "bernoulli":
        x = R.bernoulli(seed, tag, keys, _p(d, "p"))
    elif k == "gamma":
        x = R.gamma(seed, tag, keys, _p(d, "a"), _p(d, "scale"))
    elif k == "weibull":
        x = R.weibull(seed, tag, keys, _p(d, "a"), d.params.get("scale", 1.0))
    elif k == "categorical":
        x = R.categorical(seed, tag, keys, list(d.values), list(d.weights) or None)
    elif k == "mixture":
        comp = R.index_by_cdf(R.uniform01(seed, f"{tag}#mix", keys), R.cumulative(list(d.weights)))
        x = F.lit(None).cast("double")
        for i in reversed(range(len(d.components))):
            x = F.when(comp == i, sample(d.components[i], seed, f"{tag}#c{i}", keys)).otherwise(x)
    else:
        raise ValueError(f"unknown distribution {d.kind}")
    if k != "categorical" and (d.clip_min is not None or d.clip_max is not None):
        x = R.clip(x, d.clip_min, d.clip_max)
    return x


def required_distribution(semantic_type: str | None, kind: str) -> str:
    rules = dict(SEMANTIC_RULES)
    if not semantic_type:
        return kind
    return rules.get(semantic_type.lower(), kind)


def override_frame(spark) -> DataFrame:
    """The semantic-type rules as a small table (semantic_type, required)."""
    return spark.createDataFrame(SEMANTIC_RULES, "semantic_type string, required string")


def distribution_override(specs: DataFrame, sem_col: str, dist_col: str, rules: DataFrame) -> DataFrame:
    """Rows of (column, semantic type, proposed distribution) -> corrected distribution via a
    broadcast join to the rules table (21 rows)."""
    r = F.broadcast(rules.select(F.col("semantic_type").alias("_st"), "required"))
    j = specs.join(r, F.lower(specs[sem_col]) == r["_st"], "left")
    return j.withColumn("distribution", F.coalesce(F.col("required"), F.col(dist_col))).drop("_st", "required")


def default_column(c: ColumnSpec, table: str, seed, idx: Column, keys: Sequence) -> Column:
    """Typed default generator: PK uuid; enum choice; integer 1..999; float N(50, 15);
    boolean; consecutive days from 2020-01-01; text ``name_i``."""
    t = (c.data_type or "string").lower()
    if c.primary_key:
        return R.uuid_like(F.concat_ws(":", F.lit(str(seed)), F.lit(table), F.lit(c.name), idx.cast("string")))
    if c.enum_values:
        return R.categorical(seed, c.name, keys, list(c.enum_values))
    if t == "integer":
        return (F.lit(1) + F.floor(R.uniform01(seed, c.name, keys) * F.lit(999))).cast("long")
    if t == "float":
        return R.normal(seed, c.name, keys, 50.0, 15.0)
    if t == "boolean":
        return R.uniform01(seed, c.name, keys) < F.lit(0.5)
    if t in ("datetime", "date"):
        d = F.date_add(F.lit("2020-01-01").cast("date"), idx.cast("int"))
        return d if t == "date" else d.cast("timestamp_ntz")
    return F.concat(F.lit(f"{c.name}_"), idx.cast("string"))


def spec_column(c: ColumnSpec, table: str, seed, idx: Column, keys: Sequence) -> Column:
    """Column from a spec: distribution if given, enum -> uniform choice, boolean -> p=0.5,
    numeric -> chosen from its meaning, name and type; integers rounded; clipped to min/max."""
    t = (c.data_type or "string").lower()
    if c.primary_key or (t not in ("integer", "float", "boolean") and not c.enum_values and not c.distribution):
        return default_column(c, table, seed, idx, keys)
    if c.enum_values and t == "string":
        return R.categorical(seed, c.name, keys, list(c.enum_values))
    if t == "boolean":
        return R.uniform01(seed, c.name, keys) < F.lit(0.5)
    d = c.distribution
    if d is not None:
        d = Dist(required_distribution(c.semantic_type, d.kind), d.params, d.clip_min, d.clip_max, d.values,
                 d.weights, d.components)
    else:
        d = meant_distribution(c) or (Dist("poisson", {"mu": 10.0}) if t == "integer" else Dist("normal", {"mean": 0.0, "std": 1.0}))
    x = sample(d, seed, c.name, keys)
    if c.min_value is not None or c.max_value is not None:
        x = R.clip(x, c.min_value, c.max_value)
    return F.round(x).cast("long") if t == "integer" else x


def topological_order(rules: list[DagRule]) -> list[DagRule]:
    """Rules ordered parents-before-children (Kahn's algorithm, alphabetical ties); a cycle raises.
    Rules on the same child keep their given order."""
    children = {r.child for r in rules}
    nodes = sorted({p for r in rules for p in r.all_parents} | children)
    deps = {n: set() for n in nodes}
    for r in rules:
        for p in r.all_parents:
            if p != r.child:
                deps[r.child].add(p)
            else:
                raise ValueError(f"self-loop on {p}")
    order, ready = [], sorted(n for n in nodes if not deps[n])
    while ready:
        n = ready.pop(0)
        order.append(n)
        for m in nodes:
            if n in deps[m]:
                deps[m].discard(n)
                if not deps[m] and m not in order and m not in ready:
                    ready.append(m)
                    ready.sort()
    if len(order) != len(nodes):
        raise ValueError("cycle in causal rules")
    pos = {n: i for i, n in enumerate(order)}
    return sorted(rules, key=lambda r: pos[r.child])  # stable: same-child rules keep their order


def causal_derive(df: DataFrame, rules: list[DagRule]) -> DataFrame:
    """Apply rules in topological order: child := expr, skipped when a parent column is missing;
    a row where the expression fails or gives null keeps its old child value (if any), and a rule
    that cannot be analysed at all changes nothing. Overflow, division by zero and bad casts fail a row
    (``try_`` functions, the session's settings are left alone); only expressions with parts that have
    no such form are analysed without ANSI checks, where an integer overflow wraps."""
    out = df
    for r in topological_order(rules):
        if any(p not in out.columns for p in r.all_parents):
            continue
        tolerant = null_on_failure(out, r.expression)
        with nullcontext() if tolerant else _failing_as_null(df.sparkSession):
            try:
                new = F.expr(tolerant or r.expression)
                out = out.withColumn(r.child, F.coalesce(new, F.col(r.child)) if r.child in out.columns else new)
            except (AnalysisException, ParseException):
                continue
    return out


@contextmanager
def _failing_as_null(spark):
    """Expressions analysed inside give null where they would fail (division by zero, bad casts)."""
    key = "spark.sql.ansi.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, old)


def conditional(conditions: list[tuple[str, object, int]], default) -> Column:
    """First true condition by priority (highest first; equal priorities keep list order), else default."""
    ordered = sorted(enumerate(conditions), key=lambda t: (-t[1][2], t[0]))
    out = F.lit(default)
    for _, (cond, value, _) in reversed(ordered):
        out = F.when(F.coalesce(F.expr(cond), F.lit(False)), F.lit(value)).otherwise(out)
    return out


def generate_table(spine: DataFrame, key_col: str, spec: TableSpec, seed: int, dag: list[DagRule] = (),
                   default_only: bool = False) -> DataFrame:
    """One row per spine row: independent columns, then causal columns, then per-column nulls.

    ``key_col`` is a unique integer key of the spine (e.g. a table's primary key or ``id`` of
    ``spark.range``); it keys every draw and numbers rows for uuids and dates.
    """
    idx = F.col(key_col)
    keys = [idx]
    cols = {}
    for c in spec.columns:
        cols[c.name] = (default_column if default_only else spec_column)(c, spec.name, seed, idx, keys)
    out = spine.select(idx.alias("_row"), *[v.alias(k) for k, v in cols.items()])
    if dag:
        out = causal_derive(out, list(dag))
    nulls = {c.name: F.when(R.uniform01(seed, f"null:{c.name}", [F.col("_row")]) >= F.lit(c.null_rate), F.col(c.name))
             for c in spec.columns if c.null_rate > 0 and not c.primary_key}
    if nulls:
        out = out.withColumns(nulls)
    return out.drop("_row")


def fk_child(child_spine: DataFrame, child_key: str, parent_indexed: DataFrame, parent_idx: str, parent_pk: str,
             n_parent: int, seed: int, fk_name: str) -> DataFrame:
    """Child rows get a parent key drawn uniformly: index floor(U * n_parent) joined to the parent's
    dense index (0..n-1), so every foreign key exists in the parent."""
    draws = child_spine.withColumn(
        "_pidx", F.floor(R.uniform01(seed, f"fk:{fk_name}", [F.col(child_key)]) * F.lit(n_parent)).cast("long"))
    p = parent_indexed.select(F.col(parent_idx).alias("_pidx"), F.col(parent_pk).alias(fk_name))
    return draws.join(p, "_pidx").drop("_pidx")


def one_to_one(child: DataFrame, child_keys: list[str], parent: DataFrame, parent_pk: str, fk_name: str) -> DataFrame:
    """Every child row gets a parent key of its own: child and parent rows are numbered densely in the order of
    their keys' hashes and joined by number. Needs at least as many parents as children; children beyond
    that get a null key."""
    c = dense_index(child, child_keys, "_i")
    p = dense_index(parent.select(F.col(parent_pk).alias(fk_name)), [fk_name], "_j")
    return c.join(p, F.col("_i") == F.col("_j"), "left").drop("_i", "_j")


def many_to_many(left_indexed: DataFrame, left_pk: str, n_left: int, right_indexed: DataFrame, right_pk: str, n_right: int,
                 n_links: int, seed: int, name: str, idx: str = "_idx") -> DataFrame:
    """Link table (left key, right key): ``n_links`` draws of both keys, repeated pairs kept once.

    Both sides come with a dense index ``idx`` (0..n-1), so every key exists in its table.
    """
    spark = left_indexed.sparkSession
    draw = lambda side, n: F.floor(R.uniform01(seed, f"link:{name}:{side}", [F.col("id")]) * F.lit(n)).cast("long")
    pairs = spark.range(n_links).select(draw("a", n_left).alias("_a"), draw("b", n_right).alias("_b")).distinct()
    a = left_indexed.select(F.col(idx).alias("_a"), F.col(left_pk))
    b = right_indexed.select(F.col(idx).alias("_b"), F.col(right_pk))
    return pairs.join(a, "_a").join(b, "_b").select(left_pk, right_pk)


def related(child: DataFrame, child_keys: list[str], parent: DataFrame, rel: Relationship, seed: int) -> DataFrame:
    """The child table with its foreign key by the relationship's kind; for N:M the link table."""
    if rel.kind == "1:1":
        return one_to_one(child, child_keys, parent, rel.parent_column, rel.child_column)
    p = dense_index(parent.select(rel.parent_column), [rel.parent_column], "_idx")
    n = parent.count()
    if rel.kind == "1:N":
        return fk_child(child, child_keys[0], p, "_idx", rel.parent_column, n, seed, rel.child_column)
    if rel.kind == "N:M":
        c = dense_index(child.select(*child_keys), child_keys, "_idx")
        m = child.count()
        return many_to_many(c, child_keys[0], m, p, rel.parent_column, n, m, seed, f"{rel.child_table}:{rel.parent_table}")
    raise ValueError(f"unknown relationship {rel.kind}")


# fixed values: column-name keywords and the semantic type they stand for, in order
NAME_KEYWORDS = [
    ("salary", "salary"), ("pay", "salary"), ("wage", "salary"), ("income", "income"), ("revenue", "salary"), ("amount", "salary"),
    ("age", "age"), ("years", "years"), ("score", "score"), ("rating", "score"), ("count", "count"), ("qty", "count"),
    ("quantity", "count"), ("probability", "probability"), ("rate", "rate"), ("duration", "duration"), ("tenure", "duration"),
    ("is_", "boolean"), ("has_", "boolean"),
]

# fixed values: distribution of a data type that nothing else decides
TYPE_DISTRIBUTIONS = [("integer", "poisson"), ("float", "normal"), ("string", "categorical"), ("datetime", "uniform"),
                      ("date", "uniform"), ("boolean", "bernoulli")]


def choose_distribution(name: Column, data_type: Column, semantic_type: Column, has_enum: Column) -> Column:
    """Distribution kind of a column: enum, boolean, semantic type, name keyword (prefix or suffix), data type."""
    rules = dict(SEMANTIC_RULES)
    low, sem = F.lower(name), F.lower(F.coalesce(semantic_type, F.lit("")))
    out = F.lit("normal")
    for t, kind in reversed(TYPE_DISTRIBUTIONS):
        out = F.when(data_type == t, kind).otherwise(out)
    for kw, meaning in reversed(NAME_KEYWORDS):
        out = F.when(F.startswith(low, F.lit(kw)) | F.endswith(low, F.lit(kw)), rules[meaning]).otherwise(out)
    for t, kind in SEMANTIC_RULES:
        out = F.when(sem == t, kind).otherwise(out)
    return F.when(has_enum, "categorical").when(data_type == "boolean", "bernoulli").otherwise(out)


def meant_distribution(c: ColumnSpec) -> Dist | None:
    """What a column's semantic type or name asks for, with default parameters and the column's bounds."""
    rules, low = dict(SEMANTIC_RULES), c.name.lower()
    kind = rules.get((c.semantic_type or "").lower())
    if kind is None:
        kind = next((rules[m] for kw, m in NAME_KEYWORDS if low.startswith(kw) or low.endswith(kw)), None)
    return Dist(kind, dict(DEFAULT_PARAMS[kind]), c.min_value, c.max_value) if kind else None


# fixed values: metadata columns that fill a short schema, in order, and its least size
FILLERS = [("notes", "string", "notes"), ("category", "string", "category"), ("sub_category", "string", "category"),
           ("region", "string", "region"), ("source", "string", "source"), ("is_active", "boolean", "flag"),
           ("priority", "integer", "priority"), ("updated_at", "datetime", "timestamp"), ("external_id", "string", "id"),
           ("metadata_tags", "string", "tags"), ("confidence_score", "float", "score"), ("version", "integer", "version")]
MIN_COLUMNS = 12


def complete_schema(spec: TableSpec, dag: list[DagRule] = ()) -> TableSpec:
    """A key column if there is none, fillers up to MIN_COLUMNS; the key first, then
    columns outside the DAG by name, then the DAG's columns in its order."""
    cols = list(spec.columns)
    if not any(c.primary_key for c in cols):
        cols.insert(0, ColumnSpec(f"{spec.name}_id", "uuid", False, True, True, semantic_type="id"))
    missing = MIN_COLUMNS - len(cols)
    for i in range(max(0, missing)):
        name, kind, meaning = FILLERS[i] if i < len(FILLERS) else (f"field_{i + 1}", "string", None)
        cols.append(ColumnSpec(name, kind, semantic_type=meaning, null_rate=0.05))
    nodes = []
    for r in topological_order(list(dag)):
        nodes += [n for n in (*r.all_parents, r.child) if n not in nodes]
    place = {n: i + 1 for i, n in enumerate(nodes)}
    return dataclasses.replace(spec, columns=tuple(sorted(cols, key=lambda c: (not c.primary_key, place.get(c.name, 0), c.name))))
