"""Rejecting rows across related tables: what refers to a rejected row is rejected too, to a fixpoint.

Only keys travel: each round joins the child tables with the parent keys that the round before
removed, never with all removed keys, and stops when a round removes none. Chains take one round a
table; cycles and self-references as many as the longest chain of references into a rejected row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators import constraints as C
from weft.plans.spec import Relationship, Rule
from weft.session import cut_lineage


def rejected_keys(tables: dict[str, DataFrame], relations: list[Relationship], rules: dict[str, list[Rule]],
                  orphans: bool = True, max_rounds: int = 1000) -> tuple[dict[tuple[str, str], DataFrame], int]:
    """({(table, key column): removed key values}, rounds) for every column that a relation refers to.

    Such a column must be a key of its table (unique where it is not null). ``rules`` are judged on the
    incoming rows; those with action ``reject`` remove them. With ``orphans`` a row whose foreign key has no parent
    in the given tables is removed as well. A null foreign key refers to nothing; a row without a key
    value is removed with its references, but nothing can refer to it.
    """
    for r in relations:
        if r.parent_table not in tables or r.child_table not in tables:
            raise ValueError(f"relation {r.parent_table} -> {r.child_table}: a table is not given")
    keys: dict[str, list[str]] = {}
    for r in relations:
        keys.setdefault(r.parent_table, [])
        if r.parent_column not in keys[r.parent_table]:
            keys[r.parent_table].append(r.parent_column)

    judged = {t: first_rejects(df, t, tables, relations, rules.get(t, []), orphans) for t, df in tables.items() if t in keys}
    removed = {}
    for t, k in ((t, k) for t in keys for k in keys[t]):  # a key that another row keeps is not removed
        each = judged[t].groupBy(F.col(k).alias("key")).agg(F.min("_bad").alias("all_bad")).where("key is not null and all_bad")
        removed[t, k] = cut_lineage(each.select("key"))
    fresh = dict(removed)
    for rounds in range(1, max_rounds + 1):
        new: dict[tuple[str, str], list[DataFrame]] = {}
        for r in relations:
            delta = fresh.get((r.parent_table, r.parent_column))
            if delta is None or r.child_table not in keys:  # nobody refers to the child
                continue
            hit = tables[r.child_table].join(delta.withColumnRenamed("key", "_gone"), F.col(r.child_column) == F.col("_gone"), "left_semi")
            for k in keys[r.child_table]:
                new.setdefault((r.child_table, k), []).append(hit.select(F.col(k).alias("key")).where("key is not null"))
        fresh = {}
        for at, parts in new.items():
            found = parts[0]
            for p in parts[1:]:
                found = found.unionByName(p)
            found = cut_lineage(found.distinct().join(removed[at], "key", "left_anti"))
            if not found.isEmpty():
                fresh[at] = found
        if not fresh:
            return removed, rounds
        for at, found in fresh.items():
            removed[at] = cut_lineage(removed[at].unionByName(found))
    raise RuntimeError(f"rejection did not settle in {max_rounds} rounds")


def first_rejects(df: DataFrame, name: str, tables: dict[str, DataFrame], relations: list[Relationship], rules: list[Rule], orphans: bool) -> DataFrame:
    """The rows of a table with ``_bad``: they break a rejecting rule, or (with ``orphans``) refer to a key that is not there."""
    marked, judged = C.with_violations(df, [r for r in rules if r.action == "reject"], tables)
    cond = F.greatest(*[F.col(n) for _, n in judged], F.lit(False)) if judged else F.lit(False)
    for i, r in enumerate(x for x in relations if orphans and x.child_table == name):
        there = tables[r.parent_table].select(F.col(r.parent_column).alias(f"_pk{i}")).where(f"_pk{i} is not null").distinct().withColumn(f"_has{i}", F.lit(True))
        marked = marked.join(there, F.col(r.child_column) == F.col(f"_pk{i}"), "left")
        cond = cond | (F.col(r.child_column).isNotNull() & F.col(f"_has{i}").isNull())
    return marked.select(*df.columns, cond.alias("_bad"))


def cascade_reject(tables: dict[str, DataFrame], relations: list[Relationship], rules: dict[str, list[Rule]] | None = None,
                   orphans: bool = True) -> dict[str, DataFrame]:
    """Every table without the rows that are rejected by a rule, or refer (through any number of tables) to one that is.

    The result has no dangling reference among the given tables and relations. Repeated rows are kept or removed alike; empty
    tables stay empty.
    """
    rules = rules or {}
    removed, _ = rejected_keys(tables, relations, rules, orphans)
    out = {}
    for name, df in tables.items():
        keep = df
        for r in (x for x in relations if x.child_table == name):
            gone = removed[r.parent_table, r.parent_column].withColumnRenamed("key", "_gone")
            keep = keep.join(gone, F.col(r.child_column) == F.col("_gone"), "left_anti")  # a null key refers to nothing and stays
            if orphans:
                there = tables[r.parent_table].select(F.col(r.parent_column).alias("_pk")).where("_pk is not null").distinct()
                given, none = keep.where(F.col(r.child_column).isNotNull()), keep.where(F.col(r.child_column).isNull())
                keep = given.join(there, F.col(r.child_column) == F.col("_pk"), "left_semi").unionByName(none)
        rejecting = [r for r in rules.get(name, []) if r.action == "reject"]
        out[name] = C.enforce(keep, rejecting, tables) if rejecting and all(r.kind != "unique" for r in rejecting) else _without(keep, df, rejecting, tables)
    return out


def _without(keep: DataFrame, whole: DataFrame, rules: list[Rule], tables: dict[str, DataFrame]) -> DataFrame:
    """``keep`` without the rows that break ``rules`` when judged on the whole incoming table (a unique rule needs all rows)."""
    if not rules:
        return keep
    good = C.enforce(whole, rules, tables)
    return keep.intersectAll(good)
