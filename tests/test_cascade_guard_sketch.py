"""Rejects across tables, guarded rule expressions and mergeable profiles."""

import numpy as np
import pytest

from weft.operators import cascade as CA
from weft.operators import constraints as C
from weft.operators import guard as GD
from weft.operators import scale as SC
from weft.operators import sketch_profile as SP
from weft.plans.spec import Relationship, Rule
from weft.sources import files as FS

STAFF = "id long, boss long, pay int"
LOW = [Rule("pay", "range", ("pay",), "reject", min_value=10.0)]


def brute(rows, bad):
    gone = {r[0] for r in rows if bad(r)} | {r[0] for r in rows if r[1] is not None and r[1] not in {x[0] for x in rows}}
    while more := {r[0] for r in rows if r[1] in gone} - gone:
        gone |= more
    return sorted(r[0] for r in rows if r[0] not in gone)


def test_self_references_chains_and_cycles(spark):
    r = np.random.default_rng(2)
    rows = [(i, i - 1 if 0 < i < 30 else None, 5 if i == 3 else 50) for i in range(30)]  # a chain of 27 below the rejected one
    rows += [(100 + i, 100 + (i + 1) % 7, 50) for i in range(7)] + [(200 + i, 200 + (i + 1) % 5, 5 if i == 2 else 50) for i in range(5)]  # a clean and a rejected cycle
    rows += [(300 + i, int(r.integers(300, 345)) if i % 4 else None, int(r.integers(8, 99))) for i in range(40)] + [(900, 12345, 50)]  # orphans too
    df = spark.createDataFrame(rows, STAFF).repartition(3)
    out = CA.cascade_reject({"staff": df}, [Relationship("staff", "id", "staff", "boss")], {"staff": LOW})["staff"]
    assert sorted(x.id for x in out.collect()) == brute(rows, lambda x: x[2] < 10)
    _, rounds = CA.rejected_keys({"staff": df}, [Relationship("staff", "id", "staff", "boss")], {"staff": LOW})
    assert rounds >= 27


def test_two_tables_nulls_empty_tables_and_missing_ones(spark):
    parent = spark.createDataFrame([(1, None, 50), (2, None, 5), (None, None, 50)], STAFF)
    child = spark.createDataFrame([(10, 1, 1), (11, 2, 1), (12, None, 1), (13, 99, 1)], STAFF)
    rel = [Relationship("p", "id", "c", "boss")]
    ids = lambda o: sorted((x.id for x in o.collect()), key=repr)
    out = CA.cascade_reject({"p": parent, "c": child}, rel, {"p": LOW})
    assert ids(out["p"]) == [1, None] and ids(out["c"]) == [10, 12]
    assert ids(CA.cascade_reject({"p": parent, "c": child}, rel, {"p": LOW}, orphans=False)["c"]) == [10, 12, 13]
    empty = CA.cascade_reject({"p": parent.limit(0), "c": child.limit(0)}, rel, {"p": LOW})
    assert empty["p"].collect() == empty["c"].collect() == []
    with pytest.raises(ValueError):
        CA.cascade_reject({"p": parent}, rel)


GOOD = ["pay > 3", "pay BETWEEN 1 AND 9 OR boss IS NULL", "coalesce(pay, 0) * 2 + 1 >= id % 5", "CASE WHEN pay IN (1, 2) THEN true ELSE id <> 4 END", "cast(pay AS string) LIKE '1%'",
        "length(concat('a', cast(id AS string))) < 9", "NOT (pay <=> 3)", "try_divide(pay, id) > 1", "if(pay > 1, id, boss) = 7"]
BAD = ["pay IN (SELECT 1)", "EXISTS (SELECT 1)", "(SELECT max(pay) FROM staff) > 3", "rand() > 0.5", "uuid() = 'x'", "sum(pay) > 3", "count(DISTINCT pay) > 1", "explode(array(1)) = 1", "pay > ",
       "java_method('java.lang.Runtime', 'x') = 1", "reflect('a', 'b') = ''", "current_timestamp() > '2020-01-01'", "nobody > 3", "pay + 1", "a.b.c(pay)", "row_number() OVER (ORDER BY pay) = 1",
       "transform(array(1), x -> x) = array(1)", "input_file_name() = ''", "pay > 1; DROP TABLE t"]


def test_the_guard(spark):
    df = spark.createDataFrame([(1, 2, 3)], STAFF)
    for e in GOOD:
        assert GD.checked(df, e, "boolean") == e
    for e in BAD:
        with pytest.raises(GD.RefusedExpression):
            GD.checked(df, e, "boolean")
    spark.udf.register("own_udf", lambda x: x)
    with pytest.raises(GD.RefusedExpression):
        GD.checked(df, "own_udf(pay) = '3'", "boolean")


def test_a_failing_causal_rule_is_a_null_per_row(spark):
    from weft.operators.generate import causal_derive
    from weft.plans.spec import DagRule

    df = spark.createDataFrame([(2147483647, 0, "x"), (7, 2, "3")], "a int, b int, t string")
    rules = [DagRule("a", "up", "a + 1"), DagRule("a", "per", "a / b", ("a", "b")), DagRule("t", "n", "cast(t AS int) * 2"), DagRule("a", "neg", "-a - 5"),
             DagRule("a", "kind", "CASE WHEN a % b = 1 AND NOT (b IS NULL) THEN 'odd' ELSE concat('x', t) END", ("a", "b", "t"))]
    got = [tuple(r) for r in causal_derive(df, rules).orderBy("a").select("up", "per", "n", "neg", "kind").collect()]
    assert got == [(8, 3.5, 6, -12, "odd"), (None, None, None, None, "xx")]
    assert [r.same for r in causal_derive(df, [DagRule("t", "same", "t = 3")]).orderBy("a").collect()] == [True, None]
    assert GD.null_on_failure(df, "a +") is None and GD.null_on_failure(df, "to_date(t)") is None


def test_rules_of_json_are_enforceable(spark):
    df = spark.createDataFrame([(i, i, 10 * i) for i in range(6)], STAFF)
    text = """[{"name": "a", "type": "range", "columns": ["pay"], "action": "CLIP", "parameters": {"max": 30}},
               {"name": "b", "type": "expression", "columns": ["id"], "action": "reject", "parameters": {"expression": "id <> 2"}},
               {"name": "c", "type": "range", "columns": ["pay"]}, {"name": "d", "type": "enum", "columns": ["nope"], "parameters": {"values": [1]}},
               {"name": "e", "type": "expression", "columns": ["id"]}, {"type": "range"}, 7, {"name": "f", "type": "range", "columns": ["pay"], "parameters": {"min": "many"}}]"""
    rules, refused = GD.rules_of_json(df, text)
    assert [(r.name, r.kind, r.action, r.severity) for r in rules] == [("a", "range", "clip", "medium"), ("b", "expression", "reject", "medium")]
    assert [n for n, _ in refused] == ["c", "d", "e", "item 5", "item 6", "f"] and all(why for _, why in refused)
    assert sorted((r.id, r.pay) for r in C.enforce(df, rules).collect()) == [(0, 0.0), (1, 10.0), (3, 30.0), (4, 30.0), (5, 30.0)]
    with pytest.raises(ValueError):
        GD.rules_of_json(df, "not json")


def test_a_new_part_is_all_that_is_read_and_merges_like_the_whole(spark):
    df = spark.range(30000).selectExpr("id", "if(id % 50 = 0, null, cast(id % 700 as double)) as v", "concat('k', id % 9) as s", "array(id) as a")
    path = FS.scratch_path(spark, "sketch")
    for k in range(3):
        SP.add_part(df.where(f"id % 3 = {k}"), path, f"day{k}")
    with pytest.raises(ValueError):
        SP.add_part(df, path, "day1")
    m = {r.column_name: r for r in SP.merged(spark, path).collect()}
    v = np.array([i % 700 for i in range(30000) if i % 50], float)
    assert (m["v"].n_rows, m["v"].n_null, m["v"].min_value, m["v"].max_value) == (30000, 600, 1.0, 699.0)
    assert abs(m["v"].mean - v.mean()) < 1e-9 and abs(m["v"].std - v.std(ddof=1)) < 1e-9
    assert abs(m["v"].n_distinct - 700) < 28 and abs(m["v"].q50 - np.median(v)) < 0.02 * 700 and abs(m["id"].n_distinct - 30000) < 1200
    assert (m["s"].n_distinct, m["s"].mean, m["s"].q50) == (9, None, None) and abs(m["a"].n_distinct - 30000) < 1200
    one = {r.column_name: r for r in SP.merged(spark, path, ["day1"]).collect()}
    assert one["id"].n_rows == 10000
    shared = {r.column_name: r for r in SP.shared_values(spark, path, ["day0"], ["day1"]).collect()}
    assert shared["id"].n_common < 50 and abs(shared["v"].jaccard - 1) < 0.05
    gap = {r.column_name: r.distance for r in SP.shift(spark, path, ["day0"], ["day1"]).collect()}
    assert set(gap) == {"id", "v"} and all(x < 0.03 for x in gap.values())


def test_an_empty_part_changes_nothing(spark):
    df = spark.createDataFrame([(1, 2, 3.0), (2, None, float("nan"))], "a int, b int, c double")
    path = FS.scratch_path(spark, "sketch")
    SP.add_part(df.limit(0), path, "none")
    assert {(r.column_name, r.n_rows, r.mean, r.q50) for r in SP.merged(spark, path).collect()} == {(c, 0, None, None) for c in "abc"}
    SP.add_part(df, path, "some")
    got = {r.column_name: (r.n_rows, r.n_null, r.n_distinct, r.mean, r.std) for r in SP.merged(spark, path).collect()}
    assert got["a"] == (2, 0, 2, 1.5, pytest.approx(0.5 ** 0.5)) and got["b"] == (2, 1, 1, 2.0, None) and got["c"] == (2, 1, 1, 3.0, None)


def test_nearest_correlation_of_infeasible_targets():
    bad = np.array([[1, .9, -.9], [.9, 1, .9], [-.9, .9, 1]])
    near = SC.nearest_correlation(bad)
    assert np.allclose(np.diag(near), 1) and np.allclose(near, near.T) and np.linalg.eigvalsh(near).min() > 0
    good = np.array([[1, .5], [.5, 1]])
    assert np.array_equal(SC.nearest_correlation(good), good)
    r = np.random.default_rng(3)
    for _ in range(20):
        a = np.clip(r.uniform(-1, 1, (5, 5)), -1, 1)
        a = np.triu(a, 1) + np.triu(a, 1).T + np.eye(5)
        near = SC.nearest_correlation(a)
        assert np.linalg.eigvalsh(near).min() > 0
        for _ in range(30):  # no other correlation matrix tried is nearer
            b = r.standard_normal((5, 7))
            c = np.corrcoef(b @ b.T) if r.random() < .2 else (1 - (t := r.uniform(0, .2))) * near + t * np.corrcoef(b)
            assert np.linalg.norm(a - near) <= np.linalg.norm(a - c) + 1e-6


def test_iman_conover_with_an_infeasible_target(spark):
    df = spark.range(3000).selectExpr("id", "cast(id % 97 as double) a", "cast(id * 7 % 101 as double) b", "cast(id * 13 % 89 as double) c")
    bad = np.array([[1, .9, -.9], [.9, 1, .9], [-.9, .9, 1]])
    out, report = SC.iman_conover_report(df, ["a", "b", "c"], bad, ["id"], 4)
    assert sorted(r.a for r in out.collect()) == sorted(float(i % 97) for i in range(3000))
    rows = {(r.col_a, r.col_b): r for r in report.collect()}
    assert len(rows) == 3 and rows["a", "b"].target == 0.9 and rows["a", "b"].used < 0.9
    assert all(abs(r.achieved - r.used) < 0.1 for r in rows.values())
