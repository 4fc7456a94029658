from collections import defaultdict

import duckdb

from weft.llm.line_dedup import line_dedup
from weft.llm.queries import ORACLES, QUERIES

SF_SMALL = "/root/testdata/sf0.001"


def brute(pairs, run, min_words=0):
    """text -> kept text per (id, text), first places by (id, text order as given by the operator's hash: unused here)."""
    seen, gone = {}, defaultdict(set)
    for d, t in pairs:
        ls = t.split("\n")
        for i in range(len(ls) - run + 1):
            w = tuple(ls[i: i + run])
            if seen.setdefault(w, (d, i)) != (d, i):
                gone[d] |= set(range(i, i + run))
        for i in [i for i in gone[d] if i - 1 not in gone[d]]:
            end = next(j for j in range(i, len(ls) + 1) if j not in gone[d])
            if sum(len(x.encode().split()) for x in ls[i:end]) < min_words:
                gone[d] -= set(range(i, end))
    return {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[d]) for d, t in pairs}


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{SF_SMALL}/documents.parquet')")
    got = QUERIES["op2_line_dedup"](spark, SF_SMALL)
    want = con.sql(f"select {', '.join(got.columns)} from ({ORACLES['op2_line_dedup']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_other_lengths_against_brute_force(spark):
    import random

    rnd = random.Random(3)
    pairs = [(d, "\n".join(rnd.choice(["a", "b", "c", "", "a b\x0b c", " "]) for _ in range(rnd.randint(1, 25)))) for d in range(60)]
    df = spark.createDataFrame(pairs, "doc_id long, text string")
    for gram, window, words in ((1, 1, 0), (1, 3, 0), (2, 3, 0), (3, 2, 0), (1, 1, 5), (2, 2, 9)):
        got = dict(map(tuple, line_dedup(df, gram=gram, window=window, min_words=words).select("doc_id", "text").collect()))
        assert got == brute(pairs, gram + window - 1, words), (gram, window, words)


def test_messy_rows(spark, messy, no_docs, clashing):
    out = line_dedup(messy)
    assert out.columns == [*messy.columns, "n_lines", "n_removed", "n_runs"]
    assert out.count() == messy.count()
    by = {r["doc_id"]: r for r in out.collect()}
    assert by[4]["text"] is None and by[4]["n_lines"] == 0
    assert by[7]["n_removed"] == 0
    assert by[8]["text"] == "start\nend" and by[8]["n_runs"] == 1
    assert by[9]["text"] == "own line of nine" and by[9]["n_removed"] == 3
    assert by[14]["n_removed"] == 0 and by[5]["text"] == ""
    assert line_dedup(no_docs).collect() == []
    assert {r["doc_id"]: r["text"] for r in line_dedup(clashing).collect()} == {r["doc_id"]: r["text"] for r in out.collect()}


def test_native_plan(spark, messy):
    plan = line_dedup(messy, gram=1, window=1, min_words=5)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
