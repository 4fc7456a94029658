import duckdb
import numpy as np

from weft.llm import quality as Q
from weft.llm.queries import ORACLES, QUERIES

SF_SMALL = "/root/testdata/sf0.001"


def sql_rows(df, cols):
    import pandas as pd

    documents = pd.DataFrame([tuple(r) for r in df.select("doc_id", "text").collect()], columns=["doc_id", "text"]).astype({"doc_id": "Int64", "text": "string"})
    con = duckdb.connect()
    con.register("documents", documents)
    return con.sql(f"select {', '.join(cols)} from ({ORACLES['op8_quality_rules']})").fetchall()


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{SF_SMALL}/documents.parquet')")
    got = QUERIES["op8_quality_rules"](spark, SF_SMALL)
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(f"select {', '.join(got.columns)} from ({ORACLES['op8_quality_rules']})").fetchall())


def test_messy_rows_equal_sql(spark, messy, no_docs, clashing):
    got = Q.quality_measures(messy, keep=["doc_id"])
    rows = sorted(map(tuple, got.collect()), key=repr)
    assert rows == sorted(sql_rows(messy, got.columns), key=repr)
    assert rows == sorted(map(tuple, Q.quality_measures(clashing, keep=["doc_id"]).collect()), key=repr)
    assert Q.quality_measures(no_docs).collect() == []
    full = Q.quality_measures(clashing)
    assert full.count() == messy.count() and len(full.columns) == len(set(full.columns))
    by = {r["doc_id"]: r for r in full.collect()}
    assert by[4]["base_failed"] and not by[15]["kept"] and by[14]["kept"] and by[1]["kept"]


def test_slices_do_not_change_counts():
    texts = ["a b c a b c a b c d e f", "", "x\ny\nx\ny", "one word \x0b two \x1c three", "é" * 9 + " # $ | é"] * 7
    whole = Q.measure(texts)
    parts = [Q.measure(texts[k: k + 3]) for k in range(0, len(texts), 3)]
    for c in Q.COUNTS:
        assert (np.concatenate([p[c] for p in parts]) == whole[c]).all()


def test_junk_goes_and_labelled_clean_text_stays(spark):
    con = duckdb.connect()
    clean = {r[0] for r in con.sql(f"select doc_id from read_parquet('{SF_SMALL}/labels.parquet') where quality = 1").fetchall()}
    junk = {r[0] for r in con.sql(f"select doc_id from read_parquet('{SF_SMALL}/labels.parquet') where quality = 0").fetchall()}
    got = QUERIES["op8_quality_rules"](spark, SF_SMALL).collect()
    assert all(r["kept"] for r in got if r["doc_id"] in clean and not r["base_failed"])
    assert sum(r["kept"] for r in got if r["doc_id"] in junk) < 0.5 * len(junk)
