import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from weft.llm import merkle as M
from weft.llm.queries import ORACLES, QUERIES

SF_SMALL = "/root/testdata/sf0.001"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(row):
    out = ""
    for v in row:
        out += "-" if v is None else f"{len(str(v).encode())}:{v}"
    return H(out)


def tree(nodes):
    """(root, path per leaf): a path is a list of (place of the leaf's node among its run, run)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[k: k + 2] for k in range(0, len(nodes), 2)]
        for x, p in enumerate(at):
            paths[x].append((p % 2, runs[p // 2]))
        at = [p // 2 for p in at]
        nodes = [H("".join(r)) for r in runs]
    return nodes[0], paths


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    order = sorted(langs, key=lambda g: (g is not None, (g or "").encode()))
    per = {}
    for g in order:
        rs = sorted(langs[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        per[g] = (rs, *tree([leaf_of(r) for r in rs]))
    root, tops = tree([per[g][1] for g in order])
    out = []
    for g, top in zip(order, tops):
        rs, sub, paths = per[g]
        for r, path in zip(rs, paths):
            path = path + top
            proof = H("".join(x for p, run in path for k, x in enumerate(run) if k != p))
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            cur = leaf_of((*r[:3], r[3] + 1, r[4])) if bad else leaf_of(r)
            for p, run in path:
                cur = H("".join(cur if k == p else x for k, x in enumerate(run)))
            out.append((r[0], leaf_of(r), sub, root, proof, cur, cur == root))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("digits", [2, 10])
def test_query_equals_brute_force(spark, monkeypatch, digits):
    monkeypatch.setattr(M, "BLOCK_DIGITS", digits)  # 2: several tiers
    rows = duckdb.sql(f"select {', '.join(FIELDS)} from read_parquet('{SF_SMALL}/documents.parquet')").fetchall()
    assert got(QUERIES["op12_merkle_manifest"](spark, SF_SMALL)) == brute(rows)


def test_messy_rows(spark, monkeypatch, messy, no_docs, clashing):
    rows = [tuple(r) for r in messy.select(*FIELDS).collect()]
    want = brute(rows)
    assert got(M.verified_manifest(messy)) == want
    assert got(M.verified_manifest(clashing.withColumn("grp", F.lit(1)).withColumn("h", F.lit(2)))) == want
    assert M.verified_manifest(no_docs).collect() == []
    monkeypatch.setattr(M, "BLOCK_DIGITS", 1)
    monkeypatch.setattr(M, "COPIES", 2)
    many = messy.unionByName(messy.where("doc_id = 2")).unionByName(messy.where("doc_id = 2"))
    assert got(M.verified_manifest(many)) == brute([tuple(r) for r in many.select(*FIELDS).collect()])


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 9, 17])
def test_sizes_around_powers_of_two(spark, monkeypatch, n):
    monkeypatch.setattr(M, "BLOCK_DIGITS", 2)
    df = spark.range(n).selectExpr("id as doc_id", "concat('t', id) as text", "if(id % 5 = 4, null, 'en') as lang", "'s' as source", "id as n_chars")
    assert got(M.verified_manifest(df)) == brute([tuple(r) for r in df.select(*FIELDS).collect()])


def test_every_group_its_own(spark):
    df = spark.range(40).selectExpr("id as doc_id", "'t' as text", "concat('l', id % 23) as lang", "'s' as source", "id as n_chars").repartition(5)
    assert got(M.verified_manifest(df)) == brute([tuple(r) for r in df.select(*FIELDS).collect()])


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{SF_SMALL}/documents.parquet')")
    df = QUERIES["op12_merkle_manifest"](spark, SF_SMALL)
    assert got(df) == sorted(con.sql(f"select {', '.join(df.columns)} from ({ORACLES['op12_merkle_manifest']})").fetchall(), key=repr)
