import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weft.llm import jaccard as J
from weft.llm import shingles as S
from weft.llm.queries import QUERIES

SF_SMALL = "/root/testdata/sf0.001"


def shingles(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(w[i: i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(pairs, k=4, percent=85):
    sets = [shingles(t, k) for _, t in pairs]
    root = list(range(len(pairs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = {}
    for i, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(i)
    met = set()
    for at in where.values():
        met |= {(a, b) for n, a in enumerate(at) for b in at[n + 1:]}
    for a, b in met:
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    low = {}
    for i, (d, _) in enumerate(pairs):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted(((d, len(sets[i]), low.get(find(i))) for i, (d, _) in enumerate(pairs)), key=repr)


def got(df):
    return sorted((tuple(r)[:3] for r in df.collect()), key=repr)


def test_query_equals_brute_force(spark):
    pairs = duckdb.sql(f"select doc_id, text from read_parquet('{SF_SMALL}/documents.parquet')").fetchall()
    assert got(QUERIES["op11_jaccard"](spark, SF_SMALL)) == brute(pairs)


def test_messy_rows(spark, messy, no_docs, clashing):
    pairs = [tuple(r) for r in messy.select("doc_id", "text").collect()]
    assert got(J.jaccard_components(messy)) == brute(pairs)
    assert got(J.jaccard_components(clashing)) == brute(pairs)
    assert got(J.jaccard_components(messy, shingle=1, percent=50)) == brute(pairs, 1, 50)
    assert J.jaccard_components(no_docs).collect() == []


def near_copies(n, seed, length=40, vocabulary=3000, clusters=5):
    """Clusters of near copies with words exchanged, cut or added; a passage that many texts share; short texts."""
    r = np.random.default_rng(seed)
    base = [r.integers(0, vocabulary, length + 7 * c) for c in range(clusters)]
    passage = " ".join(f"p{k}" for k in range(25))
    out = []
    for k in range(n):
        w = [f"w{x}" for x in base[k % clusters]]
        for _ in range(int(r.integers(0, 4))):
            at = int(r.integers(0, len(w)))
            what = r.random()
            w[at: at + 1] = [f"x{r.integers(0, 9)}"] if what < .5 else [] if what < .75 else [w[at], f"y{r.integers(0, 9)}"]
        t = " ".join(w)
        out.append(t if k % 5 else f"{passage} {t}" if k % 2 else " ".join(f"s{x}" for x in r.integers(0, 3, int(r.integers(1, 7)))))
    return out


@pytest.mark.parametrize("seed,cell,copy,buckets,sent", [(1, 4096, 256, 1 << 18, 400_000), (2, 3, 2, 4, 0), (3, 7, 5, 1, 0)])
def test_dense_clusters_hot_shingles_and_small_cells(spark, monkeypatch, seed, cell, copy, buckets, sent):
    for name, value in (("SENT_ROWS", sent), ("CELL", cell), ("COPY", copy), ("BUCKETS", buckets), ("CHUNK", min(buckets, 4096))):
        monkeypatch.setattr(J, name, value)
    texts = near_copies(160, seed)
    pairs = list(enumerate(texts, 1000))
    assert got(J.jaccard_components(spark.createDataFrame(pairs, "doc_id long, text string").repartition(5))) == brute(pairs)


def test_equal_prefixes_and_sizes_make_one_group(spark, monkeypatch):
    """With a single counter the order is that of the hashes: texts differ behind their common prefix."""
    monkeypatch.setattr(J, "BUCKETS", 1)
    monkeypatch.setattr(J, "CHUNK", 1)
    names = [f"t{k}" for k in range(4000)]
    pool = [w for _, w in sorted(zip((int(s[0]) for s in S.shingle_sets(pa.array(names), 1)), names))]
    r = np.random.default_rng(0)
    pairs = [(k, " ".join(pool[:20] + sorted(r.choice(pool[2000:], 60, replace=False)) if k % 3 else pool[:20] + pool[2000 + k: 2060 + k])) for k in range(60)]
    own = J._measured(spark.createDataFrame(pairs, "key long, text string").selectExpr("key as id", "key", "text"), 1, 85).collect()
    assert len({bytes(o["grp"]) for o in own}) == 1
    assert got(J.jaccard_components(spark.createDataFrame(pairs, "doc_id long, text string"), shingle=1)) == brute(pairs, 1)


def degrees(pairs, k=4, percent=85):
    """id: other shingle sets that link with its own."""
    sets = {d: frozenset(shingles(t, k)) for d, t in pairs}
    return {d: sum(100 * len(s & o) >= percent * len(s | o) for o in set(sets.values()) - {s} if s and o) for d, s in sets.items()}


@pytest.mark.parametrize("seed,cell,room,sent", [(2, 3, 1 << 19, 400_000), (3, 4096, 3000, 0)])
def test_all_links_of_a_component_are_counted(spark, monkeypatch, seed, cell, room, sent):
    for name, value in (("CELL", cell), ("SHINGLES", room), ("SENT_ROWS", sent)):
        monkeypatch.setattr(J, name, value)
    texts = near_copies(120, seed, length=120, clusters=2)
    pairs = list(enumerate([*texts, *texts[:9], None, ""], 1000))
    out = J.jaccard_components(spark.createDataFrame(pairs, "doc_id long, text string").repartition(5)).collect()
    want = degrees(pairs)
    assert {r["doc_id"]: r["n_links"] for r in out} == want and max(want.values()) > 8


def test_links_of_blocks_equal_brute_force(monkeypatch):
    r = np.random.default_rng(0)
    monkeypatch.setattr(J, "FEW", 40)
    for rows, expanded in ((512, 1 << 22), (7, 50)):
        monkeypatch.setattr(J, "ROWS", rows)
        monkeypatch.setattr(J, "EXPANDED", expanded)
        for pool, core in ((40, 0), (400, 60), (5000, 30), (60, 3)):
            sets = [np.unique(np.r_[np.arange(core)[r.random(core) > .03], 100_000 + r.integers(0, pool, int(r.integers(1, 30)))]).astype(np.uint64) for _ in range(45)]
            link = np.array([[100 * len(np.intersect1d(a, b)) >= 60 * len(np.union1d(a, b)) for b in sets] for a in sets])
            mine, theirs = J._linked(sets[:20], sets[20:], 60)
            assert mine.tolist() == link[:20, 20:].sum(axis=1).tolist() and theirs.tolist() == link[:20, 20:].sum(axis=0).tolist()
            assert J._linked(sets, None, 60)[0].tolist() == (link.sum(axis=1) - 1).tolist()
            assert J._linked(sets[:6], None, 60)[0].tolist() == (link[:6, :6].sum(axis=1) - 1).tolist()


def test_thresholds_meet_at_the_border():
    for a in range(1, 60):
        for b in range(a, 60):
            for i in range(a + 1):
                assert (100 * i >= 85 * (a + b - i)) == (i >= J.needed(a + b, 85))
        assert J.prefix_length(a, 85) == a - -(-85 * a // 100) + 1


def test_sizes_that_allow_a_link_lie_in_neighbouring_bands(spark):
    for percent in (10, 20, 50, 85, 99, 100):
        pairs = [(n, m) for n in [*range(1, 130), 625, 1000, 15625] for m in {n, n * 100 // percent}]
        got = spark.createDataFrame(pairs, "n long, m long").select("n", "m", J._band(F.col("n"), percent).alias("a"), J._band(F.col("m"), percent).alias("b")).collect()
        assert [tuple(r) for r in got if not 0 <= r["b"] - r["a"] <= 1] == []


@pytest.mark.parametrize("segment", [37, 1 << 16])
def test_shingle_sets_of_odd_texts(monkeypatch, segment):
    monkeypatch.setattr(S, "SEGMENT", segment)
    odd = ["a b c d e", None, "", " ", "A b C d E", "x" * 10000 + " y z w", "x" * 9999 + "z y z w", ("x" * 5000 + "ab") * 3, "one two", "two one", "one two three",
           "one two three four", " a b", "\u00e9 \u00c9 \u00df", "a  b\n\tc\x0bd e ", "a b c d b a c d a b d c", "a a a a a a", "\u00a0x\u2003y z", " ".join(map(str, range(3000)))]
    for k in (1, 4):
        got = list(S.shingle_sets(pa.array(odd), k))
        assert [len(s) for s in got] == [len(shingles(t, k)) for t in odd]
        for a, x in zip(got, odd):
            for b, y in zip(got, odd):
                assert len(np.intersect1d(a, b)) == len(shingles(x, k) & shingles(y, k))
        part = list(S.shingle_sets(pa.array(odd).slice(3, 9), k))
        assert all(np.array_equal(a, b) for a, b in zip(part, got[3:12])) and len(part) == 9
    assert list(S.shingle_sets(pa.array([], pa.string()), 4)) == []
