import re

import duckdb
import numpy as np
import xxhash

from weft.llm import simhash as S
from weft.llm.common import connected_components
from weft.llm.queries import QUERIES

SF_SMALL = "/root/testdata/sf0.001"


def fingerprint(text, shingle=3):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(w[k: k + shingle]) for k in range(len(w) - shingle + 1)] if len(w) >= shingle else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute(pairs, shingle=3, bits=2):
    fps = np.array([fingerprint(t, shingle) for _, t in pairs], np.uint64)
    root = list(range(len(pairs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(pairs)):
        for b in np.flatnonzero(np.bitwise_count(fps ^ fps[a]) <= bits):
            x, y = find(a), find(int(b))
            root[max(x, y)] = min(x, y)
    low = {}
    for k, (d, _) in enumerate(pairs):
        if d is not None:
            low[find(k)] = min(low.get(find(k), d), d)
    return sorted(((d, f"{fps[k]:016x}", low.get(find(k))) for k, (d, _) in enumerate(pairs)), key=repr)


def test_query_equals_brute_force(spark):
    pairs = duckdb.sql(f"select doc_id, text from read_parquet('{SF_SMALL}/documents.parquet')").fetchall()
    assert sorted(map(tuple, QUERIES["op10_simhash"](spark, SF_SMALL).collect()), key=repr) == brute(pairs)


def test_messy_rows(spark, messy, no_docs, clashing):
    pairs = [tuple(r) for r in messy.select("doc_id", "text").collect()]
    want = brute(pairs)
    assert sorted(map(tuple, S.simhash_components(messy).collect()), key=repr) == want
    assert sorted(map(tuple, S.simhash_components(clashing).collect()), key=repr) == want
    assert S.simhash_components(no_docs).collect() == []
    assert sorted(map(tuple, S.simhash_components(messy, shingle=1, max_bits=3).collect()), key=repr) == brute(pairs, 1, 3)
    kept = S.one_per_component(clashing)
    assert kept.columns == clashing.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(x for x in ids if x is not None) == sorted({c for d, _, c in want if d == c and d is not None})
    assert ids.count(None) == 2
    assert S.one_per_component(no_docs).collect() == []


def close_pairs(fp, bits):
    return {(min(a, b), max(a, b)) for a in range(len(fp)) for b in np.flatnonzero(np.bitwise_count(fp ^ fp[a]) <= bits) if a != b}


def test_links_within_groups_by_pairs_and_by_neighbours(monkeypatch):
    r = np.random.default_rng(4)
    free = np.uint64(0x3FFFFFF)
    fp = np.unique(np.concatenate([r.integers(0, 1 << 26, 60), *[np.array([c ^ (1 << a) ^ (1 << b)]) for c in r.integers(0, 1 << 26, 12) for a, b in r.integers(0, 26, (5, 2))]])).astype(np.uint64)
    want = close_pairs(fp, 2)
    for split in (4, 10_000):
        monkeypatch.setattr(S, "SPLIT_OVER", split)
        got = set()
        for a, b in S._links(fp, np.zeros(len(fp), int), np.full(len(fp), free), 2, S.pivots()):
            got |= {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())}
        assert got == want and want


def test_masks_meet_every_close_pair():
    r = np.random.default_rng(9)
    masks = [np.uint64(m) for m in S.segment_masks(2)]
    for a, b in r.integers(0, 64, (300, 2)):
        flip = np.uint64((1 << int(a)) ^ (1 << int(b)))
        assert any(not int(flip & m) for m in masks)


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(k, k + 1) for k in range(1, 60)] + [(1000, k) for k in range(1001, 1200)] + [(5000, 4000), (4000, 5000)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = dict(map(tuple, connected_components(df).collect()))
    assert {got[k] for k in range(1, 61)} == {1} and {got[k] for k in range(1000, 1200)} == {1000} and got[5000] == 4000
    assert connected_components(df.limit(0)).collect() == []
