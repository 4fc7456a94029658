from collections import defaultdict

import duckdb
import zlib

from weft.llm.queries import QUERIES
from weft.llm.sharding import PrefixGrid, minimax_shards

SF_SMALL = "/root/testdata/sf0.001"


def brute(pairs, shards):
    groups = {}
    for d, t in pairs:
        g = groups.setdefault(t or "", [d, 0])
        g[0], g[1] = min(g[0], d), g[1] + len((t or "").encode()) + 1
    sizes = [s for _, s, _ in sorted((a, b, t) for t, (a, b) in groups.items())]

    def needs(cap):
        n, fill = 1, 0
        for s in sizes:
            if s > cap:
                return shards + 1
            n, fill = (n + 1, s) if fill + s > cap else (n, fill + s)
        return n

    return next(c for c in range(max(sizes), sum(sizes) + 1) if needs(c) <= shards)


def test_smallest_capacity(spark):
    got = QUERIES["op3_sharding"](spark, SF_SMALL).collect()
    pairs = duckdb.sql(f"select doc_id, text from read_parquet('{SF_SMALL}/documents.parquet')").fetchall()
    text, load, slots, at = dict(pairs), defaultdict(int), defaultdict(list), {}
    for r in got:
        body = text[r["doc_id"]] or ""
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(body.encode()) + 1, zlib.crc32(body.encode()), "bytes", None)
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        assert at.setdefault(body, r["shard"]) == r["shard"]
    assert len(got) == len(pairs) and set(load) <= set(range(16))
    assert max(load.values()) == brute(pairs, 16)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_coarse_grid_finds_the_same(spark):
    import random

    rnd = random.Random(5)
    sizes = [rnd.choice([1, 1, 3, 50, 999]) for _ in range(400)]
    ends, run = [], 0
    for s in sizes:
        run += s
        ends.append((run,))
    df = spark.createDataFrame(ends, "end long").cache()
    fine = PrefixGrid(df, "end", run, 5, grid=100_000).solve()
    assert PrefixGrid(df, "end", run, 5, grid=64).solve() == fine


def test_even_cuts_keep_the_capacity_and_share_the_rest(spark):
    import random

    rnd = random.Random(8)
    sizes = [rnd.choice([1, 2, 3, 5]) for _ in range(600)]
    sizes[200] = 900  # one group larger than a third of all
    ends, run = [], 0
    for s in sizes:
        run += s
        ends.append(run)
    df = spark.createDataFrame([(e,) for e in ends], "end long").cache()
    for grid in (64, 100_000):
        g = PrefixGrid(df, "end", run, 8, grid=grid)
        capacity, greedy = g.solve()
        cuts = g.even_cuts(capacity)
        load = [b - a for a, b in zip([0, *cuts], cuts)]
        assert capacity == 900 and max(load) <= capacity and set(cuts) <= set(ends)
        rest = sorted(load)[:-1]
        assert rest[0] > 0.5 * rest[-1] and min(b - a for a, b in zip([0, *greedy], greedy)) == 0


def test_messy_rows(spark, messy, no_docs, clashing):
    for df in (messy, clashing):
        got = minimax_shards(df, 4).collect()
        assert len(got) == messy.count()
        slots = defaultdict(list)
        for r in got:
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
        assert len({r["shard"] for r in got if r["text_crc32"] == 0}) == 1  # null and empty texts are equal
    assert minimax_shards(no_docs).collect() == []
    one = spark.createDataFrame([(1, "same")] * 5, "doc_id long, text string")
    got = minimax_shards(one, 3).collect()
    assert len({r["shard"] for r in got}) == 1 and sorted(r["slot"] for r in got) == list(range(5))
