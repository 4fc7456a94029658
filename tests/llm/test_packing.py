from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weft.llm.packing import LENGTHS, best_fit, pack, pack_tokens
from weft.llm.queries import QUERIES, tokenizer_path

SF_SMALL = "/root/testdata/sf0.001"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 64), max_size=60))
def test_pack_keeps_every_token(sizes):
    sizes = np.array(sizes, np.int64)
    bins, offset, length = pack(sizes, (16, 32, 64), 2)
    spans = defaultdict(list)
    for s, b, o in zip(sizes, bins, offset):
        spans[b].append((o, o + s))
    for b, xs in spans.items():
        xs.sort()
        assert xs[0][0] == 0 and all(p[1] == q[0] for p, q in zip(xs, xs[1:]))  # no overlap, no gap
        used = xs[-1][1]
        assert length[b] == min(n for n in (16, 32, 64) if n >= used)  # downsized
    assert len(spans) == len(length)


def test_choice_of_length():
    # three pieces of 16 fill a bin of 48 less well than one of 16 each would; four fill 64
    assert pack(np.array([16]), (16, 64), 1)[2] == [16]
    assert pack(np.array([16] * 4), (16, 64), 8)[2] == [64]


def check(rows, top=max(LENGTHS)):
    docs, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r["doc_id"]].append(r)
        bins[r["group"], r["bin"]].append(r)
    for rs in bins.values():
        used = sum(r["n_tokens"] for r in rs)
        assert {r["bin_tokens"] for r in rs} == {used}
        assert {r["length"] for r in rs} == {min(n for n in LENGTHS if n >= used)}
        at = sorted((r["offset"], r["offset"] + r["n_tokens"]) for r in rs)
        assert at[0][0] == 0 and all(p[1] == q[0] for p, q in zip(at, at[1:]))
    return docs


def library_counts(texts):
    """Ids of whole texts by the library, and the end id."""
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    return {d: len(tk.encode(t or "", add_special_tokens=False).ids) + 1 for d, t in texts.items()}


def brute(sizes, lengths, overhead):
    """Bin of every piece and the bins' lengths, each piece held against every bin and every later piece."""
    at, room, used = [None] * len(sizes), [], []
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    for n, i in enumerate(order):
        s = sizes[i]
        fits = [(r, b) for b, r in enumerate(room) if r >= s and r > 0]
        if fits:
            b = min(fits)[1]
        else:
            costs = []
            for length in lengths:
                fill = s
                for j in order[n + 1:]:
                    if fill + sizes[j] <= length:
                        fill += sizes[j]
                if length >= s:
                    costs.append(((length + overhead) / max(1, fill), length))
            b = len(room)
            room.append(min(costs)[1])
            used.append(0)
        at[i] = b
        room[b] -= s
        used[b] += s
    return at, [min(n for n in lengths if n >= u) for u in used]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 64), max_size=50), st.integers(0, 20))
def test_pack_against_brute_force(sizes, overhead):
    bins, _, length = pack(np.array(sizes, np.int64), (16, 32, 64), overhead)
    assert (bins.tolist(), length) == brute(sizes, (16, 32, 64), overhead)


def test_messy_rows_by_token_ids(spark, messy, no_docs, clashing):
    from llm.conftest import messy_rows

    texts = {r[0]: r[1] for r in messy_rows() if r[0] is not None}
    want = library_counts(texts)
    want[2] *= 2  # stands twice
    for df in (messy, clashing):
        docs = check(pack_tokens(df, tokenizer_path("word_bpe_49k.json")).collect())
        assert {d: sum(r["n_tokens"] for r in rs) for d, rs in docs.items() if d is not None} == want
        assert len(docs[None]) == 2 and want[4] == want[5] == 1 and len(docs[14]) == -(-want[14] // 4096)
    assert pack_tokens(no_docs, tokenizer_path("word_bpe_49k.json")).collect() == []


def test_query(spark):
    rows = QUERIES["op4_best_fit_packing"](spark, SF_SMALL).collect()
    docs = check(rows)
    ids = library_counts({r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()})
    assert {d: sum(r["n_tokens"] for r in rs) for d, rs in docs.items()} == ids
    assert all(sorted(r["piece"] for r in rs) == list(range(rs[0]["n_pieces"])) for rs in docs.values())
    bins = {(r["group"], r["bin"]): r["length"] for r in rows}
    assert sum(ids.values()) / sum(bins.values()) > 0.95  # little padding


def test_messy_rows(spark, messy, no_docs, clashing):
    for df in (messy, clashing):
        docs = check(best_fit(df).collect())
        assert len(docs[None]) == 2 and len(docs[2]) == 2 and docs[4][0]["n_tokens"] == 0
        assert [r["n_tokens"] for r in sorted(docs[14], key=lambda r: r["piece"])] == [4096] * 7 + [30000 - 7 * 4096]
    assert best_fit(no_docs).collect() == []


def test_own_token_counts(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, 10), (2, None), (3, 5000)], "doc_id long, n long")
    got = best_fit(df.withColumn("text", F.lit("")), tokens=F.col("n")).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got) == [(1, 10), (2, 0), (3, 904), (3, 4096)]


@pytest.mark.parametrize("n", [1, 2000])
def test_equal_sizes(n):
    bins, _, length = pack(np.full(n, 512), LENGTHS)
    assert sum(length) == 512 * n if n == 1 else sum(length) < 1.01 * 512 * n


def test_placement_does_not_follow_the_partitioning(spark, messy, monkeypatch):
    from weft.llm import packing

    monkeypatch.setattr(packing, "GROUP_TOKENS", 500)
    monkeypatch.setattr(packing, "COPIES", 2)
    many = messy.unionByName(messy.where("doc_id <= 5")).unionByName(messy.where("doc_id = 2"))
    got = [sorted((tuple(r) for r in packing.best_fit(many.repartition(k)).collect()), key=repr) for k in (1, 7)]
    assert got[0] == got[1] and len({r[6] for r in got[0]}) > 1
