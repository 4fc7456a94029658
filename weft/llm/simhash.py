"""Operator 10: SimHash near-dedup with pivot distance tables.

64-bit fingerprints of word shingles are linked at ``max_bits`` or fewer differing bits. For every
distinct fingerprint the Hamming distances to fixed reference fingerprints are tabled; by the triangle
inequality a pair whose distances to any pivot differ by more than ``max_bits`` is discarded, and the
survivors are verified. The pairs that meet the tables come from an equi-join: the 64 bits are cut
into ``max_bits + 3`` segments, and a linked pair agrees on all bits of some 3 of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import as_row, connected_components, n_parts, stored

SEED = 42
N_PIVOTS = 16
SPLIT_OVER = 512  # groups above this many fingerprints are searched by neighbours, not by pairs
SLICE_BYTES = 1 << 20


def pivots(n: int = N_PIVOTS) -> np.ndarray:
    """Fixed reference fingerprints: hashes of 0..n-1."""
    return np.array([xxhash.xxh64_intdigest(bytes([k]), 7) for k in range(n)], np.uint64)


def fingerprints(texts: list[str], shingle: int) -> np.ndarray:
    """uint64 per text: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, majority bit over XXH64 (seed 42) of all shingles."""
    out = np.zeros(len(texts), np.uint64)
    todo: list[tuple[int, list[int]]] = []
    for k, t in enumerate(texts):
        w = t.encode().lower().split()
        if not w:
            continue
        grams = map(b" ".join, zip(*(w[i:] for i in range(shingle)))) if len(w) >= shingle else [b" ".join(w)]
        todo.append((k, list(map(xxhash.xxh64_intdigest, grams, repeat(SEED)))))
        if sum(len(h) for _, h in todo[-1:]) > SLICE_BYTES // 8 or k % 256 == 255:
            _majority(todo, out)
            todo = []
    _majority(todo, out)
    return out


def _majority(todo: list[tuple[int, list[int]]], out: np.ndarray) -> None:
    for k, h in todo:
        n = len(h)
        count = np.zeros(64, np.int64)
        for at in range(0, n, SLICE_BYTES):
            part = np.array(h[at: at + SLICE_BYTES], np.uint64)
            count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(2 * count > n, bitorder="little").view(np.uint64)[0]


def segment_masks(max_bits: int) -> list[int]:
    """Bit masks, one for each choice of 3 among max_bits + 3 segments of the 64 bits."""
    n = max_bits + 3
    cut = [round(64 * k / n) for k in range(n + 1)]
    seg = [((1 << cut[k + 1]) - 1) ^ ((1 << cut[k]) - 1) for k in range(n)]
    return [a | b | c for a, b, c in combinations(seg, 3)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each component of n nodes."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def _links(fp: np.ndarray, key: np.ndarray, free: np.ndarray, max_bits: int, ref: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within max_bits among equal keys. ``key`` is sorted; ``free``: the mask of bits outside the key."""
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[start, len(key)])
    big = size > SPLIT_OVER
    dist = np.bitwise_count(fp[:, None] ^ ref).astype(np.int8)  # the pivot distance table
    left = np.repeat(np.where(big, 0, size), size) - 1 - (np.arange(len(key)) - np.repeat(start, size))  # later members of the group
    shift, at = 1, np.flatnonzero(left >= 1)
    while len(at):
        a, b = at, at + shift
        for lo in range(0, N_PIVOTS, 4):  # Chebyshev distance over the table, a few pivots at a time
            near = (np.abs(dist[a, lo: lo + 4] - dist[b, lo: lo + 4]) <= max_bits).all(axis=1)
            a, b = a[near], b[near]
        ok = np.bitwise_count(fp[a] ^ fp[b]) <= max_bits
        yield a[ok], b[ok]
        shift += 1
        at = np.flatnonzero(left >= shift) if shift < 8 else at[left[at] >= shift]
    for s, n in zip(start[big], size[big]):  # many members: look each one's neighbours up instead
        own = fp[s: s + n]
        order = np.argsort(own)
        bits = [np.uint64(1 << k) for k in range(64) if (int(free[s]) >> k) & 1]
        for r in range(1, max_bits + 1):
            for flip in combinations(bits, r):
                want = own ^ np.bitwise_or.reduce(np.array(flip, np.uint64))
                spot = np.minimum(np.searchsorted(own, want, sorter=order), n - 1)
                hit = np.flatnonzero((own[order[spot]] == want) & (own < want))
                yield s + hit, s + order[spot[hit]]


def linked(distinct: DataFrame, fp: str, max_bits: int) -> DataFrame:
    """Edges (a, b) among distinct fingerprints (signed longs) that span the same components as all links.

    One row per mask and fingerprint is dealt by its masked bits; a task sees the groups of equal bits
    in order and keeps one group at a time. Groups of over SPLIT_OVER members are searched by looking
    up every fingerprint that differs in at most ``max_bits`` of the free bits: linear in the group.
    A group gives a spanning star per component, never its pairs.
    """
    masks = segment_masks(max_bits)
    free = np.array([((1 << 64) - 1) ^ m for m in masks], np.uint64)
    spark = distinct.sparkSession
    keyed = distinct.select(F.col(fp).alias("fp"), F.posexplode(F.array(*[F.col(fp).bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("m", "key"))
    dealt = keyed.repartition(n_parts(spark), "m", "key").sortWithinPartitions("m", "key", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ref = pivots()

        def solve(m: np.ndarray, key: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            group = np.cumsum(np.r_[True, (m[1:] != m[:-1]) | (key[1:] != key[:-1])])
            many = np.bincount(group)[group] > 1
            m, fps, group = m[many], fps[many], group[many]
            a, b = (np.concatenate(x) for x in zip((np.zeros(0, int), np.zeros(0, int)), *_links(fps, group, free[m], max_bits, ref)))
            root = _roots(len(fps), a, b) if len(fps) else np.zeros(0, int)
            own = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([pa.array(fps[own].view(np.int64)), pa.array(fps[root[own]].view(np.int64))], names=["a", "b"])

        held = None
        for batch in batches:
            cur = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("m", "key", "fp")]
            cur[2] = cur[2].view(np.uint64)
            if held is not None:
                cur = [np.concatenate(x) for x in zip(held, cur)]
            m, key, _ = cur
            open_from = 0 if not len(m) else int(np.flatnonzero((m == m[-1]) & (key == key[-1]))[0])  # the last group may go on
            if open_from:
                yield solve(*(x[:open_from] for x in cur))
            held = [x[open_from:] for x in cur]
        if held is not None:
            yield solve(*held)

    return dealt.mapInArrow(run, "a long, b long").distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (smallest id reachable).

    Null and empty texts have fingerprint zero and are linked like any other. Texts of fewer words than
    ``shingle`` count as one shingle. Repeated rows each keep a row. Null ids are linked, but never name
    a component while another id can; a component of null ids only has a null component_id. Other
    columns are ignored. An empty table gives an empty result.

    Copies meet in a map-side combined ``min`` per fingerprint; only fingerprints that recur or are
    linked are joined back, and only distinct fingerprints are compared.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = fingerprints([x or "" for x in b.column("text").to_pylist()], shingle)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fp.view(np.int64))], names=["id", "fp"])

    own = stored(src.mapInArrow(run, "id long, fp long"), "simhash")
    groups = own.groupBy("fp").agg(F.min("id").alias("low"), F.count("*").alias("n"))
    nodes = connected_components(linked(groups.select("fp"), "fp", max_bits))
    rooted = groups.join(nodes, groups["fp"] == nodes["node"], "left").select("fp", "low", "n", F.coalesce("root", "fp").alias("root"), F.col("root").isNotNull().alias("linked"))
    comp = rooted.where("linked").groupBy("root").agg(F.min("low").alias("component"))
    named = rooted.where("linked or n > 1").join(comp, "root", "left").select("fp", F.coalesce("component", "low").alias("component"))
    return own.join(named, "fp", "left").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component", "id").alias("component_id"))


def one_per_component(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """``docs`` with one row of each near-duplicate component: the one whose id names it.

    Rows with a null id cannot be told apart and all stay; of rows that repeat the naming id, the one
    with the smallest text stays.
    """
    comp = simhash_components(docs, id_col, text, shingle, max_bits)
    gone = comp.where(F.col("component_id") != F.col(id_col)).select(F.col(id_col).alias("gone")).distinct()
    own = as_row(docs).withColumn("id", F.col("row")[id_col])
    apart = F.when(F.col("id").isNull(), F.monotonically_increasing_id())  # null ids spread instead of meeting
    left = own.join(gone, F.col("id") == F.col("gone"), "left_anti").withColumn("apart", apart)
    nth = F.row_number().over(Window.partitionBy("id", "apart").orderBy(F.col("row")[text].asc_nulls_last()))
    return left.withColumn("nth", nth).where("nth = 1").select("row.*")
