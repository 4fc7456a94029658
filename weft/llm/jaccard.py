"""Operator 11: n-gram Jaccard join by a grouped prefix join.

Documents with equal shingle sets are one class. Shingles have one global order, rare ones first, and
two sets of enough overlap share a shingle of their prefixes. Classes with the same prefix and size
form a group; groups meet by an equi-join on prefix shingles, group pairs are filtered by size and
position, then expanded to their members and verified on the whole sets.

Two rounds keep dense clusters linear and lose no link. In the first, each group is verified against
one other only (of the groups that stand first under its shingles, the one that does so most often).
In the second, only pairs whose ends are not yet connected meet: under each shingle the members
outside its largest component against all, cut into cells of bounded size where a shingle is hot.
Then the components are known, and no link leaves one: a third round verifies all pairs inside every
component, a block of sets against a block at a time, and counts the links of each set.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import connected_components, n_parts, stored
from weft.llm.shingles import shingle_sets

BUCKETS = 1 << 18  # counters of the shingle order: 2 MB on the driver and in each worker, whatever the corpus
CELL = 4096  # members of a hot shingle, and sets of a component, that one cell of the second and third round holds on each side
SHINGLES = 1 << 19  # of the sets that a cell of the third round holds on each side
FEW = 64  # pairs of a cell that are compared one by one
ROWS = 512  # sets of a block whose overlaps with the other block are counted at once
EXPANDED = 1 << 22  # places of overlaps that are counted at once
SENT_ROWS = 400_000  # rows of 56 bytes that are broadcast at most, 22 MB
COPY = 256  # pairs of one document that share a copy of its text
CHUNK = 4096


def _digest(*parts: np.ndarray, salt: int = 0) -> bytes:
    return hashlib.blake2b(b"".join(p.tobytes() for p in parts), digest_size=16, salt=salt.to_bytes(8, "little")).digest()


def _bucket(s: np.ndarray, buckets: int) -> np.ndarray:
    return (s >> np.uint64(32)).view(np.int64) % buckets


def needed(total: int, percent: int) -> int:
    """Least intersection of two sets whose sizes add up to ``total``: 100 i >= percent (total - i)."""
    return -(-percent * total // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _order(docs: DataFrame, k: int) -> np.ndarray:
    """Shingle counts over all documents, in BUCKETS counters."""
    buckets = BUCKETS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(buckets, np.int64)
        for b in batches:
            for s in shingle_sets(b.column("text"), k):
                np.add.at(count, _bucket(s, buckets), 1)
        for at in range(0, buckets, CHUNK):
            yield pa.RecordBatch.from_pydict({"at": pa.array([at], pa.int32()), "c": pa.array([count[at: at + CHUNK]], pa.list_(pa.int64()))})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for at, c in zip(b.column("at").to_pylist(), b.column("c")):
                held[at] = held.get(at, 0) + c.values.to_numpy()
        yield pa.RecordBatch.from_pydict({"at": pa.array(list(held), pa.int32()), "c": pa.array(list(held.values()), pa.list_(pa.int64()))})

    parts = docs.select("text").mapInArrow(run, "at int, c array<long>")
    total = parts.repartition(n_parts(docs.sparkSession), "at").mapInArrow(add, "at int, c array<long>")
    out = np.zeros(BUCKETS, np.int64)
    for r in total.toLocalIterator():
        out[r["at"]: r["at"] + CHUNK] = r["c"]
    return out


def _measured(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """One row per document: id, key, n, digest of the set, digest of (n, prefix), prefix in the global order."""
    spark = docs.sparkSession
    counts = spark.sparkContext.broadcast(_order(docs, k))  # BUCKETS longs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counts.value
        for b in batches:
            sizes, digests, groups, prefixes = [], [], [], []
            for s in shingle_sets(b.column("text"), k):
                n, head = len(s), s[:0]
                if n:
                    p = prefix_length(n, percent)
                    rank = count[_bucket(s, len(count))]
                    near = np.flatnonzero(rank <= np.partition(rank, p - 1)[p - 1])
                    head = s[near[np.argsort(rank[near], kind="stable")][:p]]  # equal counts in the order of the hash
                sizes.append(n)
                digests.append(_digest(s))
                groups.append(_digest(head, salt=n))
                prefixes.append(head.view(np.int64))
            flat = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(p) for p in prefixes])].astype(np.int32)),
                                            pa.array(np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("key"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                                              pa.array(groups, pa.binary()), flat], names=["id", "key", "n", "digest", "grp", "prefix"])

    return docs.mapInArrow(run, "id long, key long, n long, digest binary, grp binary, prefix array<long>")


def _least(total: Column, percent: int) -> Column:
    """``needed`` as a column."""
    return F.ceil(percent * total / (100 + percent))


def _lists(tokens: DataFrame) -> DataFrame:
    """(gid, n, shared, places): a group's prefix shingles that other groups have too, in the global order."""
    each = tokens.groupBy("gid", "n").agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("t"))
    return each.select("gid", "n", F.col("t.token").alias("shared"), F.col("t.pos").alias("places"))


def _bounded(pairs: DataFrame, lists: DataFrame, percent: int) -> DataFrame:
    """The pairs (ga, gb, ...) of groups that may link by their whole prefixes: behind the last common shingle there is only the rest of the smaller one."""
    side = [lists.select(*[F.col(c).alias(f"{c}_{s}") for c in lists.columns]) for s in "ab"]
    both = pairs.join(side[0], F.col("ga") == F.col("gid_a")).join(side[1], F.col("gb") == F.col("gid_b"))
    both = both.withColumn("common", F.array_intersect("shared_a", "shared_b")).where("size(common) > 0").withColumn("last", F.element_at("common", -1))
    rest = [F.col(f"n_{s}") - 1 - F.element_at(f"places_{s}", F.array_position(f"shared_{s}", F.col("last")).cast("int")) for s in "ab"]
    return both.where(F.size("common") + F.least(*rest) >= _least(F.col("n_a") + F.col("n_b"), percent)).select(*pairs.columns)


def _with_texts(roles: DataFrame, src: DataFrame) -> DataFrame:
    """The stored ``roles`` with the texts of their keys: few enough go to the documents; else the documents are dealt by key."""
    return src.select("key", "text").join(F.broadcast(roles) if roles.count() <= SENT_ROWS else roles, "key")


def _verified(pairs: DataFrame, members: DataFrame, src: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of class ids whose whole sets overlap enough.

    Every b is a centre: its text and those of its partners meet in one task, in order, so that a task
    holds two sets at a time; a centre of many pairs has a copy for COPY of them. A text is known by the
    digest of its set, since an id may be repeated with another text.
    """
    pairs = stored(pairs, "jaccard-pairs")
    cut = pairs.groupBy("b").agg(F.ceil(F.count("*") / COPY).cast("int").alias("copies"))
    partners = pairs.join(cut, "b").select(F.col("a").alias("cid"), "b", F.pmod(F.xxhash64("a"), F.col("copies")).cast("int").alias("copy"), F.lit(1).alias("role"))
    centres = cut.select(F.col("b").alias("cid"), "b", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(0).alias("role"))
    roles = stored(partners.unionByName(centres).join(members.select("cid", "key", "digest"), "cid"), "jaccard-roles")
    dealt = (_with_texts(roles, src).select("b", "copy", "role", "cid", "digest", "text")
             .repartition(n_parts(src.sparkSession), "b", "copy").sortWithinPartitions("b", "copy", "role"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, None
        for batch in batches:
            a, z = [], []
            cols = [batch.column(c).to_pylist() for c in ("b", "copy", "role", "cid", "digest")]
            for b, copy, role, cid, digest, s in zip(*cols, shingle_sets(batch.column("text"), k)):
                if _digest(s) != digest:
                    continue
                if role == 0:
                    now, own = (b, copy), s
                elif now == (b, copy):
                    both = np.sort(np.concatenate([own, s]))
                    if np.count_nonzero(both[1:] == both[:-1]) >= needed(len(both), percent):
                        a.append(cid)
                        z.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], names=["a", "b"])

    return stored(dealt.mapInArrow(run, "a long, b long").distinct(), "jaccard-links")


def _band(n: Column, percent: int) -> Column:
    """Linked sizes lie in the same or next band: a band is a little wider than the factor that a link allows, so
    that rounded logarithms of sizes on its edge do not come to lie two bands apart."""
    return F.floor(F.log(n.cast("double")) / F.lit(max(math.log(100 / percent), 1e-3) * (1 + 1e-9))).cast("int")


def _may_link(n: Column, pos: Column, n2: Column, pos2: Column, percent: int) -> Column:
    """Sizes allow a link, and so do the places of a common shingle and what is left after it: true at a linked pair's first common one."""
    return (100 * F.least(n, n2) >= percent * F.greatest(n, n2)) & (F.least(n - pos, n2 - pos2) >= _least(n + n2, percent))


def _centres(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (ga, gb): each group with one other, of the groups that stand first under its shingles the one that does so most often.

    The group with the smallest place of a shingle has the fewest rarer ones, so whatever links at all
    most likely links with it. One row a group, however many share a shingle.
    """
    banded = rows.withColumn("band", _band(F.col("n"), percent))
    best = banded.groupBy("token", "band").agg(F.min(F.struct("pos", "gid", "n")).alias("c"))
    near = best.select("token", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), "c")
    met = banded.join(near, ["token", "band"]).where((F.col("c.gid") != F.col("gid")) & _may_link(F.col("n"), F.col("pos"), F.col("c.n"), F.col("c.pos"), percent))
    votes = met.groupBy("gid", F.col("c.gid").alias("b")).agg(F.count("*").alias("v"))
    return votes.groupBy(F.col("gid").alias("ga")).agg(F.max_by("b", F.struct("v", "b")).alias("gb"))


def _open_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (ga, ca, gb, cb) of rows (token, gid, comp, n, pos) that share a token, differ in component and may link.

    Of the tokens with the same rows only the one that stands first in them is kept. Under each token the
    rows outside its largest component meet all; a hot token's two sides are dealt into cells of about
    CELL rows each.
    """
    per = rows.groupBy("token", "comp").agg(F.count("*").alias("m"), F.min("pos").alias("first"), F.sum(F.xxhash64("gid", "comp").cast("decimal(38,0)")).alias("s"),
                                            F.bit_xor(F.xxhash64("comp", "gid", F.lit(1))).alias("x"))
    tokens = (per.groupBy("token").agg(F.max_by("comp", F.struct("m", "comp")).alias("largest"), F.count("*").alias("parts"), F.sum("m").alias("m"),
                                       F.min("first").alias("first"), F.sum("s").alias("s"), F.bit_xor("x").alias("x")).where("parts > 1"))
    tokens = stored(tokens.groupBy("m", "s", "x").agg(F.min(F.struct("first", "token", "largest")).alias("t")).select("t.token", "t.largest"), "jaccard-mixed")
    own = stored(rows.join(tokens, "token").withColumn("band", _band(F.col("n"), percent)), "jaccard-open")
    left = own.where("comp <> largest").withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    size = {s: d.groupBy("token", "band").agg(F.ceil(F.count("*") / CELL).cast("int").alias(s)) for s, d in (("l", left), ("r", own))}
    cells = size["l"].join(size["r"], ["token", "band"]).where("l > 1 or r > 1")

    def cut(side: DataFrame, mine: str, theirs: str) -> DataFrame:
        dealt = side.join(cells, ["token", "band"], "left")
        return (dealt.withColumn(f"at_{mine}", F.when(F.col(mine) > 1, F.pmod(F.xxhash64("gid", "comp"), F.col(mine)).cast("int")).otherwise(0))
                .withColumn(f"at_{theirs}", F.explode(F.sequence(F.lit(0), F.coalesce(theirs, F.lit(1)) - 1)))
                .select("token", "band", "at_l", "at_r", "gid", "comp", "n", "pos"))

    a, b = cut(left, "l", "r").alias("x"), cut(own, "r", "l").alias("y")
    met = a.join(b, ["token", "band", "at_l", "at_r"]).where(
        (F.col("x.comp") != F.col("y.comp")) & _may_link(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos"), percent))
    one, two = F.struct(F.col("x.gid").alias("g"), F.col("x.comp").alias("c")), F.struct(F.col("y.gid").alias("g"), F.col("y.comp").alias("c"))
    return (met.select(F.least(one, two).alias("s"), F.greatest(one, two).alias("t")).distinct()
            .select(F.col("s.g").alias("ga"), F.col("s.c").alias("ca"), F.col("t.g").alias("gb"), F.col("t.c").alias("cb")))


def _overlaps(left: list[np.ndarray], right: list[np.ndarray] | None) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, sizes of the intersections) for ROWS sets of ``left`` at a time with all of ``right`` (None: of ``left``).

    A shingle in more than half of the sets is counted by the sets that lack it, one in a single set not at all. Of
    the others, those in many sets are a matrix product, those in few are counted pair by pair.
    """
    both = left if right is None else left + right
    n, m = len(both), len(left)
    _, col = np.unique(np.concatenate(both), return_inverse=True)
    row, count = np.repeat(np.arange(n), [len(s) for s in both]), np.bincount(col)
    usual = 2 * count > n
    plain = ~usual[col] & (count[col] > 1)
    has = np.zeros((n, int(usual.sum())), bool)
    has[row[usual[col]], (np.cumsum(usual) - 1)[col[usual[col]]]] = True
    lacks = has.shape[1] - has.sum(axis=1)
    at, spot = np.nonzero(~has)
    row, col = np.concatenate([row[plain], at]), np.concatenate([col[plain], spot + len(count)])
    col = np.unique(col, return_inverse=True)[1]
    count = np.bincount(col, minlength=1)
    many = count > n / 14  # from there on a product is faster
    dense = np.zeros((n, int(many.sum())), np.float32)
    dense[row[many[col]], (np.cumsum(many) - 1)[col[many[col]]]] = 1
    row, col = row[~many[col]], col[~many[col]]
    order = np.argsort(row, kind="stable")
    row, col = row[order], col[order]
    here = slice(0, n) if right is None else slice(m, n)
    width = here.stop - here.start
    mine = np.flatnonzero(row >= here.start)
    mine = mine[np.argsort(col[mine], kind="stable")]
    met, each = row[mine] - here.start, np.bincount(col[mine], minlength=len(count))
    start = np.cumsum(each) - each
    for lo in range(0, m, ROWS):
        hi = min(m, lo + ROWS)
        out = np.rint(dense[lo:hi] @ dense[here].T).astype(np.int64) + (has.shape[1] - lacks[lo:hi, None] - lacks[here])
        a, z = np.searchsorted(row, (lo, hi))
        total = np.cumsum(each[col[a:z]])
        while a < z:
            end = a + max(1, int(np.searchsorted(total, total[0] - each[col[a]] + EXPANDED, "right")))
            c = col[a:end]
            first = np.repeat(start[c] - (np.cumsum(each[c]) - each[c]), each[c])
            pair = np.repeat((row[a:end] - lo) * width, each[c]) + met[first + np.arange(len(first))]
            out += np.bincount(pair, minlength=out.size).reshape(out.shape)
            total, a = total[end - a:], end
        yield lo, out


def _linked(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """For each set of ``left`` and of ``right``, how many of the other side overlap enough; None: of ``left``, a set with the others."""
    other = left if right is None else right
    a, z = np.array([len(s) for s in left]), np.array([len(s) for s in other])
    mine, theirs = np.zeros(len(left), np.int64), np.zeros(len(other), np.int64)
    if len(left) * len(other) <= FEW:
        for i, x in enumerate(left):
            for j in range(i + 1 if right is None else 0, len(other)):
                both = np.sort(np.concatenate([x, other[j]]))
                if np.count_nonzero(both[1:] == both[:-1]) >= needed(len(both), percent):
                    mine[i] += 1
                    theirs[j] += 1
        return (mine + theirs, theirs) if right is None else (mine, theirs)
    for lo, common in _overlaps(left, right):
        link = common * (100 + percent) >= percent * (a[lo: lo + len(common), None] + z)
        if right is None:
            link[np.arange(len(link)), lo + np.arange(len(link))] = False
        mine[lo: lo + len(link)] = link.sum(axis=1)
        theirs += link.sum(axis=0)
    return mine, theirs


def _cells(joined: DataFrame, percent: int) -> DataFrame:
    """(cid, key, digest, root, cell, side): the cells in which a class (cid, key, digest, n, root) meets the others of its component.

    A component of up to CELL classes and SHINGLES shingles is one cell. A larger one is cut into bands of sizes and
    these into blocks, and each block meets every block of its own band and of the next: sides 0 and 1, or 2 where it
    meets itself. Blocks are dealt by a hash, so a side may be empty.
    """
    size = joined.groupBy("root").agg(F.count("*").alias("m"), F.sum("n").alias("t")).select("root", ((F.col("m") > CELL) | (F.col("t") > SHINGLES)).alias("cut"))
    banded = joined.join(size, "root").withColumn("band", F.when(F.col("cut"), _band(F.col("n"), percent)).otherwise(0))
    per = stored(banded.groupBy("root", "band").agg(F.greatest(F.ceil(F.count("*") / CELL), F.ceil(F.sum("n") / SHINGLES)).cast("int").alias("blocks")), "jaccard-blocks")
    own = banded.join(per, ["root", "band"]).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    near = F.when(F.col("cut"), F.array(*[F.col("band") + x for x in (-1, 0, 1)])).otherwise(F.array("band"))
    met = (own.withColumn("other", F.explode(near)).join(per.select("root", F.col("band").alias("other"), F.col("blocks").alias("theirs")), ["root", "other"])
           .withColumn("met", F.explode(F.sequence(F.lit(0), F.col("theirs") - 1))))
    mine, yours = F.struct(F.col("band").alias("x"), F.col("block").alias("y")), F.struct(F.col("other").alias("x"), F.col("met").alias("y"))
    low, high = F.least(mine, yours), F.greatest(mine, yours)
    cell = ((low["x"].cast("long") * 2 + high["x"] - low["x"]) * (1 << 23) + low["y"]) * (1 << 23) + high["y"]
    return met.select("cid", "key", "digest", "root", cell.alias("cell"), F.when(mine == yours, 2).otherwise((mine > yours).cast("int")).alias("side"))


def _degrees(joined: DataFrame, src: DataFrame, k: int, percent: int) -> DataFrame:
    """(cid, n_links): for each class of a component all other classes whose sets overlap enough with its own."""
    roles = stored(_cells(joined, percent), "jaccard-cells")
    dealt = (_with_texts(roles, src).select("root", "cell", "side", "cid", "digest", "text")
             .repartition(n_parts(src.sparkSession), "root", "cell").sortWithinPartitions("root", "cell", "side", "cid"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []  # class ids and sets on each side

        def links() -> pa.RecordBatch:
            (a, left), (z, right), (ids, sets) = held
            if sets:
                n = _linked(sets, None, percent)[0]
            elif left and right:
                ids, n = a + z, np.concatenate(_linked(left, right, percent))
            else:
                n = []
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64())], names=["cid", "n"])

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("root", "cell", "side", "cid", "digest")]
            for root, cell, side, cid, digest, s in zip(*cols, shingle_sets(batch.column("text"), k)):
                if _digest(s) != digest:
                    continue
                if now != (root, cell):
                    if now:
                        yield links()
                    now, held = (root, cell), [([], []), ([], []), ([], [])]
                ids, sets = held[side]
                if not ids or ids[-1] != cid:  # a repeated row
                    ids.append(cid)
                    sets.append(s)
        if now:
            yield links()

    return dealt.mapInArrow(run, "cid long, n long").groupBy("cid").agg(F.sum("n").alias("n_links"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 4, percent: int = 85) -> DataFrame:
    """One row per input row: id, n_shingles (distinct), component_id (smallest id reachable), n_links (other
    shingle sets that link with the row's own, all of them).

    A-Z are lower-cased, words are ``[^\\x20\\x09-\\x0D]+``; a text of fewer words than ``shingle`` is one
    shingle. Two documents link when 100 * intersection >= percent * union. Null, empty and blank texts
    have no shingle and link with nothing, also not with each other: their component is their own id.
    Equal sets always link. Repeated rows each keep a row; null ids are linked, but never name a
    component while another id can. Very long texts are read whole. Other columns are ignored, whatever
    their names. An empty table gives an empty result.

    Sets are compared by 64-bit hashes of their shingles.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).withColumn("key", F.coalesce("id", F.xxhash64("text")))
    own = stored(_measured(src, shingle, percent), "jaccard-sets")
    classes = stored(own.where("n > 0").groupBy("digest", "grp", "n").agg(F.min("key").alias("key"), F.min("id").alias("low"))
                     .withColumn("cid", F.monotonically_increasing_id()), "jaccard-classes")  # written, so ids are settled
    group = Window.partitionBy("grp")
    members = stored(classes.select("*", F.min("cid").over(group).alias("gid"), F.lag("cid").over(group.orderBy("cid")).alias("before")).drop("grp"), "jaccard-members")

    heads = stored(members.where("cid = gid").select("gid", "key", "digest"), "jaccard-heads")
    by_size = Window.partitionBy("token").orderBy("n", "gid", "pos")
    tokens = (own.join(heads, ["key", "digest"]).select("gid", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "token"))
              .select("*", F.lag("n").over(by_size).alias("n0"), F.lead("n").over(by_size).alias("n2"))
              .where((F.col("n0") * 100 >= percent * F.col("n")) | (F.col("n") * 100 >= percent * F.col("n2"))).select("token", "gid", "n", "pos"))
    tokens = stored(tokens, "jaccard-tokens")  # shingles of one group, or of groups too far apart in size, are gone

    lists = stored(_lists(tokens), "jaccard-lists")
    within = members.where("before is not null")
    first = (_bounded(_centres(tokens, percent), lists, percent).select(F.col("ga").alias("a"), F.col("gb").alias("b"))
             .unionByName(within.select(F.col("cid").alias("a"), F.col("before").alias("b"))))
    links = _verified(first, members, src, shingle, percent)

    comp = connected_components(links)
    named = stored(members.select("cid", "gid", "n").join(comp, F.col("cid") == F.col("node"), "left").select("cid", "gid", "n", F.coalesce("root", "cid").alias("comp")), "jaccard-named")
    parts = stored(named.groupBy("gid", "comp").agg(F.max("n").cast("int").alias("n")), "jaccard-parts")
    mixed = parts.groupBy("gid").agg(F.count("*").alias("m")).where("m > 1").select("gid")
    rows = tokens.select("token", "gid", "n", "pos").join(parts.select("gid", "comp"), "gid").select("token", "gid", "comp", "n", "pos")
    apart = parts.join(mixed, "gid")  # a group's own parts meet too
    own_parts = apart.select(F.xxhash64("gid", F.lit("group")).alias("token"), "gid", "comp", "n", F.lit(0).alias("pos"))
    pairs = stored(_open_pairs(rows.unionByName(own_parts), percent), "jaccard-groups")
    pairs = pairs.where("ga = gb").unionByName(_bounded(pairs.where("ga <> gb"), lists, percent))
    side = [named.select(F.col("gid").alias(f"g{s}"), F.col("comp").alias(f"c{s}"), F.col("cid").alias(s)) for s in "ab"]
    expanded = pairs.join(side[0], ["ga", "ca"]).join(side[1], ["gb", "cb"]).select("a", "b")
    links = links.unionByName(_verified(expanded, members, src, shingle, percent))

    roots = connected_components(links)
    joined = stored(members.select("cid", "key", "digest", "n").join(roots, F.col("cid") == F.col("node")).drop("node"), "jaccard-joined")
    degree = _degrees(joined, src, shingle, percent)
    low = members.select("cid", "digest", "low").join(roots, F.col("cid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cid"))
    least = low.groupBy("root").agg(F.min("low").alias("component"))
    final = low.join(least, "root").join(degree, "cid", "left").select("digest", "component", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    empty = own.where("n = 0").select("id", "n", F.col("id").alias("component"), F.lit(0).cast("long").alias("n_links"))
    return (own.where("n > 0").select("id", "n", "digest").join(final, "digest").select("id", "n", "component", "n_links").unionByName(empty)
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "n_links"))
