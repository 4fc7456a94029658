"""Operator 3: sharding by minimax contiguous partition.

Groups of equal texts are atomic and stand in the order of their smallest id. The smallest shard
capacity that lets a greedy scan pack all groups into the given number of shards is found by binary
search. Of the cuts that keep this capacity, the most even ones are taken, so that one very large group
does not leave later shards empty.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import md5_bytes, n_parts, prefix_sums, stored

GRID = 4096  # prefix values that the driver asks for in one round


class PrefixGrid:
    """The ordered prefix sums (ends of groups) of a distributed table, known to the driver only where it matters.

    The driver holds cells (smallest end, largest end, number of ends). A cell of up to two ends is known
    exactly; others give bounds, and ``refine`` asks Spark to cut those that matter into GRID finer ones.
    """

    def __init__(self, ends: DataFrame, end: str, total: int, shards: int, grid: int = GRID):
        self.ends, self.end, self.total, self.shards = ends, end, total, shards
        self.grid = max(grid, 64 * shards)  # room for several cells around every cut
        self.cells: list[tuple[int, int, int]] = []
        self._load([(0, total)])

    def _load(self, ranges: list[tuple[int, int]]) -> None:
        """Replace all cells within each (lo, hi] by finer ones: one aggregate over the prefix table."""
        step = [max(1, -(-(hi - lo) // max(1, self.grid // len(ranges)))) for lo, hi in ranges]
        c = F.col(self.end)
        which = F.lit(None).cast("string")
        for (lo, hi), s in zip(ranges, step):
            which = F.when((c > lo) & (c <= hi), F.concat_ws("_", F.lit(lo), F.floor((c - lo - 1) / s))).otherwise(which)
        new = self.ends.groupBy(which.alias("cell")).agg(F.min(c), F.max(c), F.countDistinct(c)).where("cell is not null").collect()
        keep = [x for x in self.cells if not any(lo < x[0] and x[1] <= hi for lo, hi in ranges)]
        self.cells = sorted([*keep, *((r[1], r[2], r[3]) for r in new)])
        self.low, self.high = [x[0] for x in self.cells], [x[1] for x in self.cells]

    def reach(self, limit: int) -> tuple[int, int]:
        """Bounds (from below, from above) of the largest end that is at most ``limit``."""
        k = bisect_right(self.low, limit) - 1
        if k < 0:
            return 0, 0
        low, high, n = self.cells[k]
        if high <= limit:
            return high, high
        return low, (low if n <= 2 else min(limit, high - 1))

    def after(self, start: int) -> int:
        """The smallest end that is at least ``start`` (of an unsettled cell: its largest, and the cell is noted)."""
        if start <= 0:
            return 0
        k = bisect_left(self.high, start)
        low, high, n = self.cells[k]
        if low >= start:
            return low
        if n > 2:
            self.unsettled.add((low - 1, high))
        return high

    def upto(self, limit: int) -> int:
        """The largest end that is at most ``limit`` (of an unsettled cell: its smallest, and the cell is noted)."""
        least, most = self.reach(limit)
        if least != most:
            low, high, _ = self.cells[bisect_right(self.low, limit) - 1]
            self.unsettled.add((low - 1, high))
        return least

    def even_cuts(self, capacity: int) -> list[int]:
        """Cuts of the most even partition of that capacity: each as close to an equal share of the rest as it allows."""
        while True:
            self.unsettled: set[tuple[int, int]] = set()
            need = [self.total]  # where j shards of the capacity still reach the end from
            for _ in range(self.shards - 1):
                need.append(self.after(need[-1] - capacity))
            cuts, at = [], 0
            for left in range(self.shards - 1, 0, -1):
                share = at + (self.total - at) // (left + 1)
                below, above = self.upto(share), self.after(share)
                near = below if at < below and share - below <= above - share else above  # no empty shard before a large group
                at = max(at, min(max(near, need[left]), self.upto(at + capacity)))
                cuts.append(at)
            cuts.append(self.total)
            if not self.unsettled:
                return cuts
            self._load(_joined(sorted(self.unsettled), self.grid // 8))

    def greedy(self, capacity: int, sure: bool) -> list[int]:
        """Cuts of a greedy scan, by the lower (sure) or the upper bounds."""
        cuts, at = [], 0
        for _ in range(self.shards):
            at = max(at, self.reach(at + capacity)[0 if sure else 1])
            cuts.append(at)
        return cuts

    def smallest(self, sure: bool) -> int:
        lo, hi = -(-self.total // self.shards), self.total
        while lo < hi:
            mid = (lo + hi) // 2
            if self.greedy(mid, sure)[-1] >= self.total:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def solve(self) -> tuple[int, list[int]]:
        """(smallest feasible capacity, cuts)."""
        while True:
            most, least = self.smallest(True), self.smallest(False)
            first, last = self.greedy(least, True), self.greedy(most, False)
            if most == least and first == last:
                return most, first
            inside = sorted({(x[0] - 1, x[1]) for a, b in zip(first, last) for x in self.cells[max(0, bisect_left(self.high, a) - 1): bisect_right(self.low, b) + 1] if x[2] > 2})
            if not inside:  # every end near a cut is known: the bounds agree
                return most, self.greedy(most, True)
            self._load(_joined(inside, self.grid // 8))


def _joined(ranges: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """Touching ranges as one; then the closest ones joined until there are at most ``most``."""
    out = [ranges[0]]
    for lo, hi in ranges[1:]:
        out[-1:] = [(out[-1][0], hi)] if lo <= out[-1][1] else [out[-1], (lo, hi)]
    while len(out) > most:
        k = min(range(len(out) - 1), key=lambda i: out[i + 1][0] - out[i][1])
        out[k: k + 2] = [(out[k][0], out[k + 1][1])]
    return out


def shard_groups(sizes: DataFrame, shards: int) -> tuple[DataFrame, int]:
    """(key, shard) for groups (key, first, size), and the capacity. Shards may be empty if there are fewer groups."""
    summed, total = prefix_sums(sizes, ["first", "key"], "size", "before", "shard-groups")
    ends = stored(summed.select("key", (F.col("before") + F.col("size")).alias("end")), "shard-ends")
    if not total:
        return ends.select("key", F.lit(0).alias("shard")), 0
    grid = PrefixGrid(ends, "end", total, shards)
    capacity, _ = grid.solve()
    cuts = grid.even_cuts(capacity)
    shard = F.aggregate(F.lit(cuts[:-1] or [total]), F.lit(0), lambda n, cut: n + (F.col("end") > cut).cast("int"))
    return ends.select("key", F.least(shard, F.lit(shards - 1)).alias("shard")), capacity


def minimax_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes (null: none) plus 1; rows with equal texts (null counts as empty) share
    a shard. ``law`` is ``bytes``: the largest shard is as small as any contiguous cut of the groups
    allows. slot numbers a shard's rows from 0 without gaps, by id (null ids first), then text. Repeated
    rows each keep a row and a slot of their own; null ids are placed by their text. Other columns are
    ignored. An empty table gives an empty result.

    A group's size is a map-side combined sum; rows fetch their shard from the group table. No task sees
    a whole shard, and the driver sees one subtotal per partition and at most GRID prefix cells a round.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    rows = stored(docs.select(F.col(id_col).alias("id"), (F.octet_length(body) + 1).cast("long").alias("size"),
                              F.crc32(F.encode(body, "utf-8")).alias("crc"), md5_bytes(body).alias("key")), "shard-rows")
    groups = rows.groupBy("key").agg(F.min("id").alias("first"), F.sum("size").alias("size"))
    placed, _ = shard_groups(groups, shards)
    held = rows.join(placed, "key")
    # slots: ids are dealt by range; a row's slot counts its shard's rows in earlier ranges, then in its own
    # (written first, so that the number which tells repeated rows apart is the same in every retry)
    salted = stored(held.withColumn("dup", F.monotonically_increasing_id()), "shard-placed")
    ranged = stored(salted.repartitionByRange(n_parts(spark), F.col("id"), F.col("key"), F.col("dup")).withColumn("part", F.spark_partition_id()), "shard-slots")
    counts = {(r[0], r[1]): r[2] for r in ranged.groupBy("part", "shard").count().collect()}  # partitions x shards
    parts = max((p for p, _ in counts), default=-1) + 1
    base, run = [0] * max(1, parts * shards), [0] * shards
    for p in range(parts):
        for s in range(shards):
            base[p * shards + s] = run[s]
            run[s] += counts.get((p, s), 0)
    nth = F.row_number().over(Window.partitionBy("part", "shard").orderBy("id", "key", "dup"))
    slot = F.get(F.lit(base), F.col("part") * shards + F.col("shard")) + nth - 1
    return ranged.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
                         slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
