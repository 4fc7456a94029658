"""Operator 12: Merkle manifest of a table by a nested-struct rollup.

Every row is a leaf, leaves of a group stand in order, and every two consecutive nodes become one. A
leaf's rank is cut into binary digits; the last ``BLOCK_DIGITS`` of them are grouped away one after the
other inside a block (all leaves that agree on the other digits), and each step nests the children
under their parent's digest. Block roots are the leaves of the next tier, until one node is left in
each group; the groups' roots are then treated likewise. On the way down one transform a level carries
the siblings' digests to the leaves of a block and one explode emits them, so proofs need no join
inside blocks. Only block rows (one for 1,024 nodes, unique keys on both sides) are joined with the
path above them, since a whole tree nested into one row would have no bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import n_parts, stored

BLOCK_DIGITS = 10
COPIES = 1024  # equal rows are ranked as one and dealt out in runs of this length


def field(value: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, ``:``, value."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_digest(columns: list[Column]) -> Column:
    """Lowercase hex SHA-256 of the fields."""
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def _h(*digests: Column) -> Column:
    return F.sha2(F.concat(*digests), 256)


def _ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` (grp, copies, ...) with ``start`` (copies before the row in its group) and ``total`` (of the group).

    Rows are range-partitioned by (grp, order) and written. A partition holds whole groups but for its
    first and last one, so the driver sees two counts a partition, whatever the groups are.
    """
    spark = rows.sparkSession
    ranged = stored(rows.repartitionByRange(n_parts(spark), F.col("grp").asc(), *[F.col(c).asc_nulls_first() for c in order])
                    .withColumn("part", F.spark_partition_id()), name)
    ends = (ranged.groupBy("part", "grp").agg(F.sum("copies").alias("n")).groupBy("part")
            .agg(F.sha2(F.min("grp"), 256).alias("first"), F.min_by("n", "grp").alias("n_first"),
                 F.sha2(F.max("grp"), 256).alias("last"), F.max_by("n", "grp").alias("n_last"))
            .orderBy("part").collect())
    before, after = {}, {}
    key, run = None, 0
    for e in ends:
        before[e.part] = run if e.first == key else 0
        key, run = e.last, e.n_last + (before[e.part] if e.first == e.last else 0)
    key, run = None, 0
    for e in reversed(ends):
        after[e.part] = run if e.last == key else 0
        key, run = e.first, e.n_first + (after[e.part] if e.first == e.last else 0)
    edge = spark.createDataFrame([(e.part, e.first, before[e.part], e.last, after[e.part]) for e in ends],
                                 "part int, first string, before long, last string, after long")
    own = Window.partitionBy("part", "grp")
    earlier = own.orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("start", F.coalesce(F.sum("copies").over(earlier), F.lit(0))).withColumn("total", F.sum("copies").over(own))
    mine = F.sha2("grp", 256)
    lead = F.when(mine == F.col("first"), F.col("before")).otherwise(F.lit(0))
    tail = F.when(mine == F.col("last"), F.col("after")).otherwise(F.lit(0))
    return (local.join(F.broadcast(edge), "part")  # one row a partition
            .withColumn("start", F.col("start") + lead).withColumn("total", F.col("total") + lead + tail)
            .drop("part", "first", "before", "last", "after"))


def _tier(nodes: DataFrame, digits: int) -> DataFrame:
    """Blocks (grp, total, block, node) of the nodes (grp, total, pos, node): node is a struct with its digest ``h``."""
    b = nodes.select("grp", "total", F.shiftright("pos", digits).alias("block"),
                     *[F.shiftright("pos", k).bitwiseAND(F.lit(1)).cast("byte").alias(f"d{k}") for k in range(digits)], "node")
    b = b.repartition(n_parts(nodes.sparkSession), "grp", "total", "block")  # every level below groups inside this partitioning
    for k in range(digits):
        keys = ["grp", "total", "block", *[f"d{j}" for j in range(digits - 1, k, -1)]]
        pair = [F.first(F.when(F.col(f"d{k}") == side, F.col("node")), ignorenulls=True).alias(f"kid{side}") for side in (0, 1)]
        both = F.concat(F.col("kid0.h"), F.coalesce(F.col("kid1.h"), F.lit("")))
        digest = F.when(F.col("total") > (1 << k), F.sha2(both, 256)).otherwise(F.col("kid0.h"))  # a lone last node is hashed alone
        b = b.groupBy(*keys).agg(*pair).select(*keys, F.struct(digest.alias("h"), F.array_compact(F.array("kid0", "kid1")).alias("kids")).alias("node"))
    return b


def _kids(hashed: Column):
    """The children of a node with their paths; ``hashed``: the group has more than one node on their level."""

    def down(x):
        kids = x["node"]["kids"]

        def step(kid, i):
            side = F.when(F.size(kids) == 1, "alone").when(i == 0, "right").otherwise("left")
            other = F.when(F.size(kids) == 2, F.get(kids, 1 - i)["h"])
            hop = F.array(F.struct(side.alias("side"), other.alias("digest")))
            return F.struct(kid.alias("node"), F.when(hashed, F.concat(hop, x["path"])).otherwise(x["path"]).alias("path"))

        return F.transform(kids, step)

    return down


def _unfold(blocks: DataFrame, digits: int) -> DataFrame:
    """One row per node under the blocks (grp, total, block, node, path, ...): ``node`` and the path from it to the root."""
    keep = [c for c in blocks.columns if c not in ("total", "block", "node", "path")]
    cur = blocks.withColumn("nodes", F.array(F.struct("node", "path")))
    for k in range(digits - 1, -1, -1):
        cur = cur.withColumn("nodes", F.flatten(F.transform("nodes", _kids(F.col("total") > (1 << k)))))
    return cur.select(*keep, F.explode("nodes").alias("x")).select(*keep, F.col("x.node").alias("node"), F.col("x.path").alias("path"))


def _tree(leaves: DataFrame, largest: int, name: str) -> list[DataFrame]:
    """Stored block tables, lowest tier first; the last one has one block a group."""
    tiers, cur = [], leaves
    while True:
        blocks = stored(_tier(cur, BLOCK_DIGITS), f"{name}-{len(tiers)}")
        tiers.append(blocks)
        largest = -(-largest >> BLOCK_DIGITS)
        if largest <= 1:
            return tiers
        size = F.shiftright(F.col("total") + ((1 << BLOCK_DIGITS) - 1), BLOCK_DIGITS)
        cur = blocks.select("grp", size.alias("total"), F.col("block").alias("pos"), F.struct(F.col("node.h").alias("h"), F.col("block").alias("at")).alias("node"))


def _paths(tiers: list[DataFrame], top: DataFrame) -> DataFrame:
    """(grp, node, path, carried columns of ``top``) for every leaf: ``top`` holds one row per group with its path."""
    above = top.withColumn("block", F.lit(0).cast("long"))
    for blocks in reversed(tiers):
        nodes = _unfold(blocks.join(above, ["grp", "block"]), BLOCK_DIGITS)
        above = nodes if blocks is tiers[0] else nodes.withColumn("block", F.col("node.at")).drop("node")
    return above


def _largest(ranked: DataFrame) -> int:
    return ranked.agg(F.max("total")).first()[0] or 1


def merkle_manifest(docs: DataFrame, columns: list[str], id_col: str = "doc_id", group: str = "lang", given: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: id, leaf, given, subroot, root, proof (array of side and digest, leaf to root).

    ``columns`` are the fields of a leaf. ``given`` is a digest over the columns of ``docs`` that a reader
    presents for the row (default: the leaf); ``folded`` turns it into a root. Leaves of a group stand in
    the order of the id (null first), then of leaf and ``given``; groups in bytewise order, null first.
    A proof step is ``left`` or ``right`` with the sibling's digest, or ``alone`` (digest null) where the
    last node of a level is hashed alone; levels end with one node, so a single row has an empty proof.

    Null fields and null ids are values like any other; empty and very long texts are hashed whole.
    Repeated rows are a leaf each (equal ones counted, not gathered, before they are ranked). Other
    columns, whatever their names, are ignored. An empty table gives an empty result and no root.
    """
    leaf = leaf_digest([F.col(f"`{c}`") for c in columns])
    grp = F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0"))  # null first
    src = docs.select(F.col(id_col).alias("id"), grp.alias("grp"), leaf.alias("h"), (leaf if given is None else given).alias("given"))
    ranked = _ranked(src.groupBy("grp", "id", "h", "given").agg(F.count("*").alias("copies")), ["id", "h", "given"], "merkle-rows")
    run = F.explode(F.expr(f"sequence(start, start + copies - 1, {COPIES}L)"))
    one = F.explode(F.expr(f"sequence(pos, least(pos + {COPIES - 1}L, start + copies - 1))"))
    leaves = (ranked.withColumn("pos", run).withColumn("pos", one)
              .select("grp", "total", "pos", F.struct("h", "id", "given").alias("node")))
    tiers = _tree(leaves, _largest(ranked), "merkle")

    subroots = tiers[-1].select(F.lit("").alias("grp"), F.lit(1).cast("long").alias("copies"), F.col("grp").alias("of"), F.col("node.h").alias("h"))
    top = _ranked(subroots, ["of"], "merkle-groups")
    upper = _tree(top.select("grp", "total", F.col("start").alias("pos"), F.struct("h", "of").alias("node")), _largest(top), "merkle-top")
    empty_path = F.expr("cast(array() as array<struct<side:string,digest:string>>)")
    crown = upper[-1].select("grp", F.col("node.h").alias("root"), empty_path.alias("path"))
    groups = _paths(upper, crown).select(F.col("node.of").alias("grp"), F.col("node.h").alias("subroot"), "root", "path")

    out = _paths(tiers, groups)
    return out.select(F.col("node.id").alias(id_col), F.col("node.h").alias("leaf"), F.col("node.given").alias("given"), "subroot", "root", F.col("path").alias("proof"))


def proof_digest(proof: Column) -> Column:
    """SHA-256 of the proof's sibling digests, leaf to root (of nothing: of the empty string)."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: s["digest"]), ""), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that ``leaf`` gives with the siblings of ``proof``."""

    def step(acc, s):
        return F.when(s["side"] == "left", _h(s["digest"], acc)).when(s["side"] == "right", _h(acc, s["digest"])).otherwise(_h(acc))

    return F.aggregate(proof, leaf, step)


def verified_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of ``documents`` with the root that each row's presented leaf folds to.

    Rows whose id's decimal digits have an unsigned CRC-32 divisible by 7 are presented with ``n_chars``
    one higher (a null stays null, so such a row still verifies; so does a row without id).
    """
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    changed = [F.col("n_chars") + 1 if c == "n_chars" else F.col(c) for c in fields]
    plain = leaf_digest([F.col(c) for c in fields])
    m = merkle_manifest(docs, fields, given=F.when(tampered & F.col("n_chars").isNotNull(), leaf_digest(changed)).otherwise(plain))
    m = m.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), folded(F.col("given"), F.col("proof")).alias("folded_root"))
    return m.withColumn("verified", F.col("folded_root") == F.col("root"))
