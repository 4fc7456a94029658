"""Operator 4: variable-capacity best-fit packing.

Pieces of documents go into sequences of several permitted lengths. The lengths are chosen jointly: a new
bin opens at the length whose cost per expected token is least given the pieces that are still to come,
each piece goes to the bin it fits best, and every bin is finally downsized to the smallest permitted
length that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import stored
from weft.llm.tokens import count_tokens

LENGTHS = (512, 1024, 2048, 4096)
OVERHEAD = 16  # cost of a bin besides its length, in tokens
COPIES = 4096  # equal rows are numbered in runs of this length
GROUP_TOKENS = 4 << 20  # tokens packed in one task group, about


def count_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null: none."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def pack(sizes: np.ndarray, lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(bin, offset) of every piece, and the length of every bin. Pieces are placed from large to small, ties in their order.

    An open bin with the least room that still fits takes the piece. Else a bin opens: for each length
    that fits, the fill is estimated by letting the remaining smaller pieces follow greedily, and the
    length with the least (length + overhead) per token so filled is opened.
    """
    lengths = tuple(sorted(lengths))
    order = np.argsort(-sizes, kind="stable")
    desc = sizes[order]
    bins, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    room: list[tuple[int, int]] = []  # (room left, bin), sorted
    used: list[int] = []
    for at, k in enumerate(order):
        s = int(sizes[k])
        spot = bisect_left(room, (s, -1))
        if spot < len(room):
            left, b = room.pop(spot)
        else:
            b, left = len(used), _open(desc, at, s, lengths, overhead)
            used.append(0)
        bins[k], offset[k] = b, used[b]
        used[b] += s
        if left > s:
            insort(room, (left - s, b))
    return bins, offset, [lengths[bisect_left(lengths, u)] for u in used]


def _open(desc: np.ndarray, at: int, s: int, lengths: tuple[int, ...], overhead: int) -> int:
    """The permitted length with the least cost per token, if the next fitting pieces follow."""
    best, least = lengths[-1], None
    for n in lengths:
        if n < s:
            continue
        fill, look = s, at + 1
        while fill < n and look < len(desc):
            look = max(look, int(np.searchsorted(-desc, fill - n)))  # the first piece that still fits
            if look == len(desc) or desc[look] == 0:
                break
            fill += int(desc[look])
            look += 1
        cost = (n + overhead) / max(1, fill)
        if least is None or cost < least:
            best, least = n, cost
    return best


def pack_tokens(docs: DataFrame, tokenizer: str, end_id: int | None = 2, id_col: str = "doc_id", text: str = "text",
                lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD) -> DataFrame:
    """``best_fit`` over the token ids of the texts, each document with its end id; a null or empty text is the end id alone.

    Rows as in ``best_fit``; its rules for nulls, ties, repeated rows, long texts and empty tables hold.
    """
    counted = count_tokens(docs, tokenizer, end_id, id_col, text)
    return best_fit(counted, F.col("n_tokens"), id_col, "text_hash", lengths, overhead)


def best_fit(docs: DataFrame, tokens: Column | None = None, id_col: str = "doc_id", text: str = "text",
             lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD) -> DataFrame:
    """One row per piece: id, piece, n_pieces, start (token of the document), n_tokens, group, bin, offset, length, bin_tokens.

    A document of more tokens than the largest length is cut into pieces of that length and one rest; no
    token is lost. ``tokens`` counts a row's tokens (default: its words); ``text`` is any column that tells rows
    of one id apart. Documents without tokens
    (null or empty text) give one piece of 0 tokens in a bin. (group, bin) names a sequence of ``length``
    tokens that holds ``bin_tokens``; a piece stands at ``offset``. Null ids and repeated rows are packed
    like any other row. Other columns are ignored; an empty table gives an empty result.

    Groups of about GROUP_TOKENS tokens are drawn by a hash, so that each has the mix of sizes that
    packing needs and none grows with the input; equal rows are numbered and spread by their numbers. The
    packing does not depend on the input's partitioning. Very long texts are counted whole.
    """
    spark = docs.sparkSession
    counted = docs.select(F.col(id_col).cast("long").alias("id"), (count_words(F.col(text)) if tokens is None else F.coalesce(tokens, F.lit(0)).cast("long")).alias("n"),
                          F.xxhash64(F.col(text)).alias("tie"))
    equal = counted.groupBy("id", "n", "tie").agg(F.count("*").alias("copies"))  # combined before the exchange, then numbered
    runs = equal.withColumn("copy", F.explode(F.expr(f"sequence(0L, copies - 1, {COPIES}L)")))
    rows = stored(runs.withColumn("copy", F.explode(F.expr(f"sequence(copy, least(copy + {COPIES - 1}L, copies - 1))"))).drop("copies"), "packing")
    total = rows.agg(F.sum("n"), F.count("*")).first()
    groups = max(1, -(-max(total[0] or 0, 16 * total[1]) // GROUP_TOKENS))
    top = max(lengths)
    pieces = F.greatest(F.ceil(F.col("n") / top), F.lit(1)).cast("int")
    cut = rows.withColumn("n_pieces", pieces).select("id", "n", "tie", "copy", "n_pieces", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)).alias("piece"))
    cut = cut.select("id", "tie", "copy", "piece", "n_pieces", (F.col("piece").cast("long") * top).alias("start"),
                     F.least(F.col("n") - F.col("piece").cast("long") * top, F.lit(top)).cast("long").alias("n_tokens"),
                     F.pmod(F.xxhash64("id", "tie", "copy", "piece"), F.lit(groups)).alias("group"))

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["id", "tie", "copy", "piece"], kind="stable")
        bins, offset, length = pack(rows["n_tokens"].to_numpy(np.int64), lengths, overhead)
        fill = np.bincount(bins, weights=rows["n_tokens"], minlength=len(length)).astype(np.int64)
        return rows.drop(columns=["tie", "copy"]).assign(bin=bins, offset=offset, length=np.array(length, np.int64)[bins], bin_tokens=fill[bins])

    schema = "id long, piece int, n_pieces int, start long, n_tokens long, group long, bin long, offset long, length long, bin_tokens long"
    return cut.groupBy("group").applyInPandas(solve, schema).withColumnRenamed("id", id_col)
