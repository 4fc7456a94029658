"""Operator 2: line dedup by winnowing. DataFrame functions only.

A text's lines are hashed; ``gram`` consecutive hashes make a gram, and of every ``window`` consecutive
grams the smallest is selected. Any run of ``gram + window - 1`` lines that occurs twice therefore shares
a selected gram. Positions of recurring grams are joined, the matches are extended both ways to whole
windows of lines and on to maximal runs, and every run that stands later than its first occurrence is
deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import as_row, stored


def line_hashes(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda x: F.xxhash64(x))


def _grams(h: Column, gram: int) -> Column:
    """Hash of every ``gram`` consecutive line hashes."""
    return F.transform(F.sequence(F.lit(1), F.size(h) - gram + 1), lambda i: F.xxhash64(*[F.get(h, i - 1 + k) for k in range(gram)]))


def _minima(g: Column, window: int) -> Column:
    """Positions (from 1) of the smallest gram, leftmost on ties, of every ``window`` consecutive grams."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(g) - window + 1),
                                        lambda j: j - 1 + F.array_position(F.slice(g, j, window), F.array_min(F.slice(g, j, window))).cast("int")))


def _n_words(lines: Column) -> Column:
    return F.size(F.filter(F.split(F.array_join(lines, " "), r"[\x20\x09-\x0D]+"), lambda w: w != ""))


def repeated_windows(docs: DataFrame, gram: int, window: int) -> DataFrame:
    """(id, tie, at): starts (from 1) of windows of gram + window - 1 lines that also start earlier in (id, tie, line) order."""
    run = gram + window - 1
    lines = docs.select("id", "tie", line_hashes(F.col("text")).alias("h")).where(F.size("h") >= run)
    lines = stored(lines.dropDuplicates(["id", "tie"]), "line-hashes")
    g = lines.withColumn("g", _grams(F.col("h"), gram))
    prints = g.select("id", "tie", "h", "g", F.explode(_minima(F.col("g"), window)).alias("p")).withColumn("print", F.get("g", F.col("p") - 1))
    again = prints.groupBy("print").agg(F.count("*").alias("n")).where("n > 1").select("print")
    # the lines that windows holding the selected gram can reach, one position per window start
    first = F.greatest(F.col("p") - window + 1, F.lit(1))
    last = F.least(F.col("p"), F.size("h") - run + 1)
    reach = prints.select("id", "tie", "print", first.alias("first"), (last - first + 1).alias("n"), F.slice("h", first, last - first + run).alias("near"))
    starts = reach.join(again, "print").select("id", "tie", "first", F.posexplode(F.transform(F.sequence(F.lit(1), F.col("n")), lambda j: F.slice("near", j, run))).alias("k", "lines"))
    spot = F.struct(F.col("id").isNull().alias("x"), "id", "tie", (F.col("first") + F.col("k")).alias("at"))
    wins = starts.select(spot.alias("spot"), "lines").distinct()
    earliest = wins.groupBy("lines").agg(F.min("spot").alias("low"), F.count("*").alias("n")).where("n > 1")
    return wins.join(earliest, "lines").where("spot > low").select("spot.id", "spot.tie", "spot.at")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", gram: int = 2, window: int = 2, min_words: int = 0) -> DataFrame:
    """``docs`` with its text rewritten and three counts added: n_lines, n_removed, n_runs (deleted runs).

    A line goes if it lies in a run of at least ``gram + window - 1`` lines that, line by line equal, also
    starts at an earlier place; places are ordered by id (null ids last), a hash of the text, and line.
    Runs within one text count too. Windows that touch make one run; a run of fewer than ``min_words`` words
    (what stands between ASCII white space, over all its lines) stays. Lines are what stands between ``\\n``; the kept ones are joined by
    ``\\n``, and a text whose lines all go becomes empty. Very long texts are read whole. Null texts stay null (0 lines). Rows with equal
    id and text are one place: all of them keep the same lines. Ties have no say: equal runs are told
    apart by place only. Columns named n_lines, n_removed or n_runs are replaced. Empty tables stay empty.

    Recurring grams and first places are map-side combined aggregates; they are joined back by
    equi-joins that adaptive execution splits for a hot line. No group is ever gathered but the deleted
    places of one text.
    """
    run = gram + window - 1
    own = docs.drop("n_lines", "n_removed", "n_runs")
    body = F.col("row")[text]
    tied = as_row(own).withColumn("tie", F.xxhash64(body))
    gone = repeated_windows(tied.select(F.col("row")[id_col].alias("id"), "tie", body.alias("text")), gram, window)
    gone = gone.groupBy("id", "tie").agg(F.sort_array(F.collect_set("at")).alias("at")).withColumnRenamed("tie", "own_tie")
    out = tied.join(gone, F.col("row")[id_col].eqNullSafe(F.col("id")) & (F.col("tie") == F.col("own_tie")), "left").select("row", "at")
    at, lines = F.col("at"), F.split(body, "\n")
    n = F.size(at)
    # windows that touch make one run: where each begins, and where the lines after it resume
    begins = F.filter(at, lambda x, i: (i == 0) | (x > F.get(at, i - 1) + run))
    resumes = F.transform(F.filter(at, lambda x, i: (i == n - 1) | (F.get(at, i + 1) > x + run)), lambda x: x + run)
    cut = F.arrays_zip(begins.alias("begin"), resumes.alias("resume"))
    if min_words:
        cut = F.filter(cut, lambda r: _n_words(F.slice(lines, r["begin"], r["resume"] - r["begin"])) >= min_words)
    out = out.withColumn("cut", F.when(F.size(cut) > 0, cut))
    out = out.withColumns({"starts": F.concat(F.array(F.lit(1)), F.transform("cut", lambda r: r["resume"])),
                           "stops": F.concat(F.transform("cut", lambda r: r["begin"]), F.array(F.size(lines) + 1))})
    kept = F.flatten(F.transform(F.arrays_zip("starts", "stops"), lambda s: F.slice(lines, s["starts"], F.greatest(s["stops"] - s["starts"], F.lit(0)))))
    hit = F.col("cut").isNotNull()
    n_lines = F.when(body.isNotNull(), F.size(lines)).otherwise(0).cast("long")
    removed = F.when(hit, F.aggregate(F.arrays_zip("starts", "stops"), F.size(lines), lambda a, s: a - (s["stops"] - s["starts"]))).otherwise(0).cast("long")
    runs = F.when(hit, F.size("cut")).otherwise(0).cast("long")
    new = F.when(hit, F.array_join(kept, "\n")).otherwise(body)
    return out.select(*[new.alias(c) if c == text else F.col("row")[c].alias(c) for c in own.columns],
                      n_lines.alias("n_lines"), removed.alias("n_removed"), runs.alias("n_runs"))
