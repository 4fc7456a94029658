"""Corpus pipeline: quality rules, line dedup, SimHash near-dedup, suffix-array dedup, best-fit packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame
that is written and read again as the next one's ``docs``. All but the last return the columns of
``documents``.

In every stage nulls in any column are carried along, a null text counts as empty (the quality stage
rejects it), very long texts are handled whole, other columns (whatever their names) are dropped at the
start, and an empty table gives an empty result. Ties and repeated rows: each row is judged on its own
in the quality and packing stages; the line, SimHash and suffix stages order places by doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import stored, table
from weft.llm.line_dedup import line_dedup
from weft.llm.packing import pack_tokens
from weft.llm.quality import quality_measures
from weft.llm.queries import tokenizer_path
from weft.llm.simhash import one_per_component
from weft.llm.suffix_dedup import suffix_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_measures(docs.select(*COLUMNS), keep=COLUMNS).where("kept").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand earlier in the corpus are cut out, where they make runs of five words or more; n_chars follows the text."""
    return _counted(line_dedup(docs.select(*COLUMNS), gram=1, window=1, min_words=5))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the smallest doc_id."""
    return one_per_component(docs.select(*COLUMNS), shingle=3, max_bits=2)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes covered by a 50-byte string of a smaller doc_id are cut out (whole characters only); n_chars follows the text."""
    return _counted(suffix_dedup(docs.select(*COLUMNS)))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of token ids: its sequence (group, bin), offset, the sequence's length and fill."""
    return pack_tokens(docs.select(*COLUMNS), tokenizer_path("word_bpe_49k.json"), end_id=2)


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


STAGES = [("quality", quality_stage), ("lines", line_stage), ("simhash", simhash_stage), ("suffix", suffix_stage), ("packing", packing_stage)]

#: The stages use fingerprints and suffix order, which SQL over ``documents`` cannot state.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
