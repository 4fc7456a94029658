"""One registered query per operator, and the DuckDB SQL where it can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import table
from weft.llm.jaccard import jaccard_components
from weft.llm.line_dedup import line_dedup
from weft.llm.merkle import verified_manifest
from weft.llm.packing import pack_tokens
from weft.llm.pieces import piece_digests
from weft.llm.quality import quality_measures
from weft.llm.sharding import minimax_shards
from weft.llm.simhash import simhash_components
from weft.llm.sql import LINES_SQL, MERKLE_SQL, QUALITY_SQL, TOPK_SQL, URL_SQL
from weft.llm.suffix_dedup import repeated_bytes
from weft.llm.tokens import token_files
from weft.llm.topk import top_k
from weft.llm.url_filter import url_filter
from weft.llm.whitening import whitened

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return deco


def tokenizer_path(name: str) -> str:
    """A public vocabulary file that is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_token_files")
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("word_bpe_49k.json"), end_id=2)


@query("op2_line_dedup", LINES_SQL)
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), gram=1, window=1, min_words=5)
    return kept.select("doc_id", "n_lines", "n_removed", "n_runs", F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


@query("op3_sharding")
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minimax_shards(table(spark, sf_dir, "documents"), shards=16)


@query("op4_best_fit_packing")
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("word_bpe_49k.json"), end_id=2)


@query("op5_exact_top_k", TOPK_SQL)
def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10)


@query("op6_url_filter", URL_SQL)
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, URL_RULES))} AS t(host, path, verdict)")
    return url_filter(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


@query("op7_sentencepiece")
def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


@query("op8_quality_rules", QUALITY_SQL)
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_measures(table(spark, sf_dir, "documents"), keep=["doc_id"])


@query("op9_suffix_array_dedup")
def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(table(spark, sf_dir, "documents"))


@query("op10_simhash")
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"), shingle=3, max_bits=2)


@query("op11_jaccard")
def op11_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), shingle=4, percent=85)


@query("op12_merkle_manifest", MERKLE_SQL)
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified_manifest(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"))


@query("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation as bigint)"))
