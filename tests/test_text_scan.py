"""One-pass keyword lookup, staged draws, gated scans: the same values as the plain forms, each part read once."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weft.functions import keywords as KW
from weft.functions import pii as P
from weft.functions import rand as R
from weft.functions import text as TX
from weft.operators import dirty as D
from weft.operators import temporal as TP
from weft.operators.rank import ordinal
from weft.plans.spec import DirtyProfile, TemporalPatterns

GROUPS = [*TX.DOMAIN_KEYWORDS.values(), ["hr", "é", "supply chain"], ["hr", "hr"]]


def _plain(text):
    return None if text is None else [sum(w in text for w in g) for g in GROUPS]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("cut", [7, 1 << 20])
def test_keyword_hits_equal_a_test_a_keyword(monkeypatch, cut):
    monkeypatch.setattr(KW, "SLICE_BYTES", cut)  # keywords lie across slices, and across neighbouring texts
    rng, words = random.Random(3), [w for g in GROUPS for w in g]
    texts = ["", None, "hr", "h", "r", "ban", "king", "supply chai", "n", "é\x00ß", *("".join(rng.choice([*words, " ", "x", "本", "h"])
             [rng.randrange(2):] for _ in range(rng.randrange(40))) for _ in range(60))]
    run = KW.counter(GROUPS)
    assert run(pa.array(texts)).to_pylist() == [_plain(t) for t in texts]
    assert run(pa.array(["bank", *texts]).slice(1)).to_pylist() == [_plain(t) for t in texts]
    assert run(pa.array([], pa.string())).to_pylist() == []


def test_texts_are_read_once_for_all_domain_keywords(spark):
    rows = [(0, "The BANK near the hospital ward"), (1, None), (2, ""), (3, "patient bank"), (4, "bank loan patient")]
    df = TX.with_domain(spark.createDataFrame(rows, "id int, text string"), "text")
    assert [r.domain for r in df.orderBy("id").collect()] == ["healthcare", "general", "general", "healthcare", "banking"]
    assert "contains" not in _plan(df).lower()


def test_row_counts_are_matched_once(spark):
    rows = [(0, "Create 1,200 of them"), (1, None), (2, "0 rows, generate 5"), (3, "no number"), (4, "GENERATE 12 things, 7 Rows")]
    df = TX.with_row_count(spark.createDataFrame(rows, "id int, text string"), "text")
    assert [r.row_count for r in df.orderBy("id").collect()] == [1200, 1000, 5, 1000, 7]
    assert _plan(df).count("regexp_extract(text") == len(TX.ROW_COUNT_PATTERNS)


def test_gated_scan_finds_what_the_whole_scan_finds(spark):
    rng = random.Random(5)
    bits = ["ABCDE1234F", "2345 6789 0123", "123-45-6789", "GB12WEST123456", "+91 9876543210", "a.b@c.de", "4111111111111111", "@", "+", "7",
            " ", "word", "É", "X1", "", "123.456.789-09", "-", "Z"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(8)))) for i in range(400)] + [(400, None), (401, "no span  here")]
    df = spark.createDataFrame(rows, "id int, text string").select(
        "text", P.segments(F.col("text")).alias("got"), F.split("text", P.SCAN).alias("plain"), F.regexp_extract_all("text", F.lit(P.SCAN), F.lit(0)).alias("spans"),
        P.mask_text(F.col("text"), 7).alias("masked"))
    for r in df.collect():
        if r.text is None:
            assert r.got is None and r.masked is None
        else:
            assert [x for i, x in enumerate(r.got) if i % 2] == r.spans and "".join(r.got) == r.text
            assert r.spans or r.masked == r.text


@pytest.mark.parametrize("rate", [0.0, 1e-17, 0.05, 0.3, 0.5, 1.0])
def test_below_equals_the_comparison(spark, rate):
    df = spark.range(3000).select(R.below(1, "t", ["id"], rate).alias("a"), (R.uniform01(1, "t", ["id"]) < F.lit(rate)).alias("b"))
    assert df.where("a <> b OR a IS NULL").count() == 0


def test_a_draw_is_hashed_once_for_its_whole_tree(spark):
    df = spark.range(50).select("id", F.expr("timestamp_ntz'2024-02-28 05:06:07.25' + make_dt_interval(id)").alias("ts"))
    out = TP.temporal_patterns(df, TemporalPatterns(tuple([1.0] * 7), tuple([1.0] * 24)), 1, ["id"])
    assert _plan(out).count("sha2(") == 2


def test_copies_are_drawn_before_they_are_soiled(spark):
    df = spark.range(2000).select("id", (F.col("id") % 97).cast("double").alias("v"), F.concat(F.lit("name"), "id").alias("s"))
    p = DirtyProfile(null_rate=0.1, typo_rate=0.2, outlier_rate=0.1, date_format_mix_rate=0.0, duplicate_rate=0.1, near_duplicate_rate=0.0)
    out = D.dirty_profile(df, p, 4, ["id"])
    first = D.dirty_profile(df, DirtyProfile(null_rate=0.1, typo_rate=0.2, outlier_rate=0.1, date_format_mix_rate=0.0, duplicate_rate=0.0, near_duplicate_rate=0.0), 4, ["id"])
    drawn = D.duplicate_draws(first, 0.1, 4, ["id"], "dup").drop("_draw")
    assert sorted(map(str, out.collect())) == sorted(map(str, first.unionByName(drawn).collect())) and out.count() == 2200


def test_ordinal_with_a_given_hash_and_counts(spark):
    df = spark.range(500).select("id", F.when(F.col("id") % 9 > 0, F.col("id") % 5).alias("v"))
    h = df.withColumn("h", R.hex52(F.concat_ws(":", F.col("id").cast("string"))))
    a = ordinal(df, "v", ["id"], "p").select("id", "p").collect()
    assert sorted(a) == sorted(ordinal(h, "v", ["id"], "p", hashed="h", counted=h).select("id", "p").collect())


def test_rows_of_one_key_take_places_by_the_tie_columns(spark):
    df = spark.createDataFrame([(1, 5, t) for t in (2, 0, 3, 1)] + [(2, 4, 0)], "id int, v int, t int").repartition(4)
    got = ordinal(df, "v", ["id"], "p", ties=["t"]).select("id", "t", "p").collect()
    assert sorted((r.p, r.t) for r in got) == [(0, 0), (1, 3), (2, 2), (3, 1), (4, 0)]
