"""Sample values beside a detected schema."""

from weft.sources import files as FS


def test_samples_of_odd_columns(spark):
    df = spark.createDataFrame([(3, None, "b"), (1, None, "a"), (1, None, None), (2, None, "")], "n int, none string, t string")
    got = {r.column_name: (r.position, r.n_null, r.n_distinct, list(r.samples)) for r in FS.detect_schema(df, 2).collect()}
    assert got == {"n": (1, 0, 3, ["1", "2"]), "none": (2, 4, 0, []), "t": (3, 1, 3, ["", "a"])}
    assert "samples" not in FS.detect_schema(df).columns
    assert [list(r.samples) for r in FS.detect_schema(df.limit(0), 2).collect()] == [[], [], []]
