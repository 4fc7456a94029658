import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LINES = [f"this is line number {k} of a passage that several texts share" for k in range(6)]


def messy_rows():
    """Nulls in any column, empty and blank texts, ties, repeated rows, copies, a long text, shared passages."""
    passage = "\n".join(LINES)
    words = " ".join(f"w{k * 7919 % 1009}x{k}" for k in range(80))
    rows = [(1, words, "en", "a", 5), (2, words, "en", "a", 5), (2, words, "en", "a", 5), (3, words + " tail", None, None, None),
            (4, None, "en", "b", 0), (5, "", "en", "b", 0), (6, " \t\n ", "de", "b", 4), (None, words, "en", "c", 1), (None, None, None, None, None),
            (7, passage, "en", "c", 1), (8, "start\n" + passage + "\nend", "en", "c", 1), (9, "\n".join(LINES[2:5]) + "\nown line of nine", "en", "c", 1),
            (10, "é" * 70 + "ü", "fr", "d", 71), (11, "x" + "é" * 70, "fr", "d", 71), (12, "tiny", "en", "d", 4), (13, "tiny", "en", "d", 4),
            (14, " ".join(f"long{k % 977}y{k}" for k in range(30000)), "en", "d", 1), (15, "a " * 120, "en", "d", 1)]
    return rows


@pytest.fixture(scope="session")
def messy(spark):
    return spark.createDataFrame(messy_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(messy):
    """Extra columns with the names that the operators use inside and return."""
    from pyspark.sql import functions as F

    names = ["id", "tie", "size", "shard", "slot", "key", "crc", "fp", "fingerprint", "component_id", "n_words", "kept", "n_lines", "n_removed",
             "piece", "group", "bin", "block", "part", "ids", "n", "start", "_id", "_tie", "_at", "_text", "_gone", "h", "law", "base_failed"]
    return messy.select("*", *[F.lit("clash").alias(c) for c in names])


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
