"""Every registered query of the library against its DuckDB oracle at sf0.001 (weft.llm has its own tests)."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

from check import TABLES, digest  # noqa: E402

from weft.plans.registry import ORACLES, QUERIES, load_all  # noqa: E402

SF = "/root/testdata/sf0.001"
load_all()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    want = con.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    got_rows, want_rows = [tuple(r) for r in df.collect()], want.fetchall()
    spark.catalog.clearCache()
    assert len(got_rows) == len(want_rows)
    got, a = digest(got_rows, df.columns, 5)
    exp, b = digest(want_rows, want.columns, 5)
    assert got == exp, ([x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3])
