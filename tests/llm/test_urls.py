import duckdb

from weft.llm.queries import ORACLES, QUERIES
from weft.llm.url_filter import url_filter

SF_SMALL = "/root/testdata/sf0.001"

URLS = ["http://example.com/en/x", "https://www.example.com/en/x", "https://WWW.Example.COM/en/x?y#z", "http://a.net/es/", "http://a.net/es", "http://net/fr/a",
        "http://notnet/fr/a", "ftp://example.com", "http://example.com?x=/en/", "no scheme", None, "", "http://", "http:///en/", "x://y://example.com/en/", "http://É.com/é/",
        "http://example.com/en/" + "a/" * 5000, "http://" + "a." * 500 + "com/", "http://example.com./en/", "http://example.com/en/x\ny", "http://user@example.com/en/"]


def run_sql(spark, df):
    import pandas as pd

    pages = pd.DataFrame([tuple(r) for r in df.select("page_id", "url").collect()], columns=["page_id", "url"]).astype({"url": "string"})
    con = duckdb.connect()
    con.register("pages", pages)
    return con.sql(f"select page_id, host, path, rule, verdict from ({ORACLES['op6_url_filter']})").fetchall()


def rules(spark, *rows):
    return spark.createDataFrame(list(rows), "host string, path string, verdict string")


def test_query_and_odd_urls_equal_sql(spark, tmp_path):
    con = duckdb.connect()
    con.sql(f"create view pages as select * from read_parquet('{SF_SMALL}/pages.parquet')")
    got = QUERIES["op6_url_filter"](spark, SF_SMALL)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(con.sql(f"select {', '.join(got.columns)} from ({ORACLES['op6_url_filter']})").fetchall(), key=repr)
    df = spark.createDataFrame([*enumerate(URLS), *enumerate(URLS)], "page_id long, url string")
    df.write.parquet(str(tmp_path / "pages.parquet"))
    got = QUERIES["op6_url_filter"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(run_sql(spark, df), key=repr)


def test_precedence_and_partial_segments(spark):
    r = rules(spark, ("a.com", "/x", "block"), ("a.com", "/x/y/", "allow"), ("a.com", "", "block"), ("b.com", "/", "block"), ("b.com", "/", "allow"), (None, "/", "block"), ("", "/", "block"), ("c.com", "/", None))
    urls = ["http://a.com/xylophone", "http://a.com/x/y/z", "http://a.com", "http://s.b.com/", "http://c.com/", "http://d.com/"]
    got = {x["url"]: (x["rule"], x["verdict"]) for x in url_filter(spark.createDataFrame([(u,) for u in urls], "url string"), r, default="keep").collect()}
    assert [got[u] for u in urls] == [("a.com/x", "block"), ("a.com/x/y/", "allow"), ("a.com", "block"), ("b.com/", "block"), (None, "keep"), (None, "keep")]


def test_empty_tables_and_clashing_columns(spark):
    r = rules(spark, ("a.com", "/", "block"))
    df = spark.createDataFrame([(1, "http://a.com/", "h", "p", "r", "v", "d", "e")], "page_id long, url string, host string, path string, rule string, verdict string, digest string, expr string")
    row = url_filter(df, r).first()
    assert (row["host"], row["path"], row["rule"], row["verdict"], row["digest"], row["expr"]) == ("a.com", "/", "a.com/", "block", "d", "e")
    assert url_filter(df.limit(0), r).collect() == []
    assert url_filter(df, r.limit(0)).first()["verdict"] == "allow"
