"""The rules of op6 are those of its contract, in the query and in its SQL."""
import duckdb

from lexloom.llm.catalog import ORACLES, QUERIES

URLS = {
    "http://a.org/x": ("org/", "allow"), "http://example.org/es/1": ("example.org/es/", "block"), "http://example.org/en/1": ("example.org/en/1", "block"),
    "http://WWW.example.org/en/17?q": ("example.org/en/1", "block"), "http://example.org/en/2": ("org/", "allow"),
    "http://b.com/fr/": ("com/fr/", "allow"), "http://b.com/de/x": ("com/de/", "block"), "http://b.com/en/1": (None, "allow"),
}


def test_rules_of_the_contract(spark, tmp_path):
    rows = [(i, u) for i, u in enumerate([*URLS, None])]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    want = {(i, *URLS.get(u, (None, "allow"))) for i, u in rows}
    got = QUERIES["op6_url_filter"](spark, str(tmp_path)).collect()
    assert {(r.page_id, r.rule, r.verdict) for r in got} == want
    sql = ORACLES["op6_url_filter"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert {(r[0], r[3], r[4]) for r in con.execute(sql).fetchall()} == want
