from glint.operators import surface
from glint.plans import catalog


def test_all_customers_are_read(spark, tmp_path):
    spark.range(101, 171).withColumnRenamed("id", "c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r.url for r in catalog.QUERIES["q_archive_js_dedupe"](spark, str(tmp_path)).collect()}
    assert got == {f"https://d.example/j{k % 30}.js?v={k}" for k in range(101, 131)}


def test_query_equals_its_sql(spark):
    import duckdb

    c = duckdb.connect()
    c.sql("CREATE VIEW customer AS SELECT * FROM read_parquet('/root/testdata/sf0.1/customer.parquet')")
    want = sorted(c.sql(f"SELECT domain, url FROM ({catalog.ORACLES['q_archive_js_dedupe']})").fetchall())
    assert sorted(map(tuple, catalog.QUERIES["q_archive_js_dedupe"](spark, "/root/testdata/sf0.1").collect())) == want


def test_first_script_of_a_path(spark):
    urls = [("d.e", "https://a.d.e/x.js?v=2"), ("d.e", "https://a.d.e/x.js?v=10"), ("d.e", "https://b.d.e/x.js"), ("d.e", "https://a.d.e/x.css")]
    got = surface.archived_scripts(spark.createDataFrame(urls, "domain string, url string")).collect()
    assert sorted(r.url for r in got) == ["https://a.d.e/x.js?v=10", "https://b.d.e/x.js"]
