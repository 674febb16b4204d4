"""The crawl queries against their SQL on the smallest tables, and empty or null rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

from glint.operators import crawl
from glint.operators import hosts as H
from glint.plans import crawl_queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(crawl_queries.QUERIES))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("customer", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(crawl_queries.ORACLES[name])
    names = sorted(c[0] for c in want.description)
    place = [[c[0] for c in want.description].index(n) for n in names]
    rows = sorted(str([r[i] for i in place]) for r in want.fetchall())
    got = crawl_queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == names
    assert rows and sorted(str([r[n] for n in names]) for r in got.collect()) == rows


def test_nulls(spark):
    d = spark.createDataFrame([(None, None, None), ("t", None, 1), (None, "https://a.example/x.js", 2)], "target string, url string, ordinal long")
    assert crawl.capped_scripts(d).count() == 1
    assert crawl.seed_urls(d, d.limit(0)).count() == 1
    one = spark.createDataFrame([("a b", None), (None, "x"), ("a b", "")], "text string, secret string")
    assert [r[0] for r in one.select(crawl.scrubbed(F.col("text"), F.col("secret"))).collect()] == ["a b", None, "a b"]


def test_keys_match_as_patterns_do(spark):
    """The keys that hosts are joined to patterns by say the same as the pairwise comparison."""
    hosts_ = ["a.b.com", "B.com.", "b.com", "10.1.2.3", "10.1.2.300", "x", "", None, " a.b.com ", "192.168.0.9", "com"]
    patterns = ["*.B.com", "b.com", "*.com.", "10.0.0.0/8", "10.1.2.3/32", "0.0.0.0/0", "192.168.0.0/29", "x", "", None, "*.", "a.b.com", "999.0.0.0/8"]
    h = spark.createDataFrame([(x,) for x in hosts_], "host string")
    d = h.crossJoin(spark.createDataFrame([(x,) for x in patterns], "pattern string"))
    key = H.pattern_key(F.col("pattern"))
    got = d.select("host", "pattern", H.host_matches(F.col("host"), F.col("pattern")).alias("a"), F.coalesce((key != "") & F.array_contains(H.host_keys(F.col("host")), key), F.lit(False)).alias("b")).collect()
    assert [r for r in got if r.a != r.b] == [] and sum(r.a for r in got) > 12


def test_latest_grant_decides(spark):
    grants = spark.sql("""SELECT * FROM VALUES ('e1', array('a.example'), cast(array() as array<string>), 'active', date'2024-01-01', date'2024-12-31', timestamp'2024-01-01 00:00:00'),
      ('e2', array('*.example'), null, 'active', date'2024-01-01', date'2024-12-31', timestamp'2024-02-01 00:00:00'), ('e3', null, array('b.example'), 'revoked', null, null, null) AS t(engagement_id, scope, exclusions, status, starts_at, expires_at, created_at)""")
    targets = spark.createDataFrame([("a.example",), ("b.example",), ("c.test",)], "host string")
    got = {r.host: (r.allowed, r.reason, r.engagement_id) for r in H.authorize(targets, grants, "2024-06-01").collect()}
    assert got == {"a.example": (True, "allowed", "e2"), "b.example": (False, "excluded", "e3"), "c.test": (False, "no authorization", None)}
