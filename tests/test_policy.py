"""The policy queries against their SQL on the smallest tables, and empty or null rows."""

import duckdb
import pytest

from glint.operators import policy
from glint.plans import policy_queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(policy_queries.QUERIES))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{SF}/customer.parquet'")
    want = con.execute(policy_queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    names = sorted(columns)
    rows = sorted(str([r[columns.index(n)] for n in names]) for r in want.fetchall())
    got = policy_queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == names
    assert rows and sorted(str([r[n] for n in names]) for r in got.collect()) == rows


GRANTS = "SELECT 'e1' AS engagement_id, array('a.example') AS scope, cast(array() AS array<string>) AS exclusions, 'active' AS status, date'2024-01-01' AS starts_at, date'2024-12-31' AS expires_at, true AS permit_deep_scan, cast(null AS boolean) AS permit_verification"


def test_enforce_switches(spark):
    d = spark.createDataFrame([("a.example", True, None), ("a.example", None, True), ("127.0.0.1", True, True), ("LOCALHOST", None, None), ("100.64.0.1", None, None), (None, None, None)], "host string, deep boolean, verify boolean")
    grants = spark.sql(GRANTS)
    got = [(r.host, r.reason) for r in policy.enforce(d, grants, "2024-06-01", allow_private=True).collect()]
    want = [("a.example", "allowed"), ("a.example", "verification not permitted"), ("127.0.0.1", "lab target"), ("LOCALHOST", "lab target"), ("100.64.0.1", "no authorization"), (None, "no authorization")]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert policy.enforce(d, grants, "2024-06-01").where("allowed").count() == 1
    assert policy.enforce(d, grants, "2024-06-01", require=False).where("allowed").count() == 6


def test_nulls_and_empty(spark):
    none = spark.createDataFrame([], "kind string, value string")
    assert tuple(policy.ground_truth(none, none).first()) == (0, 0, 0, 0, 1.0, 1.0, 1.0)
    r = spark.createDataFrame([(None, None, None), ("slack", 200, None), ("other", 200, None)], "provider string, status_code int, body string")
    assert [(x.active, x.detail) for x in policy.provider_outcome(r).collect()] == [(False, ""), (False, ""), (True, "")]
    a = spark.createDataFrame([("h", None), ("g", "8.8.8.8"), ("g", "127.0.0.1")], "host string, address string")
    assert {x.host: (x.pinned, x.refused) for x in policy.pinned_addresses(a).collect()} == {"h": (None, None), "g": (None, "127.0.0.1")}
