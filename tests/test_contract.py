import pytest

import __spark_entry__
from glint.plans import catalog

DIR = "/root/testdata/sf0.001"
QUICK = ["q_scan_summary", "q_detect_registry_planted_1", "q_composite_pair", "q_mask_cap_redact", "q_previous_scan_asof", "q_delta_tier", "q_posture_headers", "q_redirect_hops", "q_events_session"]


def test_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("customer", "orders", "documents", "labels", "pages", "events", "part"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    df = catalog.QUERIES[name](spark, DIR)
    r = c.sql(catalog.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(r.columns)
    want = sorted(repr(tuple(dict(zip(r.columns, x, strict=True))[k] for k in columns)) for x in r.fetchall())
    assert sorted(repr(tuple(x[k] for k in columns)) for x in df.collect()) == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
