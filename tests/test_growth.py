"""What large tables call for: rows on all cores, each value worked out once."""

import json

import pytest
from pyspark.sql import functions as F

from glint.functions import columns as C
from glint.functions.registry import BY_NAME, EXAMPLE_VALUES, PLACEHOLDER
from glint.operators import detect, report
from glint.plans import catalog
from glint.plans.planted import assets

DIR = "/root/testdata/sf0.001"


def _plan(d):
    return d._jdf.queryExecution().optimizedPlan().toString()


def _tasks(d):
    return d.select(F.spark_partition_id()).distinct().count()


def test_planted_assets_are_dealt_to_all_cores(spark):
    assert _tasks(assets(spark, DIR)) >= spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("name", ["q_detect_registry_planted_8", "q_entropy_values", "q_composite_pair", "q_base64_decode"])
def test_queries_of_one_file_run_on_all_cores(spark, name):
    assert _tasks(catalog.QUERIES[name](spark, DIR)) >= spark.sparkContext.defaultParallelism


def test_entropy_is_worked_out_once_behind_the_gates(spark):
    d = spark.createDataFrame([("u", "x")], "source_url string, body string")
    assert _plan(detect.detect_values(d, detectors=(BY_NAME["JWT Token"],))).lower().count("log2(") == 1
    assert _plan(detect.pair_values(d)).lower().count("log2(") == 2  # one of each rule


def test_entropy_works_its_value_out_once(spark):
    assert _plan(spark.range(1).select(C.entropy(F.md5(F.col("id").cast("string").cast("binary"))).alias("e"))).count("md5(") == 1


def test_placeholders_are_those_of_the_pattern(spark):
    values = ["", "YOUR-KEY", "your_id", "yourself", "chanGEME", "xXxXxXxX", "x" * 7, "0" * 8, "<ab>", "<a>", "<", "your_Key", "redaсted", "K" * 3, "PLACEHOLDER", *EXAMPLE_VALUES, None]
    v = F.col("v")
    for r in spark.createDataFrame([(x,) for x in values], "v string").select("v", C.is_placeholder(v).alias("got"), (v.isin(*EXAMPLE_VALUES) | v.rlike(C.UNICODE + PLACEHOLDER)).alias("want")).collect():
        assert r.got == r.want, r


def test_a_large_scans_report_is_put_together_from_sorted_pieces(spark):
    d = spark.range(3000).select(
        F.when(F.col("id") < 2900, "s1").otherwise("s2").alias("scan_id"), F.when(F.col("id") % 3 == 0, "drop").otherwise("review").alias("bucket"), F.concat(F.lit("v\"\\ä" + "x" * 12), "id").alias("value"),
        F.lit("Slack Token").alias("kind"), F.lit("HIGH").alias("severity"), F.lit(75).alias("confidence"), F.lit("u").alias("source_url"), F.col("id").cast("string").alias("fingerprint"),
    )
    item = d.select("scan_id", F.to_json(F.struct("fingerprint")).alias("_item"))
    sizes = [len(json.loads(f"[{r._text}]")) for r in report.json_pieces(item, "scan_id").collect()]
    assert sum(sizes) == 3000 and max(sizes) < 1500
    got = {r.scan_id: json.loads(r.report) for r in report.json_report(d, beside=report.html_report(d).withColumn("x", F.lit(1))).where("x = 1 and html like '<!doctype%'").collect()}
    want = {s: {b: {str(i) for i in range(3000) if (i < 2900) == (s == "s1") and (i % 3 == 0) == (b == "drop")} for b in ("drop", "review")} for s in ("s1", "s2")}
    assert {s: {b: {json.loads(x)["fingerprint"] for x in rows} for b, rows in r.items()} for s, r in got.items()} == want
    assert all(list(r) == sorted(r) and all(rows == sorted(rows) for rows in r.values()) for r in got.values())
    results = {r.scan_id: json.loads(r.sarif)["runs"][0]["results"] for r in report.sarif(d).collect()}
    assert {s: {x["partialFingerprints"]["finding/v1"] for x in r} for s, r in results.items()} == {s: w["review"] for s, w in want.items()}
