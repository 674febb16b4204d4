import ipaddress

import pytest
from pyspark.sql import functions as F

from glint.functions import columns as C
from glint.operators import history, hosts, report, surface
from glint.sources import readers
from glint.streaming import incremental


def test_forbidden_addresses(spark):
    cases = ["8.8.8.8", "10.1.2.3", "100.64.0.1", "127.0.0.1", "169.254.1.1", "172.31.0.1", "172.32.0.1", "192.168.1.1", "224.0.0.1", "255.255.255.255", "1.1.1.1"]
    d = spark.createDataFrame([(c,) for c in cases], "a string").select("a", C.is_forbidden_v4(F.col("a")).alias("f"))
    shared = ipaddress.ip_network("100.64.0.0/10")
    for r in d.collect():
        a = ipaddress.ip_address(r.a)
        assert r.f == (not a.is_global or a.is_multicast or a in shared), r.a
    assert spark.range(1).select(C.is_forbidden_v4(F.lit("300.1.1.1"))).first()[0]


@pytest.mark.parametrize(("host", "base", "want"), [("a.b.com", "www.b.com", True), ("b.com", "b.com", True), ("evilb.com", "b.com", False), ("b.com.evil.net", "b.com", False)])
def test_scope(spark, host, base, want):
    assert spark.range(1).select(C.same_scope(F.lit(host), F.lit(base))).first()[0] is want


def test_host_patterns(spark):
    cases = [("a.b.com", "*.b.com", True), ("b.com", "*.b.com", False), ("b.com", "B.com", True), ("10.1.2.3", "10.1.0.0/16", True), ("10.2.2.3", "10.1.0.0/16", False), ("x.com", "10.0.0.0/8", False), ("a.b.com", "*.B.com.", True), ("A.B.com.", "*.b.com", True), ("b.com", "*.", False), ("", "", False)]
    d = spark.createDataFrame(cases, "h string, p string, w boolean")
    assert all(r.g == r.w for r in d.withColumn("g", hosts.host_matches(F.col("h"), F.col("p"))).collect())


def test_two_rules_of_registered_names(spark):
    d = spark.createDataFrame([("a.b.co.uk",), ("x.or.jp",), ("y.gov.fr",), ("z.com",)], "h string").select("h", C.registrable_domain(F.col("h")).alias("a"), C.site_domain(F.col("h")).alias("b"))
    assert [(r.a, r.b) for r in d.collect()] == [("b.co.uk", "b.co.uk"), ("x.or.jp", "x.or.jp"), ("gov.fr", "y.gov.fr"), ("z.com", "z.com")]


def test_comments_go_but_strings_stay():
    code = "a = 'http://x'; // gone\nb = /[/]\\/\\/x/; /* gone\ntoo */ c = 4 / 2 // x\n`//in`"
    out = surface._strip_comments(code)
    assert len(out) == len(code) and out.count("\n") == code.count("\n")
    assert "gone" not in out and "http://x" in out and "`//in`" in out and "c = 4 / 2" in out
    assert "/[/]" not in out  # a regular expression is blanked: its slashes read like an address


def test_links_of_a_page(spark):
    html = '<a href="/a#x">1</a><a href=\'b/../c.html\'>2</a><a href="mailto:x@y.z">3</a><a href="https://other.net/">4</a><a href="/s.css">5</a><a href="/a">6</a><a href="/f.rss">7</a><a href="/x.js">8</a><a href="/t.TAR">9</a>'
    d = spark.createDataFrame([("https://www.h.com/d/", html)], "url string, html string")
    assert sorted(r.link for r in surface.page_links(d).collect()) == ["https://www.h.com/a", "https://www.h.com/d/c.html", "https://www.h.com/x.js"]


def test_contacts(spark):
    d = spark.createDataFrame([("k", "Contact: mailto:sec@a.com\nhello@a.com noreply@a.com joe.doe@gmail.com")], "key string, text string")
    got = surface.rank_contacts(surface.emails(d, F.col("text"), "key"), "key", F.lit("www.a.com")).orderBy("place").collect()
    assert [(r.email, r.score) for r in got] == [("sec@a.com", 18.0), ("hello@a.com", 9.0), ("joe.doe@gmail.com", 1.5)]


def test_normalise_and_grounding(spark):
    s = spark.createDataFrame([("k", "Mail  us: info [at] A.com &amp; more")], "key string, text string")
    v = spark.createDataFrame([("k", "info@a.com"), ("k", "nobody@a.com")], "key string, value string")
    assert {r.value: r.is_grounded for r in surface.grounded(v, s, "key").collect()} == {"info@a.com": True, "nobody@a.com": False}


def test_delta_needs_coverage(spark):
    f = lambda xs: spark.createDataFrame([("t", x) for x in xs], "target_url string, fingerprint string")
    guard = spark.createDataFrame([("t", "complete", 4, 10)], "target_url string, status string, now int, before int")
    got = {r.fingerprint: r.change for r in history.delta(f("ab"), f("bc"), guard=guard).collect()}
    assert got == {"a": "new", "b": "recurring", "c": "unverified"}
    assert {r.fingerprint: r.change for r in history.delta(f("ab"), f("bc")).collect()}["c"] == "resolved"


def test_upsert_keeps_the_latest(spark):
    a = spark.createDataFrame([(1, "x", 1), (2, "y", 1)], "k int, v string, at int")
    b = spark.createDataFrame([(2, "z", 2), (3, "w", 2)], "k int, v string, at int")
    assert sorted((r.k, r.v) for r in history.upsert(a, b, "k", "at").collect()) == [(1, "x"), (2, "z"), (3, "w")]


def test_confusion_of_nothing_is_perfect(spark):
    r = report.confusion(spark.createDataFrame([("a", None)], "id string, expect string"), spark.createDataFrame([], "id string, kind string"), "id").first()
    assert (r.tn, r.precision, r.recall, r.f1) == (1, 1.0, 1.0, 1.0)


def test_roster_and_content_types(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"targets": [{"url": "a"}, {"url": "b"}]}')
    assert readers.roster(spark, str(tmp_path / "r.json")).count() == 2
    d = spark.createDataFrame([("text/html; x", "1"), ("image/png", "1"), (None, None), ("application/json", "99999999")], "content_type string, content_length string")
    assert readers.scannable(d).count() == 2


def test_streams(spark, tmp_path):
    schema = "ts timestamp, host string, status_code int"
    spark.createDataFrame([(1, "a", 429), (2, "a", 429), (3, "a", 200), (1, "b", 200)], "t int, host string, status_code int").select(F.timestamp_seconds("t").alias("ts"), "host", "status_code").write.parquet(str(tmp_path / "in"))
    q = incremental.throttle(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("delays").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    assert {r.host: r.delay for r in spark.table("delays").collect()} == {"a": 0.75, "b": 0.0}
    token = "gh" + "p_" + "a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5P6q7R8"
    spark.createDataFrame([("u", f"x {token}"), ("u", f"again {token}")], "source_url string, body string").withColumn("ts", F.timestamp_seconds(F.lit(5))).write.parquet(str(tmp_path / "assets"))
    stream = spark.readStream.schema("source_url string, body string, ts timestamp").parquet(str(tmp_path / "assets"))
    q = incremental.first_seen(incremental.scan_stream(stream), "ts").writeStream.format("memory").queryName("seen").start()
    q.processAllAvailable()
    q.stop()
    rows = spark.table("seen").collect()
    assert len(rows) == 1 and token not in str(rows)


def test_source_maps_of_scripts(spark):
    body = "//# sourceMappingURL = a.map\n/*@ sourceMappingURL=/b.map */\nx = '#sourceMappingURL=zz';\n//# sourceMappingURL=data:x\n//# sourceMappingURL=https://cdn.net/c.map"
    d = spark.createDataFrame([("https://h.com/js/a.js", body)], "source_url string, body string")
    got = {(r.map, r.in_scope) for r in surface.sourcemap_urls(d).collect()}
    assert got == {("https://h.com/js/a.map", True), ("https://h.com/b.map", True), ("https://cdn.net/c.map", False)}


def test_endpoints_of_a_script(spark):
    body = "f('/-b/c'); g(\"/a/v1?x={id}\"); h = 'https://api.h.com/{tenant}/y'; // https://gone.com/\ni = '//cdn.net/z'; j = '//bad'"
    d = spark.createDataFrame([("https://h.com/a.js", body)], "source_url string, body string")
    got = {r.endpoint: r.in_scope for r in surface.endpoints(d).collect()}
    assert got == {"https://h.com/-b/c": True, "https://h.com/a/v1?x={id}": True, "https://api.h.com/": True, "https://cdn.net/z": False}
    assert {r.endpoint for r in surface.endpoints(d, most=1).collect()} == {"https://api.h.com/"}


def test_tiers_and_reasons(spark):
    rows = [("a", "new", "low", "verified"), ("b", "new", "high", None), ("c", "new", "low", ""), ("d", "recurring", "high", "verified")]
    guard = [(t, "complete", 9, 10) for t in "abcd"] + [("e", "failed", 0, 10), ("f", "clean", 10, 10), ("g", "complete", 1, 10)]
    d = spark.createDataFrame(rows, "target_url string, change string, severity string, verified string")
    g = spark.createDataFrame(guard, "target_url string, status string, now long, before long")
    got = {r.target_url: (r.tier, r.reasons) for r in history.tier(d, guard=g).collect()}
    assert got["a"] == ("URGENT", "live: unknown") and got["b"] == ("URGENT", "high: unknown") and got["c"] == ("REVIEW", "1 new below the urgent bar")
    assert got["d"] == got["f"] == ("ROUTINE", "") and got["e"] == got["g"] == ("REVIEW", "coverage anomaly")
