"""Queries of history, hosts, surface, reports, evaluation and event windows, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glint.functions import columns as C
from glint.functions.registry import GENERIC
from glint.operators import detect, history, hosts, report, surface, verdict
from glint.plans.planted import assets, assets_sql
from glint.plans.scan_queries import FLAGSHIP, _VERDICT_SQL, collapsed_sql, gated_sql
from glint.streaming import incremental

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str = ""):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "orders")
    status = F.expr("CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'clean' ELSE 'failed' END")
    return d.select(F.col("o_orderkey").alias("scan_id"), F.col("o_custkey").alias("target_url"), F.col("o_orderdate").alias("created_at"), status.alias("status"))


_SCANS = "SELECT o_orderkey AS scan_id, o_custkey AS target_url, o_orderdate AS created_at, CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'clean' ELSE 'failed' END AS status FROM orders"


@query("q_previous_scan_asof", f"WITH s AS ({_SCANS}) SELECT scan_id, (SELECT arg_max(p.scan_id, (p.created_at, p.scan_id)) FROM s p WHERE p.target_url = s.target_url AND p.status = 'complete' AND (p.created_at, p.scan_id) < (s.created_at, s.scan_id)) AS previous_id FROM s")
def q_previous_scan_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.previous_scan(_scans(spark, sf_dir)).select("scan_id", "previous_id")


@query("q_retention_topn", f"SELECT scan_id, created_at FROM ({_SCANS}) ORDER BY created_at DESC, scan_id DESC LIMIT 1000")
def q_retention_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.retain(_scans(spark, sf_dir)).select("scan_id", "created_at")


@query("q_paging", f"SELECT scan_id, status FROM ({_SCANS}) ORDER BY created_at DESC, scan_id LIMIT 50 OFFSET 100")
def q_paging(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.page(_scans(spark, sf_dir), 50, 100).select("scan_id", "status")


_DELTA = """WITH c AS (SELECT source AS target_url, doc_id::VARCHAR AS fingerprint FROM documents WHERE doc_id % 3 <> 0), p AS (SELECT source AS target_url, doc_id::VARCHAR AS fingerprint FROM documents WHERE doc_id % 3 <> 1),
g AS (SELECT source AS target_url, count(*) FILTER (doc_id % 4 = 0) >= 0.5 * count(*) FILTER (doc_id % 2 = 0) AND source <> 'src1' AS ok FROM documents GROUP BY source),
j AS (SELECT coalesce(c.target_url, p.target_url) AS target_url, coalesce(c.fingerprint, p.fingerprint) AS fingerprint, c.fingerprint IS NOT NULL AS nc, p.fingerprint IS NOT NULL AS np FROM c FULL JOIN p ON c.target_url = p.target_url AND c.fingerprint = p.fingerprint),
d AS (SELECT j.target_url, fingerprint, CASE WHEN NOT np THEN 'new' WHEN nc THEN 'recurring' WHEN ok THEN 'resolved' ELSE 'unverified' END AS change FROM j LEFT JOIN g ON j.target_url = g.target_url)"""


def _delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("target_url"), F.col("doc_id").cast("string").alias("fingerprint"))
    guard = d.groupBy("target_url").agg(F.count_if(F.col("doc_id") % 4 == 0).alias("now"), F.count_if(F.col("doc_id") % 2 == 0).alias("before"))
    guard = guard.withColumn("status", F.when(F.col("target_url") == "src1", "failed").otherwise("complete"))
    return history.delta(d.where("doc_id % 3 <> 0"), d.where("doc_id % 3 <> 1"), guard=guard)


@query("q_delta_outer", f"{_DELTA} SELECT target_url, fingerprint, change FROM d")
def q_delta_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _delta(spark, sf_dir)


@query(
    "q_delta_tier",
    f"""{_DELTA}, v AS (SELECT *, CASE WHEN fingerprint::BIGINT % 50 = 1 THEN 'CRITICAL' ELSE 'LOW' END AS severity FROM d),
t AS (SELECT target_url, count(*) FILTER (change = 'new') AS n_new, count(*) FILTER (change = 'resolved') AS n_resolved, count(*) FILTER (change = 'recurring') AS n_recurring, count(*) FILTER (change = 'unverified') AS n_unverified, count(*) FILTER (change = 'new' AND severity = 'CRITICAL') AS n_grave FROM v GROUP BY target_url)
SELECT *, CASE WHEN n_grave > 0 THEN 'URGENT' WHEN n_unverified > 0 OR n_new > 0 THEN 'REVIEW' ELSE 'ROUTINE' END AS tier,
  CASE WHEN n_grave > 0 THEN 'critical: unknown' WHEN n_unverified > 0 THEN 'coverage anomaly' WHEN n_new > 0 THEN n_new || ' new below the urgent bar' ELSE '' END AS reasons FROM t""",
)
def q_delta_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _delta(spark, sf_dir).withColumns({"severity": F.when(F.col("fingerprint").cast("long") % 50 == 1, "CRITICAL").otherwise("LOW"), "verified": F.lit("")})
    return history.tier(d)


@query("q_asset_budget", "SELECT doc_id, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 50000 AS accepted FROM documents")
def q_asset_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.within_budget(_t(spark, sf_dir, "documents"), 50_000, by="source", order="doc_id").select("doc_id", "accepted")


@query(
    "q_cache_decision",
    """SELECT doc_id, CASE WHEN (s = 304 OR h = ch) AND coalesce(clean, false) THEN 'skip' WHEN s = 304 THEN 'refetch' ELSE 'scan' END AS action FROM (
  SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 304 ELSE 200 END AS s, substr(sha256(text), 1, 32) AS h, CASE WHEN doc_id % 2 = 0 THEN CASE WHEN doc_id % 4 = 0 THEN substr(sha256(text), 1, 32) ELSE 'x' END END AS ch, CASE WHEN doc_id % 2 = 0 THEN doc_id % 5 <> 0 END AS clean FROM documents)""",
)
def q_cache_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("url"), F.expr("CASE doc_id % 3 WHEN 0 THEN 304 ELSE 200 END").alias("status_code"), F.substring(F.sha2("text", 256), 1, 32).alias("content_hash"))
    cache = d.where("doc_id % 2 = 0").select("url", (F.col("doc_id") % 5 != 0).alias("was_clean"), F.when(F.col("doc_id") % 4 == 0, F.col("content_hash")).otherwise("x").alias("content_hash"))
    return history.cache_decision(d, cache).select("doc_id", "action")


@query(
    "q_domain_rollup",
    """SELECT domain, host, grouping(domain, host)::BIGINT AS level, count(*) AS scans, sum(assets)::BIGINT AS assets, sum(confirmed)::BIGINT AS confirmed, sum(review)::BIGINT AS review FROM (
  SELECT 'd' || (c_custkey % 5)::VARCHAR AS domain, 'h' || (c_custkey % 20)::VARCHAR AS host, c_custkey % 9 AS assets, (c_custkey % 11 = 0)::INT AS confirmed, (c_custkey % 4 = 0)::INT AS review FROM customer) GROUP BY ROLLUP (domain, host)""",
)
def q_domain_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    d = _t(spark, sf_dir, "customer").select(F.concat(F.lit("d"), k % 5).alias("domain"), F.concat(F.lit("h"), k % 20).alias("host"), (k % 9).alias("assets"), (k % 11 == 0).cast("long").alias("confirmed"), (k % 4 == 0).cast("long").alias("review"))
    return history.domain_rollup(d)


@query(
    "q_domain_coverage_verdict",
    """SELECT domain, live_hosts, scanned, confirmed, CASE WHEN confirmed > 0 THEN 'EXPOSURE' WHEN scanned < live_hosts THEN 'PARTIAL' ELSE 'CLEAN' END AS verdict FROM (
  SELECT 'd' || (page_id % 17)::VARCHAR AS domain, count(*) FILTER (page_id % 3 <> 0) AS live_hosts, count(*) FILTER (page_id % 3 <> 0 AND page_id % 29 <> 0) AS scanned, sum((page_id % 23 = 0)::INT)::BIGINT AS confirmed FROM pages GROUP BY 1)""",
)
def q_domain_coverage_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    d = _t(spark, sf_dir, "pages").select(F.concat(F.lit("d"), k % 17).alias("domain"), (k % 3 != 0).alias("live"), F.when(k % 29 == 0, "timeout").alias("error"), (k % 23 == 0).cast("long").alias("confirmed"))
    return history.domain_verdict(d)


@query(
    "q_redirect_collapse",
    """WITH h AS (SELECT 'd' || (c_custkey % 10)::VARCHAR AS domain, 'h' || c_custkey::VARCHAR AS host, CASE WHEN c_custkey % 4 = 0 THEN 'h' || (c_custkey + 10)::VARCHAR ELSE '' END AS redirect_host FROM customer),
g AS (SELECT *, redirect_host <> host AND EXISTS (SELECT 1 FROM h o WHERE o.domain = h.domain AND o.host = h.redirect_host) AS gone FROM h)
SELECT domain, host FROM (SELECT *, count(*) FILTER (NOT gone) OVER (PARTITION BY domain) AS n FROM g) WHERE NOT gone OR n = 0""",
)
def q_redirect_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    d = _t(spark, sf_dir, "customer").select(F.concat(F.lit("d"), k % 10).alias("domain"), F.concat(F.lit("h"), k).alias("host"), F.when(k % 4 == 0, F.concat(F.lit("h"), k + 10)).otherwise("").alias("redirect_host"))
    return history.collapse_redirects(d).select("domain", "host")


@query(
    "q_redirect_hops",
    """WITH RECURSIVE r AS (SELECT c_custkey AS start, c_custkey AS cur, 0 AS hops FROM customer UNION ALL SELECT start, cur + 1, hops + 1 FROM r WHERE cur % 7 <> 0 AND hops < 5)
SELECT 'https://a.example/' || start::VARCHAR AS start, 'https://a.example/' || arg_max(cur, hops)::VARCHAR AS url, max(hops)::INT AS hops FROM r GROUP BY start""",
)
def q_redirect_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    url = lambda x: F.concat(F.lit("https://a.example/"), x)
    c = _t(spark, sf_dir, "customer")
    edges = c.select(F.explode(F.sequence(k, k + 5)).alias("k")).distinct().where("k % 7 <> 0").select(url(F.col("k")).alias("from_url"), url(F.col("k") + 1).alias("to_url"))
    return hosts.follow_redirects(edges, c.select(url(k).alias("url")))


@query(
    "q_posture_headers",
    """WITH h AS (SELECT c_custkey, c_custkey % 2 = 0 AS tls, c_custkey % 3 = 0 AS hsts, c_custkey % 5 = 0 AS csp, c_custkey % 4 = 0 AS ver, c_custkey % 7 = 0 AS cookie FROM customer)
SELECT name, severity, cwe, count(*) AS n FROM (
  SELECT 'Missing HSTS' AS name, 'MEDIUM' AS severity, 'CWE-319' AS cwe FROM h WHERE tls AND NOT hsts UNION ALL SELECT 'Missing Content-Security-Policy', 'MEDIUM', 'CWE-693' FROM h WHERE NOT csp
  UNION ALL SELECT 'Missing X-Content-Type-Options: nosniff', 'LOW', 'CWE-693' FROM h UNION ALL SELECT 'No clickjacking protection', 'MEDIUM', 'CWE-1021' FROM h WHERE NOT csp
  UNION ALL SELECT 'Missing Referrer-Policy', 'LOW', 'CWE-200' FROM h UNION ALL SELECT 'Missing Permissions-Policy', 'LOW', 'CWE-693' FROM h
  UNION ALL SELECT 'Version disclosure via server', 'LOW', 'CWE-200' FROM h WHERE ver UNION ALL SELECT 'Cookie without Secure flag', 'MEDIUM', 'CWE-614' FROM h WHERE tls AND cookie
  UNION ALL SELECT 'Cookie without HttpOnly flag', 'LOW', 'CWE-1004' FROM h WHERE cookie) GROUP BY ALL""",
)
def q_posture_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    entry = lambda c, n, v: F.when(c, F.struct(F.lit(n).alias("k"), F.lit(v).alias("v")))
    parts = F.array(entry(k % 3 == 0, "Strict-Transport-Security", "max-age=1"), entry(k % 5 == 0, "Content-Security-Policy", "frame-ancestors 'self'"), entry(k % 4 == 0, "Server", "nginx/1.2"), entry(k % 4 == 1, "Server", "edge"), entry(k % 7 == 0, "Set-Cookie", "a=b"))
    d = _t(spark, sf_dir, "customer").select("c_custkey", F.map_from_entries(F.filter(parts, lambda x: x.isNotNull())).alias("headers"), F.when(k % 2 == 0, "https://a.example").otherwise("http://a.example").alias("final_url"))
    return hosts.posture(d).groupBy("name", "severity", "cwe").agg(F.count("*").alias("n"))


@query(
    "q_takeover_match",
    """SELECT 'h' || c_custkey::VARCHAR AS host, CASE c_custkey % 4 WHEN 0 THEN 'GitHub Pages' ELSE 'Heroku' END AS service, 'HIGH' AS severity, CASE WHEN c_custkey % 4 = 0 THEN 'x.github.io' ELSE '' END AS cname
FROM customer WHERE c_custkey % 4 = 0 OR c_custkey % 4 = 1""",
)
def q_takeover_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    body = F.expr("CASE c_custkey % 4 WHEN 0 THEN 'There isn''t a GitHub Pages site here.' WHEN 1 THEN 'No such app' WHEN 2 THEN 'No such app' ELSE 'fine' END")
    names = F.when(k % 4 == 0, F.array(F.lit("x.github.io"))).when(k % 4 == 2, F.array(F.lit("x.fastly.net"))).otherwise(F.array().cast("array<string>"))
    return hosts.takeovers(_t(spark, sf_dir, "customer").select(F.concat(F.lit("h"), k).alias("host"), names.alias("cnames"), body.alias("body")))


@query(
    "q_ip_class_v4",
    """WITH a AS (SELECT o_orderkey, (o_orderkey * 2654435761) % 4294967296 AS n FROM orders) SELECT o_orderkey, (n < 16777216 OR n BETWEEN 167772160 AND 184549375 OR n BETWEEN 1681915904 AND 1686110207 OR n BETWEEN 2130706432 AND 2147483647
  OR n BETWEEN 2851995648 AND 2852061183 OR n BETWEEN 2886729728 AND 2887778303 OR n BETWEEN 3221225472 AND 3221225727 OR n BETWEEN 3221225984 AND 3221226239 OR n BETWEEN 3232235520 AND 3232301055
  OR n BETWEEN 3323068416 AND 3323199487 OR n BETWEEN 3325256704 AND 3325256959 OR n BETWEEN 3405803776 AND 3405804031 OR n >= 3758096384) AS forbidden FROM a""",
)
def q_ip_class_v4(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.expr("(o_orderkey * 2654435761) % 4294967296")
    part = lambda s: F.floor(F.col("n") / s) % 256
    d = _t(spark, sf_dir, "orders").select("o_orderkey", n.alias("n"))
    return d.select("o_orderkey", C.is_forbidden_v4(F.concat_ws(".", part(16777216), part(65536), part(256), part(1))).alias("forbidden"))


@query(
    "q_scope_authorization",
    """SELECT host, reason = 'allowed' AS allowed, reason, CASE WHEN reason <> 'no authorization' THEN 'e' || g::VARCHAR END AS engagement_id FROM (
  SELECT 'a' || c_custkey::VARCHAR || '.site' || (c_custkey % 4)::VARCHAR || '.example' AS host, c_custkey % 4 AS g, CASE c_custkey % 4 WHEN 0 THEN CASE WHEN c_custkey % 8 = 0 AND c_custkey = 8 THEN 'excluded' ELSE 'allowed' END WHEN 1 THEN 'expired' WHEN 2 THEN 'not active' ELSE 'no authorization' END AS reason FROM customer)""",
)
def q_scope_authorization(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    targets = _t(spark, sf_dir, "customer").select(F.concat(F.lit("a"), k, F.lit(".site"), k % 4, F.lit(".example")).alias("host"))
    grants = spark.sql("""SELECT * FROM VALUES ('e0', array('*.site0.example'), array('a8.site0.example'), 'active', date'2024-01-01', date'2024-12-31'),
      ('e1', array('*.site1.example'), array(), 'active', date'2023-01-01', date'2023-12-31'), ('e2', array('*.site2.example'), array(), 'revoked', date'2024-01-01', date'2024-12-31') AS t(engagement_id, scope, exclusions, status, starts_at, expires_at)""")
    return hosts.authorize(targets, grants, "2024-12-31")


@query(
    "q_robots_groups",
    "SELECT 'site' || c_custkey::VARCHAR AS site, unnest(['*', 'bot']) AS agent, unnest([c_custkey % 2 = 0 AND c_custkey % 3 <> 0, c_custkey % 2 = 0 AND c_custkey % 3 <> 0]) AS blocked FROM customer",
)
def q_robots_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("concat('User-agent: *\nUser-agent: Bot # all\nDisallow: ', CASE c_custkey % 2 WHEN 0 THEN '/' ELSE '/x' END, CASE c_custkey % 3 WHEN 0 THEN '\nAllow: /' ELSE '' END, '\nCrawl-delay: 3')")
    d = _t(spark, sf_dir, "customer").select(F.concat(F.lit("site"), "c_custkey").alias("site"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return hosts.root_blocked(hosts.robots_groups(d))




@query("q_page_hosts", "SELECT host, count(*) AS n FROM (SELECT lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS host FROM pages) GROUP BY host")
def q_page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "pages").groupBy(C.host_of(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


@query("q_page_links")
def q_page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all pages, resolved (RFC 3986 needs a function of its own, so SQL can't say it)."""
    return surface.page_links(_t(spark, sf_dir, "pages"))


@query("q_endpoints_surface")
def q_endpoints_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surface.endpoints(_t(spark, sf_dir, "pages"), "url", "html")


@query("q_script_urls")
def q_script_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surface.script_urls(_t(spark, sf_dir, "pages"))


@query(
    "q_registrable_domain",
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 's' || c_custkey::VARCHAR || '.co.uk' WHEN 1 THEN 'shop.com' WHEN 2 THEN 'co.uk' END AS domain FROM customer""",
)
def q_registrable_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.expr("CASE c_custkey % 4 WHEN 0 THEN concat('a.b.s', c_custkey, '.co.uk') WHEN 1 THEN 'www.shop.com.' WHEN 2 THEN 'co.uk' ELSE '10.0.0.7' END")
    return _t(spark, sf_dir, "customer").select("c_custkey", C.registrable_domain(host).alias("domain"))


@query(
    "q_ct_names",
    "SELECT DISTINCT 'd' || (c_custkey % 5)::VARCHAR || '.example' AS domain, unnest(['a' || (c_custkey % 9)::VARCHAR || '.d' || (c_custkey % 5)::VARCHAR || '.example', 'd' || (c_custkey % 5)::VARCHAR || '.example']) AS host FROM customer",
)
def q_ct_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("concat('[{\"name_value\":\"*.a', c_custkey % 9, '.d', c_custkey % 5, '.example\\\\nx@y.d', c_custkey % 5, '.example\",\"common_name\":\"D', c_custkey % 5, '.example\"}]')")
    return surface.certificate_names(_t(spark, sf_dir, "customer").select(F.concat(F.lit("d"), F.col("c_custkey") % 5, F.lit(".example")).alias("domain"), text.alias("json")))


@query("q_archive_js_dedupe", "SELECT DISTINCT 'd.example' AS domain, 'https://d.example/j' || (c_custkey % 30)::VARCHAR || '.js?v=' || min(c_custkey) OVER (PARTITION BY c_custkey % 30)::VARCHAR AS url FROM customer WHERE c_custkey < 100")
def q_archive_js_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    d = _t(spark, sf_dir, "customer").select(F.lit("d.example").alias("domain"), F.lit("cdx").alias("kind"), F.concat(F.lit('[["original"],["https://d.example/j'), k % 30, F.lit(".js?v="), k, F.lit('"]]')).alias("json"))
    first = surface.archived_urls(d)
    return surface.archived_scripts(first.withColumn("n", F.regexp_extract("url", r"v=(\d+)", 1).cast("long")), "n")


_MAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"


@query("q_contacts_rank", f"SELECT doc_id, count(DISTINCT lower(e)) AS emails FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_MAIL}')) AS e FROM documents) GROUP BY doc_id")
def q_contacts_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = surface.emails(_t(spark, sf_dir, "documents"), F.col("text"), "doc_id")
    return surface.rank_contacts(found, "doc_id", F.lit("example.com")).groupBy("doc_id").agg(F.max("place").cast("long").alias("emails"))


@query(
    "q_confusion_matrix",
    """WITH d AS (SELECT doc_id % 2 = 0 AS pos, doc_id % 3 = 0 AS hit, doc_id % 6 = 0 AS typed FROM labels), c AS (SELECT count(*) FILTER (pos AND hit) AS tp, count(*) FILTER (NOT pos AND hit) AS fp, count(*) FILTER (pos AND NOT hit) AS fn, count(*) FILTER (NOT pos AND NOT hit) AS tn, count(*) FILTER (pos AND typed) AS typed FROM d),
r AS (SELECT *, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall, round(typed / tp, 4) AS type_accuracy FROM c) SELECT *, round(2 * precision * recall / (precision + recall), 4) AS f1 FROM r""",
)
def q_confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "labels").select("doc_id").distinct()
    return report.confusion(d.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "A").alias("expect")), d.where("doc_id % 3 = 0").select("doc_id", F.when(F.col("doc_id") % 6 == 0, "A").otherwise("B").alias("kind")), "doc_id")


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdict.offline_verdicts(detect.scan_assets(assets(spark, sf_dir, FLAGSHIP)))


@query(
    "q_csv_rows",
    f"""WITH {gated_sql(assets_sql(FLAGSHIP), FLAGSHIP, "scan_id, target_url, source_url")}, v AS ({_VERDICT_SQL} {collapsed_sql()})
SELECT CASE bucket WHEN 'review' THEN 'NEEDS_REVIEW' ELSE 'INFORMATIONAL' END AS status, kind, severity, source_url, substr(value, 1, 6) || '…******…' || right(value, 4) || '  (' || length(value) || ' chars)' AS match FROM v""",
)
def q_csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.csv_rows(_found(spark, sf_dir)).select("status", "kind", "severity", "source_url", "match")


@query("q_sarif_results")
def q_sarif_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.sarif(_found(spark, sf_dir))


@query("q_json_html_reports")
def q_json_html_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _found(spark, sf_dir)
    return report.json_report(found, beside=report.html_report(found))


@query(
    "q_severity_summary",
    f"""WITH {gated_sql(assets_sql(FLAGSHIP), FLAGSHIP, "scan_id, target_url, source_url")}, v AS ({_VERDICT_SQL} {collapsed_sql()}), w AS (SELECT scan_id, severity, CASE WHEN bucket = 'review' AND kind <> '{GENERIC}' THEN 'confirmed' ELSE bucket END AS b FROM v)
SELECT scan_id, count(*) FILTER (b = 'confirmed' AND severity = 'CRITICAL') AS critical, count(*) FILTER (b = 'confirmed' AND severity = 'HIGH') AS high, count(*) FILTER (b = 'confirmed' AND severity = 'MEDIUM') AS medium, count(*) FILTER (b = 'confirmed' AND severity = 'LOW') AS low,
  count(*) FILTER (b = 'confirmed') AS confirmed, count(*) FILTER (b = 'review') AS review, 'CRITICAL' AS risk FROM w GROUP BY scan_id""",
)
def q_severity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _found(spark, sf_dir)
    b = F.when((F.col("bucket") == "review") & (F.col("kind") != GENERIC), "confirmed").otherwise(F.col("bucket"))
    return history.severity_summary(found.withColumn("bucket", b))


@query("q_events_tumbling", "SELECT date_trunc('hour', ts) AS starts, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def q_events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.tumbling(_t(spark, sf_dir, "events"))


@query(
    "q_events_sliding",
    "SELECT s AS starts, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT event_type, value, unnest([date_trunc('hour', ts) + INTERVAL 30 MINUTE * (CASE WHEN date_part('minute', ts) >= 30 THEN 1 ELSE 0 END), date_trunc('hour', ts) + INTERVAL 30 MINUTE * (CASE WHEN date_part('minute', ts) >= 30 THEN 1 ELSE 0 END) - INTERVAL 30 MINUTE]) AS s FROM events) GROUP BY ALL",
)
def q_events_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.tumbling(_t(spark, sf_dir, "events"), "1 hour", slide="30 minutes")


@query(
    "q_events_session",
    """WITH o AS (SELECT user_id, ts, coalesce(ts > lag(ts) OVER w + INTERVAL 30 MINUTE, true)::INT AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT user_id, min(ts) AS starts, max(ts) + INTERVAL 30 MINUTE AS ends, count(*) AS n FROM s GROUP BY user_id, k""",
)
def q_events_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.sessions(_t(spark, sf_dir, "events"))
