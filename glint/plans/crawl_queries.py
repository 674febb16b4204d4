"""Queries of what a scan reads, with their SQL. The rows are made from whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glint.operators import crawl, hosts
from glint.plans.estate_queries import _t

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _c(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))


def _made(spark: SparkSession, sf_dir: str, **columns: str) -> DataFrame:
    return _c(spark, sf_dir).select("k", *(F.expr(e).alias(n) for n, e in columns.items()))


_C = "SELECT c_custkey AS k FROM customer"


@query(f"""WITH l AS (SELECT 't' || (k % 20)::VARCHAR AS target, 'https://t' || (k % 20)::VARCHAR || '.example/p' || ((k * 7) % 60)::VARCHAR AS url, min(k) AS pos FROM ({_C}) WHERE k % 9 <> 0 GROUP BY ALL),
n AS (SELECT target, url, row_number() OVER (PARTITION BY target ORDER BY pos, url)::INT AS place FROM l)
SELECT target, url, place FROM n WHERE place < 25 UNION ALL SELECT DISTINCT 't' || (k % 20)::VARCHAR, 'https://t' || (k % 20)::VARCHAR || '.example/', 0 FROM ({_C})""")
def q_crawl_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    home = "concat('https://t', k % 20, '.example/')"
    d = _made(spark, sf_dir, target="concat('t', k % 20)", home=home, from_url=f"if(k % 9 = 0, concat({home}, 'elsewhere'), {home})", to_url=f"concat({home}, 'p', (k * 7) % 60)", ordinal="k")
    return crawl.crawl_pages(d, d.select("target", F.col("home").alias("url")))


@query(f"SELECT target, url, place FROM (SELECT target, url, row_number() OVER (PARTITION BY target ORDER BY url)::INT AS place FROM (SELECT DISTINCT 't' || (k % 2)::VARCHAR AS target, 'https://t.example/' || (k % 1200)::VARCHAR || '.js' AS url FROM ({_C}))) WHERE place <= 400")
def q_capped_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.capped_scripts(_made(spark, sf_dir, target="concat('t', k % 2)", url="concat('https://t.example/', k % 1200, '.js')"))


@query(f"""WITH s AS (SELECT 't' || (k % 3)::VARCHAR AS target, 'https://t.example/' || (k % 900)::VARCHAR AS url, min(k) AS pos FROM ({_C}) GROUP BY ALL)
SELECT target, url, place FROM (SELECT target, url, row_number() OVER (PARTITION BY target ORDER BY pos, url)::INT AS place FROM s WHERE (target, url) NOT IN (SELECT 't' || (k % 3)::VARCHAR, 'https://t.example/' || (k % 900)::VARCHAR FROM ({_C}) WHERE k % 5 = 0)) WHERE place <= 200""")
def q_seed_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _made(spark, sf_dir, target="concat('t', k % 3)", url="concat('https://t.example/', k % 900)", ordinal="k")
    return crawl.seed_urls(d, d.where("k % 5 = 0"))


@query(f"""WITH e AS (SELECT DISTINCT 't' || (k % 4)::VARCHAR AS target, 'https://t.example/' || (k % 700)::VARCHAR || CASE k % 3 WHEN 0 THEN '.js?v=1' WHEN 1 THEN '.JS' ELSE '.css' END AS url, 'https://t.example/' || (k % 700)::VARCHAR AS base, k % 3 AS kind FROM ({_C}) WHERE k % 7 <> 0)
SELECT target, url, place FROM (SELECT target, url, row_number() OVER (PARTITION BY target ORDER BY url)::INT AS place FROM e WHERE kind <> 2 AND NOT (kind = 0 AND (target, base) IN (SELECT 't' || (k % 4)::VARCHAR, 'https://t.example/' || (k % 700)::VARCHAR FROM ({_C}) WHERE k % 11 = 0))) WHERE place <= 50""")
def q_deeper_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _made(spark, sf_dir, target="concat('t', k % 4)", base="concat('https://t.example/', k % 700)", in_scope="k % 7 <> 0")
    ending = F.expr("CASE k % 3 WHEN 0 THEN '.js?v=1' WHEN 1 THEN '.JS' ELSE '.css' END")
    return crawl.deeper_scripts(d.withColumn("url", F.concat("base", ending)), d.where("k % 11 = 0").select("target", F.concat("base", F.lit(".js?v=0")).alias("url")))


@query(f"""SELECT k, outcome, outcome IN ('failed', 'throttled', 'blocked') AS again FROM (SELECT k, CASE k % 10 WHEN 0 THEN 'not modified' WHEN 1 THEN 'throttled' WHEN 2 THEN 'gone' WHEN 3 THEN 'gone' WHEN 4 THEN 'blocked' WHEN 5 THEN 'refused' WHEN 6 THEN 'failed'
  ELSE CASE WHEN k % 4 = 0 THEN 'not scannable' WHEN k * 10000 > 5242880 THEN 'cut' ELSE 'read' END END AS outcome FROM ({_C}))""")
def q_fetch_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = "CASE k % 10 WHEN 0 THEN 304 WHEN 1 THEN 429 WHEN 2 THEN 404 WHEN 3 THEN 410 WHEN 4 THEN 406 WHEN 5 THEN 500 WHEN 6 THEN NULL ELSE 200 END"
    return crawl.fetch_outcome(_made(spark, sf_dir, status_code=status, n_bytes="k * 10000"), F.col("k") % 4 != 0).select("k", "outcome", "again")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate::TIMESTAMP > (SELECT max(o_orderdate)::TIMESTAMP FROM orders WHERE o_orderkey = -1) OR o_orderdate::TIMESTAMP > TIMESTAMP '1997-06-30 12:00:00' - INTERVAL 24 HOUR")
def q_fresh_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("updated_at"))
    return crawl.fresh_cache(d, "1997-06-30 12:00:00").select("o_orderkey")


@query("SELECT o_custkey AS scan_id, count(*) FILTER (o_orderkey % 3 <> 0) AS assets_fetched, count(*) FILTER (o_orderkey % 3 = 0) AS assets_cached, count(*) AS assets_scanned FROM orders GROUP BY o_custkey")
def q_coverage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("scan_id"), F.expr("if(o_orderkey % 3 = 0, 'skip', 'scan')").alias("action"))
    return crawl.coverage_counts(d)


@query(f"SELECT 'https://a.example/' || k::VARCHAR AS url, unnest(['cdn' || (k % 30)::VARCHAR || '.example', 'api.example']) AS host FROM ({_C})")
def q_referenced_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = "concat('fetch(\"https://CDN', k % 30, '.example:8443/x\"); // see https://doc.example/a\\nload(\"//api.example/v1\", \"https://cdn', k % 30, '.example/y\"); /* http://old.example */ go(\"https://nohost/z\")')"
    return crawl.referenced_hosts(_made(spark, sf_dir, source_url="concat('https://a.example/', k)", body=body))


@query(f"SELECT DISTINCT 'd' || (k % 5)::VARCHAR || '.example' AS domain, 'x' || (k % 40)::VARCHAR || '.other.example' AS host FROM ({_C}) WHERE k % 3 = 0")
def q_associated_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.associated_hosts(_made(spark, sf_dir, domain="concat('d', k % 5, '.example')", host="CASE k % 3 WHEN 0 THEN concat('x', k % 40, '.other.example') WHEN 1 THEN concat('a.d', k % 5, '.example') ELSE concat('d', k % 5, '.example') END"))


@query(f"""WITH e AS (SELECT 'd' || (k % 5)::VARCHAR || '.example' AS domain, CASE k % 4 WHEN 0 THEN 'evil.example' ELSE 'h' || (k % 90)::VARCHAR || '.d' || (k % 5)::VARCHAR || '.example' END AS host, (k % 2)::INT AS phase, k AS pos FROM ({_C})),
a AS (SELECT * FROM e UNION ALL SELECT DISTINCT domain, 'www.' || domain, -2, 0 FROM e UNION ALL SELECT DISTINCT domain, domain, -1, 0 FROM e),
f AS (SELECT domain, host, min(phase) AS phase, arg_min(pos, (phase, pos)) AS pos FROM a WHERE host <> 'evil.example' GROUP BY ALL)
SELECT domain, host, row_number() OVER (PARTITION BY domain ORDER BY phase, pos, host)::INT AS place FROM f""")
def q_candidate_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _made(spark, sf_dir, domain="concat('d', k % 5, '.example')", host="if(k % 4 = 0, 'evil.example', concat('h', k % 90, '.d', k % 5, '.example'))", phase="cast(k % 2 AS int)", ordinal="k")
    return crawl.candidate_hosts(d.select("domain", F.concat(F.lit("www."), "domain").alias("host")).distinct(), d)


@query(f"SELECT 'https://www.s' || (k % 7)::VARCHAR || '.co.uk/' || k::VARCHAR AS url, unnest(['https://www.s' || (k % 7)::VARCHAR || '.co.uk/About-Us', 'https://help.s' || (k % 7)::VARCHAR || '.co.uk/support']) AS link, unnest([0, 3])::INT AS place FROM ({_C})")
def q_contact_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = "concat('<a href=\"/About-Us\">a</a><a href=\"mailto:team@x.example\">b</a><A class=x HREF=\"https://else.example/contact\">c</a><a href=\"https://help.s', k % 7, '.co.uk/support\">d</a><a href=\"/price?about\">e</a><a href=\"/About-Us\">f</a>')"
    return crawl.contact_links(_made(spark, sf_dir, url="concat('https://www.s', k % 7, '.co.uk/', k)", html=page))


@query(f"SELECT k, CASE k % 4 WHEN 0 THEN '*.A.example.' WHEN 1 THEN '10.0.0.0/8' WHEN 2 THEN 'b.example' END AS pattern FROM ({_C})")
def q_first_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _made(spark, sf_dir, host="CASE k % 4 WHEN 0 THEN 'x.a.example' WHEN 1 THEN '10.1.2.3' WHEN 2 THEN 'B.example.' ELSE 'a.example' END")
    listed = F.array(*(F.lit(p) for p in ("*.A.example.", "x.a.example", "10.0.0.0/8", "b.example", "*.example2")))
    return d.select("k", crawl.first_pattern(F.col("host"), listed).alias("pattern"))


@query("SELECT o_orderkey AS scan_id FROM orders WHERE o_orderstatus <> 'O' ORDER BY o_orderdate, o_orderkey LIMIT (SELECT greatest(count(*) - 200, 0) FROM orders)")
def q_registry_evicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scan_id"), F.col("o_orderdate").alias("started"), (F.col("o_orderstatus") != "O").alias("finished"))
    return crawl.evicted(d)


@query(f"SELECT k, CASE WHEN k % 3 = 0 THEN 2 WHEN k % 2 = 0 THEN 1 ELSE 0 END::INT AS exit_code FROM ({_C})")
def q_exit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.exit_codes(_made(spark, sf_dir, allowed="if(k % 3 = 0, if(k % 2 = 0, false, null), true)", confirmed="if(k % 2 = 0, 1, 0)")).select("k", "exit_code")


@query(f"SELECT k, 'GET /[REDACTED]/x?a=[REDACTED]&b=[REDACTED] ' || k::VARCHAR AS text FROM ({_C})")
def q_scrubbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _made(spark, sf_dir, secret="concat('s/', k, ' é*~+=')", text="concat('GET /s/', k, ' é*~+=/x?a=s%2F', k, '%20%C3%A9%2A~%2B%3D&b=s/', k, '%20%C3%A9%2A~%2B%3D ', k)")
    return d.select("k", crawl.scrubbed(F.col("text"), F.col("secret")).alias("text"))


@query(f"SELECT k, 'No model.' || ' Offline triage: rule ' || (k % 5)::VARCHAR AS reason FROM ({_C})")
def q_skipped_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _c(spark, sf_dir).select("k", crawl.skipped_reason(F.lit("No model."), F.concat(F.lit("rule "), F.col("k") % 5)).alias("reason"))


_FOUND = dict(
    scan_id="k % 50", kind="concat('kind', k % 6)", severity="CASE k % 4 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END", bucket="if(k % 3 = 0, 'review', 'confirmed')",
    confidence="k % 100", fingerprint="lpad(k, 9, '0')", cwe="concat('CWE-', k % 8)", remediation="if(k % 5 = 0, '', concat('rotate ', k))", verified="if(k % 7 = 0, 'verified', 'unverified')", change="if(k % 2 = 0, 'new', 'recurring')",
)


@query(f"""SELECT scan_id, kind, 'CWE-' || (k % 8)::VARCHAR AS cwe, 'rotate ' || k::VARCHAR AS remediation FROM (
  SELECT k, k % 50 AS scan_id, 'kind' || (k % 6)::VARCHAR AS kind, row_number() OVER (PARTITION BY k % 50, k % 6 ORDER BY k % 4, -(k % 100), k) AS n FROM ({_C}) WHERE k % 3 <> 0 AND k % 5 <> 0) WHERE n = 1""")
def q_remediations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.remediations(_made(spark, sf_dir, **_FOUND))


@query(f"""WITH f AS (SELECT k % 50 AS scan_id, k, k % 3 <> 0 AS sure FROM ({_C})), p AS (SELECT k % 70 AS scan_id, count(*) AS posture FROM ({_C}) WHERE k % 70 >= 20 GROUP BY ALL),
g AS (SELECT scan_id, count(*) FILTER (sure AND k % 4 = 0) AS critical, count(*) FILTER (sure AND k % 4 = 1) AS high, count(*) FILTER (sure AND k % 4 = 2) AS medium, count(*) FILTER (sure AND k % 7 = 0) AS verified_active, count(*) FILTER (sure AND k % 2 = 0) AS new, count(*) FILTER (sure AND k % 2 = 1) AS recurring, count(*) FILTER (NOT sure) AS review FROM f GROUP BY ALL)
SELECT coalesce(g.scan_id, p.scan_id) AS scan_id, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(verified_active, 0) AS verified_active, coalesce(new, 0) AS new, coalesce(recurring, 0) AS recurring, coalesce(review, 0) AS review, coalesce(posture, 0) AS posture FROM g FULL JOIN p ON g.scan_id = p.scan_id""")
def q_report_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.report_tiles(_made(spark, sf_dir, **_FOUND), _made(spark, sf_dir, scan_id="k % 70").where("scan_id >= 20"))


@query("SELECT o_orderkey AS id, o_orderdate AS decided_at FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def q_recent_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.recent_decisions(_t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("decided_at")))


@query(f"""SELECT host, NOT ends AS allowed, CASE WHEN ends THEN 'not active' ELSE 'allowed' END AS reason, 'e1' AS engagement_id FROM (
  SELECT 'h' || k::VARCHAR || '.a.example' AS host, k % 2 = 0 AS ends FROM ({_C})) WHERE ends UNION ALL SELECT 'h' || k::VARCHAR || '.b.example', true, 'allowed', 'e2' FROM ({_C}) WHERE k % 2 = 1""")
def q_revoked_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = _made(spark, sf_dir, host="concat('h', k, if(k % 2 = 0, '.a.example', '.b.example'))")
    grants = spark.sql("SELECT * FROM VALUES ('e1', array('*.a.example'), array(), 'active', date'2024-01-01', date'2024-12-31'), ('e2', array('*.b.example'), array(), 'active', date'2024-01-01', date'2024-12-31') AS t(engagement_id, scope, exclusions, status, starts_at, expires_at)")
    return hosts.authorize(targets, crawl.revoke(grants, "e1"), "2024-06-01")
