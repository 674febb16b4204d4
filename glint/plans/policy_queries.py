"""Queries of permits, addresses, recorded answers, contacts and recall, with their SQL. The rows are made from whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glint.operators import policy
from glint.plans.crawl_queries import _C, _made

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


@query(f"""SELECT k, host, reason = 'allowed' AS allowed, reason, CASE k % 3 WHEN 0 THEN 'e1' WHEN 1 THEN 'e2' END AS engagement_id FROM (SELECT k, CASE k % 3 WHEN 0 THEN 'h' || k::VARCHAR || '.a.example' WHEN 1 THEN 'h' || k::VARCHAR || '.b.example' ELSE '10.0.0.1' END AS host,
  CASE WHEN k % 3 = 2 THEN 'no authorization' WHEN k % 3 = 0 AND k % 2 = 0 THEN 'deep scan not permitted' WHEN k % 3 = 1 AND k % 5 = 0 THEN 'verification not permitted' ELSE 'allowed' END AS reason FROM ({_C}))""")
def q_technique_permits(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _made(spark, sf_dir, host="CASE k % 3 WHEN 0 THEN concat('h', k, '.a.example') WHEN 1 THEN concat('h', k, '.b.example') ELSE '10.0.0.1' END", deep="k % 2 = 0", verify="k % 5 = 0")
    grants = spark.sql("""SELECT *, 'active' AS status, date'2024-01-01' AS starts_at, date'2024-12-31' AS expires_at FROM VALUES
      ('e1', array('*.a.example'), array(), false, true), ('e2', array('*.b.example'), array(), true, null) AS t(engagement_id, scope, exclusions, permit_deep_scan, permit_verification)""")
    return policy.enforce(d, grants, "2024-06-01").select("k", "host", "allowed", "reason", "engagement_id")


_ADDRESS = ("8.8.8.8", "10.0.0.1", "2606:4700::1111", "::1", "100.64.0.1", "fe80::1", "::ffff:100.64.0.1", "nonsense", "1.1.1.1")


@query(f"""SELECT 'h' || k::VARCHAR AS host, CASE k % 9 WHEN 0 THEN '8.8.8.8' WHEN 2 THEN '2606:4700::1111' WHEN 8 THEN '1.1.1.1' END AS pinned, CASE k % 9 WHEN 1 THEN '10.0.0.1' WHEN 3 THEN '::1' WHEN 4 THEN '100.64.0.1' WHEN 5 THEN 'fe80::1' WHEN 6 THEN '::ffff:100.64.0.1' WHEN 7 THEN 'nonsense' END AS refused FROM ({_C})""")
def q_pinned_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _made(spark, sf_dir, host="concat('h', k)").withColumn("address", F.get(F.array(*map(F.lit, _ADDRESS)), F.expr("cast(k % 9 AS int)")))
    return policy.pinned_addresses(d).withColumn("pinned", F.array_join("pinned", ","))


@query(f"SELECT 'h' || k::VARCHAR AS host, CASE k % 4 WHEN 0 THEN 'unresolved' WHEN 1 THEN 'private' ELSE 'public' END AS ip_class FROM ({_C})")
def q_target_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _made(spark, sf_dir, host="concat('h', k)", address="CASE k % 4 WHEN 1 THEN '192.168.1.9' WHEN 2 THEN '100.64.0.1' WHEN 3 THEN '8.8.4.4' END")
    return policy.target_class(d, d.unionByName(d.withColumn("address", F.expr("if(k % 4 = 0, null, '9.9.9.9')"))))


@query(f"""SELECT k, CASE k % 8 WHEN 0 THEN true WHEN 2 THEN true WHEN 4 THEN true WHEN 6 THEN true ELSE false END AS active,
  CASE k % 8 WHEN 0 THEN 'Slack t' || k::VARCHAR || ' · as u' WHEN 4 THEN 'Linear a@b.example' WHEN 6 THEN 'xAI · key: n · 2 ACL(s)' ELSE '' END AS detail FROM ({_C})""")
def q_provider_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    provider = "CASE k % 8 WHEN 0 THEN 'Slack' WHEN 1 THEN 'slack' WHEN 2 THEN 'cloudflare' WHEN 3 THEN 'datadog' WHEN 4 THEN 'linear' WHEN 5 THEN 'github' ELSE 'xai' END"
    body = """CASE k % 8 WHEN 0 THEN concat('{"ok":true,"team":"t', k, '","user":"u"}') WHEN 1 THEN '{"ok":false,"team":"t"}' WHEN 2 THEN '{"success":true,"result":{}}' WHEN 3 THEN 'no json'
      WHEN 4 THEN '{"data":{"viewer":{"name":"n","email":"a@b.example"}}}' WHEN 5 THEN '{}' WHEN 6 THEN '{"name":"n","acls":["a","b"]}' ELSE '{"name":"n","api_key_blocked":true}' END"""
    return policy.provider_outcome(_made(spark, sf_dir, provider=provider, body=body, status_code="if(k % 8 = 5, 401, 200)")).select("k", "active", "detail")


@query(f"""SELECT 'd' || k::VARCHAR || '.example' AS domain, CASE WHEN k % 3 = 0 THEN 'security@d' || k::VARCHAR || '.example' END AS email, CASE WHEN k % 3 = 0 THEN 'https://d' || k::VARCHAR || '.example/1' END AS source_url,
  CASE k % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END::BIGINT AS n_pages, CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN 'no address' ELSE 'no page' END AS note FROM ({_C})""")
def q_verified_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _made(spark, sf_dir, domain="concat('d', k, '.example')")
    pages = d.where("k % 3 < 2").select("domain", "k", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("place"))
    body = "CASE WHEN k % 3 = 1 THEN if(place = 2, 'nothing here', null) WHEN place = 0 THEN concat('write to jobs@', domain) WHEN place = 1 THEN concat('<a href=\"mailto:security@', domain, '\">x</a>') ELSE '' END"
    pages = pages.select("domain", "place", F.concat(F.lit("https://"), "domain", F.lit("/"), "place").alias("url"), F.expr(body).alias("body"))
    return policy.verified_contacts(d, pages).select("domain", "email", "source_url", "n_pages", "note")


@query(f"SELECT CASE k % 3 WHEN 0 THEN 'GCP' WHEN 1 THEN 'hugging' ELSE 'acme' END AS provider, 'r' || k::VARCHAR AS rule, CASE WHEN k % 4 = 0 THEN 'detected' WHEN k % 3 < 2 THEN 'in-scope miss' ELSE 'no detector' END AS outcome FROM ({_C})")
def q_external_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _made(spark, sf_dir, provider="CASE k % 3 WHEN 0 THEN 'GCP' WHEN 1 THEN 'hugging' ELSE 'acme' END", rule="concat('r', k)")
    return policy.external_recall(d, d.where("k % 4 = 0"), spark.sql("SELECT * FROM VALUES ('Google Cloud API Key'), ('Hugging Face Token') AS t(kind)"))


@query(f"""WITH n AS (SELECT count(*) FILTER (k % 4 < 2) AS tp, count(*) FILTER (k % 4 = 2) AS mistyped, count(*) FILTER (k % 4 = 3) AS missed, count(*) FILTER (k % 5 = 0) AS fp FROM ({_C})),
r AS (SELECT *, tp / (tp + fp) AS p, tp / (tp + mistyped + missed) AS q FROM n) SELECT tp, mistyped, missed, fp, round(p, 4) AS precision, round(q, 4) AS recall, round(2 * p * q / (p + q), 4) AS f1 FROM r""")
def q_ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _made(spark, sf_dir, kind="concat('kind', k % 7)", value="concat(lpad(k, 12, '0'), if(k % 2 = 0, repeat('x', 90), ''))")
    seen = "if(length(value) > 80, concat(substring(value, 1, 75), '…', right(value, 4)), value)"
    found = d.where("k % 4 < 3").selectExpr("if(k % 4 = 2, 'other', kind) AS kind", f"if(k % 3 = 0, value, concat(substring(value, 1, 12), substring({seen}, 13))) AS value")
    return policy.ground_truth(d, found.unionByName(found).unionByName(d.where("k % 5 = 0").selectExpr("kind", "concat('decoy', k) AS value")))
