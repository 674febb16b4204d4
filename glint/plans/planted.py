"""Assets with credential-shaped values made from keys of the tables, by expressions that Spark and SQL share.

Values are put together from fragments and digests, so that no credential-shaped literal stands in the source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: For each detector of a fixed shape: SQL of a value, from h(), k characters of digests of a key (lower hex).
#: {h:n} stands for n hex digits, {H:n} for upper-case ones, {p} for pieces joined by ||.
SHAPES: dict[str, str] = {
    "AWS Access Key": "'AK' || 'IA' || {H:16}",
    "Google Cloud API Key": "'AI' || 'za' || {h:35}",
    "Slack Webhook": "'https://hooks.' || 'slack.com/services/T' || {H:8} || '/B' || {H:8} || '/' || {h:24}",
    "JWT Token": "'ey' || 'J' || {h:20} || '.' || {h:30} || '.' || {h:26}",
    "GitHub Personal Access Token": "'gh' || 'p_' || {h:36}",
    "GitHub OAuth Token": "'gh' || 'o_' || {h:36}",
    "Stripe Secret Key": "'sk' || '_live_' || {h:24}",
    "Stripe Test Key": "'sk' || '_test_' || {h:24}",
    "Stripe Publishable Key": "'pk' || '_live_' || {h:24}",
    "SendGrid API Key": "'S' || 'G.' || {h:22} || '.' || {h:43}",
    "Mailgun API Key": "'ke' || 'y-' || {h:32}",
    "Shopify Access Token": "'shp' || 'at_' || {h:32}",
    "GitHub Fine-Grained PAT": "'github' || '_pat_' || {h:82}",
    "GitLab Token (non-PAT)": "'gl' || 'dt-' || {h:24}",
    "GitLab Personal Access Token": "'gl' || 'pat-' || {h:20}",
    "OpenAI API Key": "'s' || 'k-' || {h:24} || 'T3Blbk' || 'FJ' || {h:24}",
    "Anthropic API Key": "'sk' || '-ant-' || {h:40}",
    "ElevenLabs API Key": "'s' || 'k_' || {h:48}",
    "Groq API Key": "'gs' || 'k_' || {h:52}",
    "Hugging Face Access Token": "'h' || 'f_' || {h:34}",
    "Replicate API Token": "'r' || '8_' || {h:37}",
    "Perplexity API Key": "'ppl' || 'x-' || {h:48}",
    "xAI API Key": "'xa' || 'i-' || {h:80}",
    "OpenRouter API Key": "'sk' || '-or-v1-' || {h:64}",
    "LangSmith API Key": "'ls' || 'v2_pt_' || {h:32} || '_' || {h:10}",
    "Pinecone API Key": "'pc' || 'sk_' || {h:60}",
    "Slack Token": "'xo' || 'xb-' || {h:40}",
    "npm Access Token": "'np' || 'm_' || {h:36}",
    "PyPI Upload Token": "'pyp' || 'i-AgEIcHlwaS' || {h:60}",
    "DigitalOcean PAT": "'do' || 'p_v1_' || {h:64}",
    "HashiCorp Vault Token": "'hv' || 's.' || {h:30}",
    "Google OAuth Client Secret": "'GOC' || 'SPX-' || {h:28}",
    "Square Access Token": "'sq' || '0atp-' || {h:22}",
    "Postman API Key": "'PM' || 'AK-' || {h:24} || '-' || {h:34}",
    "Databricks Token": "'da' || 'pi' || {h:32}",
    "Firebase Cloud Messaging Key": "'AA' || 'AA' || {h:7} || ':' || {h:140}",
    "Slack App-Level Token": "'xa' || 'pp-1-A' || {H:8} || '-123456-' || {h:32}",
    "GitHub Server/Refresh Token": "'gh' || 's_' || {h:36}",
    "OpenAI Service Account Key": "'sk' || '-svcacct-' || {h:30}",
    "New Relic API Key": "'NR' || 'AK-' || {H:27}",
    "Grafana Cloud Access Token": "'gl' || 'c_' || {h:40}",
    "Grafana Service Account Token": "'gl' || 'sa_' || {h:32} || '_' || {h:8}",
    "Supabase Access Token": "'sb' || 'p_' || {h:40}",
    "Supabase Secret Key": "'sb_' || 'secret_' || {h:30}",
    "Sentry DSN": "'https://' || {h:32} || '@o1.ingest.' || 'sentry.io/42'",
    "Linear API Key": "'lin' || '_api_' || {h:40}",
    "Notion Integration Token": "'nt' || 'n_' || {h:46}",
    "Doppler Token": "'d' || 'p.pt.' || {h:42}",
    "PostHog Project API Key": "'ph' || 'c_' || {h:43}",
    "Figma Personal Access Token": "'fi' || 'gd_' || {h:44}",
    "Cloudflare Origin CA Key": "'v1' || '.0-' || {h:24} || '-' || {h:146}",
    "Cloudflare API Token": "'cf' || 'ut_' || {h:40}",
    "Database Connection URI": "'post' || 'gres://app:' || {h:20} || '@db.example.net/main'",
    "Basic-Auth URL Credentials": "'ht' || 'tps://app:' || {h:20} || '@files.example.net/x'",
    "Generic High-Entropy Secret": "{h:32}",
    "OAuth Client Secret": "{h:24}",
    "Datadog API Key": "{h:32}",
    "Twilio Auth Token": "{h:32}",
    "GCP Service Account Key (JSON)": "{h:40}",
    "Azure Storage Account Key": "{h:88}",
    "Bearer Token": "{h:40}",
}
#: What stands around a value where its detector asks for it; {v} is the value's SQL.
AROUND = {
    "Generic High-Entropy Secret": "'pass' || 'word = \"' || {v} || '\"'",
    "OAuth Client Secret": "'client_' || 'secret: \"' || {v} || '\"'",
    "Datadog API Key": "'data' || 'dog k \"' || {v} || '\"'",
    "Twilio Auth Token": "'twi' || 'lio t \"' || {v} || '\"'",
    "GCP Service Account Key (JSON)": "'\"private_' || 'key_id\": \"' || {v} || '\"'",
    "Azure Storage Account Key": "'Account' || 'Key=' || {v}",
    "Bearer Token": "'bea' || 'rer ' || {v}",
}
PLAIN = "'const v = \"' || {v} || '\";'"


def _digits(key: str, n: int, upper: bool) -> str:
    parts = " || ".join(f"md5({key} || '{c}')" for c in "abcdef"[: -(-n // 32)])
    out = f"substr({parts}, 1, {n})"
    return f"upper({out})" if upper else out


def value_sql(kind: str, key: str) -> str:
    out = SHAPES[kind]
    for n in range(150, 0, -1):
        for mark, upper in (("h", False), ("H", True)):
            if f"{{{mark}:{n}}}" in out:
                out = out.replace(f"{{{mark}:{n}}}", _digits(key, n, upper))
    return f"({out})"


def assets_sql(kinds: list[str] | None = None, table: str = "customer", key: str = "c_custkey", rows: str = "") -> str:
    """SQL of assets (scan_id, target_url, source_url, body): a line for each kind, from the row's key."""
    k = f"cast({key} AS varchar(20))"
    lines = []
    for i, kind in enumerate(kinds or list(SHAPES)):
        v = value_sql(kind, f"({k} || '-{i}-')")
        lines.append(AROUND.get(kind, PLAIN).format(v=v))
    body = " || chr(10) || ".join(lines)
    return f"""SELECT 's' || cast({key} % 7 AS varchar(20)) AS scan_id, 'https://shop' || cast({key} % 7 AS varchar(20)) || '.acme-store.net' AS target_url,
  'https://shop' || cast({key} % 7 AS varchar(20)) || '.acme-store.net/a' || {k} || '.js' AS source_url, {body} AS body FROM {table} {rows}"""


def dealt(d: DataFrame) -> DataFrame:
    """Rows dealt to all cores, a few tasks each: the keys of millions of texts fit into one block of one file, which one
    task reads. To be called on the keys, before anything is made of them."""
    return d.repartition(4 * d.sparkSession.sparkContext.defaultParallelism)


def assets(spark: SparkSession, sf_dir: str, kinds: list[str] | None = None, rows: str = "") -> DataFrame:
    dealt(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")).createOrReplaceTempView("_planted_customer")
    return spark.sql(assets_sql(kinds, "_planted_customer", rows=rows).replace("chr(10)", "chr(10L)"))
