"""Queries of detection, gates, claims, verdicts and routing, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glint.functions import columns as C
from glint.functions.registry import BY_NAME, DETECTORS, GENERIC, PAIR_RULES, PLACEHOLDER
from glint.operators import detect, verdict
from glint.plans.planted import SHAPES, assets, assets_sql, dealt

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = ["AWS Access Key", "GitHub Personal Access Token", "Stripe Publishable Key", GENERIC]


def spread(d: DataFrame) -> DataFrame:
    """Dealt anew where a small file gives fewer partitions than there are cores: detection is all CPU."""
    cores = d.sparkSession.sparkContext.defaultParallelism
    return d.repartition(cores) if d.rdd.getNumPartitions() < cores else d


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return d.select("doc_id", F.concat(F.lit("https://docs.example.org/"), F.col("doc_id").cast("string")).alias("source_url"), F.col("text").alias("body"))


# -- SQL parts --------------------------------------------------------------------------------------------------------
def _quote(text: str) -> str:
    return text.replace("'", "''")


def entropy_sql(value: str, key: str, source: str) -> str:
    """A table (key, e) of the entropies of a column of values."""
    return f"""(SELECT {key}, round(-sum(p * log2(p)), 4) AS e FROM (SELECT {key}, c, count(*) / max(n) AS p FROM (
      SELECT {key}, unnest(string_split({value}, '')) AS c, length({value})::DOUBLE AS n FROM {source}) WHERE c <> '' GROUP BY {key}, c) GROUP BY {key})"""


def _re2(kind: str) -> str:
    pattern = BY_NAME[kind].pattern.replace("(?!svcacct-)", "")
    return _quote(pattern)


def matches_sql(source: str, kinds: list[str], columns: str) -> str:
    """Rows (columns, kind, ordinal, value) of the kinds' matches in source.body."""
    index = {d.name: i for i, d in enumerate(DETECTORS)}
    parts = []
    for k in kinds:
        keep = " WHERE NOT starts_with(value, 'sk-' || 'svcacct-')" if k == "OpenAI API Key" else ""
        parts.append(
            f"SELECT * FROM (SELECT {columns}, '{k}' AS kind, {index[k]} * 1000 + unnest(range(len(m))) AS ordinal, unnest(m) AS value FROM "
            f"(SELECT {columns}, list_slice(regexp_extract_all(body, '{_re2(k)}', 1), 1, 100) AS m FROM {source})){keep}"
        )
    return " UNION ALL ".join(parts)


def gated_sql(source: str, kinds: list[str], columns: str) -> str:
    """CTEs a (assets), m, g: g has (columns, kind, ordinal, value, entropy) behind the gates."""
    return f"""a AS ({source}), m AS (SELECT *, row_number() OVER () AS rid FROM ({matches_sql("a", kinds, columns)})),
g AS (SELECT {columns}, kind, ordinal, value, e AS entropy FROM m JOIN {entropy_sql("value", "rid", "m")} USING (rid)
  WHERE NOT regexp_matches(value, '{_quote(PLACEHOLDER)}') AND e >= CASE WHEN kind = '{GENERIC}' THEN 3.5 ELSE 2.5 END)"""


_FP = "substr(sha256(kind || '|' || source_url || '|' || value), 1, 16)"
_SEV = "CASE " + " ".join(f"WHEN kind = '{d.name}' THEN '{d.severity}'" for d in DETECTORS) + " ELSE 'MEDIUM' END"
_CWE = "CASE " + " ".join(f"WHEN kind = '{d.name}' THEN '{d.cwe}'" for d in DETECTORS) + " ELSE 'CWE-798' END"
_PUBLIC = "kind IN ('" + "', '".join(verdict.PUBLIC_TYPES) + "')"
_RANK = f"CASE WHEN kind = '{GENERIC}' THEN 0 WHEN kind IN ('" + "', '".join(r.name for r in PAIR_RULES) + "') THEN 1 ELSE 2 END"


def collapsed_sql(g: str = "g") -> str:
    return f"""(SELECT * EXCLUDE (n1, n2) FROM (SELECT *, row_number() OVER (PARTITION BY source_url, value ORDER BY {_RANK} DESC, ordinal) AS n2 FROM
      (SELECT *, {_FP} AS fingerprint, row_number() OVER (PARTITION BY {_FP} ORDER BY ordinal) AS n1 FROM {g}) WHERE n1 = 1) WHERE n2 = 1)"""


_VERDICT_SQL = f"""SELECT *, CASE WHEN {_PUBLIC} THEN 95 WHEN kind = 'Google Cloud API Key' THEN 55 WHEN kind = '{GENERIC}' THEN 45 WHEN entropy >= 3.5 THEN 75 ELSE 60 END AS confidence,
  CASE WHEN {_PUBLIC} THEN 'informational' ELSE 'review' END AS bucket, CASE WHEN {_PUBLIC} THEN 'INFO' ELSE {_SEV} END AS severity FROM """


# -- queries ----------------------------------------------------------------------------------------------------------
def query(name: str, sql: str = ""):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query(
    "q_scan_summary",
    f"""WITH {gated_sql(assets_sql(FLAGSHIP), FLAGSHIP, "scan_id, target_url, source_url")}, f AS {collapsed_sql()}, v AS ({_VERDICT_SQL} f)
SELECT kind, bucket, severity, count(*) AS findings, count(DISTINCT source_url) AS sources, max(confidence) AS confidence, max(entropy) AS top_entropy FROM v GROUP BY ALL""",
)
def q_scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = verdict.offline_verdicts(detect.scan_assets(assets(spark, sf_dir, FLAGSHIP)))
    return found.groupBy("kind", "bucket", "severity").agg(
        F.count("*").alias("findings"), F.countDistinct("source_url").alias("sources"), F.max("confidence").alias("confidence"), F.max("entropy").alias("top_entropy")
    )


_DOCS = "SELECT doc_id, 'https://docs.example.org/' || doc_id::VARCHAR AS source_url, text AS body FROM documents"


@query("q_detect_generic_documents", f"WITH {gated_sql(_DOCS, [GENERIC], 'doc_id, source_url')} SELECT doc_id, kind, value, entropy, {_FP} AS fingerprint FROM g")
def q_detect_generic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.detect_values(_documents(spark, sf_dir), detectors=(BY_NAME[GENERIC],))
    return found.select("doc_id", "kind", "value", "entropy", C.fingerprint(F.col("kind"), F.col("source_url"), F.col("value")).alias("fingerprint"))


@query("q_detect_registry_documents")
def q_detect_registry_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All detectors over all documents, with the text around each match."""
    found = detect.with_context(detect.detect_values(_documents(spark, sf_dir)))
    return found.select("doc_id", "kind", "value", "entropy", "context_snippet")


def _family(kinds: list[str]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = detect.detect_values(assets(spark, sf_dir, kinds), detectors=tuple(BY_NAME[k] for k in kinds))
        kind = F.col("kind")
        return found.select("source_url", "kind", "value", "entropy", C.severity_of(kind).alias("severity"), C.cwe_of(kind).alias("cwe"))

    sql = f"WITH {gated_sql(assets_sql(kinds), kinds, 'source_url')} SELECT source_url, kind, value, entropy, {_SEV} AS severity, {_CWE} AS cwe FROM g"
    return run, sql


_kinds = list(SHAPES)
for _i in range(0, len(_kinds), 8):
    QUERIES[f"q_detect_registry_planted_{_i // 8 + 1}"], ORACLES[f"q_detect_registry_planted_{_i // 8 + 1}"] = _family(_kinds[_i : _i + 8])


@query("q_entropy_values", f"WITH v AS (SELECT p_partkey, p_name || md5(p_partkey::VARCHAR) AS value FROM part) SELECT p_partkey, e AS entropy, e >= 3.5 AS passes FROM {entropy_sql('value', 'p_partkey', 'v')}")
def q_entropy_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dealt(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name")).select("p_partkey", C.entropy(F.concat("p_name", F.md5(F.col("p_partkey").cast("string")))).alias("entropy"))
    return d.withColumn("passes", F.col("entropy") >= 3.5)


_VALUES = "CASE {k} % 6 WHEN 0 THEN 'your_api_key_' || md5({s}) WHEN 1 THEN 'xxxxxxxxxx' || {s} WHEN 2 THEN 'AKIA' || 'IOSFODNN7EXAMPLE' WHEN 3 THEN '<insert ' || {s} || '>' WHEN 4 THEN md5({s}) || md5({s} || 'b') || md5({s} || 'c') ELSE substr(md5({s}), 1, 1 + {k} % 30) END"


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = _VALUES.format(k="c_custkey", s="cast(c_custkey AS string)")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.expr(value).alias("value"))


_VALUES_SQL = f"WITH v AS (SELECT c_custkey, {_VALUES.format(k='c_custkey', s='c_custkey::VARCHAR')} AS value FROM customer)"


@query("q_placeholder_filter", f"{_VALUES_SQL} SELECT c_custkey, value, (value = 'AKIA' || 'IOSFODNN7EXAMPLE' OR regexp_matches(value, '{_quote(PLACEHOLDER)}')) AS benign FROM v")
def q_placeholder_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, sf_dir).withColumn("benign", C.is_placeholder(F.col("value")))


@query(
    "q_mask_cap_redact",
    f"""{_VALUES_SQL}, r AS (SELECT *, length(value) AS n, CASE WHEN length(value) <= 8 THEN 0 ELSE least(6, length(value) // 4) END AS keep FROM v)
SELECT c_custkey, CASE WHEN n <= 80 THEN value ELSE substr(value, 1, 75) || '…' || right(value, 4) END AS capped,
  CASE WHEN n <= 12 THEN repeat('*', n) ELSE substr(value, 1, 6) || '…******…' || right(value, 4) || '  (' || n || ' chars)' END AS masked,
  substr(value, 1, keep) || repeat('*', n - keep) AS redacted, replace('k=' || value || ';', value, substr(value, 1, keep) || repeat('*', n - keep)) AS snippet FROM r""",
)
def q_mask_cap_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    snippet = C.redact_snippet(F.concat(F.lit("k="), v, F.lit(";")), v)
    return _values(spark, sf_dir).select("c_custkey", C.cap_raw(v).alias("capped"), C.mask(v).alias("masked"), C.redact(v).alias("redacted"), snippet.alias("snippet"))


@query("q_fingerprint", "SELECT doc_id, substr(sha256('Doc' || '|' || source || '|' || text), 1, 16) AS fingerprint FROM documents")
def q_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", C.fingerprint(F.lit("Doc"), F.col("source"), F.col("text")).alias("fingerprint"))


_B64 = "SELECT c_custkey, {enc} AS blob FROM customer"


@query("q_base64_decode", "SELECT c_custkey, 'token holder ' || md5(c_custkey::VARCHAR) || CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'x' ELSE 'xy' END AS decoded, 0 AS view_no FROM customer")
def q_base64_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = F.expr("concat('token holder ', md5(cast(c_custkey AS string)), CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'x' ELSE 'xy' END)")
    d = dealt(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")).select("c_custkey", F.concat(F.lit("v = '"), F.base64(plain.cast("binary")), F.lit("';")).alias("body"))
    return detect.base64_texts(d).select("c_custkey", "decoded", "view_no")


_PAIR_BODY = "concat('id=AK', 'IA', upper(substr(md5(cast({k} AS {t})), 1, 16)), ' ', repeat('x ', cast({k} % 200 AS int)), '\"', substr(md5(cast({k} AS {t})), 1, 10), upper(substr(md5(concat('b', cast({k} AS {t}))), 1, 30)), '\"')"


@query(
    "q_composite_pair",
    f"""WITH v AS (SELECT c_custkey, substr(md5(c_custkey::VARCHAR), 1, 10) || upper(substr(md5('b' || c_custkey::VARCHAR), 1, 30)) AS value, 2 + 2 * (c_custkey % 200) AS gap FROM customer)
SELECT c_custkey, 'AWS Secret Access Key' AS kind, value, e AS entropy FROM v JOIN {entropy_sql("value", "c_custkey", "v")} USING (c_custkey)
WHERE gap <= 250 AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[0-9]') AND e >= 2.5""",
)
def q_composite_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dealt(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")).select("c_custkey", F.expr(_PAIR_BODY.format(k="c_custkey", t="string")).alias("body"))
    return detect.pair_values(d).select("c_custkey", "kind", "value", "entropy")


_DUP = ["GitHub Personal Access Token", GENERIC]
_DUP_SQL = "SELECT 'https://a.example/' || c_custkey::VARCHAR AS source_url, 'pass' || 'word = \"gh' || 'p_' || substr(md5(c_custkey::VARCHAR) || md5('b' || c_custkey::VARCHAR), 1, 36) || '\"; x = \"gh' || 'p_' || substr(md5(c_custkey::VARCHAR) || md5('b' || c_custkey::VARCHAR), 1, 36) || '\"' AS body FROM customer"


@query("q_authority_collapse", f"WITH {gated_sql(_DUP_SQL, _DUP, 'source_url')} SELECT source_url, kind, value, fingerprint FROM {collapsed_sql()}")
def q_authority_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")).createOrReplaceTempView("_dup_customer")
    d = spark.sql(_DUP_SQL.replace("::VARCHAR", "::string").replace("FROM customer", "FROM _dup_customer"))
    return detect.scan_assets(d).select("source_url", "kind", "value", "fingerprint")


_TR = ["Google Cloud API Key", "Stripe Publishable Key", GENERIC, "GitHub OAuth Token"]


@query("q_triage_bucket", f"WITH {gated_sql(assets_sql(_TR), _TR, 'source_url')} SELECT source_url, kind, confidence, bucket, severity FROM ({_VERDICT_SQL} {collapsed_sql()})")
def q_triage_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdict.offline_verdicts(detect.scan_assets(assets(spark, sf_dir, _TR))).select("source_url", "kind", "confidence", "bucket", "severity")


_AI = """WITH f AS (SELECT doc_id, quality, toxic, CASE doc_id % 3 WHEN 0 THEN 'GitHub Personal Access Token' WHEN 1 THEN 'Generic High-Entropy Secret' ELSE 'SendGrid API Key' END AS kind FROM labels)"""


def _ai_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.expr("CASE doc_id % 3 WHEN 0 THEN 'GitHub Personal Access Token' WHEN 1 THEN 'Generic High-Entropy Secret' ELSE 'SendGrid API Key' END")
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic", kind.alias("kind"), F.col("doc_id").cast("string").alias("fingerprint"))


@query(
    "q_ai_escalation_merge",
    f"""{_AI}, t AS (SELECT *, CASE WHEN doc_id % 5 <> 0 THEN quality = 1 END AS v1, CASE WHEN doc_id % 5 <> 0 THEN 60 + doc_id % 40 END AS c1,
  CASE WHEN doc_id % 2 = 0 THEN toxic = 0 END AS v2, CASE WHEN doc_id % 2 = 0 THEN 50 + doc_id % 50 END AS c2 FROM f),
j AS (SELECT *, (kind LIKE 'GitHub%' OR coalesce(v1, false)) AND c2 IS NOT NULL AS second FROM t),
r AS (SELECT doc_id, kind, CASE WHEN second THEN v2 WHEN c1 IS NOT NULL THEN v1 ELSE false END AS is_valid, CASE WHEN second THEN c2 WHEN c1 IS NOT NULL THEN c1 ELSE -1 END AS confidence FROM j)
SELECT doc_id, is_valid, confidence::INT AS confidence, CASE WHEN confidence = -1 THEN 'review' WHEN is_valid AND confidence >= 80 THEN 'confirmed'
  WHEN kind NOT LIKE 'Generic%' AND NOT (NOT is_valid AND confidence >= 80) THEN 'review' ELSE 'drop' END AS bucket FROM r""",
)
def q_ai_escalation_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _ai_findings(spark, sf_dir)
    tier = lambda valid, conf, keep: d.where(keep).select("fingerprint", F.expr(valid).alias("is_valid"), F.expr(f"cast({conf} AS int)").alias("confidence"), F.lit(False).alias("public_by_design"))
    out = verdict.merge_ai(d, tier("quality = 1", "60 + doc_id % 40", "doc_id % 5 <> 0"), tier("toxic = 0", "50 + doc_id % 50", "doc_id % 2 = 0"))
    return out.select("doc_id", "is_valid", "confidence", "bucket")


@query(
    "q_verification_promote",
    """WITH f AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'review' ELSE 'informational' END AS b, CASE doc_id % 4 WHEN 0 THEN 'verified' WHEN 1 THEN 'unverified' END AS s FROM labels),
r AS (SELECT doc_id, CASE WHEN b = 'informational' THEN '' ELSE coalesce(s, 'unsupported') END AS verified, coalesce(b = 'review' AND s = 'verified', false) AS promoted, b FROM f)
SELECT doc_id, verified, promoted, CASE WHEN promoted THEN 'confirmed' ELSE b END AS bucket FROM r WHERE NOT (b = 'confirmed' AND verified = 'unverified')""",
)
def q_verification_promote(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _ai_findings(spark, sf_dir).withColumn("bucket", F.expr("CASE doc_id % 3 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'review' ELSE 'informational' END"))
    results = d.select("fingerprint", F.expr("CASE doc_id % 4 WHEN 0 THEN 'verified' WHEN 1 THEN 'unverified' END").alias("status")).where("status is not null")
    return verdict.merge_verification(d, results, only_verified=True).select("doc_id", "verified", "promoted", "bucket")


@query(
    "q_suppress_is_new",
    "SELECT doc_id, doc_id % 7 <> 0 AS is_new FROM documents WHERE doc_id % 5 <> 0",
)
def q_suppress_is_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("doc_id").cast("string").alias("fingerprint"))
    return verdict.mark_new(verdict.suppress(d, d.where("doc_id % 5 = 0")), d.where("doc_id % 7 = 0")).select("doc_id", "is_new")


@query("q_severity_rollup", f"WITH {gated_sql(assets_sql(FLAGSHIP), FLAGSHIP, 'scan_id, target_url, source_url')}, v AS ({_VERDICT_SQL} {collapsed_sql()}) SELECT target_url, severity, count(*) AS findings, grouping(target_url, severity)::BIGINT AS level FROM v GROUP BY ROLLUP (target_url, severity)")
def q_severity_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = verdict.offline_verdicts(detect.scan_assets(assets(spark, sf_dir, FLAGSHIP)))
    return found.rollup("target_url", "severity").agg(F.count("*").alias("findings"), F.grouping_id().cast("long").alias("level"))
