"""What becomes of a finding: deterministic verdict, other verdicts merged in, bucket, suppression, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glint.functions import columns as C
from glint.functions.registry import GENERIC, GENERIC_ENTROPY

# Types that are meant to be public; what marks a key's surroundings; confidences.
PUBLIC_TYPES = ("Stripe Publishable Key", "Sentry DSN", "PostHog Project API Key")
FIREBASE = r"(?i)\b(authDomain|projectId|storageBucket|messagingSenderId|appId|measurementId|databaseURL)\b|firebaseapp\.com|firebaseio\.com"
MAPS = r"(?i)maps\.googleapis\.com|maps\.google\.com|google\.maps|recaptcha"
TEST_TEXT = (
    r"(?i)\b(mock|dummy|fixture|sample|faker?|stub|lorem|example[_-]?(?:key|token|secret|value)|"
    r"test[_-]?(?:key|token|secret|value|data)|describe|it\(|expect\(|assert)"
)
TEST_PATH = r"(?i)(^|[/._-])(tests?|__tests__|spec|specs|mocks?|__mocks__|fixtures?|examples?|samples?|stories|storybook|e2e|cypress|jest|karma)([/._-]|$)"
DISMISS, STRUCTURAL, WEAK_STRUCTURAL, LONE_GOOGLE, LOOSE, NEEDS_REVIEW, AI_SURE = 95, 75, 60, 55, 45, -1, 80
# The kinds of impact, by the first of these names that a type has.
IMPACTS = (
    "AWS Access Key", "AWS Secret Access Key", "GCP Service Account", "Private Key Block", "PGP Private Key", "Database Connection URI", "Basic-Auth URL",
    "Stripe Secret Key", "GitHub", "GitLab", "Slack", "Discord Bot Token", "Telegram Bot Token", "SendGrid", "Mailgun", "Twilio", "OpenAI", "Anthropic", "API Key", "Token",
)


def impact_class(kind: Column, severity: Column) -> Column:
    out = F.concat(F.lit("by severity: "), F.when(F.upper(severity).isin("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"), F.upper(severity)).otherwise("MEDIUM"))
    for name in reversed(IMPACTS):
        out = F.when(F.lower(kind).contains(name.lower()), name).otherwise(out)
    return out


def looks_non_production(snippet: Column, url: Column) -> Column:
    return F.coalesce(snippet, F.lit("")).rlike(C.UNICODE + TEST_TEXT) | F.coalesce(url, F.lit("")).rlike(C.UNICODE + TEST_PATH)


def triage(kind: Column, entropy: Column, snippet: Column, url: Column) -> Column:
    """struct<is_valid, confidence, public_by_design, rule> of the ordered rules."""
    s, low = F.coalesce(snippet, F.lit("")), F.lower(kind)
    public, google, generic = F.lit(False), low.contains("google cloud api key"), kind == GENERIC
    for t in PUBLIC_TYPES:
        public = public | low.contains(t.lower())
    v = lambda valid, conf, pub, rule: F.struct(F.lit(valid).alias("is_valid"), F.lit(conf).alias("confidence"), F.lit(pub).alias("public_by_design"), F.lit(rule).alias("rule"))
    return (
        F.when(public, v(False, DISMISS, True, "public type"))
        .when(google & s.rlike(C.UNICODE + FIREBASE), v(False, DISMISS, True, "web app configuration"))
        .when(google & s.rlike(C.UNICODE + MAPS), v(False, DISMISS, True, "map or captcha key"))
        .when(google, v(True, LONE_GOOGLE, False, "google key alone"))
        .when(generic & looks_non_production(snippet, url), v(False, DISMISS, False, "test code"))
        .when(~generic & (entropy >= GENERIC_ENTROPY), v(True, STRUCTURAL, False, "known shape"))
        .when(~generic, v(True, WEAK_STRUCTURAL, False, "known shape, little entropy"))
        .otherwise(v(True, LOOSE, False, "loose match"))
    )


def bucket(kind: Column, valid: Column, confidence: Column, public: Column, ai_judged: Column, triaged: Column) -> Column:
    """confirmed, review, informational or drop."""
    structural = kind != GENERIC
    return (
        F.when(confidence == NEEDS_REVIEW, "review")
        .when(public, "informational")
        .when(~ai_judged & (~triaged | valid), "review")
        .when(~ai_judged & (confidence >= AI_SURE), "drop")
        .when(~ai_judged, "review")
        .when(valid & (confidence >= AI_SURE), "confirmed")
        .when(structural & ~(~valid & (confidence >= AI_SURE)), "review")
        .otherwise("drop")
    )


def effective_severity(kind: Column, public: Column) -> Column:
    return F.when(public, "INFO").otherwise(C.severity_of(kind))


def validation_tier(ai_judged: Column, triaged: Column) -> Column:
    return F.when(ai_judged, "ai").when(triaged, "offline-triage").otherwise("none")


def offline_verdicts(found: DataFrame) -> DataFrame:
    """Findings with the deterministic verdict's columns and their bucket."""
    snippet = F.col("context_snippet") if "context_snippet" in found.columns else F.lit("")
    d = found.withColumn("_v", triage(F.col("kind"), F.col("entropy"), snippet, F.col("source_url"))).select("*", "_v.*").drop("_v")
    d = d.withColumns({"ai_judged": F.lit(False), "offline_triaged": F.lit(True)})
    return routed(d)


def routed(d: DataFrame) -> DataFrame:
    made = bucket(*(F.col(c) for c in ("kind", "is_valid", "confidence", "public_by_design", "ai_judged", "offline_triaged")))
    return d.withColumns({"bucket": made, "severity": effective_severity(F.col("kind"), F.col("public_by_design"))})


def merge_ai(found: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Verdicts of two tiers by fingerprint (is_valid, confidence, public_by_design): the second counts where the first
    or the severity calls for it, else the first; with neither the finding needs review. Confidences beyond 0..100 are no verdict."""
    tier = lambda d, n: d.where("confidence between 0 and 100").select("fingerprint", F.struct("is_valid", "confidence", "public_by_design").alias(n))
    d = found.join(tier(first, "t1"), "fingerprint", "left").join(tier(second, "t2"), "fingerprint", "left")
    asked = (C.severity_of(F.col("kind")) == "CRITICAL") | F.coalesce(F.col("t1.is_valid"), F.lit(False))
    none = F.struct(F.lit(False).alias("is_valid"), F.lit(NEEDS_REVIEW).alias("confidence"), F.lit(False).alias("public_by_design"))
    v = F.coalesce(F.when(asked, F.col("t2")), F.col("t1"), none)
    old = [c for c in found.columns if c not in ("is_valid", "confidence", "public_by_design", "ai_judged", "offline_triaged")]
    d = d.withColumn("_v", v).select(*old, "_v.*").withColumns({"ai_judged": F.col("confidence") >= 0, "offline_triaged": F.lit(False)})
    return routed(d)


def merge_verification(found: DataFrame, results: DataFrame, only_verified: bool = False) -> DataFrame:
    """``results``: fingerprint, status (verified, unverified, unsupported). What was verified in review is confirmed."""
    d = found.join(results.select("fingerprint", F.col("status").alias("_s")), "fingerprint", "left")
    checked = F.col("bucket").isin("confirmed", "review")
    d = d.withColumn("verified", F.when(checked, F.coalesce("_s", F.lit("unsupported"))).otherwise("")).drop("_s")
    d = d.withColumn("promoted", (F.col("bucket") == "review") & (F.col("verified") == "verified"))
    d = d.withColumn("bucket", F.when(F.col("promoted"), "confirmed").otherwise(F.col("bucket")))
    return d.where("not (bucket = 'confirmed' and verified = 'unverified')") if only_verified else d


def suppress(found: DataFrame, suppressed: DataFrame) -> DataFrame:
    return found.join(suppressed.select("fingerprint").distinct(), "fingerprint", "left_anti")


def mark_new(found: DataFrame, previous: DataFrame) -> DataFrame:
    """``is_new``: the fingerprint isn't among the previous scan's confirmed ones."""
    before = previous.select("fingerprint").distinct().withColumn("_old", F.lit(True))
    return found.join(before, "fingerprint", "left").withColumn("is_new", F.col("_old").isNull()).drop("_old")


def alerts(found: DataFrame) -> DataFrame:
    urgent = (F.col("bucket") == "review") & (C.severity_of(F.col("kind")) == "CRITICAL")
    return found.where(((F.col("bucket") == "confirmed") & F.col("is_new")) | urgent)
