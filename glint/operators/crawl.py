"""What a scan reads: pages, scripts and seeds within their bounds, outcomes of fetches, the cache, hosts, coverage.

Bounds of None take all. Ranks within a target only ever keep its first rows, which Spark cuts before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glint.functions import columns as C
from glint.operators import hosts as H
from glint.operators.surface import ABSOLUTE, strip_js_comments, url_join

PAGES, SCRIPTS, SEEDS, DEEPER, REGISTRY, CACHE_HOURS = 25, 400, 200, 50, 200, 24
ASSET_BYTES = 5 * 1024 * 1024
# How firewalls answer.
BLOCKED = (401, 403, 406, 503)


def _first(d: DataFrame, by: str, order: list[Column], most: int | None) -> DataFrame:
    """``d`` with place, a row's number by target from 1, as far as ``most``."""
    d = d.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    return d if most is None else d.where(F.col("place") <= most)


def _once(d: DataFrame, by: str, url: str, order: str) -> DataFrame:
    """Each address of a target once, where it stands first."""
    return d.where(F.col(url).isNotNull()).groupBy(by, url).agg(F.min(order).alias("_at"))


def crawl_pages(links: DataFrame, roots: DataFrame, most: int | None = PAGES, by: str = "target") -> DataFrame:
    """target, url, place: the root (target, url) and then the pages that it links to (target, from_url, to_url, ordinal)."""
    r = roots.select(by, F.col("url").alias("from_url")).distinct()
    found = links.join(r, [by, "from_url"]).where("to_url != from_url").select(by, F.col("to_url").alias("url"), "ordinal")
    found = _first(_once(found, by, "url", "ordinal"), by, [F.col("_at"), F.col("url")], None if most is None else most - 1)
    return r.select(by, F.col("from_url").alias("url"), F.lit(0).alias("place")).unionByName(found.drop("_at"))


def capped_scripts(scripts: DataFrame, most: int | None = SCRIPTS, by: str = "target") -> DataFrame:
    """target, url, place: a target's different scripts in the order of their addresses."""
    return _first(scripts.select(by, "url").where("url is not null").distinct(), by, [F.col("url")], most)


def seed_urls(seeds: DataFrame, have: DataFrame, most: int | None = SEEDS, by: str = "target") -> DataFrame:
    """target, url, place: seeds (target, url, ordinal) that the scan doesn't have yet (target, url), first come."""
    new = _once(seeds, by, "url", "ordinal").join(have.select(by, "url").distinct(), [by, "url"], "left_anti")
    return _first(new, by, [F.col("_at"), F.col("url")], most).drop("_at")


def deeper_scripts(endpoints: DataFrame, have: DataFrame, most: int | None = DEEPER, by: str = "target") -> DataFrame:
    """target, url, place: endpoints (target, url, in_scope) that are scripts of the target and not read yet, queries aside."""
    path = lambda c: F.split(c, r"\?", 2)[0]
    new = endpoints.where("in_scope").select(by, "url").distinct().withColumn("_p", path(F.col("url"))).where(F.lower("_p").endswith(".js"))
    new = new.join(have.select(by, path(F.col("url")).alias("_p")).distinct(), [by, "_p"], "left_anti").drop("_p")
    return _first(new, by, [F.col("url")], most)


def fetch_outcome(responses: DataFrame, scannable: Column, most: int = ASSET_BYTES) -> DataFrame:
    """``responses`` (status_code, n_bytes) with outcome and whether to ask again.

    Asked again: too many requests, what a firewall answers, and failures without a status. A body beyond ``most``
    bytes is cut, not left out.
    """
    s, again = F.col("status_code"), F.col("status_code").isNull() | F.col("status_code").isin(429, *BLOCKED)
    outcome = (
        F.when(s.isNull(), "failed").when(s == 304, "not modified").when(s == 429, "throttled").when(s.isin(404, 410), "gone")
        .when(s.isin(*BLOCKED), "blocked").when(~s.between(200, 299), "refused").when(~F.coalesce(scannable, F.lit(False)), "not scannable")
        .when(F.col("n_bytes") > most, "cut").otherwise("read")
    )
    return responses.withColumns({"outcome": outcome, "again": again})


def fresh_cache(cache: DataFrame, now: str, hours: int = CACHE_HOURS) -> DataFrame:
    """Cache entries that are younger than so many hours (updated_at): older ones are never trusted."""
    return cache.where(F.col("updated_at") > F.lit(now).cast("timestamp") - F.make_interval(hours=F.lit(hours)))


def coverage_counts(assets: DataFrame, by: str = "scan_id") -> DataFrame:
    """Bodies fetched, those skipped as clean and unmodified (action), and both: what a scan covers."""
    d = assets.groupBy(by).agg(F.count_if(F.col("action") != "skip").alias("assets_fetched"), F.count_if(F.col("action") == "skip").alias("assets_cached"))
    return d.withColumn("assets_scanned", F.col("assets_fetched") + F.col("assets_cached"))


def referenced_hosts(assets: DataFrame, url: str = "source_url", body: str = "body") -> DataFrame:
    """url, host: the different hosts of addresses in texts, comments left out."""
    d = assets.select(F.col(url).alias("url"), F.explode(F.regexp_extract_all(strip_js_comments(F.col(body)), F.lit(ABSOLUTE), F.lit(0))).alias("_r"))
    host = F.lower(F.regexp_extract("_r", r"//([^/:]+)", 1))
    return d.select("url", host.alias("host")).where(C.valid_host(F.col("host"))).distinct()


def associated_hosts(found: DataFrame) -> DataFrame:
    """domain, host (rows of the same): the hosts beyond the domain's own."""
    return found.where(~C.same_scope(F.col("host"), F.col("domain"))).select("domain", "host").distinct()


def candidate_hosts(typed: DataFrame, enumerated: DataFrame) -> DataFrame:
    """domain, host, place: what was typed (domain, host), the domain, then enumerated hosts (domain, host, phase, ordinal).

    Each host once, where it stands first, and only the domain's own.
    """
    first = typed.select("domain", "host", F.lit(-2).alias("phase"), F.lit(0).cast("long").alias("ordinal"))
    apex = typed.select("domain", F.col("domain").alias("host"), F.lit(-1).alias("phase"), F.lit(0).cast("long").alias("ordinal"))
    d = first.unionByName(apex).unionByName(enumerated.select("domain", "host", "phase", F.col("ordinal").cast("long").alias("ordinal")))
    d = d.where((F.col("host") == F.col("domain")) | F.col("host").endswith(F.concat(F.lit("."), "domain")))
    d = d.groupBy("domain", "host").agg(F.min(F.struct("phase", "ordinal")).alias("_at"))
    return _first(d, "domain", [F.col("_at"), F.col("host")], None).drop("_at")


# Words of the paths where contacts stand.
CONTACT_WORDS = ("contact", "about", "security", "team", "impressum", "support")


def contact_links(pages: DataFrame, url: str = "url", body: str = "html") -> DataFrame:
    """url, link, place: a page's links on its own site whose path has one of the words, first come."""
    refs = F.regexp_extract_all(F.col(body), F.lit(r"(?i)<a\b[^>]*href\s*=\s*[\"']([^\"'#]+)[\"']"), F.lit(1))
    d = pages.select(F.col(url).alias("url"), F.posexplode(refs).alias("place", "_r")).where(~F.col("_r").rlike(r"(?i)\A(mailto:|tel:|javascript:)"))
    d = d.withColumn("link", url_join(F.col("url"), F.col("_r"))).where(F.col("link").rlike(r"\Ahttps?://"))
    d = d.where(C.site_domain(C.host_of(F.col("link"))) == C.site_domain(C.host_of(F.col("url"))))
    path = F.lower(F.regexp_extract("link", r"\Ahttps?://[^/?#]*([^?#]*)", 1))
    return d.where(path.rlike("|".join(CONTACT_WORDS))).groupBy("url", "link").agg(F.min("place").alias("place"))


def first_pattern(host: Column, patterns: Column) -> Column:
    """The first of a list's patterns that the host matches, else null."""
    return F.get(F.filter(patterns, lambda p: H.host_matches(host, p)), 0)


def evicted(registry: DataFrame, most: int = REGISTRY) -> DataFrame:
    """scan_id of the oldest finished scans (scan_id, started, finished), as many as there are scans beyond ``most``."""
    beyond = max(registry.count() - most, 0)
    return registry.where("finished").orderBy("started", "scan_id").limit(beyond).select("scan_id")


def exit_codes(scans: DataFrame, fail_on_findings: bool = True) -> DataFrame:
    """``scans`` (allowed, confirmed) with exit_code: 2 without authorization, 1 with findings where they count, else 0."""
    code = F.when(~F.coalesce("allowed", F.lit(False)), 2).when(F.lit(fail_on_findings) & (F.col("confirmed") > 0), 1).otherwise(0)
    return scans.withColumn("exit_code", code)


def quoted(value: Column, safe: str = "") -> Column:
    """Percent-encoding of all but letters, digits and _ . - ~, and ``safe``."""
    out = F.url_encode(value)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), *((f"%{ord(c):02X}", c) for c in safe)):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def scrubbed(text: Column, secret: Column) -> Column:
    """The text without the secret, as it is or percent-encoded; the longest form first, so no tail of one is left."""
    out, secret = text, F.coalesce(secret, F.lit(""))
    for form in (quoted(secret), quoted(secret, "/"), secret):
        out = F.when(form == "", out).otherwise(F.replace(out, form, F.lit("[REDACTED]")))
    return out


def skipped_reason(prefix: Column, offline: Column) -> Column:
    """Why the offline tier judged a finding, and what it said."""
    return F.concat(prefix, F.lit(" Offline triage: "), offline)


def remediations(found: DataFrame, by: str = "scan_id") -> DataFrame:
    """scan_id, kind, cwe, remediation: of each kind among the confirmed the first in a report's order that has one."""
    d = found.where("bucket = 'confirmed' and remediation != ''")
    rank = F.struct(C.report_rank(F.col("severity")).alias("r"), (-F.col("confidence")).alias("c"), "fingerprint", "cwe", "remediation")
    return d.groupBy(by, "kind").agg(F.min(rank).alias("_f")).select(by, "kind", "_f.cwe", "_f.remediation")


def report_tiles(found: DataFrame, posture: DataFrame, by: str = "scan_id") -> DataFrame:
    """The numbers at a report's head: findings (bucket, severity, verified, change) and header weaknesses by scan."""
    sure = F.col("bucket") == "confirmed"
    n = lambda c, a: F.count_if(c).alias(a)
    level = [n(sure & (F.upper("severity") == s), s.lower()) for s in ("CRITICAL", "HIGH", "MEDIUM")]
    change = [n(sure & (F.col("change") == c), c) for c in ("new", "recurring")]
    d = found.groupBy(by).agg(*level, n(sure & (F.col("verified") == "verified"), "verified_active"), *change, n(F.col("bucket") == "review", "review"))
    return d.join(posture.groupBy(by).agg(F.count("*").alias("posture")), by, "full").fillna(0)


def recent_decisions(decisions: DataFrame, most: int = 50) -> DataFrame:
    """The latest decisions (decided_at, id) on targets."""
    return decisions.orderBy(F.desc("decided_at"), F.desc("id")).limit(most)


def revoke(grants: DataFrame, engagement_id: str) -> DataFrame:
    """The grants with one of them revoked."""
    return grants.withColumn("status", F.when(F.col("engagement_id") == engagement_id, "revoked").otherwise(F.col("status")))
