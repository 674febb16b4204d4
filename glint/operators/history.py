"""Scans over time: previous scan, what is new, resolved or recurring, retention, roll-ups by host and domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glint.functions import columns as C

# Fixed value: a scan that covers less than this share of the one before can't say that something is resolved.
LEAST_COVERAGE = 0.5
KEEP_SCANS = 1000


def previous_scan(scans: DataFrame) -> DataFrame:
    """Each scan with the scan_id of the latest complete scan of its target before it (null: none)."""
    w = Window.partitionBy("target_url").orderBy("created_at", "scan_id").rowsBetween(Window.unboundedPreceding, -1)
    done = F.when(F.col("status") == "complete", F.struct("created_at", "scan_id"))
    return scans.withColumn("previous_id", F.max(done).over(w)["scan_id"])


def coverage(scan: DataFrame) -> Column:
    """Assets scanned, else fetched, else 0."""
    return F.when(F.col("assets_scanned") > 0, F.col("assets_scanned")).when(F.col("assets_fetched") > 0, F.col("assets_fetched")).otherwise(0)


def delta(current: DataFrame, previous: DataFrame, by: str = "target_url", guard: DataFrame | None = None) -> DataFrame:
    """fingerprint, change (new, recurring, resolved, unverified) of two scans' findings for each target.

    ``guard``: target, status, now and before (coverages). What has gone is resolved only if the scan ended well and
    covered enough; without a guard all targets did.
    """
    one = lambda d, side: d.where("fingerprint is not null").groupBy(by, "fingerprint").agg(F.lit(True).alias(side))
    d = one(current, "_c").join(one(previous, "_p"), [by, "fingerprint"], "full")
    if guard is not None:
        d = d.join(guard.select(by, _conclusive().alias("_ok")), by, "left")
    ok = F.coalesce("_ok", F.lit(False)) if guard is not None else F.lit(True)
    change = F.when(F.col("_p").isNull(), "new").when(F.col("_c").isNotNull(), "recurring").when(ok, "resolved").otherwise("unverified")
    return d.select(by, "fingerprint", change.alias("change"))


def tier(changes: DataFrame, by: str = "target_url", guard: DataFrame | None = None) -> DataFrame:
    """URGENT, REVIEW or ROUTINE for each target and the reasons, from rows with change, severity, verified and, if there, kind.

    ``guard``: as of ``delta``; a target whose scan failed or covered too little is REVIEW even if nothing is new or
    gone. Targets that only the guard has count too.
    """
    new = F.col("change") == "new"
    kind = F.col("kind") if "kind" in changes.columns else F.lit("unknown")
    live, grave = F.col("verified").eqNullSafe("verified"), F.lower("severity").isin("critical", "high")
    reason = F.when(new & live, F.concat(F.lit("live: "), kind)).when(new & grave, F.concat(F.lower("severity"), F.lit(": "), kind))
    count = lambda c: F.count_if(F.col("change") == c).alias(f"n_{c}")
    d = changes.groupBy(by).agg(*map(count, ("new", "resolved", "recurring", "unverified")), F.count(reason).alias("n_grave"), F.array_sort(F.collect_set(reason)).alias("_why"))
    sure = F.col("n_unverified") == 0
    if guard is not None:
        d = d.join(guard.select(by, _conclusive().alias("_ok")), by, "full").fillna(0)
        sure = sure & F.coalesce("_ok", F.lit(False))
    below = F.concat(F.col("n_new").cast("string"), F.lit(" new below the urgent bar"))
    d = d.withColumn("tier", F.when(F.col("n_grave") > 0, "URGENT").when(~sure | (F.col("n_new") > 0), "REVIEW").otherwise("ROUTINE"))
    why = F.when(F.col("n_grave") > 0, F.array_join("_why", "; ")).when(~sure, "coverage anomaly").when(F.col("n_new") > 0, below).otherwise("")
    return d.withColumn("reasons", why).drop("_why", "_ok")


def _conclusive() -> Column:
    """Whether a scan ended well and covered enough to tell what has gone."""
    return F.col("status").isin("complete", "clean") & ((F.col("before") <= 0) | (F.col("now") >= LEAST_COVERAGE * F.col("before")))


def retain(scans: DataFrame, keep: int = KEEP_SCANS) -> DataFrame:
    """The newest ``keep`` scans (0: all), without sorting all in one task."""
    return scans if keep <= 0 else scans.orderBy(F.desc("created_at"), F.desc("scan_id")).limit(keep)


def page(scans: DataFrame, size: int, offset: int) -> DataFrame:
    return scans.orderBy(F.desc("created_at"), "scan_id").offset(offset).limit(size)


def upsert(table: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """The table with rows added or replaced by key: of each key the latest."""
    both = table.unionByName(rows, allowMissingColumns=True)
    return both.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")


def cache_decision(assets: DataFrame, cache: DataFrame, skip_clean: bool = True) -> DataFrame:
    """action for each response: skip (not modified and clean last time), refetch (not modified, but not clean), scan."""
    c = cache.select(F.col("url").alias("_u"), "was_clean", F.col("content_hash").alias("_h"))
    d = assets.join(c, F.col("url") == F.col("_u"), "left")
    same = (F.col("status_code") == 304) | (F.col("content_hash") == F.col("_h"))
    skip = same & F.coalesce("was_clean", F.lit(False)) & F.lit(skip_clean)
    return d.withColumn("action", F.when(skip, "skip").when(F.col("status_code") == 304, "refetch").otherwise("scan")).drop("_u", "_h", "was_clean")


def within_budget(assets: DataFrame, limit: int, by: str = "scan_id", order: str = "ordinal", size: str = "n_chars") -> DataFrame:
    """``accepted``: taken while what came before is under the limit."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return assets.withColumn("accepted", F.coalesce(F.sum(size).over(w), F.lit(0)) < limit)


def domain_rollup(hosts: DataFrame) -> DataFrame:
    """Host rows summed by host, by domain and over all: domain, host, level, hosts, assets, confirmed, review."""
    return hosts.rollup("domain", "host").agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("scans"), F.sum("assets").alias("assets"), F.sum("confirmed").alias("confirmed"), F.sum("review").alias("review"))


def domain_verdict(hosts: DataFrame) -> DataFrame:
    """EXPOSURE, PARTIAL (fewer hosts scanned without error than live) or CLEAN for each domain."""
    d = hosts.groupBy("domain").agg(F.count_if("live").alias("live_hosts"), F.count_if(F.col("live") & F.col("error").isNull()).alias("scanned"), F.sum("confirmed").alias("confirmed"))
    return d.withColumn("verdict", F.when(F.col("confirmed") > 0, "EXPOSURE").when(F.col("scanned") < F.col("live_hosts"), "PARTIAL").otherwise("CLEAN"))


def collapse_redirects(hosts: DataFrame) -> DataFrame:
    """Live hosts (domain, host, redirect_host) without those that only lead to another live one; all, if none is left."""
    other = hosts.select("domain", F.col("host").alias("redirect_host")).distinct().withColumn("_other", F.lit(True))
    d = hosts.join(other, ["domain", "redirect_host"], "left")
    d = d.withColumn("_gone", F.coalesce("_other", F.lit(False)) & (F.col("redirect_host") != F.col("host")))
    left = F.count_if(~F.col("_gone")).over(Window.partitionBy("domain"))
    return d.withColumn("_left", left).where(~F.col("_gone") | (F.col("_left") == 0)).select(*hosts.columns)


def funnel(found: DataFrame, by: str = "scan_id") -> DataFrame:
    n = lambda c, a: F.count_if(c).alias(a)
    b = F.col("bucket")
    return found.groupBy(by).agg(F.count("*").alias("raw"), n(b == "confirmed", "confirmed"), n(b == "review", "review"), n(b == "informational", "informational"), n(b == "drop", "dropped"))


def severity_summary(found: DataFrame, by: str = "scan_id") -> DataFrame:
    """Counts of confirmed findings by severity, and the label that a report carries."""
    sev, confirmed = F.upper("severity"), F.col("bucket") == "confirmed"
    n = lambda s: F.count_if(confirmed & (sev == s)).alias(s.lower())
    d = found.groupBy(by).agg(n("CRITICAL"), n("HIGH"), n("MEDIUM"), n("LOW"), F.count_if(confirmed).alias("confirmed"), F.count_if(F.col("bucket") == "review").alias("review"))
    label = F.when(F.col("critical") > 0, "CRITICAL").when(F.col("high") > 0, "HIGH").when(F.col("medium") > 0, "MEDIUM").when(F.col("confirmed") > 0, "LOW")
    return d.withColumn("risk", label.when(F.col("review") > 0, "REVIEW REQUIRED").otherwise("CLEAN"))


def sorted_findings(found: DataFrame) -> DataFrame:
    return found.orderBy(C.report_rank(F.col("severity")), F.desc("confidence"), "kind", "fingerprint")
