"""What a scan may do and how its claims are checked: technique permits, addresses, recorded provider answers, contacts, recall."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from glint.functions import columns as C
from glint.operators import hosts as H
from glint.operators.surface import emails, normalise, rank_contacts

CONTACT_PAGES = 6
# Blocks that are shared or multicast, so forbidden but not private.
NOT_PRIVATE = ("100.64.0.0/10", "224.0.0.0/4")
LAB_NAMES = ("localhost", "localhost.localdomain")


def private_v4(address: Column) -> Column:
    """A private, local or reserved IPv4 address; null or anything else isn't one."""
    n, out = C.ipv4_number(address), F.lit(False)
    for block in C.FORBIDDEN_V4:
        if block not in NOT_PRIVATE:
            out = out | n.between(*C.cidr_bounds(block))
    return F.coalesce(out, F.lit(False))


@F.pandas_udf(BooleanType())
def _forbidden_v6(address: pd.Series) -> pd.Series:
    import ipaddress

    shared = ipaddress.ip_network("100.64.0.0/10")

    def one(text: str | None) -> bool:
        try:
            ip = ipaddress.IPv6Address(text)
        except ValueError:
            return True
        public = not (ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_reserved or ip.is_multicast or ip.is_unspecified)
        return not public or (ip.ipv4_mapped is not None and ip.ipv4_mapped in shared)

    return address.map(one)


def is_forbidden(address: Column) -> Column:
    """Not a public address of either family; what is no address counts as forbidden."""
    six = F.coalesce(address.contains(":"), F.lit(False))
    return F.when(six, _forbidden_v6(F.when(six, address).otherwise("::"))).otherwise(F.coalesce(C.is_forbidden_v4(address), F.lit(True)))


def pinned_addresses(addresses: DataFrame) -> DataFrame:
    """host, pinned (all its addresses in order, null unless each is public), refused (the first that isn't, null if none).

    ``addresses``: host, address. A host with any address that isn't public, or without an address, gets none to use.
    """
    bad = F.col("address").isNotNull() & is_forbidden(F.col("address"))
    d = addresses.withColumn("_bad", bad).groupBy("host").agg(F.array_sort(F.collect_set("address")).alias("_all"), F.min(F.when(F.col("_bad"), F.col("address"))).alias("refused"))
    return d.select("host", F.when(F.col("refused").isNull() & (F.size("_all") > 0), F.col("_all")).alias("pinned"), "refused")


def target_class(targets: DataFrame, addresses: DataFrame) -> DataFrame:
    """host, ip_class of each target (host): public, private (any of its addresses is) or unresolved."""
    got = addresses.where("address is not null").groupBy("host").agg(F.bool_or(private_v4(F.col("address")) | (F.col("address").contains(":") & is_forbidden(F.col("address")))).alias("_private"))
    kind = F.when(F.col("_private").isNull(), "unresolved").when(F.col("_private"), "private").otherwise("public")
    return targets.select("host").distinct().join(got, "host", "left").select("host", kind.alias("ip_class"))


def enforce(requests: DataFrame, grants: DataFrame, today: str, allow_private: bool = False, require: bool = True) -> DataFrame:
    """``requests`` (host, deep, verify) with allowed, reason, engagement_id.

    A grant (as ``hosts.authorize`` takes it, with permit_deep_scan and permit_verification) covers a host, but a
    technique only where it says so; a null permit is none. With ``allow_private``, private addresses and the local
    host need no grant.
    """
    none = F.lit(None).cast("string")
    if not require:
        return requests.withColumns({"allowed": F.lit(True), "reason": F.lit("not required"), "engagement_id": none})
    permits = grants.groupBy("engagement_id").agg(*(F.bool_and(F.coalesce(c, F.lit(False))).alias(f"_{c}") for c in ("permit_deep_scan", "permit_verification")))
    decided = H.authorize(requests, grants, today).select("host", "reason", "engagement_id").join(permits, "engagement_id", "left")
    wants = lambda c: F.coalesce(F.col(c), F.lit(False))
    lab = F.lit(allow_private) & F.coalesce(F.lower("host").isin(*LAB_NAMES) | private_v4(F.col("host")), F.lit(False))
    reason = F.coalesce(F.col("reason"), F.lit("no authorization"))
    reason = (
        F.when(lab, "lab target").when(reason != "allowed", reason)
        .when(wants("deep") & ~wants("_permit_deep_scan"), "deep scan not permitted")
        .when(wants("verify") & ~wants("_permit_verification"), "verification not permitted").otherwise("allowed")
    )
    d = requests.join(decided, "host", "left").withColumn("_why", reason)
    return d.select(*(F.col(c) for c in requests.columns), F.col("_why").isin("allowed", "lab target").alias("allowed"), F.col("_why").alias("reason"), F.when(~lab, F.col("engagement_id")).alias("engagement_id"))


def provider_outcome(responses: DataFrame) -> DataFrame:
    """``responses`` (provider, status_code, body: JSON) recorded elsewhere, with active and detail.

    Active needs status 200 and, of six providers, what the body says; the detail joins what identifies the account.
    """
    at = lambda path: F.get_json_object("body", f"$.{path}")
    true = lambda c: F.coalesce(~c.isin("false", "0", "", "[]", "{}"), F.lit(False))
    says = lambda label, c: F.when(c != "", F.concat(F.lit(label), c))
    p = F.lower("provider")
    viewer = F.coalesce(at("data.viewer.email"), at("data.viewer.name"))
    acls = F.size(F.from_json(at("acls"), "array<string>"))
    ok = (
        F.when(p.isin("slack", "telegram"), true(at("ok")))
        .when(p == "cloudflare", true(at("success")) & (F.coalesce(at("result.status"), F.lit("active")) == "active"))
        .when(p == "datadog", true(at("valid"))).when(p == "linear", true(at("data.viewer")))
        .when(p == "xai", ~true(at("api_key_blocked")) & ~true(at("api_key_disabled"))).otherwise(True)
    )
    parts = {
        "slack": (says("Slack ", at("team")), says("as ", at("user"))),
        "telegram": (says("Telegram bot @", at("result.username")),),
        "digitalocean": (says("DigitalOcean ", at("account.email")),),
        "notion": (says("Notion ", at("name")),),
        "linear": (says("Linear ", viewer),),
        "xai": (F.lit("xAI"), says("key: ", at("name")), F.when(acls > 0, F.concat(acls.cast("string"), F.lit(" ACL(s)")))),
    }
    detail = F.lit("")
    for name, words in parts.items():
        detail = F.when(p == name, F.concat_ws(" · ", *words)).otherwise(detail)
    active = F.coalesce((F.col("status_code") == 200) & ok, F.lit(False))
    return responses.withColumns({"active": active, "detail": F.when(active, detail).otherwise("")})


def verified_contacts(domains: DataFrame, pages: DataFrame, most: int | None = CONTACT_PAGES) -> DataFrame:
    """domain, email, score, ambiguous, source_url, n_pages, note of each domain (domain).

    ``pages``: domain, url, place (the order in which they were asked for), body (null: not fetched). The best ranked
    address of the first ``most`` fetched pages, and the first page in which it stands; without one, why.
    """
    p = pages.where("body != ''").select("domain", "url", "place", "body")
    p = p.withColumn("_n", F.row_number().over(Window.partitionBy("domain").orderBy("place", "url")))
    p = p if most is None else p.where(F.col("_n") <= most)
    best = rank_contacts(emails(p, F.col("body"), "domain"), "domain", F.col("domain")).where("place = 1").select("domain", "email", "score", "ambiguous")
    text = p.select("domain", F.struct("_n", "url").alias("_at"), normalise(F.col("body")).alias("_t"))
    cited = best.join(text, "domain").where(F.col("_t").contains(F.col("email"))).groupBy("domain").agg(F.min("_at").alias("_at"))
    d = domains.select("domain").distinct().join(p.groupBy("domain").agg(F.count("*").alias("n_pages")), "domain", "left")
    d = d.join(best, "domain", "left").join(cited, "domain", "left")
    note = F.when(F.col("n_pages").isNull(), "no page").when(F.col("email").isNull(), "no address").when(F.col("_at").isNull(), "not grounded").when(F.col("ambiguous"), "scored closely").otherwise("")
    return d.select("domain", "email", "score", "ambiguous", F.col("_at.url").alias("source_url"), F.coalesce("n_pages", F.lit(0)).alias("n_pages"), note.alias("note"))


def external_recall(specimens: DataFrame, found: DataFrame, detectors: DataFrame, alias: dict[str, str] | None = None) -> DataFrame:
    """provider, rule, outcome of specimens (provider, rule, value): detected, in-scope miss or no detector.

    ``found``: the rules (rule) with a finding; ``detectors``: the names (kind). A provider is covered where a name
    holds it, blanks aside. Providers are compared with the names once each, not for each specimen.
    """
    known = F.lower("provider")
    for a, b in (alias or {"gcp": "google", "googlecloud": "google"}).items():
        known = F.when(F.lower("provider") == a, b).otherwise(known)
    names = detectors.agg(F.collect_set(F.lower("kind")).alias("_names"))  # one row, of the registry's size
    providers = specimens.select("provider").distinct().join(F.broadcast(names))
    has = F.exists("_names", lambda n: n.contains(known) | F.replace(n, F.lit(" "), F.lit("")).contains(known))
    providers = providers.select(F.col("provider").alias("_p"), has.alias("_has"))
    hit = found.select(F.col("rule").alias("_r")).distinct().withColumn("_hit", F.lit(True))
    d = specimens.join(hit, F.col("rule") == F.col("_r"), "left").join(providers, F.col("provider").eqNullSafe(F.col("_p")), "left")
    return d.select("provider", "rule", F.when(F.col("_hit"), "detected").when(F.col("_has"), "in-scope miss").otherwise("no detector").alias("outcome"))


def ground_truth(planted: DataFrame, found: DataFrame) -> DataFrame:
    """One row: tp, mistyped, missed, fp, precision, recall, f1 of planted (kind, value) against found (kind, value).

    Values are compared as they are or as findings shorten them. A value under another kind is no hit, but no false
    one either; recall counts it as missed.
    """
    f = found.select("kind", "value").distinct()
    p = planted.select("kind", "value", F.monotonically_increasing_id().alias("_id"))
    p = p.select("kind", "_id", F.explode(F.array_distinct(F.array("value", C.cap_raw(F.col("value"))))).alias("value"))
    got = p.join(f.groupBy("value").agg(F.collect_set("kind").alias("_kinds")), "value", "left")
    hit, any_kind = F.coalesce(F.array_contains("_kinds", F.col("kind")), F.lit(False)), F.col("_kinds").isNotNull()
    each = got.groupBy("_id").agg(F.bool_or(hit).alias("h"), F.bool_or(any_kind).alias("a"))
    n = each.agg(F.count_if("h").alias("tp"), F.count_if(~F.col("h") & F.col("a")).alias("mistyped"), F.count_if(~F.col("a")).alias("missed"))
    n = n.join(f.join(p.select("value"), "value", "left_anti").agg(F.count("*").alias("fp")))  # one row each
    rate = lambda b: F.when(b == 0, 1.0).otherwise(F.try_divide(F.col("tp"), b))
    n = n.withColumns({"_p": rate(F.col("tp") + F.col("fp")), "_r": rate(F.col("tp") + F.col("mistyped") + F.col("missed"))})
    f1 = F.coalesce(F.try_divide(2 * F.col("_p") * F.col("_r"), F.col("_p") + F.col("_r")), F.lit(0.0))
    return n.select("tp", "mistyped", "missed", "fp", F.round("_p", 4).alias("precision"), F.round("_r", 4).alias("recall"), F.round(f1, 4).alias("f1"))
