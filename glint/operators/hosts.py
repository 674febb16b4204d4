"""Hosts and responses: header posture, takeover signatures, address classes, scope and authorization, robots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glint.functions import columns as C

# Name, severity, weakness class of each check.
CHECKS = {
    "hsts": ("Missing HSTS", "MEDIUM", "CWE-319"),
    "csp": ("Missing Content-Security-Policy", "MEDIUM", "CWE-693"),
    "sniff": ("Missing X-Content-Type-Options: nosniff", "LOW", "CWE-693"),
    "frame": ("No clickjacking protection", "MEDIUM", "CWE-1021"),
    "referrer": ("Missing Referrer-Policy", "LOW", "CWE-200"),
    "permissions": ("Missing Permissions-Policy", "LOW", "CWE-693"),
    "server": ("Version disclosure via server", "LOW", "CWE-200"),
    "x-powered-by": ("Version disclosure via x-powered-by", "LOW", "CWE-200"),
    "x-aspnet-version": ("Version disclosure via x-aspnet-version", "LOW", "CWE-200"),
    "secure": ("Cookie without Secure flag", "MEDIUM", "CWE-614"),
    "httponly": ("Cookie without HttpOnly flag", "LOW", "CWE-1004"),
}
# Service, severity, markers in its names, markers in its pages.
TAKEOVERS = (
    ("GitHub Pages", "HIGH", ("github.io",), ("There isn't a GitHub Pages site here.",)),
    ("AWS S3", "CRITICAL", ("amazonaws.com", "s3"), ("NoSuchBucket", "The specified bucket does not exist")),
    ("Heroku", "HIGH", ("herokudns.com", "herokuapp.com", "herokussl.com"), ("No such app", "herokucdn.com/error-pages/no-such-app.html")),
    ("Netlify", "HIGH", ("netlify.app", "netlify.com"), ("Not Found - Request ID",)),
    ("Shopify", "HIGH", ("myshopify.com",), ("Sorry, this shop is currently unavailable",)),
    ("Fastly", "HIGH", ("fastly.net",), ("Fastly error: unknown domain",)),
    ("Zendesk", "HIGH", ("zendesk.com",), ("Help Center Closed",)),
    ("Surge.sh", "HIGH", ("surge.sh",), ("project not found",)),
    ("Bitbucket", "HIGH", ("bitbucket.io",), ("Repository not found",)),
    ("Ghost", "HIGH", ("ghost.io",), ("The thing you were looking for is no longer here",)),
    ("Pantheon", "HIGH", ("pantheonsite.io",), ("The gods are wise, but do not know of the site which you seek.",)),
    ("Tumblr", "HIGH", ("domains.tumblr.com",), ("Whatever you were looking for doesn't currently exist at this address.",)),
    ("Wordpress", "MEDIUM", ("wordpress.com",), ("Do you want to register",)),
    ("Readme.io", "HIGH", ("readme.io",), ("Project doesnt exist... yet!",)),
    ("Cargo", "HIGH", ("cargocollective.com",), ("If you're moving your domain away from Cargo",)),
    ("Webflow", "MEDIUM", ("proxy-ssl.webflow.com", "proxy.webflow.com"), ("The page you are looking for doesn't exist or has been moved.",)),
)


def posture(responses: DataFrame) -> DataFrame:
    """A row for each weakness of responses (headers map<string,string>, final_url): name, severity, cwe, evidence."""
    d = responses.withColumn("_h", F.transform_keys("headers", lambda k, v: F.lower(k)))
    get = lambda k: F.coalesce(F.try_element_at("_h", F.lit(k)), F.lit(""))
    absent = lambda k: ~F.coalesce(F.map_contains_key("_h", k), F.lit(False))
    https = F.lower("final_url").startswith("https://")
    version = lambda k: get(k).rlike(r"\d+\.\d+|/\s*\d")
    cookie = F.lower(get("set-cookie"))
    rules = {
        "hsts": (https & absent("strict-transport-security"), F.lit("header absent")),
        "csp": (get("content-security-policy") == "", F.lit("header absent")),
        "sniff": (F.lower(get("x-content-type-options")) != "nosniff", F.concat(F.lit("value: "), get("x-content-type-options"))),
        "frame": ((get("x-frame-options") == "") & ~F.lower(get("content-security-policy")).contains("frame-ancestors"), F.lit("neither header")),
        "referrer": (absent("referrer-policy"), F.lit("header absent")),
        "permissions": (absent("permissions-policy"), F.lit("header absent")),
        **{k: (version(k), F.concat(F.lit(f"{k}: "), get(k))) for k in ("server", "x-powered-by", "x-aspnet-version")},
        "secure": (https & (cookie != "") & ~cookie.contains("secure"), F.lit("attribute absent")),
        "httponly": ((cookie != "") & ~cookie.contains("httponly"), F.lit("attribute absent")),
    }
    made = [F.when(c, F.struct(*(F.lit(x).alias(n) for x, n in zip(CHECKS[k], ("name", "severity", "cwe"), strict=True)), e.alias("evidence"))) for k, (c, e) in rules.items()]
    return d.select(*responses.columns, F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("_f")).select(*responses.columns, "_f.*")


def group_posture(found: DataFrame, host: str = "host") -> DataFrame:
    """A row for each weakness: its hosts in order, and the evidence if it is the same for all."""
    d = found.groupBy("name", "severity", "cwe").agg(F.array_sort(F.collect_set(host)).alias("hosts"), F.min("evidence").alias("_a"), F.max("evidence").alias("_b"))
    return d.select("name", "severity", "cwe", "hosts", F.size("hosts").cast("long").alias("n_hosts"), F.when(F.col("_a") == F.col("_b"), F.col("_a")).alias("evidence"))


def takeovers(hosts: DataFrame) -> DataFrame:
    """Hosts (host, cnames array, body) that show an unclaimed service: service, severity, cname of the first that fits."""
    out = F.lit(None).cast("struct<service:string,severity:string,cname:string>")
    for service, severity, names, marks in reversed(TAKEOVERS):
        shown = F.lit(False)
        for m in marks:
            shown = shown | F.coalesce(F.col("body"), F.lit("")).contains(m)
        hit = F.get(F.filter("cnames", _has_any(names)), 0)
        fits = shown & ((F.coalesce(F.size("cnames"), F.lit(0)) <= 0) | hit.isNotNull())
        out = F.when(fits, F.struct(F.lit(service).alias("service"), F.lit(severity).alias("severity"), F.coalesce(hit, F.lit("")).alias("cname"))).otherwise(out)
    return hosts.withColumn("_t", out).where("_t is not null").select("host", "_t.*")


def _has_any(names: tuple[str, ...]):
    def test(c: Column) -> Column:
        out = F.lit(False)
        for n in names:
            out = out | c.contains(n)
        return out

    return test


def public_hosts(addresses: DataFrame) -> DataFrame:
    """host, public: all its addresses (host, address) are public IPv4; a host without any isn't."""
    ok = F.bool_and(~C.is_forbidden_v4(F.col("address")))
    return addresses.groupBy("host").agg(F.coalesce(ok, F.lit(False)).alias("public"), F.count("address").alias("addresses"))


def host_matches(host: Column, pattern: Column) -> Column:
    """The pattern is the host, *.base above it (not base itself), or a block of IPv4 addresses that it is in.

    Letters' case, white space around, and dots at the end of either don't matter; empty ones match nothing.
    """
    host, pattern = (F.lower(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"\.+$", "")) for c in (host, pattern))
    block = pattern.rlike(r"\A\d{1,3}(\.\d{1,3}){3}/\d{1,2}\z")
    bits = F.least(F.coalesce(F.try_element_at(F.split(pattern, "/"), F.lit(2)).try_cast("int"), F.lit(32)), F.lit(32))
    size = F.pow(F.lit(2.0), 32 - bits).cast("bigint")
    at = lambda c: F.floor(C.ipv4_number(c) / size)
    inside = F.coalesce(at(host) == at(F.split(pattern, "/")[0]), F.lit(False))
    below = host.endswith(F.substring(pattern, F.lit(2), F.length(pattern))) & (F.length(pattern) > 2)
    return (host != "") & F.when(block, inside).when(pattern.startswith("*."), below).otherwise(host == pattern)


def _plain(c: Column) -> Column:
    """A host or pattern as it is compared: lower case, without white space around and dots at its end."""
    return F.lower(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"\.+$", ""))


def _block(address: Column, bits: Column) -> Column:
    """A name for the block of so many bits that the address is in."""
    return F.concat(F.floor(C.ipv4_number(address) / F.pow(F.lit(2.0), 32 - bits).cast("bigint")), F.lit("/"), bits)


def pattern_key(pattern: Column) -> Column:
    """What a pattern is joined by: its block of addresses, else itself."""
    p = _plain(pattern)
    block = p.rlike(r"\A\d{1,3}(\.\d{1,3}){3}/\d{1,2}\z")
    bits = F.least(F.try_element_at(F.split(p, "/"), F.lit(2)).try_cast("int"), F.lit(32))
    return F.when(block, _block(F.split(p, "/")[0], bits)).otherwise(p)


def host_keys(host: Column) -> Column:
    """The keys of all patterns that a host matches: itself, *. with each part above it, and its blocks of addresses."""
    h = _plain(host)
    labels = F.split(h, r"\.")
    n = F.size(labels)
    above = F.when(n > 1, F.transform(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), lambda i: F.concat(F.lit("*."), F.array_join(F.slice(labels, i, n), "."))))
    blocks = F.when(C.ipv4_number(h).isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(32)), lambda b: _block(h, b)))
    none = F.array().cast("array<string>")
    return F.when(h == "", none).otherwise(F.array_distinct(F.concat(F.array(h), F.coalesce(above, none), F.coalesce(blocks, none))))


def authorize(targets: DataFrame, grants: DataFrame, today: str) -> DataFrame:
    """Each target (host) with the decision of the best grant: host, allowed, reason, engagement_id.

    ``grants``: engagement_id, scope and exclusions (arrays), status, starts_at and expires_at (dates, both inclusive)
    and, if there, created_at. An exclusion of any grant beats what another allows; a grant whose scope fits but that
    isn't in force comes next; of equals the latest made, then the least id. Hosts meet patterns by equal keys.
    """
    day = F.lit(today).cast("date")
    made = F.col("created_at").cast("timestamp") if "created_at" in grants.columns else F.lit(None).cast("timestamp")
    grants = grants.withColumns({"_made": F.coalesce(F.unix_micros(made), F.lit(0)), "_grant": F.struct("engagement_id", "status", "starts_at", "expires_at")})
    listed = lambda c, out: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda p: F.struct(pattern_key(p).alias("key"), F.lit(out).alias("out")))
    patterns = grants.select("_grant", "_made", F.explode(F.concat(listed(F.col("scope").cast("array<string>"), False), listed(F.col("exclusions").cast("array<string>"), True))).alias("_p"))
    patterns = patterns.select("_grant", "_made", "_p.key", "_p.out").where("key != ''").distinct()
    out = targets.select("host").distinct()
    j = out.select("host", F.explode(host_keys(F.col("host"))).alias("key")).join(patterns, "key")
    j = j.withColumn(
        "reason",
        F.when(F.col("out"), "excluded")
        .when(~F.col("_grant.status").eqNullSafe(F.lit("active")), "not active")
        .when(day < F.col("_grant.starts_at"), "not yet valid")
        .when(day > F.col("_grant.expires_at"), "expired")
        .otherwise("allowed"),
    )
    rank = F.when(F.col("out"), 0).when(F.col("reason") == "allowed", 1).otherwise(2)
    best = F.min(F.struct(rank.alias("r"), (-F.col("_made")).alias("m"), F.col("_grant.engagement_id").alias("engagement_id"), F.col("reason"))).alias("b")
    d = out.join(j.groupBy("host").agg(best), "host", "left")
    reason = F.coalesce("b.reason", F.lit("no authorization"))
    return d.select("host", (reason == "allowed").alias("allowed"), reason.alias("reason"), "b.engagement_id")


def robots_groups(lines: DataFrame, key: str = "site") -> DataFrame:
    """Rules of robots files from rows (site, line_no, line): site, agent, field, path.

    A run of user-agent lines opens a group; the rules up to the next run are all its agents'.
    """
    d = lines.withColumn("_t", F.trim(F.regexp_replace("line", "#.*$", "")))
    d = d.withColumns({"_f": F.lower(F.trim(F.split("_t", ":", 2)[0])), "_v": F.trim(F.get(F.split("_t", ":", 2), 1))}).where("_t like '%:%' and _f in ('user-agent', 'allow', 'disallow', 'crawl-delay')")
    w = Window.partitionBy(key).orderBy("line_no")
    opens = (F.col("_f") == "user-agent") & (F.coalesce(F.lag("_f").over(w), F.lit("")) != "user-agent")
    d = d.withColumn("_o", opens.cast("int")).withColumn("_g", F.sum("_o").over(w)).where("_g > 0")
    agents = d.where("_f = 'user-agent'").select(key, "_g", F.lower("_v").alias("agent")).distinct()
    rules = d.where("_f <> 'user-agent'").select(key, "_g", "line_no", F.col("_f").alias("field"), F.col("_v").alias("path"))
    return agents.join(rules, [key, "_g"]).select(key, "agent", "field", "path", "line_no")


def root_blocked(groups: DataFrame, key: str = "site") -> DataFrame:
    """site, agent, blocked: disallows / and doesn't allow it."""
    has = lambda f: F.coalesce(F.bool_or((F.col("field") == f) & (F.col("path") == "/")), F.lit(False))
    return groups.groupBy(key, "agent").agg((has("disallow") & ~has("allow")).alias("blocked"))


def follow_redirects(edges: DataFrame, starts: DataFrame, most: int = 5) -> DataFrame:
    """start, url, hops: where each start ends after at most ``most`` redirects (from_url, to_url) within its scope."""
    here = starts.select(F.col("url").alias("start"), F.col("url"), F.lit(0).alias("hops"))
    ends = None
    for _ in range(most):
        step = here.join(edges.select(F.col("from_url").alias("url"), "to_url"), "url", "left")
        ok = F.col("to_url").isNotNull() & C.same_scope(C.host_of(F.col("to_url")), C.host_of(F.col("start")))
        done = step.where(~ok).select("start", "url", "hops")
        ends = done if ends is None else ends.unionByName(done)
        here = step.where(ok).select("start", F.col("to_url").alias("url"), (F.col("hops") + 1).alias("hops"))
    return ends.unionByName(here) if ends is not None else here
