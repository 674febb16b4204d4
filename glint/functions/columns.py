"""Column expressions: entropy, masking, fingerprints, hosts, positions of matches. All run in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from glint.functions.registry import BY_NAME, DEFAULT_CWE, DEFAULT_SEVERITY, EXAMPLE_VALUES, PLACEHOLDER, PLACEHOLDER_NEEDLES

#: Python's meaning of \b \s \w \d and of the dot.
UNICODE = "(?Ud)"


def rx(pattern: str | Column) -> Column:
    return F.lit(UNICODE + pattern) if isinstance(pattern, str) else F.concat(F.lit(UNICODE), pattern)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it stands there."""
    return F.get(F.transform(F.array(value), use), 0)


def entropy(value: Column) -> Column:
    """Bits a character, to four digits; 0 for an empty value."""

    def total(v: Column, n: Column) -> Column:
        shares = F.transform(F.array_distinct(F.split(v, "")), lambda c: (n - F.length(F.replace(v, c, F.lit("")))) / n)
        return F.round(F.aggregate(shares, F.lit(0.0), lambda acc, p: acc + -p * F.log2(p)), 4)

    return bound(value, lambda v: F.when(F.length(v) > 0, bound(F.length(v).cast("double"), lambda n: total(v, n))).otherwise(F.lit(0.0)))


def is_placeholder(value: Column) -> Column:
    """The pattern is tried only where one of its needles stands, or what isn't ASCII, whose cases fold otherwise."""
    low, likely = F.lower(value), F.octet_length(value) != F.length(value)
    for n in PLACEHOLDER_NEEDLES:
        likely = likely | low.contains(n)
    return value.isin(*EXAMPLE_VALUES) | (likely & value.rlike(UNICODE + PLACEHOLDER))


def fingerprint(kind: Column, url: Column, value: Column) -> Column:
    """16 hex digits; nulls count as empty."""
    text = F.concat(*[x for c in (kind, url, value) for x in (F.coalesce(c, F.lit("")), F.lit("|"))][:-1])
    return F.substring(F.sha2(text, 256), 1, 16)


def cap_raw(value: Column) -> Column:
    """Values over 80 characters: their first 75, an ellipsis and their last 4."""
    return F.when(F.length(value) <= 80, value).otherwise(F.concat(F.substring(value, 1, 75), F.lit("…"), F.right(value, F.lit(4))))


def mask(value: Column) -> Column:
    """For reports: first 6, six stars, last 4 and the length; stars alone up to 12 characters."""
    n = F.length(value)
    shown = F.concat(F.substring(value, 1, 6), F.lit("…"), F.repeat(F.lit("*"), 6), F.lit("…"), F.right(value, F.lit(4)), F.lit("  ("), n.cast("string"), F.lit(" chars)"))
    return F.when(n <= 12, F.repeat(F.lit("*"), n)).otherwise(shown)


def redact(value: Column) -> Column:
    """For logs: at most six leading characters (a quarter of the value), then stars; stars alone up to 8 characters."""
    n = F.length(value)
    keep = F.when(n <= 8, 0).otherwise(F.least(F.lit(6), F.floor(n / 4))).cast("int")
    return F.concat(F.substring(value, F.lit(1), keep), F.repeat(F.lit("*"), (n - keep).cast("int")))


def redact_snippet(snippet: Column, value: Column) -> Column:
    return F.when(F.length(value) > 0, F.replace(snippet, value, redact(value))).otherwise(snippet)


def severity_of(kind: Column) -> Column:
    return _lookup(kind, {k: d.severity for k, d in BY_NAME.items()}, DEFAULT_SEVERITY)


def cwe_of(kind: Column) -> Column:
    return _lookup(kind, {k: d.cwe for k, d in BY_NAME.items()}, DEFAULT_CWE)


def _lookup(key: Column, values: dict[str, str], default: str) -> Column:
    groups: dict[str, list[str]] = {}
    for k, v in values.items():
        groups.setdefault(v, []).append(k)
    out = F.lit(default)
    for v, keys in groups.items():
        if v != default:
            out = F.when(key.isin(keys), v).otherwise(out)
    return out


def report_rank(severity: Column) -> Column:
    """Order in reports: what isn't known counts as medium."""
    up = F.upper(severity)
    return F.when(up == "CRITICAL", 0).when(up == "HIGH", 1).when(up == "LOW", 3).otherwise(2)


def watch_rank(severity: Column) -> Column:
    """Order in change digests: what isn't known comes last."""
    low, out = F.lower(severity), F.lit(5)
    for i, s in enumerate(("critical", "high", "medium", "low", "info")):
        out = F.when(low == s, i).otherwise(out)
    return out


def spans(text: Column, pattern: str | Column, group: int = 0) -> Column:
    """array<struct<start,end,value>> of all matches, offsets from 0. The pattern must not match emptiness.

    ``group`` 1 is found inside its match, at the first place where its text stands.
    """
    whole = F.regexp_extract_all(text, rx(pattern), F.lit(0))
    got = F.regexp_extract_all(text, rx(pattern), F.lit(group)) if group else whole
    gaps = F.split(text, rx(pattern), -1)
    zipped = F.arrays_zip(whole.alias("m"), got.alias("g"), F.slice(gaps, F.lit(1), F.size(whole)).alias("b"))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["b"])
        inner = begin + (F.instr(x["m"], x["g"]) - 1 if group else F.lit(0))
        made = F.struct(inner.cast("int").alias("start"), (inner + F.length(x["g"])).cast("int").alias("end"), x["g"].alias("value"))
        return F.struct((begin + F.length(x["m"])).alias("at"), F.concat(acc["out"], F.array(made)).alias("out"))

    return F.when(text.isNotNull(), F.aggregate(zipped, start, step, lambda acc: acc["out"]))


def context(text: Column, start: Column, end: Column, width: int = 120) -> Column:
    """What stands around a match, on one line."""
    lo = F.greatest(start - width, F.lit(0))
    cut = F.substring(text, (lo + 1).cast("int"), (end + width - lo).cast("int"))
    return F.regexp_replace(F.replace(cut, F.lit("\n"), F.lit(" ")), r"(?U)^\s+|\s+$", "")


# Suffixes of two labels under which names are registered.
TWO_LABEL_SUFFIXES = (
    "co.uk", "org.uk", "gov.uk", "ac.uk", "me.uk", "net.uk", "sch.uk", "com.au", "net.au", "org.au",
    "edu.au", "gov.au", "co.nz", "net.nz", "org.nz", "govt.nz", "com.bd", "net.bd", "org.bd", "edu.bd",
    "gov.bd", "ac.bd", "mil.bd", "co.in", "net.in", "org.in", "gen.in", "firm.in", "ind.in", "com.br",
    "net.br", "org.br", "gov.br", "com.sg", "com.my", "com.pk", "com.np", "com.lk", "com.cn", "com.hk",
    "co.jp", "or.jp", "ne.jp", "co.kr", "co.za", "co.id", "co.th",
)


def host_of(url: Column) -> Column:
    """Lower-case host, without port; null where there is none."""
    h = F.lower(F.try_parse_url(F.when(url.contains("://"), url).otherwise(F.concat(F.lit("http://"), url)), F.lit("HOST")))
    return F.when(F.length(h) > 0, F.regexp_replace(h, r"\.+$", ""))


def valid_host(host: Column) -> Column:
    return host.rlike(r"\A[a-z0-9.-]{3,255}\z") & host.contains(".") & ~host.rlike(r"\A\.|\.\.|\.\z")


def is_ip(host: Column) -> Column:
    return host.rlike(r"\A\d{1,3}(\.\d{1,3}){3}\z") | host.contains(":")


def registrable_domain(host: Column) -> Column:
    """The last two labels, or three under a suffix of two; null for addresses and single labels."""
    h = F.regexp_replace(F.lower(F.trim(host)), r"\.+$", "")
    parts = F.split(h, r"\.")
    last = lambda n: F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), F.lit(n)), ".")
    return F.when(~is_ip(h) & (F.size(parts) >= 2), F.when(last(2).isin(*TWO_LABEL_SUFFIXES) & (F.size(parts) >= 3), last(3)).otherwise(last(2)))


def site_domain(host: Column) -> Column:
    """Another rule, for contacts: a known second-level label under a country code takes three labels."""
    parts = F.filter(F.split(F.lower(F.regexp_replace(F.trim(host), r"\.+$", "")), r"\."), lambda x: x != "")
    last = lambda n: F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), F.lit(n)), ".")
    second = F.get(parts, F.size(parts) - 2).isin("co", "com", "net", "org", "gov", "edu", "ac", "or", "ne")
    return F.when((F.size(parts) > 2) & second & (F.length(F.get(parts, F.size(parts) - 1)) == 2), last(3)).otherwise(last(2))


def same_scope(host: Column, base: Column) -> Column:
    """Equal to the base without its www., or below it."""
    root = F.regexp_replace(F.lower(base), r"^www\.", "")
    return (host == root) | host.endswith(F.concat(F.lit("."), root))


def ipv4_number(address: Column) -> Column:
    p = F.split(address, r"\.")
    part = lambda i: F.try_element_at(p, F.lit(i + 1)).try_cast("bigint")
    ok = address.rlike(r"\A\d{1,3}(\.\d{1,3}){3}\z")
    n = part(0) * 16777216 + part(1) * 65536 + part(2) * 256 + part(3)
    return F.when(ok & (F.greatest(*(part(i) for i in range(4))) <= 255), n)


# Address blocks that a public service doesn't have.
FORBIDDEN_V4 = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24",
    "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
)


def cidr_bounds(block: str) -> tuple[int, int]:
    base, bits = block.split("/")
    n = sum(int(x) << (24 - 8 * i) for i, x in enumerate(base.split(".")))
    return n, n + (1 << (32 - int(bits))) - 1


def is_forbidden_v4(address: Column) -> Column:
    """Private, local, reserved, multicast or shared; what is no IPv4 address counts as forbidden."""
    n, out = ipv4_number(address), F.lit(False)
    for b in FORBIDDEN_V4:
        lo, hi = cidr_bounds(b)
        out = out | n.between(lo, hi)
    return F.when(n.isNull(), True).otherwise(out)
