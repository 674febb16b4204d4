"""From asset texts to raw findings: decode views, detectors, gates, proximity rules, claims on the same value.

An asset table has source_url and body, and whatever else identifies a scan (scan_id, target_url). The plan is narrow
up to the claims: every detector is a literal pattern, run only on texts with one of its needles, and positions are
worked out only where something matched. Claims meet in one window by (source_url, value).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glint.functions import columns as C
from glint.functions.registry import DETECTORS, GENERIC, GENERIC_ENTROPY, MATCHES_PER_DETECTOR, PAIR_RULES, PAIRS_PER_RULE, STRUCTURAL_ENTROPY, Detector, PairRule

MATCH = "array<struct<kind:string,ordinal:int,start:int,end:int,value:string>>"
#: Decoded runs of base64 in a text; characters of an inline document's strings.
BLOBS, INLINE_CHARS = 200, 2 * 1024 * 1024
# The names under which pages keep their state for scripts.
STATE_NAMES = ("__NEXT_DATA__", "__NUXT__", "__INITIAL_STATE__", "__PRELOADED_STATE__", "__APOLLO_STATE__", "__remixContext")


def _matches(text: Column, low: Column, i: int, d: Detector) -> Column:
    hay = low if d.folded else text
    needle = F.lit(False)
    for n in d.needles:
        needle = needle | hay.contains(n)
    found = F.slice(F.regexp_extract_all(text, C.rx(d.pattern), F.lit(1)), 1, MATCHES_PER_DETECTOR)
    made = F.transform(found, lambda v, j: F.struct(F.lit(d.name).alias("kind"), (F.lit(i) * 1000 + j).cast("int").alias("ordinal"), v.alias("value")))
    return F.when(needle, made).otherwise(F.array())


def detect_values(texts: DataFrame, text: str = "body", detectors: tuple[Detector, ...] = DETECTORS, chunk: int = 12) -> DataFrame:
    """A row for each match of each detector: the columns of ``texts``, kind, ordinal, value and entropy, behind the gates.

    The detectors run in chunks, each a projection of its own, so that no generated method grows too large.
    """
    d = texts.withColumn("_low", F.lower(text))
    names = []
    for a in range(0, len(detectors), chunk):
        parts = [_matches(F.col(text), F.col("_low"), a + j, x) for j, x in enumerate(detectors[a : a + chunk])]
        names.append(f"_m{a}")
        d = d.withColumn(f"_m{a}", F.concat(*[p.cast("array<struct<kind:string,ordinal:int,value:string>>") for p in parts]))
    d = d.withColumn("_m", F.explode(behind_gates(F.concat(*names), "kind", "ordinal", "value")))
    return d.select(*texts.columns, "_m.*")


def behind_gates(matches: Column, *fields: str) -> Column:
    """Those of an array's matches that pass the gates, with their entropy; in the array, since a filter on a column of
    entropies is pushed below it and works them out once more."""
    rated = F.transform(matches, lambda m: F.struct(*[m[f].alias(f) for f in fields], C.entropy(m["value"]).alias("entropy")))
    return F.filter(rated, lambda m: passes_gates(m["kind"], m["value"], m["entropy"]))


def passes_gates(kind: Column, value: Column, entropy: Column) -> Column:
    floor = F.when(kind == GENERIC, GENERIC_ENTROPY).otherwise(STRUCTURAL_ENTROPY)
    return ~C.is_placeholder(value) & (entropy >= floor)


def with_context(found: DataFrame, text: str = "body", prefix: str = "") -> DataFrame:
    """Adds context_snippet: what stands around the match of that rank (ordinal % 1000) of its detector.

    The pattern is looked up by row here: only rows with a match get this far, and they are few beside the texts.
    """
    patterns = F.create_map(*[F.lit(x) for d in DETECTORS for x in (d.name, d.pattern)])
    at = F.get(C.spans(F.col(text), F.element_at(patterns, F.col("kind"))), F.col("ordinal") % 1000)
    d = found.withColumn("_at", at)
    snippet = F.coalesce(C.context(F.col(text), F.col("_at.start"), F.col("_at.end")), F.lit(""))
    return d.withColumn("context_snippet", F.concat(F.lit(prefix), snippet)).drop("_at")


def base64_texts(texts: DataFrame, text: str = "body") -> DataFrame:
    """Each decoded run of base64 (24 characters or more) that is printable text of 8 characters or more."""
    blobs = F.filter(F.regexp_extract_all(F.col(text), C.rx("[A-Za-z0-9+/]{24,}={0,2}"), F.lit(0)), lambda b: F.length(b) % 4 == 0)
    decoded = F.transform(blobs, lambda b: F.try_validate_utf8(F.try_to_binary(b, F.lit("base64"))))
    good = F.filter(decoded, lambda s: s.isNotNull() & (F.length(s) >= 8) & s.rlike(r"\A(?:[^\p{C}\p{Z}]| )*\z"))
    return texts.select("*", F.posexplode(F.slice(good, 1, BLOBS)).alias("view_no", "decoded"))


def inline_json_text(body: Column) -> Column:
    """All strings of the JSON documents in a page's inline scripts, keys too, in their order, a line each."""
    scripts = F.regexp_extract_all(body, F.lit(r"(?is)<script\b(?![^>]*\bsrc\s*=)[^>]*>(.*?)</script>"), F.lit(1))
    names = "|".join(STATE_NAMES)
    state = F.transform(scripts, lambda s: F.regexp_extract(s, rf"(?s)(?:{names})\s*=\s*([\[{{].*[\]}}])", 1))
    whole = F.transform(scripts, lambda s: F.trim(s))
    docs = F.filter(F.concat(F.filter(whole, lambda s: s.rlike(r"\A[\[{]")), F.filter(state, lambda s: s != "")), lambda s: F.try_parse_json(s).isNotNull())
    literals = F.flatten(F.transform(docs, lambda s: F.regexp_extract_all(s, F.lit(r'"((?:[^"\\]|\\.)*)"'), F.lit(1))))
    plain = F.transform(literals, lambda s: F.get(F.from_json(F.concat(F.lit('["'), s, F.lit('"]')), "array<string>"), 0))
    return F.substring(F.array_join(plain, "\n"), 1, INLINE_CHARS)


def sourcemap_texts(assets: DataFrame) -> DataFrame:
    """The original sources in source maps, each under ``map → name``: assets of their own."""
    v = F.try_parse_json(F.col("body"))
    src = F.try_variant_get(v, "$.sourcesContent", "array<variant>")
    names = F.try_variant_get(v, "$.sources", "array<string>")
    d = assets.where(is_sourcemap(F.col("source_url"), F.col("body"))).select("*", names.alias("_n"), F.posexplode(src).alias("_i", "_v"))
    d = d.where((F.schema_of_variant("_v") == "STRING") & (F.length(F.expr("_v::string")) > 0))
    name = F.coalesce(F.get("_n", F.col("_i")), F.concat(F.lit("source["), F.col("_i"), F.lit("]")))
    w = Window.partitionBy("source_url").orderBy("_i")
    d = d.withColumn("_r", F.row_number().over(w)).where("_r <= 200")
    return d.withColumns({"source_url": F.concat("source_url", F.lit(" → "), name), "body": F.expr("_v::string")}).select(*assets.columns)


def is_sourcemap(url: Column, body: Column) -> Column:
    head = F.substring(body, 1, 4000)
    return F.regexp_replace(url, r"[?#].*$", "").endswith(".map") | head.contains('"sourcesContent"') | (head.contains('"mappings"') & head.contains('"version"'))


def _beside(rule: PairRule):
    """Predicate on a companion span: near enough to an anchor in _a, not overlapping it, of the right alphabet."""

    def apart(c: Column, a: Column) -> Column:
        gap = F.when(a["start"] > c["end"], a["start"] - c["end"]).otherwise(c["start"] - a["end"])
        return ~((c["start"] < a["end"]) & (a["start"] < c["end"])) & (gap <= rule.window)

    def keep(c: Column) -> Column:
        near = F.exists("_a", lambda a: apart(c, a))
        v = c["value"]
        return near & v.rlike("[A-Z]") & v.rlike("[a-z]") & v.rlike("[0-9]") if rule.mixed else near

    return keep


def pair_values(texts: DataFrame, text: str = "body", rules: tuple[PairRule, ...] = PAIR_RULES) -> DataFrame:
    """Values that stand beside an anchor: the columns of ``texts``, kind, ordinal, start, end, value, entropy."""
    parts = []
    for r, rule in enumerate(rules):
        anchors, found = C.spans(F.col(text), rule.anchor), C.spans(F.col(text), rule.companion, 1)
        d = texts.where(F.col(text).rlike(C.UNICODE + rule.anchor)).select("*", anchors.alias("_a"), found.alias("_c"))

        kept = F.slice(F.filter("_c", _beside(rule)), 1, PAIRS_PER_RULE)
        named = F.transform(kept, lambda m, i: F.struct(F.lit(rule.name).alias("kind"), (F.lit(r * 1000) + i).cast("int").alias("ordinal"), m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value")))  # noqa: B023
        d = d.withColumn("_m", F.explode(behind_gates(named, "kind", "ordinal", "start", "end", "value")))
        parts.append(d.select(*texts.columns, "_m.*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def claim_rank(kind: Column) -> Column:
    return F.when(kind == GENERIC, 0).when(kind.isin([r.name for r in PAIR_RULES]), 1).otherwise(2)


def collapse(found: DataFrame) -> DataFrame:
    """One finding of each fingerprint, then one of each (source_url, value): the best claim, the first of equals."""
    order = [F.col("phase"), F.col("view_no"), F.col("ordinal")]
    first = Window.partitionBy("fingerprint").orderBy(*order)
    best = Window.partitionBy("source_url", "value").orderBy(claim_rank(F.col("kind")).desc(), *order)
    d = found.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return d.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def scan_assets(assets: DataFrame, context: bool = False) -> DataFrame:
    """All findings of assets: source maps are read instead of their own text; decoded texts count after it."""
    maps = sourcemap_texts(assets)
    plain = assets.where(~F.coalesce(is_sourcemap(F.col("source_url"), F.col("body")), F.lit(False))).unionByName(maps)
    add = lambda d, phase: d.withColumns({"phase": F.lit(phase)} | ({} if "view_no" in d.columns else {"view_no": F.lit(0)})).select(*assets.columns, "phase", "view_no")
    views = base64_texts(plain).drop("body").withColumnRenamed("decoded", "body")
    page = F.lower(F.substring("body", 1, 2_000_000)).contains("<script")
    inline = plain.where(page).withColumn("body", inline_json_text(F.col("body"))).where("length(body) > 0")
    # one pass of the detectors over all texts: their own, decoded runs, strings of inline documents
    found = detect_values(add(plain, 0).unionByName(add(views, 2)).unionByName(add(inline, 3)))
    pairs = pair_values(add(plain, 1))
    if context:
        prefix = F.when(F.col("phase") >= 2, "[base64-decoded] ").otherwise("")
        found = with_context(found).withColumn("context_snippet", F.concat(prefix, "context_snippet"))
        pairs = pairs.withColumn("context_snippet", C.context(F.col("body"), F.col("start"), F.col("end")))
    keys = [c for c in found.columns if c != "body"]
    out = found.select(*keys).unionByName(pairs.select(*keys))
    return collapse(out.withColumn("fingerprint", C.fingerprint(F.col("kind"), F.col("source_url"), F.col("value"))))


def cap_per_scan(found: DataFrame, most: int = 500, scan: str = "scan_id") -> DataFrame:
    """The first findings of each scan; raw_total has how many there were."""
    w = Window.partitionBy(scan).orderBy("source_url", "phase", "view_no", "ordinal")
    return found.withColumn("raw_total", F.count("*").over(Window.partitionBy(scan))).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def types_in(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, types: the sorted detectors that find something in a text (for guards that name types, never values)."""
    return detect_values(texts.select(key, text), text).groupBy(key).agg(F.array_sort(F.collect_set("kind")).alias("types"))
