"""Frames for reports, masked by shape, and the measurement of detection quality."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glint.functions import columns as C
from glint.functions.registry import DETECTORS
from glint.operators.history import severity_summary

ROWS_PER_BUCKET = 250
#: Pieces at least, over all documents, in which their items are sorted and put into JSON.
PIECES = 200


def masked(found: DataFrame, value: str = "value", snippet: str = "context_snippet") -> DataFrame:
    """No column of the result holds a raw value: it is masked itself, and all values of its source are redacted in its context."""
    d = found
    if snippet in d.columns:  # a source's findings are bounded by the cap on raw findings
        near = F.collect_set(value).over(Window.partitionBy("source_url"))
        near = F.array_sort(near, lambda a, b: F.length(b) - F.length(a))  # a value within another goes after it
        d = d.withColumn("_near", near).withColumn(snippet, F.aggregate("_near", F.col(snippet), lambda acc, v: C.redact_snippet(acc, v))).drop("_near")
    return d.withColumn(value, C.mask(F.col(value)))


def csv_rows(found: DataFrame, posture: DataFrame | None = None) -> DataFrame:
    """13 columns; confirmed, review and informational findings, then posture, in the order of ``section`` and ``place``."""
    section = F.when(F.col("bucket") == "confirmed", 0).when(F.col("bucket") == "review", 1).otherwise(2)
    d = masked(found.where("bucket in ('confirmed', 'review', 'informational')"))
    opt = lambda c, default: F.col(c).cast("string") if c in found.columns else F.lit(default)
    rows = d.select(
        section.alias("section"), F.when(section == 0, "CONFIRMED").when(section == 1, "NEEDS_REVIEW").otherwise("INFORMATIONAL").alias("status"), "kind", "severity", C.cwe_of(F.col("kind")).alias("cwe"), F.col("confidence").cast("string").alias("confidence"),
        "source_url", F.col("value").alias("match"), F.col("entropy").cast("string").alias("entropy"), opt("verified", "").alias("verified"), opt("is_new", "").alias("is_new"), opt("rule", "").alias("reason"), "fingerprint",
    )
    if posture is not None:
        none = [F.lit("").alias(c) for c in ("match", "entropy", "verified", "is_new")]
        rows = rows.unionByName(posture.select(F.lit(3).alias("section"), F.lit("POSTURE").alias("status"), F.col("name").alias("kind"), "severity", "cwe", F.lit("").alias("confidence"), F.col("final_url").alias("source_url"), *none, F.col("evidence").alias("reason"), F.lit("").alias("fingerprint")))
    w = Window.partitionBy("section").orderBy(C.report_rank(F.col("severity")), F.desc(F.col("confidence").try_cast("int")), "kind", "fingerprint", "source_url")
    return rows.withColumn("place", F.row_number().over(w))


def rule_id(kind: Column) -> Column:
    return F.concat(F.lit("glint/"), F.regexp_replace(F.lower(kind), "[ /]+", "-"))


def sarif(found: DataFrame, by: str = "scan_id") -> DataFrame:
    """A SARIF 2.1.0 document of each scan, in one column. A scan's findings are bounded by the cap on raw findings."""
    level = F.when(F.col("bucket") != "confirmed", "note").when(F.col("severity").isin("CRITICAL", "HIGH"), "error").when(F.col("severity") == "MEDIUM", "warning").otherwise("note")
    d = masked(found.where("bucket != 'drop'"))
    result = F.struct(
        rule_id(F.col("kind")).alias("ruleId"), level.alias("level"), F.struct(F.concat_ws(" ", F.col("kind"), F.lit("in"), F.col("source_url"), F.lit("-"), F.col("value")).alias("text")).alias("message"),
        F.array(F.struct(F.struct(F.struct(F.col("source_url").alias("uri")).alias("artifactLocation")).alias("physicalLocation"))).alias("locations"),
        F.struct(F.col("fingerprint").alias("finding/v1")).alias("partialFingerprints"), F.struct("severity", "confidence", "bucket").alias("properties"),
    )
    rules = F.array(*[F.struct(F.lit("glint/" + d.name.lower().replace(" ", "-").replace("/", "-")).alias("id"), F.lit(d.name).alias("name"), F.struct(F.lit(d.severity).alias("severity"), F.lit(d.cwe).alias("cwe")).alias("properties")) for d in DETECTORS])
    driver = F.struct(F.struct(F.lit("glint").alias("name"), rules.alias("rules")).alias("driver"))
    none = F.from_json(F.lit("[]"), "array<int>")
    frame = F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(F.struct(driver.alias("tool"), none.alias("results"))).alias("runs")))
    head = F.substring(frame, F.lit(1), F.length(frame) - 4)  # up to the bracket that opens the results
    pieces = json_pieces(d.select(by, result.alias("_item")), by).select(by, F.struct("_p", "_text").alias("_s"))
    return pieces.groupBy(by).agg(_document(lambda p, i, all: F.when(i == 0, head).otherwise(","), "]}]}").alias("sarif"))


def json_pieces(d: DataFrame, *keys: str) -> DataFrame:
    """keys, _p, _text: the column _item of all rows of a key in JSON, sorted, without brackets, in pieces numbered by _p.

    A task holds a piece or a few; only who puts a document together from its pieces holds the document. Both numbers of
    partitions are given, since adaptive execution would put the pieces into as many tasks as there are cores.
    """
    n = max(PIECES, int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = d.repartitionByRange(n, *keys, "_item").withColumn("_p", F.spark_partition_id()).repartition(n, *keys, "_p")
    return rows.groupBy(*keys, "_p").agg(_unwrapped(F.sort_array(F.collect_list("_item"))).alias("_text"))


def _document(lead: Callable[[Column, Column, Column], Column], end: str) -> Column:
    """The pieces _s (sorted by their first fields, with _text), each behind its ``lead`` of piece, place and all pieces.

    One expression over the list, without a column of its own: each further column is another copy of the document.
    """

    def joined(all: Column) -> Column:
        texts = F.flatten(F.transform(all, lambda p, i: F.array(lead(p, i, all), p["_text"])))
        return F.concat_ws("", F.concat(texts, F.array(F.lit(end))))

    return C.bound(F.sort_array(F.collect_list("_s")), joined)


def _unwrapped(items: Column) -> Column:
    """The JSON of an array without its brackets."""
    return C.bound(F.to_json(items), lambda t: F.substring(t, F.lit(2), F.length(t) - 2))


def json_report(found: DataFrame, by: str = "scan_id", beside: DataFrame | None = None) -> DataFrame:
    """A JSON document of each scan with its masked findings by bucket.

    ``beside``: a row of other columns for each of these scans, which come along; a join would copy each document again.
    """
    d = masked(found)
    row = F.struct(*[c for c in d.columns if c not in (by, "bucket")])
    pieces = json_pieces(d.select(by, "bucket", F.to_json(row).alias("_item")), by, "bucket")
    pieces = pieces.select(by, F.struct("bucket", "_p", _unwrapped(F.array("bucket")).alias("_key"), "_text").alias("_s"))

    def lead(p: Column, i: Column, all: Column) -> Column:
        opens = F.when(i == 0, "{").when(F.get(all, i - 1)["bucket"] != p["bucket"], "],")
        return F.when(opens.isNull(), ",").otherwise(F.concat(opens, p["_key"], F.lit(":[")))

    others = [c for c in beside.columns if c != by] if beside is not None else []
    if others:
        pieces = pieces.unionByName(beside, allowMissingColumns=True).where(F.col(by).isNotNull())
    return pieces.groupBy(by).agg(_document(lead, "]}").alias("report"), *[F.first(c, ignorenulls=True).alias(c) for c in others])


def html_report(found: DataFrame, by: str = "scan_id") -> DataFrame:
    """An HTML page of each scan: a banner with its risk, and a table of its masked findings, 250 of a bucket at most."""
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    w = Window.partitionBy(by, "bucket").orderBy(C.report_rank(F.col("severity")), F.desc("confidence"), "kind", "fingerprint")
    d = masked(found.where("bucket != 'drop'")).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= ROWS_PER_BUCKET)
    cells = F.concat(*[F.concat(F.lit("<td>"), esc(F.col(c).cast("string")), F.lit("</td>")) for c in ("bucket", "severity", "kind", "confidence", "source_url", "value")])
    rows = d.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "_n", F.concat(F.lit("<tr>"), cells, F.lit("</tr>")).alias("r")))), lambda x: x.r), "\n").alias("rows"))
    head = F.concat(F.lit("<!doctype html><meta charset=utf-8><h1>"), esc(F.col(by)), F.lit(": "), F.col("risk"), F.lit("</h1><table>"))
    return severity_summary(found, by).join(rows, by, "left").select(by, F.concat(head, F.coalesce("rows", F.lit("")), F.lit("</table>")).alias("html"))


def digest(changes: DataFrame, by: str = "target_url") -> DataFrame:
    """A markdown note of each target's changes: rows (change, kind, severity, fingerprint), gravest first."""
    line = F.concat(F.lit("- "), F.col("change"), F.lit(": "), F.col("kind"), F.lit(" ("), F.col("severity"), F.lit(") "), F.col("fingerprint"))
    rows = changes.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(C.watch_rank(F.col("severity")).alias("r"), F.col("fingerprint"), line.alias("t")))).alias("x"))
    return rows.select(by, F.concat(F.lit("# "), F.col(by), F.lit("\n\n"), F.array_join(F.transform("x", lambda v: v.t), "\n")).alias("markdown"))


def confusion(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """One row: tp, fp, fn, tn of samples (key, expect or null) against found (key, kind), and the rates, four digits."""
    got = found.groupBy(key).agg(F.collect_set("kind").alias("_k"))
    d = expected.join(got, key, "left").withColumn("_hit", F.coalesce(F.size("_k") > 0, F.lit(False)))
    pos = F.col("expect").isNotNull()
    d = d.agg(F.count_if(pos & F.col("_hit")).alias("tp"), F.count_if(~pos & F.col("_hit")).alias("fp"), F.count_if(pos & ~F.col("_hit")).alias("fn"), F.count_if(~pos & ~F.col("_hit")).alias("tn"), F.count_if(pos & F.coalesce(F.array_contains("_k", F.col("expect")), F.lit(False))).alias("typed"))
    rate = lambda a, b: F.round(F.when(b == 0, 1.0).otherwise(a / F.greatest(b, F.lit(1))), 4)
    p, r = rate(F.col("tp"), F.col("tp") + F.col("fp")), rate(F.col("tp"), F.col("tp") + F.col("fn"))
    return d.withColumns({"precision": p, "recall": r, "type_accuracy": rate(F.col("typed"), F.col("tp"))}).withColumn("f1", F.round(F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-9))), 4))
