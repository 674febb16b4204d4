"""Quality rules by distribution divergence, in DataFrame functions only.

A document's histogram of character classes and its histogram of common words are compared with references of
languages by the Jensen-Shannon distance (base 2, so between 0 and 1). All words that a language's list doesn't have
are one more class, so a text with hardly any common words is far from every language. A document fails where even
the nearest reference is too far; a text of too few characters or words isn't judged. The base rules (fewest words,
most repetition) hold besides. Prose of a language without a reference is far from all: add its reference first.

The references are set by hand, in round numbers near the frequencies that word lists of these languages give; they
aren't learned from the corpus.

Scale: one narrow projection, no shuffle, no Python; the references are constants of the plan. Repeated windows are
found by sorting one long for each word (the higher bits of the window's hash, then its place), or a pair in texts of
LONG words or more; two windows of a text are taken for one with odds of 2^-47 (2^-64) for each pair.

Defined results: null and empty texts have no words and fail the base rule; texts of any length are read whole;
repeated rows give repeated results; an empty table gives an empty result; other columns, whatever their names, are
left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values. Shares of character classes in running text, per thousand: lower-case a-z, upper-case A-Z, digits,
# white space, punctuation, symbols, characters beyond ASCII, others.
CLASS_REFERENCES = {
    "en": (775, 30, 5, 165, 22, 1, 1, 1),
    "de": (765, 50, 5, 145, 20, 1, 13, 1),
    "fr": (735, 25, 5, 170, 25, 1, 38, 1),
    "es": (750, 25, 5, 170, 22, 1, 26, 1),
}
# Fixed values. Frequencies of the commonest words of each language, per thousand words.
WORD_REFERENCES = {
    "en": {"the": 62, "of": 32, "and": 27, "to": 26, "in": 21, "a": 21, "is": 11, "that": 11, "for": 9, "it": 9, "was": 9, "on": 7, "as": 7, "with": 7, "are": 6, "be": 6, "by": 5, "this": 5},
    "de": {"der": 35, "die": 34, "und": 30, "in": 20, "den": 13, "von": 12, "zu": 11, "das": 11, "mit": 9, "ist": 9, "sich": 8, "des": 8, "auf": 8, "nicht": 8, "im": 7, "dem": 7, "ein": 6},
    "fr": {"de": 50, "la": 30, "le": 25, "et": 24, "les": 22, "des": 18, "en": 14, "un": 13, "du": 13, "a": 12, "une": 11, "que": 11, "est": 11, "pour": 9, "qui": 9, "dans": 9, "par": 7},
    "es": {"de": 62, "la": 37, "que": 31, "el": 28, "en": 26, "y": 25, "a": 20, "los": 17, "se": 13, "del": 12, "las": 11, "un": 10, "por": 10, "con": 9, "no": 9, "una": 8, "su": 8, "para": 7},
}
#: The distances that a document may have at most, and the characters and words under which a histogram isn't judged.
MOST_CLASS_DISTANCE, LEAST_CHARS = 0.35, 200
MOST_WORD_DISTANCE, LEAST_WORDS = 0.31, 100
#: Bits of a window's place beside its hash; longer texts keep both whole.
PLACE_BITS = 17
LONG = 1 << PLACE_BITS

_CLASSES = ("lower_az", "upper_az", "digit", "space", "punct", "n_symbols", "wide")
_VOCABULARY = sorted({w for words in WORD_REFERENCES.values() for w in words})
#: As they stand in a text: in lower case, or with a capital.
_LISTED = sorted({*_VOCABULARY, *(w.capitalize() for w in _VOCABULARY)})


def _divergence(counts: list[str], shares: list[float], total: str) -> str:
    """SQL of the Jensen-Shannon divergence of counts / total and shares."""
    terms = []
    for c, q in zip(counts, shares, strict=True):
        p = f"({c} / {total})"
        terms.append(f"(CASE WHEN {c} > 0 THEN {p} * log2(2 * {p} / ({p} + {q!r})) ELSE 0.0 END + {q!r} * log2(2 * {q!r} / ({p} + {q!r})))")
    return "0.5 * (" + " + ".join(terms) + ")"


def _nearest(counts: list[list[str]], shares: list[list[float]], totals: list[str]) -> str:
    """SQL of the distance to the nearest reference, to six digits."""
    each = ", ".join(_divergence(c, q, t) for c, q, t in zip(counts, shares, totals, strict=True))
    return f"round(sqrt(greatest(least({each}), 0.0)), 6)"


def _word_shares(reference: dict[str, int]) -> list[float]:
    """Of the listed words, then of all others."""
    return [x / 1000 for x in (*reference.values(), 1000 - sum(reference.values()))]


def _distances() -> tuple[str, str]:
    classes = [[*_CLASSES, "other"]] * len(CLASS_REFERENCES)
    class_shares = [[x / sum(r) for x in r] for r in CLASS_REFERENCES.values()]
    totals = ["cast(greatest(n_all, 1) AS double)"] * len(CLASS_REFERENCES)
    words = [[*(f"w_{w}" for w in r), "(n_words - " + " - ".join(f"w_{w}" for w in r) + ")"] for r in WORD_REFERENCES.values()]
    word_shares = [_word_shares(r) for r in WORD_REFERENCES.values()]
    word_totals = ["cast(greatest(n_words, 1) AS double)"] * len(words)
    return _nearest(classes, class_shares, totals), _nearest(words, word_shares, word_totals)


_COUNTS = ", ".join(f"cast((length(common) - length(replace(common, ',{w},', ''))) / {len(w) + 2} AS bigint) AS w_{w}" for w in _VOCABULARY)
_VERDICT = f"""
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words
       OR (n_all >= {LEAST_CHARS} AND class_distance > {MOST_CLASS_DISTANCE})
       OR (n_words >= {LEAST_WORDS} AND word_distance > {MOST_WORD_DISTANCE})) AS kept,
  class_distance, word_distance"""
_RESULT = "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words"


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, both distances, base_failed and kept."""
    removed = lambda pattern: F.length(F.regexp_replace("t", pattern, "")).cast("long")
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    d = d.withColumns(
        {
            "n_all": F.length("t").cast("long"),
            "words": F.filter(F.split("t", r"[\x20\x09-\x0D]+"), lambda x: x != ""),
            "lines": F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
            "wide": removed(r"[\x00-\x7F]+"),
            "other": removed(r"[\x20\x09-\x0Da-zA-Z0-9.,;:!?'\"()\-#*$%&|<>\x80-\x{10FFFF}]+"),
            "upper_az": removed("[^A-Z]+"),
            "digit": removed("[^0-9]+"),
            "punct": removed(r"[^.,;:!?'\"()\-]+"),
            "n_symbols": removed(r"[^#*$%&|<>]+"),
        }
    )
    d = d.withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "word_chars": F.length(F.array_join("words", "")).cast("long"),
            "common": F.array_join(F.transform(F.filter("words", lambda x: x.isin(_LISTED)), lambda x: F.concat(F.lit(","), F.lower(x), F.lit(","))), ""),
            "_short": F.expr(f"CASE WHEN size(words) >= 3 AND size(words) < {LONG} THEN sort_array(transform(sequence(0, size(words) - 3), i -> (xxhash64(words[i], words[i + 1], words[i + 2]) & {-LONG}L) | i)) ELSE array() END"),
            "_long": F.expr(f"CASE WHEN size(words) >= {LONG} THEN sort_array(transform(sequence(0, size(words) - 3), i -> struct(xxhash64(words[i], words[i + 1], words[i + 2]) AS h, i AS i))) ELSE array() END"),
        }
    )
    part = f"shiftright({{}}, {PLACE_BITS})"
    short = f"transform(filter(_short, (x, i) -> {part.format('get(_short, i - 1)')} <=> {part.format('x')} OR {part.format('get(_short, i + 1)')} <=> {part.format('x')}), x -> int(x & {LONG - 1}L))"
    long = "transform(filter(_long, (x, i) -> get(_long, i - 1).h <=> x.h OR get(_long, i + 1).h <=> x.h), x -> x.i)"
    covered = f"aggregate(sort_array(concat({short}, {long})), named_struct('n', 0L, 'last', -3), (a, p) -> named_struct('n', a.n + least(3, p - a.last), 'last', p), a -> a.n)"
    d = d.withColumns({"n_repeat_words": F.expr(covered), "space": F.col("n_all") - F.col("word_chars")})
    d = d.withColumn("lower_az", F.expr("n_all - " + " - ".join(c for c in (*_CLASSES, "other") if c != "lower_az")))
    counted = "transform(array({}), w -> (length(common) - length(replace(common, concat(',', w, ','), ''))) / (length(w) + 2))"
    lists = {f"_w_{k}": F.expr(counted.format(", ".join(f"'{w}'" for w in r))) for k, r in WORD_REFERENCES.items()}
    d = d.withColumns(lists).withColumn("_classes", F.array(*(F.col(c).cast("double") for c in (*_CLASSES, "other"))))
    rest = "concat(_w_{0}, array(n_words - aggregate(_w_{0}, 0.0D, (a, x) -> a + x)))"
    d = d.withColumns({f"_w_{k}": F.expr(rest.format(k)) for k in WORD_REFERENCES})
    d = d.withColumns(
        {
            "class_distance": _distance([("_classes", "greatest(n_all, 1)", [x / sum(r) for x in r]) for r in CLASS_REFERENCES.values()]),
            "word_distance": _distance([(f"_w_{k}", "greatest(n_words, 1)", _word_shares(r)) for k, r in WORD_REFERENCES.items()]),
        }
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    far = (F.col("n_all") >= LEAST_CHARS) & (F.col("class_distance") > MOST_CLASS_DISTANCE)
    odd = (F.col("n_words") >= LEAST_WORDS) & (F.col("word_distance") > MOST_WORD_DISTANCE)
    return d.select(*_RESULT.split(", "), failed.alias("base_failed"), (~(failed | far | odd)).alias("kept"), "class_distance", "word_distance")


def _distance(pairs: list[tuple[str, str, list[float]]]) -> Column:
    """Distance to the nearest of (array column of counts, SQL of their total, shares), to six digits."""
    each = []
    for counts, total, reference in pairs:
        shares = ", ".join(f"{x!r}D" for x in reference)
        p = f"(c / {total})"
        term = f"(CASE WHEN c > 0 THEN {p} * log2(2 * {p} / ({p} + q)) ELSE 0.0D END + q * log2(2 * q / ({p} + q)))"
        each.append(f"0.5D * aggregate(zip_with({counts}, array({shares}), (c, q) -> {term}), 0.0D, (a, x) -> a + x)")
    return F.expr(f"round(sqrt(greatest(least({', '.join(each)}), 0.0D)), 6)")


def op3_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules over every whole text of documents."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    near_class, near_word = _distances()
    removed = lambda pattern: f"length(regexp_replace(t, '{pattern}', '', 'g'))::BIGINT"
    listed = ", ".join(f"'{w}'" for w in _LISTED)
    return rf"""
WITH a AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
b AS (SELECT *, length(t)::BIGINT AS n_all, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
  {removed(r"[\x20\x09-\x0D]+")} AS word_chars, {removed(r"[\x00-\x7F]+")} AS wide, {removed("[^a-z]+")} AS lower_az, {removed("[^A-Z]+")} AS upper_az,
  {removed("[^0-9]+")} AS digit, {removed(r"[^.,;:!?''\x22()\-]+")} AS punct, {removed("[^#*$%&|<>]+")} AS n_symbols FROM a),
u AS (SELECT r, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM b),
v AS (SELECT r, i, w, lead(w) OVER p AS w2, lead(w, 2) OVER p AS w3 FROM u WINDOW p AS (PARTITION BY r ORDER BY i)),
x AS (SELECT r, i, w3 IS NOT NULL AND count(*) OVER (PARTITION BY r, w, w2, w3) > 1 AS twice FROM v),
y AS (SELECT r, count(*) FILTER (hit) AS n FROM (SELECT r, twice OR coalesce(lag(twice) OVER p, false) OR coalesce(lag(twice, 2) OVER p, false) AS hit FROM x WINDOW p AS (PARTITION BY r ORDER BY i)) GROUP BY r),
c AS (SELECT b.*, len(words)::BIGINT AS n_words, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(y.n, 0)::BIGINT AS n_repeat_words, n_all - word_chars AS space,
  array_to_string(list_transform(list_filter(words, lambda x: x IN ({listed})), lambda x: ',' || lower(x) || ','), '') AS common FROM b LEFT JOIN y USING (r)),
d AS (SELECT *, n_all - {" - ".join(_CLASSES)} AS other, {_COUNTS} FROM c),
e AS (SELECT *, {near_class} AS class_distance, {near_word} AS word_distance FROM d)
SELECT {_RESULT}, {_VERDICT} FROM e
"""


ORACLE = _oracle()
