"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A document's exponential key is -ln(u) / weight, with u from a digest of its id and size and the weight from its text. The
smallest keys are a weighted sample without replacement. A source's target is met by complete epochs over all its
documents first; what remains is a budget that the documents fill in the order of their keys (a running sum of sizes),
the last one in part.

Scale: a running sum over a whole source would be one task for the hottest. The keys of a source are therefore cut
into slices of about ``SLICE_ROWS`` rows by the key's own distribution; slices are summed, the sums (a row a slice)
are accumulated, and a window runs within a slice only. What is shuffled is an id, a size and a key, no text. All of
it is DataFrame functions.

Defined results: a null text has size 0; null sources are a source of their own, last in order; a document of size 0
takes 0; rows with equal ids and sizes get equal keys, and rows equal in all columns share what they take in any order; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glint.llm.shared import Scratch, fresh

#: Rows of a slice, about.
SLICE_ROWS = 20_000
#: A source is repeated so often at most.
MOST_EPOCHS = 3
#: The weights of the sources in their order, repeating.
SOURCE_WEIGHTS = (1, 2, 3)

_SPACES = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of runs of what isn't white space, without making them."""
    solid = F.regexp_replace(F.coalesce(text, F.lit("")), _SPACES, " ")
    solid = F.trim(solid)
    return F.when(solid == "", 0).otherwise(F.length(solid) - F.length(F.replace(solid, F.lit(" "), F.lit(""))) + 1).cast("long")


def quality_weight(text: Column) -> Column:
    """1 and up to 1 more for the share of lower-case a to z, in steps of 1/1000."""
    text = F.coalesce(text, F.lit(""))
    lower = F.length(text) - F.length(F.translate(text, "abcdefghijklmnopqrstuvwxyz", ""))
    return 1 + F.floor(1000 * lower / F.greatest(F.length(text), F.lit(1))) / 1000


def uniform(doc_id: Column, size: Column) -> Column:
    """In (0, 1), from the first 48 bits of the MD5 of the id and the size as text: rows without an id don't share a key."""
    named = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), size.cast("string"))
    digits = F.substring(F.md5(named.cast("binary")), 1, 12)
    return (F.conv(digits, 16, 10).cast("long") + 1) / F.lit(float((1 << 48) + 2))


def targets(sizes: DataFrame, weights: tuple[int, ...] = SOURCE_WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """``sizes``: source, source_size, one row a source. Adds ``target``.

    Sharing the excess over the caps again and again ends where each target is the lesser of its cap and of a level
    times its weight. With the sources sorted by cap / weight, the level is the first one that no later cap is under.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    by_cap = Window.orderBy("ratio", "place")
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    d = sizes.withColumn("place", F.row_number().over(order)).withColumn("w", w)
    d = d.withColumn("ratio", most * F.col("source_size") / F.col("w"))
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    left = F.sum("source_size").over(all_rows) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    level = left / F.sum("w").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    d = d.withColumn("level", level)
    found = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "place", "level"))).over(all_rows)["level"]
    target = F.least((most * F.col("source_size")).cast("double"), F.coalesce(found, F.lit(0.0)) * F.col("w"))
    return d.select("source", "source_size", target.alias("target"))


def mix(sized: DataFrame) -> DataFrame:
    """``sized``: doc_id, source, size, weight, and more; cheap to read again. Adds source_size, target and taken.

    The number of sources is what the plan sorts in one task and joins back; that is a row a source.
    """
    d = sized.withColumn("_key", -F.log(uniform(F.col("doc_id"), F.col("size"))) / F.col("weight"))
    per = d.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"), F.avg("weight").alias("_w"))
    goal = targets(per.select("source", "source_size"))
    goal = goal.join(per.select(F.col("source").alias("_s"), "_rows", "_w"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    goal = goal.withColumnRenamed("source", "_source")
    d = d.join(goal, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    slices = F.ceil(F.col("_rows") / SLICE_ROWS)
    d = d.withColumn("_slice", F.least(F.floor((1 - F.exp(-F.col("_key") * F.col("_w"))) * slices), slices - 1))
    sums = d.groupBy("source", "_slice").agg(F.sum("size").alias("_sum"))
    run = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("_s"), F.col("_slice").alias("_n"), F.coalesce(F.sum("_sum").over(run), F.lit(0)).alias("_before"))
    d = d.join(sums, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_slice") == F.col("_n"))).drop("_s", "_n")
    within = Window.partitionBy("source", "_slice").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_before") + F.coalesce(F.sum("size").over(within), F.lit(0))
    budget = F.floor(F.col("target") + 0.5)
    size = F.greatest(F.col("source_size"), F.lit(1))
    rest = F.pmod(budget, size)
    taken = F.floor(budget / size) * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - before))
    return d.withColumn("taken", taken.cast("long")).drop("_key", "_rows", "_w", "_slice", "_before")


def op6_mixing_es(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each document that the mix takes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = docs.select("doc_id", "source", words(F.col("text")).alias("size"), quality_weight(F.col("text")).alias("weight"))
    return mix(Scratch(spark).write(sized)).select("doc_id", "size", "source_size", "target", "taken")


def mix_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document as often as the mix takes it; the last copy may be cut at a word's end.

    Rows that are equal in id, source and text count once in the mix, and each is then taken as often as that one. All
    columns stay, whatever their names; n_chars follows the text; documents without words go, and an empty table stays.
    The weight comes from the text: a stage hands on the columns of documents only, so no earlier score arrives here.
    """
    tag, size, taken, part = fresh(docs, "tag", "size", "taken", "part")
    slim = docs.select("doc_id", "source", words(F.col("text")).alias("size"), quality_weight(F.col("text")).alias("weight"), F.xxhash64("text").alias("tag"))
    t = mix(Scratch(spark).write(slim.distinct())).where("taken > 0")
    t = t.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("tag").alias("_t"), F.col("size").alias(size), F.col("taken").alias(taken))
    same = F.col("d.doc_id").eqNullSafe(F.col("t._id")) & F.col(f"d.{tag}").eqNullSafe(F.col("t._t")) & F.col("d.source").eqNullSafe(F.col("t._source"))
    d = docs.withColumn(tag, F.xxhash64("text")).alias("d").join(t.alias("t"), same).select("d.*", f"t.{size}", f"t.{taken}")
    whole, rest = F.floor(F.col(taken) / F.col(size)), F.pmod(taken, size)
    copies = F.array_repeat(F.lit(None).cast("long"), whole.cast("int"))
    d = d.withColumn(part, F.explode(F.when(rest > 0, F.concat(copies, F.array(rest))).otherwise(copies)))
    pieces = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.array_join(F.slice(pieces, F.lit(1), F.col(part).cast("int")), "")
    d = d.withColumn("text", F.when(F.col(part).isNull(), F.col("text")).otherwise(cut))
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return d.select(*(F.col(f"`{c}`") for c in docs.columns))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         1 + floor(1000 * (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[a-z]', '', 'g'))) / greatest(length(coalesce(text, '')), 1)) / 1000 AS weight,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || size::VARCHAR), 1, 12))::BIGINT + 1) / 281474976710658.0::DOUBLE AS u
  FROM documents),
k AS (SELECT *, -ln(u) / weight AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS place FROM s),
w AS (SELECT *, (place - 1) % 3 + 1 AS w, 3 * source_size / ((place - 1) % 3 + 1) AS ratio FROM p),
l AS (SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
        / (sum(w) OVER (ORDER BY ratio, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM w),
f AS (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, place LIMIT 1),
t AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, coalesce((SELECT level FROM f), 0.0) * w) AS target FROM l),
r AS (SELECT k.doc_id, k.size, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS budget,
        coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       ((budget // greatest(source_size, 1)) * size + greatest(0, least(size, budget % greatest(source_size, 1) - before)))::BIGINT AS taken
FROM r
"""
