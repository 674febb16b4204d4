"""Captured inputs as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Kinds of content that are read, and the most characters of a body.
SCANNABLE = (
    "application/javascript", "application/x-javascript", "text/javascript", "application/json", "application/manifest+json", "application/ld+json",
    "application/xml", "application/xhtml+xml", "image/svg+xml", "application/octet-stream", "",
)
MOST_CHARS = 5 * 1024 * 1024


def assets(spark: SparkSession, path: str, url: str = "source_url", body: str = "body", form: str = "parquet") -> DataFrame:
    d = spark.read.format(form).load(path)
    return d.withColumnsRenamed({url: "source_url", body: "body"}).withColumn("body", F.substring("body", 1, MOST_CHARS))


def scannable(responses: DataFrame) -> DataFrame:
    """Responses whose content_type is text (or unknown) and whose declared length isn't over the limit."""
    kind = F.lower(F.trim(F.split(F.coalesce("content_type", F.lit("")), ";")[0]))
    small = F.coalesce(F.col("content_length").try_cast("long"), F.lit(0)) <= MOST_CHARS
    return responses.where((kind.startswith("text/") | kind.isin(*SCANNABLE)) & small)


def roster(spark: SparkSession, path: str) -> DataFrame:
    """Watched targets from JSON: a list of objects, or an object with such a list under targets."""
    d = spark.read.json(path, multiLine=True)
    return d.select(F.explode("targets").alias("t")).select("t.*") if "targets" in d.columns else d
