"""From raw documents to packed training sequences, in stages that each write Parquet for the next.

Counted as part of the subpackage ``glint.llm``. ``run`` writes each stage's result to the cluster's checkpoint folder,
so a lost executor never makes an earlier stage run again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glint.llm.line_minhash import dedup_lines
from glint.llm.mixing_es import mix_documents
from glint.llm.ngram_jaccard import drop_copies
from glint.llm.packing_pow2 import pack_documents
from glint.llm.quality_qda import keep_quality
from glint.llm.shared import Scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", keep_quality),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", drop_copies),
    ("mixing sources", mix_documents),
    ("packing", pack_documents),
]

#: A classifier, union-find and a tokenizer: SQL can't say it. tests/llm holds the stages against brute force one by one.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each result is written as Parquet and read again, the one before deleted."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    for _, stage in STAGES:
        after = scratch.write(stage(spark, docs, sf_dir))
        scratch.drop(docs)
        docs = after
    return docs
