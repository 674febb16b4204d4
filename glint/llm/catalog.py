"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glint.llm.langid_crossparse import op8_langid_crossparse
from glint.llm import mixing_es, quality_divergence
from glint.llm.mixing_es import op6_mixing_es
from glint.llm.line_minhash import op4_line_minhash
from glint.llm.ngram_jaccard import op2_ngram_jaccard
from glint.llm.packing_pow2 import op9_packing_pow2
from glint.llm.quality_divergence import op3_quality_divergence
from glint.llm.quality_qda import op7_quality_qda
from glint.llm.secret_scan import op10_secret_scan
from glint.llm.simhash import op1_simhash
from glint.llm.toxicity_fuzzy import op5_toxicity_fuzzy

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_quality_divergence": op3_quality_divergence,
    "op4_line_minhash": op4_line_minhash,
    "op5_toxicity_fuzzy": op5_toxicity_fuzzy,
    "op6_mixing_es": op6_mixing_es,
    "op7_quality_qda": op7_quality_qda,
    "op8_langid_crossparse": op8_langid_crossparse,
    "op9_packing_pow2": op9_packing_pow2,
    "op10_secret_scan": op10_secret_scan,
}
ORACLES: dict[str, str] = {
    "op3_quality_divergence": quality_divergence.ORACLE,
    "op6_mixing_es": mixing_es.ORACLE,
}
