"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

Each document becomes a short vector of shares (of symbols, capitals, repeated words and so on), smoothed towards the
corpus mean so that a short text isn't judged by a handful of words, and put on the log-odds scale. A class is a normal
density with a shrunken covariance; a score is the difference of the two log densities (squared Mahalanobis lengths by
cached Cholesky factors) and the log prior odds, through the logistic function.

Scale: the model is fitted on a bounded sample of labelled rows (``SAMPLE`` of each class), whose ids are the only
thing broadcast (a proven bound); scoring is a narrow ``mapInArrow``, without a shuffle. Labels outside 0 and 1 and
labels of missing documents are left out; of several labels for a document the lowest counts.

Defined results: a null or empty text has no words and is scored as the smoothing mean; rows that repeat get equal
scores; texts of any length are read whole; ``score`` and ``keep_quality`` keep all columns, whatever their names; an
empty table gives an empty result; with labels of fewer than two classes every score is the share of class 1 (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from glint.llm.folds import bounded_sample, crc_fold
from glint.llm.shared import fresh, lean
from glint.llm.textarrays import blocks, hashes, shingles, spans

#: Labelled rows of each class that the model is fitted on, at most (about).
SAMPLE = 10_000
#: Weight of the corpus mean in each share, in words.
SMOOTH = 20.0
#: Share of the pooled covariance in each class's, and of its mean variance on the diagonal.
POOLED, RIDGE = 0.10, 0.02

FEATURES = ("upper", "digit", "symbol", "bang", "stop", "other", "lines", "long", "unique", "twice", "same", "dup_lines", "wordlen")

_CLASS = np.full(256, 7, np.uint8)
_CLASS[97:123] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_CLASS[[ord(c) for c in "#*$%&|<>^~=+_{}[]\\/@"]] = 4
_CLASS[[ord(c) for c in "!?"]] = 5
_CLASS[[ord(c) for c in ".,;:'\"-()"]] = 6
_CLASS[128:192] = 9
_CLASS[192:] = 8
_LINE = np.zeros(256, bool)
_LINE[10] = True


def _distinct(text: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes in each of n texts."""
    key = np.sort((text.astype(np.uint64) << np.uint64(53)) | (h >> np.uint64(11)))
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    return np.bincount((key[first] >> np.uint64(53)).astype(np.int64), minlength=n)


def statistics(column: pa.Array) -> np.ndarray:
    """For each text the counts behind the shares: numerators, then denominators, in the order of FEATURES."""
    rows = []
    for _, n, buf, off in blocks(column):
        text = np.repeat(np.arange(n), np.diff(off))
        kinds = np.bincount(text * 10 + _CLASS[buf], minlength=n * 10).reshape(n, 10)
        starts, ends, first = spans(buf, off)
        words = np.diff(first)
        h = hashes(buf, starts, ends)
        of = np.repeat(np.arange(n), words)
        tri, tri_of = shingles(h, first, 3)
        tri_n = np.bincount(tri_of, minlength=n)
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
        ls, le, lfirst = spans(buf, off, _LINE)
        line_of = np.repeat(np.arange(n), np.diff(lfirst))
        lines = np.diff(lfirst)
        chars = kinds[:, :9].sum(1) - kinds[:, 3]
        letters = kinds[:, 0] + kinds[:, 1] + kinds[:, 8]
        length = ends - starts
        num = [
            kinds[:, 1], kinds[:, 2], kinds[:, 4], kinds[:, 5], kinds[:, 6], kinds[:, 7], lines, np.bincount(of[length > 15], minlength=n),
            _distinct(of, h, n), tri_n - _distinct(tri_of, tri, n), np.bincount(of[same], minlength=n), lines - _distinct(line_of, hashes(buf, ls, le), n), chars,
        ]
        den = [letters, chars, chars, chars, chars, chars, words, words, words, tri_n, words, lines, words * 20]
        rows.append(np.stack([*num, *den], 1).astype(float))
    return np.concatenate(rows) if rows else np.zeros((0, 2 * len(FEATURES)))


def transform(counts: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Smoothed shares as log odds. The smoothing weight is SMOOTH words, or 5 characters for each where characters count."""
    d = len(FEATURES)
    num, den = counts[:, :d], counts[:, d:]
    weight = np.array([SMOOTH * (20 if f == "wordlen" else 5 if f in ("upper", "digit", "symbol", "bang", "stop", "other") else 1) for f in FEATURES])
    p = np.clip((num + weight * mean) / (den + weight), 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


@dataclass
class Qda:
    """``mean``: the smoothing shares. ``base``: log prior odds; without two classes only that is used."""

    mean: np.ndarray
    base: float
    centre: list[np.ndarray]
    inverse: list[np.ndarray]
    log_det: list[float]

    def score(self, counts: np.ndarray) -> np.ndarray:
        odds = np.full(len(counts), self.base)
        if self.centre:
            x = transform(counts, self.mean)
            for k, sign in ((0, -1), (1, 1)):
                z = (x - self.centre[k]) @ self.inverse[k].T
                odds += sign * (-0.5 * (z * z).sum(1) - self.log_det[k])
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def fit(counts: np.ndarray, label: np.ndarray, prior: float | None = None) -> Qda:
    """``prior``: share of class 1 among all labelled rows, where the sample is balanced."""
    d = len(FEATURES)
    mean = (counts[:, :d].sum(0) + 0.01) / (counts[:, d:].sum(0) + 1) if len(counts) else np.full(d, 0.5)
    n1, n0 = int((label == 1).sum()), int((label == 0).sum())
    prior = prior if prior is not None else (n1 + 0.5) / (n1 + n0 + 1)
    if min(n0, n1) < 2:
        p = min(max((n1 + 0.5 * (not n0)) / max(n0 + n1, 1), 0.0), 1.0) if n0 + n1 else 0.5
        return Qda(mean, float(np.log((p + 1e-9) / (1 - p + 1e-9))), [], [], [])
    x = transform(counts, mean)
    groups = [x[label == 0], x[label == 1]]
    cov = [np.cov(g.T, bias=True) for g in groups]
    pooled = (n0 * cov[0] + n1 * cov[1]) / (n0 + n1)
    centre, inverse, log_det = [], [], []
    for g, s in zip(groups, cov, strict=True):
        s = (1 - POOLED) * s + POOLED * pooled
        s += RIDGE * max(np.trace(s) / d, 1e-6) * np.eye(d)
        factor = np.linalg.cholesky(s)
        centre.append(g.mean(0))
        inverse.append(np.linalg.inv(factor))
        log_det.append(float(np.log(np.diag(factor)).sum()))
    return Qda(mean, float(np.log(prior / (1 - prior))), centre, inverse, log_det)


@lean
def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        c = statistics(b.column("text"))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(list(c), pa.list_(pa.float64()))], ["doc_id", "label", "counts"])


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Qda:
    """``labels``: doc_id and label (0 or 1) of the rows that may be learned from."""
    known = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.min("label").alias("label"))
    totals = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    chosen = F.broadcast(bounded_sample(known, "doc_id", most, "label"))  # about 2 * most rows
    got = docs.select("doc_id", "text").join(chosen, "doc_id").mapInArrow(_counts, "doc_id long, label int, counts array<double>")
    rows = got.dropDuplicates(["doc_id", "counts"]).toPandas().sort_values("doc_id", kind="stable")
    counts = np.stack(rows["counts"].to_list()) if len(rows) else np.zeros((0, 2 * len(FEATURES)))
    n = sum(totals.values())
    prior = (totals.get(1, 0) + 0.5) / (n + 1) if len(totals) == 2 else None
    return fit(counts, rows["label"].to_numpy(int), prior)


def score(docs: DataFrame, model: Qda, name: str = "quality_score") -> DataFrame:
    """The documents' columns and a score, whose ``name`` must be new."""
    if name in docs.columns:
        raise ValueError(f"docs has a column {name}; pass another name for the score")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(statistics(b.column("text")))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], [*b.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def _learnable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").where(crc_fold("doc_id", 3) != 1).select("doc_id", F.col("quality").cast("int").alias("label"))


def op7_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every whole text of documents; labels of the held-out third are not learned from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, _learnable(spark, sf_dir))
    return _scored(docs, model).select(
        "doc_id",
        F.coalesce(crc_fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def _scored(docs: DataFrame, model: Qda) -> DataFrame:
    """doc_id and score only: no text comes back from Python."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(statistics(b.column("text"))), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str, threshold: float = 0.5) -> DataFrame:
    """Pipeline stage: the documents that score ``threshold`` or more, with their columns."""
    model = train(docs, _learnable(spark, sf_dir))
    (name,) = fresh(docs, "score")
    return score(docs, model, name).where(F.col(name) >= threshold).drop(name)


