"""Toxicity: misspelled lexicon terms by Levenshtein automata, weighed by their context.

The lexicon is learned: words, and stems (beginnings that many words share), that labelled toxic documents have and
others hardly have. Its terms form a trie. A word is matched by the intersection of the trie with the Levenshtein
automaton of each term: a state is the set of (trie node, edits so far), made when first needed and then kept, so that
a word costs one step a character. Short terms allow no edit, longer ones one, the longest two.

A hit is then looked at in its window of words: inside quotation marks it is told apart from one outside, and so is
one with further hits beside it. A document's counts of such hits go into a logistic model fitted on the same labels;
a quoted hit begins with half the weight of an unquoted one, and the labels may move that.

Scale: what is learned comes from a bounded sample of labelled rows (``SAMPLE`` of each class); word counts are summed
by Spark, and only terms that pass the thresholds (``TERMS`` at most) reach the driver. Scoring is a narrow
``mapInArrow`` without a shuffle; each Python worker keeps the words it has met, in bounded memory.

Defined results: null and empty texts have no hits and get the score of such documents; repeated rows get equal
scores; without labels of both classes the score is the share of class 1 (0 without labels); texts of any length are read whole;
other columns, whatever their names, are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glint.llm.folds import bounded_sample, crc_fold
from glint.llm.textarrays import Seen, blocks, spans

#: Labelled rows of each class that are learned from, at most (about), and terms of the lexicon.
SAMPLE, TERMS = 3000, 500
#: A term has at least so many different neighbours in toxic documents (or this share of their number), and so large a
#: share of its neighbours is toxic (both classes weighed alike).
LEAST_DOCS, LEAST_RATE, LEAST_SHARE = 4, 0.03, 0.97
#: Lengths of stems, and the different words that a stem begins at least.
STEM_LENGTHS, STEM_WORDS = range(3, 9), 6
#: Words to either side of a hit that are its context, and automaton states that a worker keeps.
WINDOW, STATES = 8, 50_000
#: Code of a word: no hit, term, misspelled term, stem, misspelled stem.
NONE, EXACT, FUZZY, STEM, FUZZY_STEM = range(5)


def edits_allowed(n: int) -> int:
    return 0 if n < 5 else 1 if n < 10 else 2


class FuzzyTrie:
    """Lexicon trie with the determinised Levenshtein automata of its terms."""

    def __init__(self, words: tuple[str, ...], stems: tuple[str, ...]):
        self.child: list[dict[str, int]] = [{}]
        self.most: list[int] = [0]  # edits that some term below the node allows
        self.word: list[int] = [-1]  # edits that the term ending here allows
        self.stem: list[int] = [-1]
        for terms, ends in ((words, self.word), (stems, self.stem)):
            for term in terms:
                node, allowed = 0, edits_allowed(len(term) - 2 * (ends is self.stem))
                for c in term:
                    self.most[node] = max(self.most[node], allowed)
                    if c not in self.child[node]:
                        self.child[node][c] = len(self.child)
                        self.child.append({})
                        for x, v in ((self.most, 0), (self.word, -1), (self.stem, -1)):
                            x.append(v)
                    node = self.child[node][c]
                self.most[node] = max(self.most[node], allowed)
                ends[node] = allowed
        self._begin()

    def _begin(self) -> None:
        """No states but the first."""
        self.sets: list[frozenset[tuple[int, int]]] = []
        self.step: list[dict[str, int]] = []
        self.final: list[int] = []
        self.number: dict[frozenset[tuple[int, int]], int] = {}
        self.start = self._state(self._skipped({(0, 0)}))

    def _skipped(self, states: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
        """With the states reached by leaving out characters of a term (an edit each)."""
        todo = list(states)
        while todo:
            node, e = todo.pop()
            for to in self.child[node].values():
                if e < self.most[to] and (to, e + 1) not in states:
                    states.add((to, e + 1))
                    todo.append((to, e + 1))
        best: dict[int, int] = {}
        for node, e in states:
            best[node] = min(e, best.get(node, e))
        return frozenset(best.items())

    def _state(self, key: frozenset[tuple[int, int]]) -> int:
        if key not in self.number:
            self.number[key] = len(self.sets)
            self.sets.append(key)
            self.step.append({})
            code = NONE
            for node, e in key:
                if 0 <= e <= self.word[node]:
                    code = EXACT if e == 0 else code or FUZZY
            self.final.append(code)
        return self.number[key]

    def _next(self, s: int, c: str) -> int:
        got: set[tuple[int, int]] = set()
        for node, e in self.sets[s]:
            to = self.child[node].get(c)
            if to is not None:
                got.add((to, e))
            if e < self.most[node]:
                got.add((node, e + 1))  # c is one too many
                got |= {(x, e + 1) for x in self.child[node].values() if e < self.most[x]}  # c for another
        self.step[s][c] = out = self._state(self._skipped(got))
        return out

    def match(self, word: str) -> int:
        """The code of a word."""
        if len(self.sets) > STATES:
            self._begin()
        s, code = self.start, NONE
        for c in word:
            to = self.step[s].get(c)
            s = self._next(s, c) if to is None else to
            here = self.sets[s]
            if not here:
                break
            if code != STEM:
                for node, e in here:
                    if e <= self.stem[node]:
                        code = STEM if e == 0 else code or FUZZY_STEM
        else:
            if self.final[s]:
                return EXACT if self.final[s] == EXACT else code if code == STEM else FUZZY
        return code


class _Codes:
    """``make`` for Seen: the code of each new word."""

    def __init__(self, trie: FuzzyTrie):
        self.trie, self.codes = trie, np.zeros(0, np.int8)

    def clear(self) -> None:
        self.codes = np.zeros(0, np.int8)

    def __call__(self, words: list[bytes]) -> None:
        match, strip = self.trie.match, "\"'.,;:!?()[]{}<>«»“”„‘’*_-~`|"
        self.codes = np.concatenate([self.codes, np.array([match(w.decode().lower().strip(strip)) for w in words], np.int8)])


FEATURES = ("exact", "fuzzy", "stem", "fuzzy_stem", "hits", "quoted", "beside", "rate")


class Scorer:
    def __init__(self, words: tuple[str, ...], stems: tuple[str, ...]):
        self.codes = _Codes(FuzzyTrie(words, stems))
        self.seen = Seen(self.codes)

    def features(self, column: pa.Array) -> np.ndarray:
        """The model's inputs for each text, in the order of FEATURES."""
        rows = []
        for _, n, buf, off in blocks(column):
            starts, ends, first = spans(buf, off)
            at = self.seen.lookup(buf, starts, ends)  # before codes is read: it grows here
            code = self.codes.codes[at]
            hit = np.flatnonzero(code)
            doc = np.searchsorted(first, hit, "right") - 1
            quoted = _quoted(buf, starts, ends, first, hit, doc)
            near = np.zeros(len(hit))
            for a, b in ((slice(1, None), slice(None, -1)), (slice(None, -1), slice(1, None))):
                near[a] += (np.abs(hit[a] - hit[b]) <= WINDOW) & (doc[a] == doc[b])
            weight = np.where(quoted, 0.5, 1.0)
            count = [np.bincount(doc[code[hit] == k], weight[code[hit] == k], n) for k in (EXACT, FUZZY, STEM, FUZZY_STEM)]
            total = sum(count)
            x = [np.minimum(c, 1) for c in count] + [np.log1p(total), np.log1p(np.bincount(doc[quoted], minlength=n)), np.log1p(np.bincount(doc, near, n))]
            rows.append(np.stack([*x, np.log1p(20 * total / np.maximum(np.diff(first), 1))], 1))
        return np.concatenate(rows) if rows else np.zeros((0, len(FEATURES)))


def _quoted(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, hit: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether each hit (a word's number) lies in quotation marks within its window.

    A word that begins with a mark opens a quotation and one that ends with a mark, but for punctuation, closes it; the
    opening one is at most WINDOW words before, the closing one at most WINDOW after, and none closes between.
    """
    if not len(hit):
        return np.zeros(0, bool)
    n = len(starts)
    padded = np.concatenate([np.zeros(4, np.uint8), buf, np.zeros(4, np.uint8)])
    at = lambda place, k: padded[place + 4 + k]
    plain = lambda x: (x == 34) | (x == 39)
    curly = lambda place, marks: (at(place, 0) == 0xE2) & (at(place, 1) == 0x80) & np.isin(at(place, 2), marks)
    opens = plain(at(starts, 0)) | curly(starts, (0x98, 0x9C, 0x9E)) | ((at(starts, 0) == 0xC2) & (at(starts, 1) == 0xAB))
    last = np.where(np.isin(at(ends, -1), [ord(c) for c in ".,;:!?"]) & (ends - starts > 1), ends - 1, ends)
    closes = np.zeros(n, bool)
    for end in (last, ends):
        closes |= plain(at(end, -1)) | curly(end - 3, (0x99, 0x9C, 0x9D)) | ((at(end, -2) == 0xC2) & (at(end, -1) == 0xBB))
    alone = opens & (ends - starts == 1)
    number = np.arange(n)
    before = np.maximum.accumulate(np.where(opens, number, -1))
    closed = np.maximum.accumulate(np.where(closes, number, -1))
    after = np.minimum.accumulate(np.where(closes, number, n + WINDOW)[::-1])[::-1]
    begin, shut, end = before[hit], np.where(hit > 0, closed[hit - 1], -1), after[hit]
    inside = (begin >= first[doc]) & (hit - begin <= WINDOW) & (end < first[doc + 1]) & (end - hit <= WINDOW)
    return inside & ((begin > shut) | ((begin == shut) & alone[begin]))


@dataclass(frozen=True)
class Model:
    words: tuple[str, ...]
    stems: tuple[str, ...]
    weights: tuple[float, ...]  # of FEATURES, and a constant
    plain: float | None = None  # the score of all, where nothing could be fitted

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.plain is not None:
            return np.full(len(x), self.plain)
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.weights[:-1]) + self.weights[-1], -500, 500)))


@lru_cache(maxsize=2)
def _scorer(words: tuple[str, ...], stems: tuple[str, ...]) -> Scorer:
    return Scorer(words, stems)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.005) -> tuple[float, ...]:
    """Newton's method with a ridge on all weights but the constant."""
    z = np.concatenate([x, np.ones((len(x), 1))], 1)
    w, pen = np.zeros(z.shape[1]), np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + pen * len(z) / 100 + 1e-9 * np.eye(len(w)), z.T @ (y - p) - pen @ w * len(z) / 100)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


_LETTERS = re.compile(r"[^\W\d_]+")


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word of three letters or more with the word before it, once a text."""
    for b in batches:
        for label, text in zip(b.column("label").to_pylist(), b.column("text").to_pylist(), strict=True):
            words = _LETTERS.findall((text or "").lower())
            pairs = {(w, v) for w, v in zip(words, ["", *words]) if len(w) >= 3}
            if pairs:
                w, v = zip(*sorted(pairs), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(w), pa.int32()), pa.array(w), pa.array(v)], ["label", "word", "before"])


def lexicon(sample: DataFrame, n1: int, n0: int) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Words and stems from rows (text, label).

    What is counted is not documents but different neighbours: a word of a text that has many copies, near ones too,
    stands beside the same words in all of them, while a term of the lexicon turns up anywhere.
    """
    pairs = sample.select("label", "text").mapInArrow(_neighbours, "label int, word string, before string")
    pairs = pairs.groupBy("word", "before").agg(F.max("label").alias("l1"), F.min("label").alias("l0"))
    counts = pairs.groupBy("word").agg(F.sum("l1").alias("a"), F.sum(1 - F.col("l0")).alias("b"))
    n1, n0 = max(n1, 1), max(n0, 1)
    share = (F.col("a") / n1) / (F.col("a") / n1 + F.col("b") / n0 + F.lit(0.2 / max(n0, n1)))
    top = lambda d: d.where((F.col("a") >= max(LEAST_DOCS, LEAST_RATE * n1)) & (share >= LEAST_SHARE)).orderBy(F.desc("a"), "word").limit(TERMS)
    stems = counts.select(F.explode(F.array(*[F.substring("word", 1, n) for n in STEM_LENGTHS])).alias("stem"), "word", "a", "b").where("word != stem")
    stems = stems.groupBy(F.col("stem").alias("word")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count("*").alias("n")).where(F.col("n") >= STEM_WORDS)
    got = [r["word"] for r in top(stems).collect()]
    kept = [s for s in got if not any(s != t and s.startswith(t) for t in got)]
    found = [r["word"] for r in top(counts).collect()]
    return tuple(sorted(w for w in found if not any(w.startswith(s) for s in kept))), tuple(sorted(kept))


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Model:
    """``labels``: doc_id and label (0 or 1) of the rows that may be learned from."""
    known = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    totals = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    n = sum(totals.values())
    if len(totals) < 2:
        return Model((), (), (), totals.get(1, 0) / n if n else 0.0)
    sample = docs.select("doc_id", "text").join(F.broadcast(bounded_sample(known, "doc_id", most, "label")), "doc_id")  # about 2 * most ids
    words, stems = lexicon(sample, min(totals[1], most), min(totals[0], most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _scorer(words, stems).features(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    rows = sample.mapInArrow(run, "doc_id long, label int, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    y = rows["label"].to_numpy(float)
    if not 0 < y.sum() < len(y):
        return Model((), (), (), totals[1] / n)
    return Model(words, stems, fit_logistic(np.stack(rows["x"].to_list()), y))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _scorer(model.words, model.stems).features(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(x), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op5_toxicity_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every whole text of documents; labels of the held-out third are not learned from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(crc_fold("doc_id", 3) != 1).select("doc_id", F.col("toxic").cast("int").alias("label"))
    return score(docs, train(docs, labels)).select(
        "doc_id",
        F.coalesce(crc_fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"),
    )
