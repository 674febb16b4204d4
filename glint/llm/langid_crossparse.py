"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded amount of its labelled text. A text is parsed into the
longest phrases that occur in that training text: the automaton is followed as far as it goes, then a phrase ends and
the next begins. The fewer phrases a language needs for its size (phrases times the log of the training length, per
character: an estimate of cross entropy), the better it explains the text; the least wins.

The automaton's transitions lie in one integer array, a missing one leading to where the next phrase begins, marked by
its sign. Each language has its own alphabet, all letters of its training text; a letter that it lacks is a phrase. All
runs of all texts of a batch take a step together, as numpy gathers. Texts are parsed whole, in runs of at most ``RUN``
characters (a run's end ends a phrase, alike in every language).

Scale: what is learned is bounded by ``TRAIN_CHARS`` per language, so the model broadcast in the task closure is too;
prediction is a narrow ``mapInArrow`` without a shuffle.

Defined results: a null or empty text, and one without letters, is ``und`` with score 0; without any learned language
every text is ``und``. Ties go to the language that sorts first. Repeated rows get equal results; texts of any length
are parsed whole; other columns, whatever their names, are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glint.llm.folds import bounded_sample, crc_fold
from glint.llm.textarrays import blocks, starts_of_codepoints

#: Characters learned from per language, at most, and texts that they are taken from (about).
TRAIN_CHARS, TRAIN_TEXTS = 40_000, 400
#: Characters of a run, and transitions of a language's automaton, about, at most: where an alphabet is large, less text
#: is learned, but all its letters are told apart.
RUN, CELLS = 512, 8_000_000


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton that accepts exactly the substrings of ``codes``; state 0 is the start."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[new] = twin
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
        last = new
    return step


def learnable(text: str) -> str:
    """The beginning of a training text whose automaton has about CELLS transitions at most."""
    letters: set[str] = set()
    for i, c in enumerate(text):
        if c.isalpha():
            letters.add(c)
        if 2 * (i + 1) * (len(letters) + 2) > CELLS:
            return text[:i]
    return text


class Model:
    """The languages' automata in one array. ``texts``: (language, training text), sorted by language."""

    def __init__(self, texts: tuple[tuple[str, str], ...]):
        self.langs = [k for k, _ in texts]
        folded = [learnable(t.lower()) for _, t in texts]
        alphabets = [sorted({c for c in t if c.isalpha()}) for t in folded]
        index = {c: i + 2 for i, c in enumerate(sorted({c for a in alphabets for c in a}))}  # 1: what is no letter; 0: letters that nothing taught
        self.letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        self.index = np.where(self.letter, 0, 1).astype(np.int32)
        for c, i in index.items():
            self.index[ord(c)] = i
            if len(c.upper()) == 1:
                self.index[ord(c.upper())] = i
        self.codes = np.zeros((len(folded), len(index) + 2), np.int32)  # a language's own code of each letter; 0: it has none
        table, self.root, self.weight, base = [], [], [], 0
        for k, (t, alphabet) in enumerate(zip(folded, alphabets, strict=True)):
            self.codes[k, 1] = 1
            self.codes[k, [index[c] for c in alphabet]] = np.arange(len(alphabet)) + 2
            learned, width = self.codes[k, self.index[np.frombuffer(t.encode("utf-32-le"), np.uint32)]], len(alphabet) + 2
            steps = suffix_automaton([int(x) for x in learned if x])
            rows = np.full((len(steps), width), -1, np.int64)
            for s, moves in enumerate(steps):
                for c, to in moves.items():
                    rows[s, c] = base + to * width
            begin = np.where(rows[0] >= 0, rows[0], base)
            table.append(np.where(rows >= 0, rows, ~begin).astype(np.int32).ravel())  # a phrase ends, and the next begins with this symbol
            self.root.append(base)
            self.weight.append(float(np.log2(max(len(learned), 2))))
            base += len(steps) * width
        self.table = np.concatenate(table) if table else np.zeros(0, np.int32)

    def parse(self, points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Normalised phrases of each text in each language, and each text's letters."""
        n, k = len(offsets) - 1, len(self.langs)
        codes = self.codes[:, self.index[points]]
        size = np.diff(offsets)
        total = np.concatenate([[0], np.cumsum(self.letter[points])])
        letters = total[offsets[1:]] - total[offsets[:-1]]
        runs = -(-size // RUN)
        of = np.repeat(np.arange(n), runs)
        begin = offsets[:-1][of] + (np.arange(len(of)) - np.repeat(np.cumsum(runs) - runs, runs)) * RUN
        length = np.minimum(offsets[1:][of] - begin, RUN)
        order = np.argsort(-length, kind="stable")
        of, begin, length = of[order], begin[order], length[order]
        state = np.repeat(np.array(self.root, np.int32)[:, None], len(of), 1)
        phrases = np.ones((k, len(of)), np.int32)
        live = np.searchsorted(-length, -np.arange(RUN), "left")  # runs longer than j come first
        for j in range(int(length[0]) if len(length) else 0):
            m = live[j]
            to = self.table[state[:, :m] + codes[:, begin[:m] + j]]
            ended = to >> 31
            phrases[:, :m] -= ended
            state[:, :m] = to ^ ended
        out = np.stack([np.bincount(of, p, n) for p in phrases], 1) if k else np.zeros((n, 0))
        return out * np.array(self.weight) / np.maximum(size, 1)[:, None], letters

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of each text. The score is 1 - best / mean of the others, at least 0; alone: 1."""
        langs, scores = [], []
        for _, n, buf, off in blocks(column):
            before = np.concatenate([[0], np.cumsum(starts_of_codepoints(buf))])
            points = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32)
            cost, letters = self.parse(points, before[off])
            if not self.langs:
                langs += ["und"] * n
                scores.append(np.zeros(n))
                continue
            best = cost.argmin(1)
            low = cost[np.arange(n), best]
            rest = (cost.sum(1) - low) / max(len(self.langs) - 1, 1)
            s = np.where(rest > 0, 1 - low / np.where(rest > 0, rest, 1), 1.0 if len(self.langs) == 1 else 0.0)
            langs += [self.langs[b] if a else "und" for a, b in zip(letters, best, strict=True)]
            scores.append(np.where(letters > 0, np.clip(s, 0, 1), 0.0))
        return langs, np.concatenate(scores) if scores else np.zeros(0)


@lru_cache(maxsize=4)
def _model(texts: tuple[tuple[str, str], ...]) -> Model:
    """Built once in each Python worker, which stays for many tasks."""
    return Model(texts)


def gathered(rows: list[tuple[str, str]], chars: int, share: int) -> tuple[tuple[str, str], ...]:
    """Training text by language: at first ``share`` characters of each different text, then the rest, up to ``chars``.

    So a wrongly labelled text, and with it every copy of it, can't explain much.
    """
    texts: dict[str, str] = {}
    rows = list(dict.fromkeys(rows))
    for rest in (False, True):
        for lang, text in rows:
            have = texts.get(lang, "")
            if len(have) < chars:
                texts[lang] = have + (text[share:] if rest else " " + text[:share])[: chars - len(have)]
    return tuple(sorted(texts.items()))


def train(docs: DataFrame, chars: int = TRAIN_CHARS, most: int = TRAIN_TEXTS) -> tuple[tuple[str, str], ...]:
    """Training text of each language from rows (doc_id, text, lang) that may be learned from."""
    rows = docs.where("lang is not null and text is not null and doc_id is not null").select("doc_id", "lang", "text")
    ids = bounded_sample(rows.select("doc_id", "lang"), "doc_id", most, "lang")
    got = rows.join(F.broadcast(ids.select("doc_id").distinct()), "doc_id")  # about ``most`` ids a language
    got = got.select("lang", "doc_id", F.substring("text", 1, chars).alias("text")).orderBy("lang", F.xxhash64("doc_id"), "text").collect()
    return gathered([(r["lang"], r["text"]) for r in got], chars, max(chars // max(most // 4, 1), 1))


def identify(docs: DataFrame, texts: tuple[tuple[str, str], ...]) -> DataFrame:
    """doc_id, lang_pred, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(texts)
        for b in batches:
            langs, scores = model.predict(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op8_langid_crossparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of documents; the held-out quarter is not learned from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = train(docs.where(crc_fold("doc_id", 4) != 2))
    return identify(docs, texts).select("doc_id", F.coalesce(crc_fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
