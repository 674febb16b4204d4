"""Document fingerprints by SimHash, and all pairs of them within a Hamming radius.

A text's terms are its word 5-grams (fewer words: all of them as one). Each term votes, with its count as weight, for
or against each of BITS bits by its own hash; the fingerprint has the bits with a majority. Texts that share a share of
their terms differ in about acos(share) / pi of the bits, so the cosine of that angle estimates the likeness.

``near_pairs``, up to RADIUS: cut into ``blocks`` parts, two fingerprints within the radius agree in blocks - radius parts at least.
For each choice of so many parts a table keyed by them (the fingerprint permuted to put them first) brings the
candidates together, and a candidate's distance is counted in the JVM. Beyond RADIUS the tables would be too many, and
all fingerprints are compared with all that are asked for: exact as well. Every fingerprint is one vertex, however many
documents have it; ``near_counts`` and ``near_documents`` go back to the documents, copies included.

NEAR: a word 5-gram Jaccard of 0.8 is a cosine of about 0.89, so 19.4 differing bits of 128 on average, give or take 4.

Scale: fingerprints are made in a narrow ``mapInArrow``, a bounded number of votes and characters at a time. What needs
the next document in order of doc_id is made where rows are dealt by ranges of doc_id: one shuffle of the texts, and the
edges of the ranges (a text each) meet in a small join. The results are written to the shared folder, which is read
twice. Beyond RADIUS the comparison takes time in proportion to (fingerprints asked for) x (fingerprints); both are
dealt in blocks of BLOCK fingerprints, and every block asked for meets every other one.

Defined results: a null text is empty; a text without words has the fingerprint 0; equal texts have equal fingerprints;
rows with equal doc_id follow each other in the order of their texts, null first; a lone document is its own next; texts
of any length are read whole; other columns, whatever their names, are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from glint.llm.shared import Scratch
from glint.llm.textarrays import _STEP, SMALL, blocks, hashes, mix, shingles, spans

#: Words of a term; bits of a fingerprint (a multiple of 64); the widest radius by tables.
TERM, BITS, RADIUS = 5, 128, 3
#: Bits that fingerprints of near documents may differ in.
NEAR = 24
#: Terms whose votes are added at a time; fingerprints in a block of the comparison; rows and characters of a batch.
VOTES, BLOCK, BATCH_ROWS, BATCH_CHARS = 4096, 4096, 500, 500_000
_LANES = [np.uint64(x) for x in np.random.Generator(np.random.PCG64(5)).integers(1, 2**63, BITS // 64)]


def fingerprints(texts: pa.Array) -> np.ndarray:
    """(texts, BITS / 8) bytes."""
    out = []
    for _, n, buf, off in blocks(texts, SMALL):
        starts, ends, first = spans(buf, off)
        terms, text = shingles(hashes(buf, starts, ends), first, TERM)
        total = np.zeros((n, BITS), np.int32)
        for a in range(0, len(terms), VOTES):  # a text's terms may lie in several parts
            part, of = terms[a : a + VOTES], text[a : a + VOTES]
            lanes = np.stack([mix(part * _STEP[0] + lane) for lane in _LANES], 1)
            bits = np.unpackbits(lanes.view(np.uint8).reshape(len(part), -1), axis=1)
            begin = np.flatnonzero(np.diff(of, prepend=-1))
            total[of[begin]] += np.add.reduceat(bits, begin, axis=0, dtype=np.int32)
        out.append(np.packbits(2 * total > np.bincount(text, minlength=n)[:, None], axis=1))
    return np.concatenate(out) if out else np.zeros((0, BITS // 8), np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated share of common terms, 0 to 1, from the Hamming distance."""
    apart = np.unpackbits(a ^ b, axis=1).sum(1)
    return np.clip(np.cos(np.pi * apart / BITS), 0, 1)


def edited(text: str, after: str) -> str:
    """The last floor(n / 2) code points replaced by the first as many (or all) of the next document."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _rows(ids: list, texts: list[str], after: list[str]) -> pa.RecordBatch:
    new = [edited(a, b) for a, b in zip(texts, after, strict=True)]
    prints = fingerprints(pa.array([*texts, *new, after[-1]] if texts else [], pa.large_string()))
    n = len(texts)
    own, changed = prints[:n], prints[n : 2 * n]
    following = np.concatenate([own[1:], prints[2 * n :]])  # each text's next is the one after it
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new], pa.string()),
            pa.array([p.tobytes().hex() for p in own], pa.string()), pa.array([p.tobytes().hex() for p in changed], pa.string()),
            pa.array(likeness(own, changed), pa.float64()), pa.array(likeness(own, following), pa.float64()),
        ],
        _NAMES,
    )


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of all rows of a sorted range but its last, and the range's first and last row as they are."""
    part, names = TaskContext.get().partitionId(), [*_NAMES, "kind", "part", "text"]
    ids: list = []  # rows not worked off yet; the last one waits for its next
    texts: list[str] = []
    chars, empty = 0, True

    def edge(kind: str, i, text: str) -> pa.RecordBatch:
        none = [pa.array([None], pa.string()) if k in (2, 3, 4) else pa.array([None], pa.float64() if k > 4 else pa.int64()) for k in range(1, 7)]
        return pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), *none, pa.array([kind]), pa.array([part], pa.int32()), pa.array([text], pa.string())], names)

    def done() -> pa.RecordBatch:
        n = len(ids) - 1
        made = _rows(ids[:n], texts[:n], texts[1:])
        return pa.RecordBatch.from_arrays([*made.columns, pa.array(["row"] * n), pa.array([part] * n, pa.int32()), pa.nulls(n, pa.string())], names)

    for b in batches:
        for i, text in zip(b.column("doc_id"), b.column("text"), strict=True):
            i, text = i.as_py(), text.as_py() or ""
            if empty:
                yield edge("first", i, text)
            empty = False
            ids.append(i)
            texts.append(text)
            chars += len(text)
            if len(ids) > 1 and (chars > BATCH_CHARS or len(ids) > BATCH_ROWS):
                yield done()
                ids, texts, chars = ids[-1:], texts[-1:], len(text)
    if len(ids) > 1:
        yield done()
    if not empty:
        yield edge("last", ids[-1], texts[-1])


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, t, x in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("after").to_pylist(), strict=True):
            yield _rows([i], [t], [x])


def compare_with_next(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints, near_edited and near_next, for all rows."""
    dealt = docs.select("doc_id", "text").repartitionByRange("doc_id", F.col("text").isNotNull(), F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    made = scratch.write(dealt.mapInArrow(_within, f"{_SCHEMA}, kind string, part int, text string"))
    # each range's last row meets the first of the next range that has rows; only the ranges' numbers are put in order
    parts = made.where("kind = 'first'").select("part")
    after = F.lead("part").over(Window.orderBy("part"))
    parts = parts.select("part", F.coalesce(after, F.min("part").over(Window.partitionBy())).alias("next"))
    firsts = made.where("kind = 'first'").select(F.col("part").alias("next"), F.col("text").alias("after"))
    edges = made.where("kind = 'last'").select("doc_id", "text", "part").join(parts, "part").join(firsts, "next")
    return made.where("kind = 'row'").select(*_NAMES).unionByName(edges.select("doc_id", "text", "after").mapInArrow(_edges, _SCHEMA))


def tables(n: int, radius: int = RADIUS, bits: int = BITS) -> list[list[int]]:
    """Choices of parts, as lists of bit positions, for about n fingerprints: the fewest tables whose keys tell n apart."""
    for parts in range(radius + 1, 2 * radius + 8):
        cuts = [bits * i // parts for i in range(parts + 1)]
        keep = parts - radius
        if keep * (bits // parts) >= min(np.log2(max(n, 2)) + 2, bits // 2):
            break
    return [[b for p in choice for b in range(cuts[p], cuts[p + 1])] for choice in combinations(range(parts), keep)]


def near_pairs(prints: DataFrame, radius: int = RADIUS, queries: DataFrame | None = None) -> DataFrame:
    """a, b, distance: all pairs of different fingerprints (hex strings) within the radius, each once (a < b).

    With ``queries`` (a column fingerprint): those pairs of a query (a) and another of ``prints`` (b).
    """
    prints = prints.select("fingerprint").where("fingerprint is not null").distinct()
    if radius > RADIUS:
        asked = prints if queries is None else queries.select("fingerprint")
        found = _compared(_packed(asked, "asked"), _packed(prints, "prints"), _pairs_within(radius), "a string, b string, distance int")
        return found.where("a < b" if queries is None else "a != b")
    binary = F.concat(*[F.lpad(F.conv(F.substring("fingerprint", 1 + 8 * i, 8), 16, 2), 32, "0") for i in range(BITS // 32)])
    chosen = tables(prints.count(), radius)

    def keyed(d: DataFrame, name: str) -> DataFrame:
        cut = lambda choice: F.concat(*[F.substring("_bits", lo + 1, hi - lo) for lo, hi in _runs(choice)])
        keys = F.array(*[F.xxhash64(F.lit(t), cut(c)) for t, c in enumerate(chosen)])
        return d.withColumn("_bits", binary).select(F.col("fingerprint").alias(name), F.explode(keys).alias("key"))

    left = keyed(queries.select("fingerprint").where("fingerprint is not null").distinct() if queries is not None else prints, "a")
    pairs = left.join(keyed(prints, "b"), "key").where("a != b" if queries is not None else "a < b")
    parts = [F.bit_count(F.conv(F.substring("a", 1 + 8 * i, 8), 16, 10).cast("long").bitwiseXOR(F.conv(F.substring("b", 1 + 8 * i, 8), 16, 10).cast("long"))) for i in range(BITS // 32)]
    distance = parts[0]
    for p in parts[1:]:
        distance = distance + p
    return pairs.select("a", "b", distance.alias("distance")).where(F.col("distance") <= radius).distinct()


def _lanes(prints: list[str]) -> np.ndarray:
    """(fingerprints, BITS / 64) words."""
    return _words(bytes.fromhex("".join(prints)))


def _words(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64).reshape(-1, BITS // 64)


def within(left: np.ndarray, right: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Positions in left and in right, and distances, of all pairs within the radius, a block of pairs at a time."""
    for a in range(0, len(left), 256):
        for b in range(0, len(right), 2048):
            x, y = left[a : a + 256], right[b : b + 2048]
            apart = np.bitwise_count(x[:, 0, None] ^ y[None, :, 0])
            i, j = np.divmod(np.flatnonzero(apart <= radius), len(y))  # the first word alone leaves few
            apart = apart[i, j].astype(np.int32)
            for w in range(1, BITS // 64):
                apart += np.bitwise_count(x[i, w] ^ y[j, w])
            ok = apart <= radius
            yield i[ok] + a, j[ok] + b, apart[ok]


def _packed(prints: DataFrame, name: str, counted: bool = False) -> DataFrame:
    """Blocks of up to BLOCK fingerprints: ``name``, their bytes, and if ``counted`` n, how many rows have each."""
    names = [name, *["n"] * counted]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, BLOCK):
                part = b.slice(a, BLOCK)
                yield pa.RecordBatch.from_arrays([pa.array([_lanes(part.column("fingerprint").to_pylist()).tobytes()], pa.binary()), *(pa.array([part.column(c).to_pylist()]) for c in names[1:])], names)

    prints = prints.where("fingerprint is not null").groupBy("fingerprint").agg(F.count("*").alias("n"))
    return prints.mapInArrow(run, f"{name} binary" + ", n array<long>" * counted)


def _compared(asked: DataFrame, prints: DataFrame, run, schema: str) -> DataFrame:
    """``run`` over all pairs of a block asked for and a block of ``prints``: the stated queries against all rows, in blocks."""
    return asked.crossJoin(prints).mapInArrow(run, schema)


def _pairs_within(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column("asked"), batch.column("prints"), strict=True):
                x, y = x.as_py(), y.as_py()
                for i, j, apart in within(_words(x), _words(y), radius):
                    if len(i):
                        text = lambda raw, at: pa.array([raw[16 * k : 16 * k + 16].hex() for k in at.tolist()], pa.string())
                        yield pa.RecordBatch.from_arrays([text(x, i), text(y, j), pa.array(apart, pa.int32())], ["a", "b", "distance"])

    return run


def _counts_within(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y, rows in zip(batch.column("asked"), batch.column("prints"), batch.column("n"), strict=True):
                x, y, rows = x.as_py(), y.as_py(), np.array(rows.as_py(), np.int64)
                n = np.zeros(len(x) // 16, np.int64)
                for i, j, _ in within(_words(x), _words(y), radius):
                    np.add.at(n, i, rows[j])
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([x[16 * k : 16 * k + 16].hex() for k in some.tolist()], pa.string()), pa.array(n[some])], ["a", "n"])

    return run


def near_counts(docs: DataFrame, asked: DataFrame, radius: int = NEAR) -> DataFrame:
    """a (a fingerprint of ``asked``), n: how many rows of ``docs`` lie within the radius, its own and copies too."""
    found = _compared(_packed(asked, "asked"), _packed(docs, "prints", counted=True), _counts_within(radius), "a string, n long")
    return found.groupBy("a").agg(F.sum("n").alias("n"))


def near_documents(docs: DataFrame, asked: DataFrame | None = None, radius: int = NEAR) -> DataFrame:
    """doc_id, near_id, distance: all pairs of documents within the radius, copies too; each once (doc_id < near_id).

    ``docs`` and ``asked``: doc_id, fingerprint. With ``asked``: those pairs of one asked for and another. Rows with
    equal doc_id are one document, as near as its nearest text; rows without doc_id have no pairs.
    """
    rows = lambda d: d.select("doc_id", "fingerprint").where("doc_id is not null").distinct()
    left = rows(docs if asked is None else asked)
    pairs = near_pairs(docs, radius, left)
    pairs = pairs.unionByName(left.select(F.col("fingerprint").alias("a"), F.col("fingerprint").alias("b")).distinct().withColumn("distance", F.lit(0)))
    out = left.withColumnRenamed("fingerprint", "a").join(pairs, "a").join(rows(docs).select(F.col("fingerprint").alias("b"), F.col("doc_id").alias("near_id")), "b")
    return out.where("doc_id < near_id" if asked is None else "doc_id != near_id").groupBy("doc_id", "near_id").agg(F.min("distance").alias("distance"))


def _runs(positions: list[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for p in positions:
        if out and out[-1][1] == p:
            out[-1][1] = p + 1
        else:
            out.append([p, p + 1])
    return [(a, b) for a, b in out]


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, compared with their edited texts' and their successors'.

    ``n_near``, for the documents whose id is divisible by 20: how many other rows' fingerprints lie within NEAR bits,
    copies included.
    """
    scratch = Scratch(spark)
    made = scratch.write(compare_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch))
    near = near_counts(made, made.where("doc_id % 20 = 0")).select(F.col("a").alias("_a"), "n")
    d = made.join(near, (F.col("fingerprint") == F.col("_a")) & (F.col("doc_id") % 20 == 0), "left")
    return d.select(*_NAMES, F.when(F.col("doc_id") % 20 == 0, F.col("n") - 1).alias("n_near"))
