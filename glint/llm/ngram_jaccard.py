"""N-gram Jaccard join: documents whose sets of word n-grams overlap enough, as connected components.

The steps are those of prefix filtering (PPJoin+):

* An n-gram is a 53-bit hash of its words; a document's set is kept as its sorted hashes. Documents with equal sets are
  one vertex from the start: exact copies cost nothing later.
* Rare first: how often the n-grams occur in all documents is counted into ``CELLS`` cells by hash. A document's
  n-grams are ordered by their cell's count, then by hash, which is one order for all documents; the prefix is so long
  that two sets with the needed overlap must share an n-gram in their prefixes.
* Members of a prefix n-gram are candidates (``linking``: each with the bucket's pivot, then what is left between
  different components). Only pairs that pass the length, positional and suffix filters become rows. The suffix filter
  is then applied again with bitmaps as wide as the sets, since a sketch of fixed width tells nothing of large ones,
  and what is left is verified once by its whole sets.

Scale: the counts are arrays of a fixed number of cells, summed by slab; with many more n-grams than cells the order
tells less and buckets grow, but results stay. The n-gram buckets that only one set has are dropped by an aggregation
with map-side combining and an exact semi-join. Whole sets are made again only for documents of pairs that the filters
leave, one for each set. A vertex id is a 64-bit hash of the set: two different sets meet with odds of n^2 / 2^65.
Sets hold 53-bit hashes of n-grams, and it is these that are verified: n-grams of one pair meet with odds of n^2 / 2^54.

Defined results: null and empty texts have empty sets and no links; a text of fewer words than n has its whole sequence
as one n-gram; rows with equal ids are linked like others; texts of any length are read whole; extra columns, whatever their names, are
left out by ``join`` and kept by ``drop_copies``; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glint.llm.linking import SKETCH, linked, shared_buckets, sketch_distance
from glint.llm.shared import Scratch, fresh, lean, small_batches
from glint.llm.textarrays import SMALL, blocks, hashes, mix, shingles, signed, spans

#: Cells of the occurrence counts, and the slabs that they are summed in.
CELLS, SLABS = 1 << 21, 32
_HASH_BITS = np.uint64(53)
_MASK = np.uint64((1 << 53) - 1)


def sets(column: pa.Array, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each block of texts: all their distinct n-grams, sorted within each text, and the index of each text's first."""
    for _, rows, buf, off in blocks(column, SMALL):
        starts, ends, first = spans(buf, off)
        grams, text = shingles(hashes(buf, starts, ends), first, n)
        key = np.sort((text.astype(np.uint64) << _HASH_BITS) | (grams >> np.uint64(11)))
        if len(key):
            key = key[np.concatenate([[True], key[1:] != key[:-1]])]
        yield key & _MASK, np.searchsorted(key >> _HASH_BITS, np.arange(rows + 1, dtype=np.uint64))


def set_ids(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set; of an empty one, 0."""
    size = np.diff(first)
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(grams * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)))])
    out = mix(total[first[1:]] - total[first[:-1]] + size.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return np.where(size > 0, out, np.uint64(0))


def occurrences(docs: DataFrame, n: int, cells: int = CELLS) -> np.ndarray:
    """How often n-grams of each cell occur in all documents, up to 65,535."""
    width = cells // SLABS

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int32)
        for b in batches:
            for grams, _ in sets(b.column("text"), n):
                np.add.at(total, (grams & np.uint64(cells - 1)).astype(np.int64), 1)
        if total.any():
            low = np.minimum(total, 65535).astype("<u2").reshape(SLABS, width)
            yield pa.RecordBatch.from_arrays([pa.array(range(SLABS), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in low], pa.binary())], ["slab", "counts"])

    def add(key, table):  # a slab: one small array from each task
        total = np.zeros(width, np.int64)
        for x in table.column("counts").to_pylist():
            total += np.frombuffer(zlib.decompress(x), "<u2")
        return pa.table({"slab": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([zlib.compress(np.minimum(total, 65535).astype("<u2").tobytes(), 1)], pa.binary())})

    with small_batches(docs.sparkSession):
        parts = docs.select("text").mapInArrow(count, "slab int, counts binary").groupBy("slab").applyInArrow(add, "slab int, counts binary").collect()
    out = np.zeros((SLABS, width), "<u2")
    for r in parts:  # SLABS rows of a fixed size
        out[r["slab"]] = np.frombuffer(zlib.decompress(r["counts"]), "<u2")
    return out.ravel()


@lru_cache(maxsize=1)
def _classes(packed: bytes) -> np.ndarray:
    """Counts to 5-bit classes of growing width: their order is all that matters."""
    counts = np.frombuffer(zlib.decompress(packed), "<u2").astype(float)
    return np.minimum(np.log2(counts + 1) * 1.9, 31).astype(np.uint64)


def prefixes(grams: np.ndarray, first: np.ndarray, classes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, n-gram, position) of all prefixes, rarest first."""
    size = np.diff(first)
    text = np.repeat(np.arange(len(size)), size)
    kind = classes[(grams & np.uint64(len(classes) - 1)).astype(np.int64)]
    key = (text.astype(np.uint64) << _HASH_BITS) | (kind << np.uint64(48)) | (mix(grams) >> np.uint64(16))
    order = np.argsort(key, kind="stable")
    place = np.arange(len(grams)) - first[:-1][text]
    long = size - -(-percent * size // 100) + 1
    keep = place < long[text]
    return text[keep], grams[order][keep], place[keep]


def sketches(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """SKETCH words for each set: a bit is set where an odd number of its n-grams fall."""
    n, bits = len(first) - 1, SKETCH * 64
    of = np.repeat(np.arange(n), np.diff(first))
    out = np.zeros((n, SKETCH), np.uint64)
    for a in range(0, n, 512):
        lo, hi = first[a], first[min(a + 512, n)]
        count = np.bincount((of[lo:hi] - a) * bits + (mix(grams[lo:hi]) % np.uint64(bits)).astype(np.int64), minlength=min(512, n - a) * bits)
        out[a : a + 512] = np.packbits((count & 1).astype(bool)).view(np.uint64).reshape(-1, SKETCH)
    return out


def bitmaps(grams: np.ndarray, first: np.ndarray) -> pa.Array:
    """A bitmap of each set, as wide as the set is large: the next power of two, 64 bits at least.

    A bit is set where an odd number of n-grams fall. A wider one folds to the width of a narrower one.
    """
    size = np.diff(first)
    wide = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
    cut = np.concatenate([[0], np.cumsum(wide)])
    of = np.repeat(np.arange(len(size)), size)
    bit = cut[:-1][of] + (mix(grams) & (wide[of] - 1).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(bit, minlength=cut[-1]) & 1).astype(bool)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((cut // 8).astype(np.int32)), pa.py_buffer(np.packbits(odd, bitorder="little"))])


def differing(x: np.ndarray, y: np.ndarray) -> int:
    """In how many bits two bitmaps differ, folded to one width: never more than their sets differ in elements."""
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


_WORDS = [f"s{i}" for i in range(SKETCH)]


def _may_link(percent: int) -> str:
    """The length, positional and suffix filters. a_pos: an n-gram's place in the rarest-first order of its set.

    The suffix filter is a least Hamming distance of the sets, from their sketches.
    """
    need = f"(({percent} * (a_n + b_n) + {99 + percent}) div {100 + percent})"
    length = f"100 * a_n >= {percent} * b_n and 100 * b_n >= {percent} * a_n"
    place = f"least(a_pos, b_pos) + 1 + least(a_n - a_pos - 1, b_n - b_pos - 1) >= {need}"
    return f"{length} and {place} and {sketch_distance()} <= a_n + b_n - 2 * {need}"


def groups(docs: DataFrame, scratch: Scratch, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, tag (xxhash64 of the text), n_shingles, component (a number for each group of linked sets) of all rows."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("tag"))
    packed = zlib.compress(occurrences(docs, n).tobytes(), 1)

    @lean
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row a document: its set's id and size, its prefix n-grams in their order, and its sketch."""
        classes = _classes(packed)
        for b in batches:
            row = 0
            for grams, first in sets(b.column("text"), n):
                ids, size = set_ids(grams, first), np.diff(first)
                text, gram, _ = prefixes(grams, first, classes, percent)
                words = sketches(grams, first)
                own = [b.column(c).slice(row, len(size)) for c in ("doc_id", "tag")]
                row += len(size)
                out = [*own, pa.array(signed(ids)), pa.array(size, pa.int64()), _lists(signed(gram), np.searchsorted(text, np.arange(len(size) + 1)), pa.int64())]
                out += [bitmaps(grams, first), *(pa.array(signed(words[:, i])) for i in range(SKETCH))]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "tag", "vertex", "n_shingles", "grams", "bits", *_WORDS])

    schema = f"doc_id long, tag long, vertex long, n_shingles long, grams array<long>, bits binary, {', '.join(f'{w} long' for w in _WORDS)}"
    base = scratch.write(docs.mapInArrow(rows, schema))
    one = scratch.write(base.where("n_shingles > 0").select("vertex", F.col("n_shingles").alias("n"), "grams", "bits", *_WORDS).dropDuplicates(["vertex"]))
    scratch.release()
    wide = scratch.write(one.select("vertex", "n", "bits"))
    members = one.select("vertex", F.posexplode("grams").alias("pos", "bucket"))
    members = members.join(shared_buckets(members), "bucket", "left_semi")
    members = scratch.write(members)
    scratch.release()
    narrow = members
    members = scratch.write(members.join(one.drop("grams", "bits"), "vertex"))
    scratch.drop(one, narrow)
    scratch.release()

    @lean
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for grams, first in sets(b.column("text"), n):
                yield pa.RecordBatch.from_arrays([pa.array(signed(set_ids(grams, first))), _lists(signed(grams), first, pa.int64())], ["vertex", "grams"])

    def close(pairs: DataFrame) -> DataFrame:
        """The pairs whose bitmaps leave them a chance; a bitmap is a fiftieth of the set."""
        ends = scratch.sized(_ends(pairs))
        hubs = scratch.sized(pairs.select(F.col("hub").alias("vertex")).distinct())
        hubs = wide.join(hubs, "vertex", "left_semi").select(F.col("vertex").alias("hub"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"))
        both = wide.join(ends, "vertex").select("a", "b", "hub", F.col("n").alias("n_a"), F.col("bits").alias("bits_a")).join(hubs, "hub")
        out = scratch.write(both.mapInArrow(_close(percent), "a long, b long, hub long"))
        scratch.release()
        return out

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = close(pairs)
        needed = pairs.select(F.explode(F.array("a", "b")).alias("vertex")).distinct()
        at = base.join(needed, "vertex", "left_semi").groupBy("vertex").agg(F.min(F.struct("doc_id", "tag")).alias("at"))
        at = scratch.sized(at.select(F.col("at.doc_id").alias("_id"), F.col("at.tag").alias("_tag")))
        texts = docs.join(at, (F.col("tag") == F.col("_tag")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select("text")
        made = scratch.write(texts.mapInArrow(whole, "vertex long, grams array<long>"))
        if made.count() > needed.count():  # rows that are equal in doc_id and text
            made = scratch.write(made.dropDuplicates(["vertex"]))
        # the whole set travels for one end of each pair, to meet its hub's
        ends = scratch.sized(_ends(pairs))
        hubs = scratch.sized(pairs.select(F.col("hub").alias("vertex")).distinct())
        hubs = made.join(hubs, "vertex", "left_semi").select(F.col("vertex").alias("hub"), F.col("grams").alias("grams_b"))
        both = made.join(ends, "vertex").select("a", "b", "hub", F.col("grams").alias("grams_a")).join(hubs, "hub")
        found = scratch.write(both.mapInArrow(_verified(percent), "a long, b long"))
        scratch.drop(made)
        scratch.release()
        return found

    found = linked(members, verify, _may_link(percent), scratch)
    scratch.drop(members, wide)
    scratch.release()
    d = base.select("doc_id", "tag", "vertex", "n_shingles").join(found, "vertex", "left")
    return d.select("doc_id", "tag", "n_shingles", F.coalesce("component", "vertex").alias("component"))


def join(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id: two documents link when 100 * intersection >= percent * union."""
    found = groups(docs, Scratch(docs.sparkSession), n, percent)
    # the least doc_id of a group, by an aggregation that combines before it shuffles
    least = found.where("n_shingles > 0").groupBy("component").agg(F.min("doc_id").alias("least"))
    d = found.join(least, "component", "left")
    return d.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def _lists(flat: np.ndarray, cut: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(flat, kind))


def _ends(pairs: DataFrame) -> DataFrame:
    """a, b, hub, and as vertex the one of the two that isn't the hub."""
    return pairs.select("a", "b", "hub", F.when(F.col("a") == F.col("hub"), F.col("b")).otherwise(F.col("a")).alias("vertex"))


def _close(percent: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total = b.column("n_a").to_numpy() + b.column("n_b").to_numpy()
            most = total - 2 * -(-percent * total // (100 + percent))
            maps = zip(b.column("bits_a"), b.column("bits_b"), strict=True)
            keep = [differing(*(np.frombuffer(v.as_buffer(), np.uint64) for v in pair)) <= most[i] for i, pair in enumerate(maps)]
            yield b.select(["a", "b", "hub"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(percent: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets_of = [(c.values.to_numpy(), c.offsets.to_numpy()) for c in (b.column("grams_a"), b.column("grams_b"))]
            keep = np.zeros(b.num_rows, bool)
            for i in range(b.num_rows):
                x, y = (flat[cut[i] : cut[i + 1]] for flat, cut in sets_of)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = 100 * common >= percent * (len(x) + len(y) - common)
            yield b.select(["a", "b"]).filter(pa.array(keep))

    return run


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents by three-word shingles at a Jaccard similarity of 0.9."""
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=3, percent=90)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str, n: int = 5, percent: int = 80) -> DataFrame:
    """Pipeline stage: of each component one row stays, that with the least doc_id (null last; of equal ids, the least hash of the text).

    Rows are told apart by doc_id and text, so rows that share an id and nothing else all stay. Rows equal in both are
    copies of each other: one of them stays. Rows without words stay, all of them.
    """
    scratch = Scratch(spark)
    found = scratch.write(groups(docs, scratch, n, percent).where("n_shingles > 0"))
    kept = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")).alias("kept"))
    rows = found.groupBy("doc_id", "tag", "component").count().join(kept, "component")
    mine = F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("tag") == F.col("kept.tag"))
    key, tag, state = fresh(docs, "key", "tag", "state")
    # 0: a copy, 1: kept but several times
    rows = rows.select(F.col("doc_id").alias(key), F.col("tag").alias(tag), F.when(~mine, 0).when(F.col("count") > 1, 1).alias(state)).where(F.col(state).isNotNull())
    d = docs.withColumn(f"{tag}t", F.xxhash64("text"))
    d = d.join(scratch.write(rows), (F.col(f"{tag}t") == F.col(tag)) & F.col("doc_id").eqNullSafe(F.col(key)), "left")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    once = d.where(F.col(state) == 1).dropDuplicates([key, tag]).select(*columns)
    return d.where(F.col(state).isNull()).select(*columns).unionByName(once)
