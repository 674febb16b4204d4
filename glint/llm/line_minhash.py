"""Line dedup: near-equal lines of all documents by MinHash, one line kept of each component.

A line's signature comes from its character shingles by one permutation: each shingle's hash falls into one of
BANDS x ROWS bins, the bin keeps its least hash, and an empty bin takes the value of another bin that the line has,
chosen by a fixed order of bins. Lines that agree in a band of ROWS bins are candidates of each other; candidates are
verified by the exact Jaccard similarity of their shingle sets, links become components by distributed star
contraction, and of each component the first line (least doc_id, then line number) stays. Equal lines are one vertex
from the start.

At a similarity of 0.8 a pair shares a band with odds of 1 - (1 - 0.8^3)^9 > 0.998.

Scale: the texts are read three times: for bands, for the lines' places, and for the lines that have a candidate.
Bands travel packed, 12 bytes each, dealt into ``SLABS`` by their hash; where only one line has a band it ends there.
Bands with the same lines are one bucket. Lines that have a candidate travel once for each of their buckets, and all
pairs of a bucket are compared where its lines meet, so no pair is ever a row. A bucket of more than ``MOST`` lines is
compared in parts that each hold its first line too, and then, if its lines are in several components still, by all
pairs of parts: that is exact, and alone grows with the square of a group of lines that are nearly, but not quite,
alike. The lines to drop come back as numbers by document; texts are shuffled once, to meet them. A vertex is a 64-bit
hash of its line: n different ones collide with odds of n^2 / 2^65, and shingles are compared by 52 bits of their
hash within a pair, by 64 within a larger bucket. Bands are told apart by 44 bits; those that meet by chance cost a
comparison and change no result.

Defined results: lines end at \\n and are compared with runs of white space as one and ends stripped; a blank line is
never dropped. A line with fewer than SHINGLE characters is its own only shingle: equal lines alone are like it. Lines
and texts of any length are read whole. A null text stays null, and rows with a null doc_id stay as they are; rows with
equal doc_id are told apart by their texts, and rows equal in both are one document. Dropping all lines leaves an empty
text. The order of lines stays. An empty table gives an empty result. All columns are kept, whatever their names; only
the two counts that ``dedup`` adds may not clash, and their names are parameters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glint.llm.linking import SKETCH, components
from glint.llm.shared import Scratch, fresh, lean
from glint.llm.textarrays import SMALL, blocks, mix, signed, starts_of_codepoints

SHINGLE, BANDS, ROWS = 8, 9, 3
PERCENT = 80
#: Bits of the widest sketch. Lines with more than half as many shingles are told apart less well before they are verified.
WIDEST = 1 << 14
#: The bands' hashes are dealt into so many slabs; lines whose bands are packed at once, and bytes of bands sorted at once.
SLABS, HELD, SORTED = 1 << 12, 100_000, 24_000_000
#: Lines of a bucket that are compared at once, those of a bucket that is compared pair by pair, bytes of lines in a
#: step, and shingles in a block of the table of which line has which.
MOST, FEW, STEP, COLUMNS = 1024, 6, 2_000_000, 1 << 14

_rng = np.random.Generator(np.random.PCG64(77))
_BINS = BANDS * ROWS
#: For each bin the order in which others stand in for it.
_INSTEAD = np.stack([np.concatenate([[b], _rng.permutation([x for x in range(_BINS) if x != b])]) for b in range(_BINS)])
_EMPTY = np.uint32(0xFFFFFFFF)


class Lines:
    """The lines of a block of texts that aren't blank: normalised bytes, document (row), number and hash."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        texts = buf.tobytes()
        odd = any(c in texts for c in (b"\t", b"\x0b", b"\x0c", b"\r"))
        self.lines, self.row, self.number = [], [], []
        for i in range(len(off) - 1):
            for j, line in enumerate(texts[off[i] : off[i + 1]].split(b"\n")):
                line = b" ".join(line.split()) if odd or b"  " in line else line.strip(b" ")
                if line:
                    self.lines.append(line)
                    self.row.append(i)
                    self.number.append(j)
        self.ids = np.fromiter(map(xxhash.xxh3_64_intdigest, self.lines), np.uint64, len(self.lines))


def char_shingles(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of SHINGLE characters running, line by line, and how many each line has. Characters are code points."""
    joined = b"".join(lines)
    ends = np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines)))
    if joined.isascii():
        h = np.frombuffer(joined, np.uint8).astype(np.uint64)
    else:
        before = np.concatenate([[0], np.cumsum(starts_of_codepoints(np.frombuffer(joined, np.uint8)))])
        ends = before[ends]
        h = np.frombuffer(joined.decode().encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.diff(ends, prepend=0)
    h += np.uint64(1)
    step, width = np.uint64(0x9E3779B97F4A7C15), 1
    while width < SHINGLE:  # runs of twice the length from runs that follow each other
        h = h[:-width] * step + h[width:] if len(h) > width else h[:0]
        step, width = np.uint64(int(step) ** 2 % 2**64), width * 2
    inside = np.ones(int(size.sum()), bool)  # a run that begins near a line's end would go on into the next
    for back in range(1, SHINGLE):
        inside[ends[size >= back] - back] = False
    return mix(h[inside[: len(h)]]), np.maximum(size - SHINGLE + 1, 0)


def bands(h: np.ndarray, made: np.ndarray) -> np.ndarray:
    """A row of BANDS bucket hashes for each line, from its shingles; every line has some."""
    n = len(made)
    line = np.repeat(np.arange(n), made)
    cell = line * _BINS + (((h & np.uint64(0xFFFF)) * np.uint64(_BINS)) >> np.uint64(16)).astype(np.int64)
    sign = np.full(n * _BINS, _EMPTY)
    np.minimum.at(sign, cell, (h >> np.uint64(32)).astype(np.uint32))
    sign = sign.reshape(n, _BINS)
    full = sign != _EMPTY
    for b in range(_BINS):
        empty = np.flatnonzero(~full[:, b])
        if len(empty):
            other = full[empty][:, _INSTEAD[b]].argmax(1)
            sign[empty, b] = sign[empty, _INSTEAD[b][other]]
    keys = np.zeros((n, BANDS), np.uint64)
    for r in range(ROWS):
        keys = mix(keys * np.uint64(31) + sign[:, r::ROWS] + np.arange(BANDS, dtype=np.uint64))
    return keys


def signatures(h: np.ndarray, made: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bands of each line, and a sketch of it in SKETCH words."""
    n = len(made)
    bits = np.zeros(n * SKETCH * 64, bool)
    bits[np.repeat(np.arange(n), made) * (SKETCH * 64) + ((h >> np.uint64(16)) % np.uint64(SKETCH * 64)).astype(np.int64)] = True
    return bands(h, made), np.packbits(bits).view(np.uint64).reshape(n, SKETCH)


def wide_sketches(h: np.ndarray, made: np.ndarray) -> pa.ListArray:
    """Words of a sketch of two to four bits a shingle for lines that SKETCH words are too few for; none for others.

    The first half of a sketch folded onto the second is the sketch of half the width.
    """
    bits = np.minimum(1 << np.ceil(np.log2(np.maximum(2 * made, 1))).astype(np.int64), WIDEST)
    bits[bits <= SKETCH * 64] = 0
    cut = np.concatenate([[0], np.cumsum(bits)])
    line = np.repeat(np.arange(len(made)), made)
    keep = bits[line] > 0
    line, field = line[keep], np.zeros(cut[-1], bool)
    field[cut[:-1][line] + ((h[keep] >> np.uint64(16)) & (bits[line] - 1).astype(np.uint64)).astype(np.int64)] = True
    return pa.ListArray.from_arrays(pa.array(cut // 64, pa.int32()), pa.array(signed(np.packbits(field).view(np.uint64))))


_PLACES = "doc_id long, tag long, line_no long, vertex long"
_BAND = np.dtype([("band", "<u4"), ("vertex", "<u8")])


def _packed(keys: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """slab, data: the bands of lines and their vertices, by slab."""
    ids, at = np.unique(ids, return_index=True)
    keys = keys[at].ravel()
    slab = (keys >> np.uint64(52)).astype(np.uint16)
    order = np.argsort(slab, kind="stable")
    data = np.empty(len(keys), _BAND)
    data["band"], data["vertex"] = keys[order].astype(np.uint32), ids[order // BANDS]
    here, first = np.unique(slab[order], return_index=True)
    cut = np.concatenate([first, [len(keys)]]) * _BAND.itemsize
    column = pa.Array.from_buffers(pa.binary(), len(here), [None, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(data.view(np.uint8))])
    return pa.RecordBatch.from_arrays([pa.array(here.astype(np.int32)), column], ["slab", "data"])


@lean
def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """slab, data of all lines that have a shingle."""
    keys, ids, n = [], [], 0
    for b in batches:
        for _, _, buf, off in blocks(b.column("text"), SMALL):
            lines = Lines(buf, off)
            _, at = np.unique(lines.ids, return_index=True)
            h, made = char_shingles([lines.lines[i] for i in at])
            at, made = at[made > 0], made[made > 0]  # shorter ones can only be equal, and equal lines are one vertex
            if len(at):
                keys.append(bands(h, made))
                ids.append(lines.ids[at])
                n += len(at)
            if n >= HELD:
                yield _packed(np.concatenate(keys), np.concatenate(ids))
                keys, ids, n = [], [], 0
    if n:
        yield _packed(np.concatenate(keys), np.concatenate(ids))


def _whole(batches: Iterator[pa.RecordBatch], keys: list[str], most: int) -> Iterator[pa.Table]:
    """Rows sorted by keys, in tables of about ``most`` bytes that hold all rows of their keys."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        step = max(1, most * b.num_rows // max(b.nbytes, 1))
        for a in range(0, b.num_rows, step):
            part = b.slice(a, step)
            same = np.ones(part.num_rows, bool)
            for k in keys:
                column = part.column(k).to_numpy()
                same &= column == column[-1]
            cut = int(part.num_rows - same[::-1].argmin()) if not same.all() else 0  # first row of the last key
            if cut == 0 and held and any(held[-1].column(k)[-1] != part.column(k)[0] for k in keys):
                yield pa.Table.from_batches(held)
                held = []
            if cut:
                yield pa.Table.from_batches([*held, part.slice(0, cut)])
                held = []
            held.append(part.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _buckets(most: int):
    """bucket, part, vertex of the bands that several lines have; bands of the same lines are the same bucket."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole(batches, ["slab"], SORTED):
            rows = [np.frombuffer(x, _BAND) for x in t.column("data").to_pylist()]
            slab = np.repeat(t.column("slab").to_numpy().astype(np.uint64), [len(x) for x in rows])
            rows = np.concatenate(rows)
            key, vertex = (slab << np.uint64(32)) | rows["band"], rows["vertex"]
            order = np.argsort(key)
            key, vertex = key[order], vertex[order]
            again = key[1:] == key[:-1]
            shared = np.concatenate([[False], again]) | np.concatenate([again, [False]])
            key, vertex = key[shared], vertex[shared]
            order = np.lexsort((vertex, key))
            key, vertex = key[order], vertex[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (vertex[1:] != vertex[:-1])
            key, vertex = key[new], vertex[new]
            if not len(key):
                continue
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.concatenate([first, [len(key)]]))
            bucket = mix(np.add.reduceat(mix(vertex * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)), first) + size.astype(np.uint64))
            rank = np.arange(len(key)) - np.repeat(first, size)
            keep = np.repeat(size > 1, size)
            parts = (size - 1) // most  # besides the first; the first line is in each
            pivots = np.repeat(np.arange(len(first)), np.where(size > 1, parts, 0))
            which = np.arange(len(pivots)) - np.repeat(np.cumsum(parts) - parts, parts) + 1
            columns = [
                np.concatenate([signed(np.repeat(bucket, size)[keep]), signed(bucket[pivots])]),
                np.concatenate([(rank // most)[keep], which]).astype(np.int32),
                np.concatenate([signed(vertex[keep]), signed(vertex[first[pivots]])]),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["bucket", "part", "vertex"])

    return run


@lean
def _fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vertex, line of the lines with the numbers asked for."""
    for b in batches:
        ids, lines = [], []
        for text, numbers in zip(b.column("text").to_pylist(), b.column("numbers").to_pylist(), strict=True):
            parts = text.encode().split(b"\n")
            lines += [b" ".join(parts[j].split()) for j in numbers]
        ids = np.fromiter(map(xxhash.xxh3_64_intdigest, lines), np.uint64, len(lines))
        yield pa.RecordBatch.from_arrays([pa.array(signed(ids)), pa.array([x.decode() for x in lines], pa.string())], ["vertex", "line"])


def similar(left: list[str], right: list[str], percent: int) -> np.ndarray:
    """Whether the shingle sets of each pair of lines are so much alike. Shorter lines are like equal ones only."""
    n = len(left)
    h, made = char_shingles([x.encode() for x in (*left, *right)])
    pair = np.repeat(np.arange(2 * n) % max(n, 1), made).astype(np.uint64)
    side = np.repeat(np.arange(2 * n) >= n, made)
    shift = np.uint64(max(12, (max(n, 1) - 1).bit_length()))
    key = (pair << (np.uint64(64) - shift)) | (h >> shift)
    x, y = np.unique(key[~side]), np.unique(key[side])
    sizes = [np.bincount((k >> (np.uint64(64) - shift)).astype(np.int64), minlength=n) for k in (x, y, np.intersect1d(x, y, assume_unique=True))]
    return (sizes[2] > 0) & (100 * sizes[2] >= percent * (sizes[0] + sizes[1] - sizes[2]))


def _sketched(h: np.ndarray, made: np.ndarray) -> np.ndarray:
    """A row of WIDEST bits, as words, for each line."""
    n, ends = len(made), np.cumsum(made)
    out = np.zeros((n, WIDEST // 64), np.uint64)
    for a in range(0, n, 256):
        z = min(a + 256, n)
        part = h[ends[a] - made[a] : ends[z - 1]]
        field = np.zeros((z - a) * WIDEST, bool)
        field[np.repeat(np.arange(z - a) * WIDEST, made[a:z]) + ((part >> np.uint64(16)) & np.uint64(WIDEST - 1)).astype(np.int64)] = True
        out[a:z] = np.packbits(field).view(np.uint64).reshape(z - a, -1)
    return out


def may_be_similar(left: pa.Array, right: pa.Array, percent: int) -> np.ndarray:
    """Whether sketches leave each pair of lines a chance; a line of many pairs is read once."""
    coded = pa.concat_arrays([left, right]).dictionary_encode()
    h, made = char_shingles([x.encode() for x in coded.dictionary.to_pylist()])
    words, at = _sketched(h, made), coded.indices.to_numpy()
    i, j = at[: len(left)], at[len(left) :]
    differ = np.zeros(len(i), np.int64)
    for a in range(0, len(i), 1000):
        differ[a : a + 1000] = np.bitwise_count(words[i[a : a + 1000]] ^ words[j[a : a + 1000]]).sum(1)
    return differ * (100 + percent) <= (100 - percent) * (made[i] + made[j])


def alike(lines: list[bytes], percent: int) -> np.ndarray:
    """Which lines, by number, are so much alike: an exact table of which line has which shingle, in blocks of shingles."""
    k = len(lines)
    h, made = char_shingles(lines)
    line = np.repeat(np.arange(k), made)
    _, shingle = np.unique(h, return_inverse=True)
    cell = np.unique(shingle * k + line)
    shingle, line = cell // k, cell % k
    n = np.bincount(line, minlength=k)
    several = np.bincount(shingle)[shingle] > 1  # what only one line has is common to none
    shingle, line = shingle[several], line[several]
    shingle = np.cumsum(np.diff(shingle, prepend=-1) != 0) - 1
    common = np.zeros((k, k), np.int32)
    for a in range(0, int(shingle[-1]) + 1 if len(shingle) else 0, COLUMNS):
        lo, hi = np.searchsorted(shingle, [a, a + COLUMNS])
        field = np.zeros((k, -(-min(COLUMNS, int(shingle[-1]) + 1 - a) // 64) * 64), bool)
        field[line[lo:hi], shingle[lo:hi] - a] = True
        words = np.packbits(field, axis=1).view(np.uint64)
        for i in range(k - 1):
            common[i, i + 1 :] += np.bitwise_count(words[i] & words[i + 1 :]).sum(1, dtype=np.int32)
    return np.argwhere((common > 0) & (100 * common.astype(np.int64) >= percent * (n[:, None] + n - common)))


def links_among(lines: list[bytes], percent: int) -> np.ndarray:
    """The like pairs of lines of any length, by number: all blocks of lines with each other."""
    block = np.cumsum([len(x) for x in lines]) // (STEP // 2)
    kinds = [np.flatnonzero(block == x) for x in np.unique(block)]
    if len(kinds) < 3:
        return alike(lines, percent)
    found = [np.zeros((0, 2), np.int64)]
    for i, x in enumerate(kinds):
        for y in kinds[i + 1 :]:
            both = np.concatenate([x, y])
            found.append(both[alike([lines[j] for j in both], percent)])
    return np.concatenate(found)


def _pairwise(vertex: np.ndarray, lines: list[str], first: np.ndarray, size: np.ndarray, percent: int) -> Iterator[np.ndarray]:
    """Row numbers of the like pairs within buckets of FEW lines at most; each pair of lines is compared once."""
    left, right = [], []
    for k in range(2, FEW + 1):
        at = first[size == k]
        for i in range(k):
            for j in range(i + 1, k):
                left.append(at + i)
                right.append(at + j)
    left, right = np.concatenate(left), np.concatenate(right)
    _, once = np.unique(np.stack([vertex[left], vertex[right]], 1), axis=0, return_index=True)
    left, right = left[once], right[once]
    length = np.fromiter(map(len, lines), np.int64, len(lines))
    step = np.cumsum(length[left] + length[right] + 1000) // STEP  # sketches are as wide for short lines
    for s in np.unique(step):
        i, j = left[step == s], right[step == s]
        maybe = may_be_similar(pa.array([lines[x] for x in i], pa.string()), pa.array([lines[x] for x in j], pa.string()), percent)
        i, j = i[maybe], j[maybe]
        for a in range(0, len(i), 1000):
            keep = similar([lines[x] for x in i[a : a + 1000]], [lines[x] for x in j[a : a + 1000]], percent)
            yield np.stack([i[a : a + 1000][keep], j[a : a + 1000][keep]], 1)


def _linker(keys: list[str], percent: int):
    """a, b: links that join what is linked among the lines of equal keys. Rows come sorted by keys and vertex."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole(batches, keys, 2 * STEP):
            vertex, lines = t.column("vertex").to_numpy(), t.column("line").to_pylist()
            new = np.zeros(len(vertex), bool)
            new[0] = True
            for k in keys:
                column = t.column(k).to_numpy()
                new[1:] |= column[1:] != column[:-1]
            first = np.flatnonzero(new)
            size = np.diff(np.concatenate([first, [len(vertex)]]))
            found = list(_pairwise(vertex, lines, first, size, percent)) if (size <= FEW).any() else []
            for at, k in zip(first[size > FEW], size[size > FEW], strict=True):
                pairs = links_among([x.encode() for x in lines[at : at + k]], percent)
                root = np.arange(k)  # a star for each component, not all pairs of it
                while (root[pairs[:, 0]] != root[pairs[:, 1]]).any():
                    low = np.minimum(root[pairs[:, 0]], root[pairs[:, 1]])
                    np.minimum.at(root, pairs.ravel(), np.repeat(low, 2))
                    root = root[root]
                found.append(at + np.stack([np.arange(k), root], 1)[root != np.arange(k)])
            if found:
                i, j = np.concatenate(found).T
                yield pa.RecordBatch.from_arrays([pa.array(vertex[i]), pa.array(vertex[j])], ["a", "b"])

    return run


def _grouped(rows: DataFrame, lines: DataFrame, keys: list[str], percent: int) -> DataFrame:
    met = rows.join(lines, "vertex").select(*keys, "vertex", "line")
    return met.repartition(*keys).sortWithinPartitions(*keys, "vertex").mapInArrow(_linker(keys, percent), "a long, b long")


def groups(buckets: DataFrame, lines: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """vertex, component of all lines (vertex, line) that have a link, from their buckets (bucket, part, vertex)."""
    links = scratch.write(_grouped(buckets, lines, ["bucket", "part"], percent))
    found = components(links, scratch)
    large = buckets.where("part > 0").select("bucket").distinct()
    rows = buckets.join(large, "bucket", "left_semi").groupBy("bucket", "vertex").agg(F.min("part").alias("part"))
    rows = rows.join(found, "vertex", "left").withColumn("component", F.coalesce("component", "vertex"))
    mixed = F.min("component").over(Window.partitionBy("bucket")) != F.max("component").over(Window.partitionBy("bucket"))
    parts = F.max("part").over(Window.partitionBy("bucket"))
    rows = scratch.write(rows.select("bucket", "part", "vertex", mixed.alias("mixed"), parts.alias("last")).where("mixed"))
    if not rows.isEmpty():  # all pairs of parts
        rows = rows.withColumn("other", F.explode(F.expr("filter(sequence(0, last), x -> x != part)")))
        rows = rows.select("bucket", F.least("part", "other").alias("part"), F.greatest("part", "other").alias("other"), "vertex")
        more = _grouped(rows, lines, ["bucket", "part", "other"], percent).unionByName(links)
        before, found = found, components(more, scratch)
        scratch.drop(before)
    scratch.drop(links)
    return found


@lean
def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, tags = b.column("doc_id"), b.column("tag")
        for row, _, buf, off in blocks(b.column("text"), SMALL):
            lines = Lines(buf, off)
            at = pa.array(np.array(lines.row, np.int64) + row)
            yield pa.RecordBatch.from_arrays([ids.take(at), tags.take(at), pa.array(lines.number, pa.int64()), pa.array(signed(lines.ids))], ["doc_id", "tag", "line_no", "vertex"])


def dropped_lines(docs: DataFrame, percent: int = PERCENT, most: int = MOST) -> DataFrame:
    """doc_id, tag (xxhash64 of the text), drop: the numbers of the lines that others stand for; documents without such are left out."""
    scratch = Scratch(docs.sparkSession)
    docs = docs.where("doc_id is not null").select("doc_id", "text", F.xxhash64("text").alias("tag"))
    packed = docs.select("text").mapInArrow(_banded, "slab int, data binary").repartition("slab").sortWithinPartitions("slab")
    buckets = scratch.write(packed.mapInArrow(_buckets(most), "bucket long, part int, vertex long").distinct())
    scratch.release()
    members = scratch.write(buckets.select("vertex").distinct())
    # every line's place, but those of lines that occur once and have no candidate: nothing can drop them
    places = scratch.write(docs.mapInArrow(_places, _PLACES))
    first = places.groupBy("vertex").agg(F.min(F.struct("doc_id", "line_no", "tag")).alias("first"), F.count("*").alias("n"))
    told = first = scratch.write(first.join(members.withColumn("member", F.lit(True)), "vertex", "left").where("n > 1 or member"))
    scratch.release()
    at = first.where("member").groupBy("first.doc_id", "first.tag").agg(F.collect_set("first.line_no").alias("numbers"))
    asked = docs.join(scratch.sized(at), ["doc_id", "tag"]).select("text", "numbers")
    lines = scratch.write(asked.mapInArrow(_fetched, "vertex long, line string"))
    if lines.count() > members.count():  # rows that are equal in doc_id and text
        lines = scratch.write(lines.dropDuplicates(["vertex"]))
    scratch.release()
    found = groups(buckets, lines, percent, scratch)
    scratch.drop(buckets, members, lines)
    scratch.release()
    first = first.join(found, "vertex", "left").withColumn("component", F.coalesce("component", "vertex")).where("n > 1 or component != vertex or member")
    kept = first.groupBy("component").agg(F.min("first").alias("kept"), F.sum("n").alias("all")).where("all > 1").select("component", "kept")
    first = first.join(kept, "component").select("vertex", "kept")
    out = places.join(first, "vertex").where("doc_id != kept.doc_id or line_no != kept.line_no or tag != kept.tag")
    out = scratch.write(out.groupBy("doc_id", "tag").agg(F.collect_set("line_no").alias("drop")))  # a document's own lines
    scratch.drop(places, found, told)
    scratch.release()
    return out


def dedup(docs: DataFrame, percent: int = PERCENT, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """The documents' columns, text without the dropped lines, and the two counts, whose names must be new."""
    if set(counts) & set(docs.columns):
        raise ValueError(f"docs has a column named like one of {counts}; pass other names for the counts")
    tag, drop, lines, doc_id = fresh(docs, "tag", "drop", "lines", "id")
    found = dropped_lines(docs.select("doc_id", "text"), percent).select(F.col("doc_id").alias(doc_id), F.col("tag").alias(tag), F.col("drop").alias(drop))
    d = docs.withColumns({tag: F.xxhash64("text"), doc_id: F.col("doc_id")}).join(found, [doc_id, tag], "left").withColumn(lines, F.split("text", "\n"))
    left = F.filter(lines, lambda x, i: ~F.array_contains(drop, i.cast("long")))
    text = F.when(F.col(drop).isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long")
    gone = F.when(F.col(drop).isNull(), 0).otherwise(F.size(drop)).cast("long")
    return d.select(*((text.alias(c) if c == "text" else F.col(f"`{c}`")) for c in docs.columns), n.alias(counts[0]), gone.alias(counts[1]))


def op4_line_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that others stand for."""
    d = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return d.select("doc_id", "n_lines", "n_dropped", "text")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents without repeated lines; those of which nothing is left go. n_chars follows the text."""
    counts = fresh(docs, "lines", "dropped")
    d = dedup(docs, counts=tuple(counts)).where(f"{counts[1]} = 0 or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    chars = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return d.withColumns(chars).select(*(F.col(f"`{c}`") for c in docs.columns))
