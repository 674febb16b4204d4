"""Packing by power-of-two decomposition.

Each document's ids, the end id included, are split into pieces whose lengths are powers of two: as many of the
longest as fit, then the binary digits of the rest, longest first. Pieces of equal length form a bucket, and every
piece is a sequence of its own: none crosses documents, and at a power of two none needs padding.

Tokenizing costs most, so a Python worker keeps the ids of the words it has met, in bounded memory, and asks the
tokenizer only for new ones. White space between words is what both the tokenizer's rules and the bytes 9-13 and 32
agree on; the tokenizer drops it, and nothing it does to a word looks past it.

Scale: tokenizing is a narrow ``mapInArrow``. Sequences are numbered without gaps: pieces are counted by bucket and by
a hash slice of the piece (a row a slice and bucket), the counts accumulated, and pieces ranked within their slice
and bucket. Only the pieces' few numbers are shuffled, never ids or texts; the pieces are written to the checkpoint
folder once, so texts are tokenized once and a lost executor loses none of them.

Defined results: a null or empty text is the end id alone; rows with equal doc_id are numbered apart; texts of any
length are packed whole; other columns, whatever their names, are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glint.llm.shared import Scratch, lean
from glint.llm.textarrays import Seen, blocks, spans

#: Tokens of the longest piece, the id after each document, and pieces of a slice, about.
LONGEST, END_ID, SLICE_ROWS = 2048, 1, 20_000
TOKENIZER = "word_bpe_49k.json"
#: Words that are handed to the tokenizer at once.
AT_ONCE = 2000


class _Words:
    """``make`` for Seen: the ids of each new word, as rows of one flat array."""

    def __init__(self, file: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(file))
        self.clear()

    def clear(self) -> None:
        self.flat, self.first = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def __call__(self, words: list[bytes]) -> None:
        flat, sizes = [self.flat], []
        for a in range(0, len(words), AT_ONCE):  # the tokenizer's own results take far more memory than the ids
            got = self.tokenizer.encode_batch_fast([w.decode() for w in words[a : a + AT_ONCE]], add_special_tokens=False)
            ids = [e.ids for e in got]
            sizes += map(len, ids)
            flat.append(np.array([i for x in ids for i in x], np.uint32))
        self.flat = np.concatenate(flat)
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(sizes, dtype=np.int64)])


@lru_cache(maxsize=1)
def _table(file: str) -> tuple[_Words, Seen]:
    words = _Words(file)
    return words, Seen(words, limit=1_000_000)


def token_ids(column: pa.Array, file: str = TOKENIZER) -> Iterator[list[np.ndarray]]:
    """The ids of the texts, a block of texts at a time."""
    words, seen = _table(file)
    for _, n, buf, off in blocks(column):
        starts, ends, first = spans(buf, off)
        row = seen.lookup(buf, starts, ends, lower=False)
        size = words.first[row + 1] - words.first[row]
        total = np.concatenate([[0], np.cumsum(size)])
        at = np.arange(total[-1]) + np.repeat(words.first[row] - total[:-1], size)
        flat = words.flat[at]
        yield [flat[total[first[i]] : total[first[i + 1]]] for i in range(n)]


def lengths(n: int, longest: int = LONGEST) -> list[int]:
    """Lengths of the pieces of n ids, longest first. ``longest`` is a power of two."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pieces(docs: DataFrame, longest: int = LONGEST, with_ids: bool = True, file: str = TOKENIZER) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens and, if wanted, ids: one row a piece."""
    if longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([END_ID], np.uint32)
        for b in batches:
            row = 0
            for block in token_ids(b.column("text"), file):
                sizes = np.array([len(ids) + 1 for ids in block], np.int64)
                parts = [lengths(n, longest) for n in sizes.tolist()]
                count = np.array([len(x) for x in parts], np.int64)
                length = np.array([n for x in parts for n in x], np.int64)
                at = np.cumsum(length)
                of = np.repeat(np.arange(len(block)), count)
                start = at - length - np.repeat(np.cumsum(sizes) - sizes, count)
                flat = np.concatenate([x for ids in block for x in (ids, end)]).astype("<u4")
                raw = memoryview(flat).cast("B")
                crc = [zlib.crc32(raw[4 * (b - n) : 4 * b]) for b, n in zip(at.tolist(), length.tolist(), strict=True)]
                out = [b.column("doc_id").take(pa.array(of + row)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(sizes[of])]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], at]), pa.int32()), pa.array(flat.astype(np.int64))))
                row += len(block)
                yield pa.RecordBatch.from_arrays(out, names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<long>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pack(found: DataFrame) -> DataFrame:
    """Adds sequence_id, from 0 without gaps, shorter sequences first, and offset (0). ``found`` must be cheap to read twice."""
    n = found.count()
    d = found.withColumn("_slice", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "doc_tokens"), F.lit(max(1, n // SLICE_ROWS))))
    counts = d.groupBy("length", "_slice").count()
    # a window over the lengths' totals, which are few, and one in each length
    totals = counts.groupBy(F.col("length").alias("_l")).agg(F.sum("count").alias("_n"))
    up = Window.unboundedPreceding
    totals = totals.select("_l", F.coalesce(F.sum("_n").over(Window.orderBy("_l").rowsBetween(up, -1)), F.lit(0)).alias("_shorter"))
    before = F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("_slice").rowsBetween(up, -1)), F.lit(0))
    counts = counts.withColumn("_b", before).join(totals, F.col("length") == F.col("_l"))
    counts = counts.select("_l", F.col("_slice").alias("_s"), (F.col("_b") + F.col("_shorter")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("length", "_slice").orderBy("doc_id", "start", "ids_crc32")) - 1
    d = d.withColumn("_rank", rank).join(counts, (F.col("length") == F.col("_l")) & (F.col("_slice") == F.col("_s")))
    return d.withColumn("sequence_id", (F.col("_before") + F.col("_rank")).cast("long")).withColumn("offset", F.lit(0).cast("long")).drop("_slice", "_l", "_s", "_before", "_rank")


def op9_packing_pow2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as sequences of a power of two of ids, 2048 at most."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(spark, docs, sf_dir)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the pieces, each with its sequence."""
    found = Scratch(spark).write(pieces(docs, with_ids=False))
    return pack(found).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
