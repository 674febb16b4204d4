"""Whole texts as flat byte arrays: words, lines and hashes without a Python object per word.

Arrow hands a batch of texts over as one buffer of UTF-8 and an array of offsets. The functions here find the
words of all those texts at once and hash them, so a task spends its time in numpy loops. Texts are worked off in
blocks of bounded size (``blocks``); a text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes and texts in a block, unless one text alone is longer; and bytes where arrays should stay in the CPU's cache.
BLOCK_BYTES = 2_000_000
BLOCK_TEXTS = 2000
SMALL = 256_000

_rng = np.random.Generator(np.random.PCG64(20240611))
_BYTE = _rng.integers(1, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]
_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)

#: The word separators of the contracts: [\x20\x09-\x0D].
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes over the whole word."""
    t = x >> _S33
    x = x ^ t
    for step in (_MIX1, _MIX2):
        x *= step
        np.right_shift(x, _S33, out=t)
        x ^= t
    return x


def blocks(column: pa.Array | pa.ChunkedArray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets) of a text column; null is an empty text. Offsets start at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1
        end = min(max(end, row + 1), row + BLOCK_TEXTS, n)
        yield row, end - row, flat[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def spans(buf: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each text the index of its first word (one more entry at the end)."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~space[buf]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    begin = word.copy()
    begin[1:] &= ~word[:-1] | cut[1:-1]
    end = word.copy()
    end[:-1] &= ~word[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span: a sum of byte codes times the powers of an odd number, mixed with the length.

    Bytes are worked off SMALL at a time, so memory beyond the spans and their hashes is bounded.
    """
    lens = ends - starts
    total = np.zeros(len(starts), np.uint64)
    power = np.full(int(min(lens.max(initial=0), SMALL)), _STEP[seed])
    power[:1] = 1
    np.multiply.accumulate(power, out=power)
    for i in np.flatnonzero(lens > SMALL):
        far = np.uint64(1)
        for a in range(starts[i], ends[i], SMALL):
            code = buf[a : min(a + SMALL, ends[i])]
            total[i] += far * (_BYTE[seed][_LOWER[code] if lower else code] * power[: len(code)]).sum()
            far *= power[-1] * _STEP[seed]
    some = np.flatnonzero(lens <= SMALL) if (lens > SMALL).any() else slice(None)
    starts, size = starts[some], lens[some]
    upto = np.cumsum(size)
    cut = [0, *np.searchsorted(upto, np.arange(SMALL, upto[-1], SMALL), "right").tolist(), len(size)] if len(size) else [0]
    short = np.zeros(len(size), np.uint64)
    for a, b in zip(cut, cut[1:], strict=False):
        if a < b:
            n = size[a:b]
            first = np.cumsum(n) - n
            within = np.arange(int(n.sum()), dtype=np.int64) - np.repeat(first, n)
            code = buf[within + np.repeat(starts[a:b], n)]
            short[a:b] = np.add.reduceat(_BYTE[seed][_LOWER[code] if lower else code] * power[within], first)
    total[some] = short
    return mix(total + lens.astype(np.uint64) * _STEP[1 - seed])


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words, and the text of each. A text of fewer words gives its whole sequence as one."""
    n = len(words)
    counts = np.diff(first)
    made = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
    text = np.repeat(np.arange(len(counts)), made)
    base = np.repeat(first[:-1] - (np.cumsum(made) - made), made)
    at = np.arange(len(text)) + base
    size = np.minimum(counts, k)[text]
    out = np.zeros(len(text), np.uint64)
    for j in range(k):
        here = size > j
        step = words[np.minimum(at + j, max(n - 1, 0))] if n else out
        out = np.where(here, mix(out * _STEP[0] + step + np.uint64(j + 1)), out)
    return out, text


def starts_of_codepoints(buf: np.ndarray) -> np.ndarray:
    """True at each byte that begins a code point."""
    return (buf & 0xC0) != 0x80


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as a signed long, as Spark has it."""
    return np.ascontiguousarray(x).view(np.int64)


class Seen:
    """Values by the 128-bit hash of a span, kept for the life of a Python worker, in bounded memory.

    ``lookup`` gives each span's row in the table; ``make`` is called with the spans that it has not met. When the
    table would pass ``limit`` entries it is emptied first. Hashes that meet in their first half are told apart by the
    second, so no value is ever taken for another's.
    """

    def __init__(self, make, limit: int = 1_500_000):
        self.make, self.limit = make, limit
        self.clear()

    def clear(self) -> None:
        self.keys, self.second, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.size = 0

    def lookup(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
        """Row numbers; new spans get theirs from ``make(list of bytes, first row)``."""
        h, g = (hashes(buf, starts, ends, lower, s) for s in (0, 1))
        key, at, inverse = np.unique(h, return_index=True, return_inverse=True)
        if (g[at][inverse] != g).any():
            h = mix(h ^ g * _STEP[0])  # another 64 bits of the two; a second meeting is past all odds
            key, at, inverse = np.unique(h, return_index=True, return_inverse=True)
        pos = np.searchsorted(self.keys, key)
        found = np.zeros(len(key), bool)
        inside = pos < len(self.keys)
        found[inside] = (self.keys[pos[inside]] == key[inside]) & (self.second[pos[inside]] == g[at][inside])
        if self.size and self.size + int((~found).sum()) > self.limit:
            self.clear()
            self.make.clear()
            return self.lookup(buf, starts, ends, lower)
        rows = np.zeros(len(key), np.int64)
        rows[found] = self.rows[pos[found]]
        if not found.all():
            new = np.flatnonzero(~found)
            raw = buf.tobytes()
            self.make([raw[starts[i] : ends[i]] for i in at[new]])
            rows[new] = np.arange(self.size, self.size + len(new))
            self.size += len(new)
            self.keys = np.insert(self.keys, pos[new], key[new])
            self.second = np.insert(self.second, pos[new], g[at][new])
            self.rows = np.insert(self.rows, pos[new], rows[new])
        return rows[inverse]
