"""Bitmaps as wide as their sets: their distance never exceeds the sets', and tells unlike large sets apart."""

import numpy as np

from glint.llm.ngram_jaccard import bitmaps, differing


def _maps(sets):
    made = bitmaps(np.concatenate([np.sort(s) for s in sets]).astype(np.uint64), np.concatenate([[0], np.cumsum([len(s) for s in sets])]))
    return [np.frombuffer(v.as_buffer(), np.uint64) for v in made]


def test_distance_is_a_lower_bound():
    r = np.random.default_rng(3)
    pool = np.unique(r.integers(0, 1 << 53, 30_000, dtype=np.uint64))
    sets = [r.choice(pool, n, replace=False) for n in (0, 1, 2, 63, 64, 65, 500, 512, 513, 1000, 5000, 9000)]
    sets += [np.concatenate([s[len(s) // 10 :], r.choice(pool, len(s) // 9)]) for s in sets[3:]]
    sets = [np.unique(s) for s in sets]
    maps = _maps(sets)
    for s, x in zip(sets, maps, strict=True):
        for t, y in zip(sets, maps, strict=True):
            assert differing(x, y) <= len(np.setxor1d(s, t))
    a, b, c = sets[11], sets[11][200:], sets[-1]
    x, y, z = _maps([a, b, c])
    assert differing(x, x) == 0 and differing(x, y) <= 200
    assert differing(x, z) > len(a) + len(c) - 2 * 90 * (len(a) + len(c)) // 190  # a Jaccard similarity of 0.9 is out of reach
