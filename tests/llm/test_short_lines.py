"""Lines of any length are deduplicated, short ones too."""

import random

import numpy as np
import pyarrow as pa

from glint.llm import line_minhash


def _left(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    return {r.doc_id: r for r in line_minhash.dedup(docs).collect()}


def test_equal_short_lines_and_a_copy_of_a_document(spark):
    long = "a line that is long enough to have been judged at all times"
    first = f"Les.\n{long}\né\n\nAnd therhean is the is esndha."
    got = _left(spark, [first, first, " Les. \nother\n\né", "Les\nLes.x"])
    assert got[0].text == first and got[0].n_dropped == 0
    assert (got[1].text, got[1].n_dropped) == ("", 4)  # the blank line stays
    assert (got[2].text, got[2].n_dropped) == ("other\n", 2)
    assert got[3].n_dropped == 0


def test_short_lines_against_brute_force(spark):
    r = random.Random(9)
    lines = []
    for _ in range(60):
        line = "".join(r.choice("abcdefghij ") for _ in range(r.randint(1, 39))).strip() or "x"
        lines += [line, *(line[k:] + r.choice(["", "!", "?"]) or "y" for k in r.sample([0, 0, 1, 2], r.randint(0, 3)))]
    r.shuffle(lines)
    lines = [" ".join(x.split()) for x in lines if x.strip()]
    sets = [{x[j : j + 8] for j in range(len(x) - 7)} or {x} for x in lines]
    group = list(range(len(lines)))
    for i in range(len(lines)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    first = {}
    for i, g in enumerate(group):
        first.setdefault(g, i)
    got = _left(spark, lines)
    wrong = [i for i, g in enumerate(group) if got[i].n_dropped != (first[g] != i)]
    assert len(set(group)) < len(lines) and not wrong


def test_sketches_leave_every_link():
    """Narrow, wide, folded and widest sketches never differ in more bits than the shingle sets in elements."""
    rng = np.random.default_rng(5)
    lines = []
    for n in (20, 120, 255, 300, 512, 600, 1100, 9000):
        base = "".join(map(chr, rng.integers(97, 123, n)))
        lines += [base, base[: n * 9 // 10], base + "zq" * (n // 25), base[: n // 2] + "é" + base[n // 2 + 1 :], base[::-1]]
    pairs = [(a, b) for a in lines for b in lines]
    left, right = pa.array([a for a, _ in pairs]), pa.array([b for _, b in pairs])
    linked = line_minhash.similar(left.to_pylist(), right.to_pylist(), 80)
    assert 100 < linked.sum() < len(pairs)
    maybe = line_minhash.may_be_similar(left, right, 80)
    assert maybe[linked].all() and not maybe.all()
    h, made = line_minhash.char_shingles([x.encode() for x in lines])
    wide = line_minhash.wide_sketches(h, made).to_pylist()
    for (a, b), link in zip([(i, j) for i in range(len(lines)) for j in range(len(lines))], linked, strict=True):
        x, y = (np.array(wide[k], np.int64).view(np.uint64) for k in (a, b))
        if len(x) < len(y):
            x, y = y, x
        if len(x) == 2 * len(y):
            x = x[: len(y)] | x[len(y) :]
        if link and len(x) == len(y):
            assert int(np.bitwise_count(x ^ y).sum()) * 180 <= 20 * (made[a] + made[b])
