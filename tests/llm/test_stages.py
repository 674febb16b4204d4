"""Stages of the pipeline on small tables: no row lost or kept by mistake, no column lost, brute force for lines."""

import random

import pytest

from glint.llm import line_minhash, mixing_es, ngram_jaccard, packing_pow2, quality_qda

EXTRA = "_drop int, _tag string, n_lines int, `my col` string, _score int, quality_score string, size int"
EXTRA_NAMES = ["_drop", "_tag", "n_lines", "my col", "_score", "quality_score", "size"]


@pytest.fixture(scope="module")
def clashing(spark):
    r = random.Random(2)
    rows = []
    for i in range(40):
        text = "\n".join(" ".join(r.choice("ab cd ef gh ij kl mn".split()) + str(r.randrange(50)) for _ in range(30)) for _ in range(3))
        rows.append((i, text, "en", "hot" if i % 3 else None, len(text), 1, "t", 7, "m", 3, "q", 9))
    rows.append((50, rows[0][1], *rows[0][2:]))
    rows.append((51, None, None, None, None, None, None, None, None, None, None, None))
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}").repartition(3)


def test_copies_go_by_row_and_not_by_id(spark):
    base = random.Random(1)
    text = lambda n: " ".join(f"w{base.randrange(10**6)}" for _ in range(n))
    a, b, c = text(60), text(60), text(60)
    rows = [(5, a), (11, a), (11, b), (12, c), (12, b + " z"), (None, c), (None, None), (13, ""), (13, ""), (7, "only"), (7, "only")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((str(r.doc_id), r.text) for r in ngram_jaccard.drop_copies(spark, docs, "").collect() if r.text)
    assert got == sorted([("5", a), ("11", b), ("12", c), ("7", "only")])
    assert sum(not r.text for r in ngram_jaccard.drop_copies(spark, docs, "").collect()) == 3


def test_stages_keep_clashing_columns(spark, clashing, sf):
    dedup = line_minhash.dedup_lines(spark, clashing, sf)
    assert dedup.columns == clashing.columns and {r.doc_id for r in dedup.collect()} == {*range(40), 51}
    copies = ngram_jaccard.drop_copies(spark, clashing, sf)
    assert copies.columns == clashing.columns and {r.doc_id for r in copies.collect()} == {*range(40), 51}
    mixed = mixing_es.mix_documents(spark, clashing, sf)
    assert mixed.columns == clashing.columns and {r.n_lines for r in mixed.collect()} == {7}
    kept = quality_qda.keep_quality(spark, clashing, sf, 0.0)
    assert kept.columns == clashing.columns and kept.count() == 42
    assert packing_pow2.pack_documents(spark, clashing, sf).select("doc_id").distinct().count() == 42
    with pytest.raises(ValueError, match="n_lines"):
        line_minhash.dedup(clashing)


def test_lines_against_brute_force(spark):
    r = random.Random(12)
    lines = []
    for _ in range(50):
        line = " ".join("".join(r.choice("abcdefghijklmno") for _ in range(r.randint(2, 8))) for _ in range(r.randint(6, 30)))
        lines.append(line)
        for _ in range(r.randint(0, 3)):
            words = line.split()
            for k in r.sample(range(len(words)), r.choice([0, 1, len(words) // 2])):
                words[k] = words[k][:-1] + "z"
            lines.append("  ".join(words))
    r.shuffle(lines)
    sets = [{x[j : j + 8] for j in range(len(x) - 7)} for x in (" ".join(y.split()) for y in lines)]
    alike = [(i, j, len(sets[i] & sets[j]) / len(sets[i] | sets[j])) for i in range(len(lines)) for j in range(i)]
    group = list(range(len(lines)))
    for i, j, s in alike:
        if s >= 0.8:
            group = [group[j] if g == group[i] else g for g in group]
    first = {}
    for i, g in enumerate(group):
        first.setdefault(g, i)
    want = {i for i, g in enumerate(group) if first[g] != i}
    docs = spark.createDataFrame([(i // 2, "\n".join(lines[i : i + 2])) for i in range(0, len(lines), 2)], "doc_id long, text string").repartition(4)
    got = set()
    for row in line_minhash.dropped_lines(docs).collect():
        got |= {2 * row.doc_id + n for n in row.drop}
    assert len(want) > 20 and got == want
