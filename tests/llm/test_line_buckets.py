"""Candidates of lines: packed bands, whole buckets compared in parts, and what travels for lines without a candidate."""

import random

import numpy as np

from glint.llm import line_minhash
from glint.llm.shared import Scratch


def _shuffled(spark):
    store, jvm, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm, spark.sparkContext._gateway
    stages = store.stageList(None, False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def _group(r, lines, edits, length=150):
    """Lines that come from one by changes of single characters: some alike enough, some not quite."""
    base = "".join(r.choice("abcdefgh ") for _ in range(length))
    out = set()
    while len(out) < lines:
        x = list(base)
        for _ in range(r.randint(0, edits)):
            x[r.randrange(length)] = r.choice("uvwxyz")
        out.add("".join(x).strip())
    return [" ".join(x.split()) for x in sorted(out)]


def _components(lines):
    sets = [{x[k : k + 8] for k in range(len(x) - 7)} for x in lines]
    group = list(range(len(lines)))
    for i in range(len(lines)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    return group


def test_all_pairs_of_a_bucket_in_parts(spark):
    r = random.Random(7)
    lines = [x for edits in (2, 4, 6) for x in _group(r, 25, edits)]
    group = _components(lines)
    assert 5 < len(set(group)) < 60
    # buckets as wide as whole groups, so that only comparing all their pairs finds the components
    rows = [(k, i % 25 // most, i) for most in (7,) for k in range(3) for i in range(25 * k, 25 * k + 25)]
    rows += [(k, part, 25 * k) for k in range(3) for part in (1, 2, 3)]  # the first line is in each part
    buckets = spark.createDataFrame([(b, p, v) for b, p, v in rows], "bucket long, part int, vertex long").repartition(3)
    table = spark.createDataFrame(list(enumerate(lines)), "vertex long, line string").repartition(3)
    got = {x.vertex: x.component for x in line_minhash.groups(buckets, table, 80, Scratch(spark)).collect()}
    got = [got.get(i, i) for i in range(len(lines))]
    assert [got.index(g) for g in got] == [group.index(g) for g in group]


def test_parts_make_no_difference(spark):
    r = random.Random(3)
    lines = [x for edits in (2, 4) for x in _group(r, 30, edits)]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(3)
    found = [{x.doc_id for x in line_minhash.dropped_lines(docs, most=most).collect()} for most in (1024, 2, 1)]
    assert found[0] and found[0] == found[1] == found[2]


def test_the_table_of_shingles_is_exact():
    r = random.Random(11)
    lines = [*_group(r, 30, 6), *_group(r, 5, 3, 4000), "short", "x" * 9, "x" * 40]
    want = {(i, j) for i in range(len(lines)) for j in range(i + 1, len(lines)) if line_minhash.similar([lines[i]], [lines[j]], 80)[0]}
    flat = [x.encode() for x in lines]
    assert want and {tuple(x) for x in line_minhash.alike(flat, 80).tolist()} == want
    before, line_minhash.STEP = line_minhash.STEP, 4000
    try:
        assert {tuple(x) for x in np.sort(line_minhash.links_among(flat, 80)).tolist()} == want
    finally:
        line_minhash.STEP = before


def test_lines_without_a_candidate_travel_as_bands_only(spark):
    r = random.Random(2)
    lines = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(400)) for _ in range(20_000)]
    docs = spark.createDataFrame([(i, "\n".join(lines[i : i + 10])) for i in range(0, len(lines), 10)], "doc_id long, text string").repartition(2)
    before = _shuffled(spark)
    docs = docs.localCheckpoint()
    at = _shuffled(spark)
    assert at > before and line_minhash.dropped_lines(docs).count() == 0
    assert (_shuffled(spark) - at) / len(lines) < 250  # bytes a line; rows of bands and sketches were over 600


def test_release_deletes_shuffle_files(spark):
    import os
    import time

    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: sum(os.path.getsize(os.path.join(d, f)) for root in folders.localDirs() for d, _, names in os.walk(str(root)) for f in names if f.startswith("shuffle_"))
    scratch = Scratch(spark)
    scratch.release()
    time.sleep(2)
    before = held()
    scratch.write(spark.range(400_000).selectExpr("id", "xxhash64(id) h").repartition(4, "h"))
    assert held() > before + 1_000_000
    scratch.release()
    time.sleep(5)
    assert held() <= before + 100_000


def test_python_gets_few_rows_at_once(spark):
    def sizes(batches):
        for b in batches:
            yield b.from_pydict({"n": [b.num_rows]})

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    table = Scratch(spark).write(spark.range(0, 5000, 1, 1).mapInArrow(sizes, "n long"))
    assert [r.n for r in table.collect()] == [1000] * 5 and spark.conf.get(name) == before


def test_the_tokenizer_gets_few_words_at_once(monkeypatch):
    from glint.llm import packing_pow2

    words = [f"w{i}x{i * i}".encode() for i in range(5000)]
    whole, parts, got = packing_pow2._Words(packing_pow2.TOKENIZER), packing_pow2._Words(packing_pow2.TOKENIZER), []
    monkeypatch.setattr(packing_pow2, "AT_ONCE", 10_000)
    whole(words)
    monkeypatch.setattr(packing_pow2, "AT_ONCE", 700)
    encode = parts.tokenizer.encode_batch_fast

    class Counted:
        def encode_batch_fast(self, some, **kw):
            got.append(len(some))
            return encode(some, **kw)

    parts.tokenizer = Counted()
    parts(words[:3000])
    parts(words[3000:])
    assert max(got) == 700 and (whole.flat == parts.flat).all() and (whole.first == parts.first).all()
