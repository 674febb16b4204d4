"""Near fingerprints against brute force, and near documents by their terms."""

import random

import pyarrow as pa
import pytest

from glint.llm import simhash


def _apart(a, b):
    return (int(a, 16) ^ int(b, 16)).bit_count()


@pytest.fixture(scope="module")
def prints():
    r, out = random.Random(4), []
    for _ in range(25):
        x = r.getrandbits(128)
        out += [x, *(x ^ sum(1 << b for b in r.sample(range(128), k)) for k in (1, 3, 4, 20, 24, 25, 30))]
    return [f"{x:032x}" for x in out + out[:40]]  # the last ones are copies


@pytest.mark.parametrize("radius", [simhash.RADIUS, simhash.NEAR])
def test_near_pairs(spark, prints, radius):
    got = simhash.near_pairs(spark.createDataFrame([(x,) for x in prints], "fingerprint string").repartition(3), radius).collect()
    alone = sorted(set(prints))
    want = sorted((a, b, _apart(a, b)) for a in alone for b in alone if a < b and _apart(a, b) <= radius)
    assert want and sorted((r.a, r.b, r.distance) for r in got) == want


def test_near_documents_and_counts(spark, prints):
    docs = spark.createDataFrame(list(enumerate(prints)), "doc_id long, fingerprint string").repartition(3)
    want = {(i, j, _apart(a, b)) for i, a in enumerate(prints) for j, b in enumerate(prints) if i != j and _apart(a, b) <= simhash.NEAR}
    assert {tuple(r) for r in simhash.near_documents(docs).collect()} == {x for x in want if x[0] < x[1]}
    assert {tuple(r) for r in simhash.near_documents(docs, docs.where("doc_id % 20 = 0")).collect()} == {x for x in want if x[0] % 20 == 0}
    n = {r.a: r.n for r in simhash.near_counts(docs, docs.where("doc_id % 20 = 0")).collect()}
    assert n == {prints[i]: sum(_apart(prints[i], b) <= simhash.NEAR for b in prints) for i in range(0, len(prints), 20)}


def test_n_near_counts_copies_and_edited_texts(spark, tmp_path):
    r = random.Random(1)
    words = [f"w{r.randint(0, 9999)}" for _ in range(300)]
    other = [f"v{r.randint(0, 9999)}" for _ in range(300)]
    edited = [*words]
    edited[150] = "changed"
    texts = [" ".join(x) for x in (words, words, edited, other)]
    spark.createDataFrame([(20 * i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x.n_near for x in simhash.op1_simhash(spark, str(tmp_path)).collect()}
    assert got == {0: 2, 20: 2, 40: 2, 60: 0}


def test_likeness_of_four_fifths_is_found():
    r, texts, wanted = random.Random(8), [], 0.8
    for _ in range(100):
        words = [f"w{r.randint(0, 10**6)}" for _ in range(400)]
        near = [*words]
        for k in range(20, 400, 57):  # 7 words changed: 35 of 396 terms, a Jaccard of 0.84
            near[k] = "x"
        terms = [{tuple(w[i : i + 5]) for i in range(396)} for w in (words, near)]
        assert wanted <= len(terms[0] & terms[1]) / len(terms[0] | terms[1]) <= 0.85
        texts += [" ".join(words), " ".join(near)]
    p = [x.tobytes().hex() for x in simhash.fingerprints(pa.array(texts))]
    found = sum(_apart(p[i], p[i + 1]) <= simhash.NEAR for i in range(0, 200, 2))
    assert found >= 85 and sum(_apart(p[i], p[i + 2]) <= simhash.NEAR for i in range(0, 198, 2)) == 0
