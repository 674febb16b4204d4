"""Every query over a fixture with nulls, ties, repeated rows, long texts and clashing columns, and over empty tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest

from glint.llm.catalog import ORACLES, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def results(spark, sf):
    return {name: q(spark, sf).collect() for name, q in QUERIES.items()}


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty_tables(spark, empty_sf, name):
    assert QUERIES[name](spark, empty_sf).collect() == []


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith("op9")])
def test_a_row_for_each_row(results, rows, name):
    assert sorted(str(r.doc_id) for r in results[name]) == sorted(str(x[0]) for x in rows)


@pytest.mark.parametrize("name", ["op5_toxicity_fuzzy", "op7_quality_qda", "op8_langid_crossparse"])
def test_scores_and_folds(results, name):
    mod, fold = (4, 2) if name.startswith("op8") else (3, 1)
    for r in results[name]:
        assert 0 <= r.score <= 1
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % mod == fold)


def test_languages(results, rows):
    texts = defaultdict(set)
    for x in rows:
        texts[x[0]].add(x[1])
    got = {r.doc_id: r.lang_pred for r in results["op8_langid_crossparse"] if r.doc_id != 11}
    assert got[203] == got[204] == got[205] == "und"
    assert sum(got[i] == ("en" if i % 3 else "de") for i in range(80) if i != 11) >= 75


def test_toxic_rows_are_caught(results, rows):
    toxic = {x[0] for x in rows if "idiot" in (x[1] or "")}
    got = {r.doc_id for r in results["op5_toxicity_fuzzy"] if r.predicted}
    assert toxic <= got and not {203, 204, 205, 206, 207, 208} & got


def test_simhash(results, rows):
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    want = []
    for k, x in enumerate(order):
        t, nxt = x[1] or "", order[(k + 1) % len(order)][1] or ""
        h = len(t) // 2
        want.append((str(x[0]), len(t), hashlib.sha256((t[: len(t) - h] + nxt[:h]).encode()).hexdigest()))
    got = [(str(r.doc_id), r.n_chars, r.edited_sha256) for r in results["op1_simhash"]]
    assert sorted(got) == sorted(want)
    prints = defaultdict(set)
    for r in results["op1_simhash"]:
        prints[r.doc_id].add(r.fingerprint)
    assert prints[200] == prints[3] and prints[203] == prints[204] == {"0" * 32}


def test_jaccard_components(results, rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for x in rows:
        w = WORD.findall((x[1] or "").translate(low))
        sets.append({tuple(w[j : j + 3]) for j in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set())
    par = list(range(len(rows)))

    def find(i):
        while par[i] != i:
            i = par[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                par[find(i)] = find(j)
    least = defaultdict(list)
    for i, x in enumerate(rows):
        least[find(i)].append(x[0])
    want = sorted((str(x[0]), len(sets[i]), str(min((v for v in least[find(i)] if v is not None), default=None) if sets[i] else x[0])) for i, x in enumerate(rows))
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in results["op2_ngram_jaccard"]) == want


def test_lines(results, rows):
    kept = {}
    for r in results["op4_line_minhash"]:
        if r.doc_id in (3, 200, 203, 204, 7, 201):
            kept[r.doc_id] = r
    text = {x[0]: x[1] for x in rows}
    assert kept[3].text == text[3] and kept[203].text is None and kept[204].text == ""
    assert kept[200].n_dropped == sum(len(" ".join(x.split())) >= 40 for x in text[3].split("\n"))
    assert kept[201].n_dropped >= sum(len(" ".join(x.split())) >= 40 for x in text[7].split("\n")) - 1


def test_mix(results):
    by = defaultdict(list)
    for r in results["op6_mixing_es"]:
        by[(r.source_size, r.target)].append(r)
        assert 0 <= r.taken <= 3 * r.size
    total = sum(s for s, _ in by)
    assert sum(t for _, t in by) == pytest.approx(total)
    for (_, target), rs in by.items():
        assert abs(sum(r.taken for r in rs) - target) <= 1 or len({r.doc_id for r in rs}) < len(rs)


def test_pieces(results, rows):
    by, seqs = defaultdict(list), Counter()
    for r in results["op9_packing_pow2"]:
        by[r.doc_id].append(r)
        seqs[r.sequence_id] += 1
        assert r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 2048
    assert set(seqs) == set(range(len(seqs))) and set(seqs.values()) == {1}
    assert by[203][0].doc_tokens == 1 and by[204][0].length == 1
    for i in (0, 208, 209):
        ps = sorted(by[i], key=lambda r: r.start)
        assert [p.start for p in ps] == [sum(q.length for q in ps[:k]) for k in range(len(ps))] and sum(p.length for p in ps) == ps[0].doc_tokens


def test_secrets(results):
    r = next(r for r in results["op10_secret_scan"] if r.doc_id == 209)
    assert (r.n_assign, r.n_access, r.n_hex) == (1, 1, 1) and r.spans.startswith("assign:0:21,access:")
    empty = next(r for r in results["op10_secret_scan"] if r.doc_id == 203)
    assert empty.spans == "" and empty.base_sha256 == hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("name", list(ORACLES))
def test_sql_says_the_same(results, sf, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet/*.parquet')")
    r = c.sql(ORACLES[name])
    got = results[name]
    columns = sorted(r.columns)
    if name.startswith("op6"):  # rows with equal ids may share in any order
        twice = {x.doc_id for x in got if sum(y.doc_id == x.doc_id for y in got) > 1}
    else:
        twice = set()
    rows = [dict(zip(r.columns, x, strict=True)) for x in r.fetchall()]
    want = sorted(repr(tuple(x[k] for k in columns)) for x in rows if x["doc_id"] not in twice)
    assert sorted(repr(tuple(x[k] for k in columns)) for x in got if x.doc_id not in twice) == want


def test_pipeline(spark, sf, rows):
    import corpus_pipeline

    names = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(*names)
    seen = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf)
        if i < 4:
            assert set(docs.columns) >= set(names)
        folder = f"{sf}/stage{i}"
        docs.write.mode("overwrite").parquet(folder)
        docs = spark.read.parquet(folder)
        seen.append(docs.count())
    assert seen[0] >= seen[1] >= seen[2] > 0 and seen[4] > 0
