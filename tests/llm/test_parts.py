"""The parts of the operators against brute force, without Spark."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glint.llm import langid_crossparse, line_minhash, packing_pow2, quality_qda, secret_scan, simhash, textarrays
from glint.llm.regexdfa import compile_rules
from glint.llm.toxicity_fuzzy import EXACT, FUZZY, FUZZY_STEM, NONE, STEM, FuzzyTrie

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\té x", max_size=12), max_size=6))
def test_words_and_shingles(texts):
    counts, sets = [], []
    for _, n, buf, off in textarrays.blocks(pa.array(texts, pa.string())):
        starts, ends, first = textarrays.spans(buf, off)
        counts += [buf[a:b].tobytes().decode() for a, b in zip(starts, ends)]
        h, text = textarrays.shingles(textarrays.hashes(buf, starts, ends), first, 3)
        sets += [len(set(h[text == i].tolist())) for i in range(n)]
    words = [WORD.findall(t) for t in texts]
    assert counts == [w for ws in words for w in ws]
    assert sets == [len({tuple(w[j : j + 3]) for j in range(len(w) - 2)}) if len(w) >= 3 else int(bool(w)) for w in words]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abc=x ", max_size=14))
def test_automaton_accepts_what_the_expression_matches(text):
    pattern = "a(b|c)+=? {0,2}x{1,3}|ba*c"
    dfa = compile_rules([pattern], [False], search=False)
    s = dfa.start
    for b in text.encode():
        s = dfa.next[s][b]
    assert (s >= dfa.first_final) == bool(re.fullmatch(pattern, text))


PIECES = ["token", "secret", "API_KEY", "apikey", "passwd", "=", ":", " ", "'", '"', "abc", "deadbeef" * 3, "0f", "AK" + "IA", "ABCD" * 4, "é", "x=", "\n", "token=key:abcdefgh"]
KINDS = [
    (re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m.group(2)) >= 6),
    (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m.group()) >= 20),
    (re.compile("[0-9a-f]+"), lambda m: len(m.group()) >= 24),
]


def test_secret_spans_are_those_of_the_expressions():
    r, scanner = random.Random(3), secret_scan.Scanner(secret_scan.BASE_RULES + secret_scan.MORE_RULES)
    for _ in range(3000):
        text = "".join(r.choice(PIECES) for _ in range(r.randint(0, 14)))
        at = secret_scan.codepoint_offsets(text.encode())
        got = [(k, at[a], at[b]) for k, a, b in scanner.spans(text.encode()) if k < 3]
        want = sorted(((k, m.start(), m.end()) for k, (p, ok) in enumerate(KINDS) for m in p.finditer(text) if ok(m)), key=lambda x: (x[1], x[0]))
        assert got == want, text


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_fuzzy_trie_against_distances():
    r, terms, stems = random.Random(1), ("idiot", "worthless", "scum", "disgusting"), ("lostrach", "vequ")
    trie, allowed = FuzzyTrie(terms, stems), lambda t: 0 if len(t) < 5 else 1 if len(t) < 10 else 2
    for _ in range(4000):
        w = list(r.choice((*terms, *(s + "abc" for s in stems), "clouds")))
        for _ in range(r.randint(0, 3)):
            i = r.randrange(len(w) + 1)
            w[i : i + r.randint(0, 1)] = r.choice(["", "x", "i", "s"])
        w = "".join(w)
        words = min((_distance(w, t) for t in terms if _distance(w, t) <= allowed(t)), default=None)
        stem = [min(_distance(w[:n], s) for n in range(len(w) + 1)) <= max(0, 0 if len(s) - 2 < 5 else 1) for s in stems]
        want = EXACT if words == 0 else STEM if any(w.startswith(s) for s in stems) else FUZZY if words is not None else FUZZY_STEM if any(stem) else NONE
        assert trie.match(w) == want, w


def test_suffix_automaton_and_phrases():
    r = random.Random(2)
    train = "".join(r.choice("abcd ") for _ in range(300))
    model = langid_crossparse.Model((("a", train), ("b", train[::-1] + "xyz")))
    for text in ["abcabc dd", "", "zzz", "".join(r.choice("abcdx ") for _ in range(900))]:
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        cost, letters = model.parse(points, np.array([0, len(points)]))
        source = train
        phrases = 0
        for a in range(0, len(text), langid_crossparse.RUN):
            run, i = text[a : a + langid_crossparse.RUN], 0
            fold = lambda s: re.sub(r"[^a-dxyz]", " ", s) if False else s
            while i < len(run):
                j = i + 1
                while j <= len(run) and fold(run[i:j]) in source:
                    j += 1
                phrases += 1
                i = max(j - 1, i + 1)
        if text and "x" not in text and "z" not in text:
            assert cost[0, 0] == pytest.approx(phrases * model.weight[0] / len(text))
        assert letters[0] == sum(c.isalpha() for c in text)


def test_packing_lengths_and_ids():
    for n in [1, 2, 3, 2047, 2048, 2049, 5000]:
        parts = packing_pow2.lengths(n)
        assert sum(parts) == n and parts == sorted(parts, reverse=True) and all(p & (p - 1) == 0 and p <= 2048 for p in parts)
        assert len(parts) == n // 2048 + bin(n % 2048).count("1")
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(packing_pow2.TOKENIZER))
    texts = ["", "Don't stop, it''s", "áb  x\x1cy é́", "<|endoftext|> hi", "Straße İstanbul", "x" * 3000, None, "日本語 テスト 123４５"]
    got = [x.tolist() for b in packing_pow2.token_ids(pa.array(texts)) for x in b]
    assert got == [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert zlib.crc32(np.array([1], "<u4").tobytes()) == zlib.crc32(b"\x01\0\0\0")


def test_fingerprints():
    r = random.Random(4)
    text = " ".join(f"w{r.randrange(5000)}" for _ in range(400))
    near = text.replace(text.split()[7], "other", 1)
    far = " ".join(f"v{r.randrange(5000)}" for _ in range(400))
    p = simhash.fingerprints(pa.array([text, text, near, far, "", None]))
    assert (p[0] == p[1]).all() and not p[4].any() and not p[5].any()
    like = lambda i, j: simhash.likeness(p[i : i + 1], p[j : j + 1])[0]
    assert like(0, 2) > 0.85 > 0.5 > like(0, 3)
    assert simhash.edited("abcde", "xyz") == "abcxy" and simhash.edited("abcd", "x") == "abx" and simhash.edited("", "x") == ""


def test_block_tables_cover_every_pair_within_the_radius():
    r = random.Random(6)
    for n in (10, 10**6, 10**10):
        tables = simhash.tables(n)
        for _ in range(300):
            flipped = set(r.sample(range(simhash.BITS), simhash.RADIUS))
            assert any(not flipped & set(t) for t in tables)


def test_line_bands_find_near_lines():
    r = random.Random(8)
    lines = [" ".join(f"{r.choice('abcdefgh')}{r.randrange(900)}" for _ in range(40)) for _ in range(60)]
    near = [x[:-6] + "zzzzzz" for x in lines]
    flat = [x.encode() for x in lines + near]
    keys, words = line_minhash.signatures(*line_minhash.char_shingles(flat))
    assert all((keys[i] == keys[i + 60]).any() for i in range(60))
    assert not any((keys[i] == keys[j]).any() for i in range(60) for j in range(i))
    sets = [{x[k : k + 8] for k in range(len(x) - 7)} for x in lines + near]
    for i in range(120):  # a sketch never differs in more bits than the sets do
        for j in (i, (i + 60) % 120, (i + 1) % 120):
            apart = int(np.bitwise_count(words[i] ^ words[j]).sum())
            assert apart <= len(sets[i] ^ sets[j]) and (j != i + 1 or apart > 100)
    want = [100 * len(sets[i] & sets[i + 60]) >= 80 * len(sets[i] | sets[i + 60]) for i in range(60)]
    assert line_minhash.similar(lines, near, 80).tolist() == want
    assert line_minhash.similar(["short", "x" * 9, ""], ["short", "x" * 9, ""], 80).tolist() == [False, True, False]


def test_qda_separates_and_survives_few_labels():
    good, bad = ["some plain words here and there " * 5] * 6, ["WORDS!! SHOUT!! #### $$$ " * 6] * 6
    s = quality_qda.statistics(pa.array(good + bad + ["", None]))
    model = quality_qda.fit(s[:12], np.array([1] * 6 + [0] * 6))
    score = model.score(s)
    assert (score[:6] > 0.9).all() and (score[6:12] < 0.1).all() and 0 <= score[12] <= 1
    assert quality_qda.fit(s[:0], np.zeros(0)).score(s)[0] == pytest.approx(0.5)
