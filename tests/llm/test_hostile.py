"""Hostile texts in linear time, all kinds of secrets against Python's patterns, and languages of other scripts."""

import random
import re
import time

import numpy as np
import pyarrow as pa

from glint.llm import langid_crossparse, secret_scan, simhash, toxicity_fuzzy


def test_a_megabyte_of_beginnings():
    scanner = secret_scan.Scanner(secret_scan.BASE_RULES + secret_scan.MORE_RULES)
    began = time.process_time()
    assert scanner.spans(b"eyJaa" * 200_000) == []
    good = b"eyJ" + b"a" * 12 + b".eyJ" + b"b" * 12 + b"." + b"c" * 12
    data = b"eyJaa" * 1000 + b" " + good + b" " + b"eyJaa" * 1000
    assert scanner.spans(data) == [(8, 5001, 5001 + len(good))]
    assert time.process_time() - began < 20


def test_added_kinds_against_patterns():
    r = random.Random(3)
    rules = secret_scan.MORE_RULES
    scanner = secret_scan.Scanner(rules)
    run = lambda n, a="abcXYZ019": "".join(r.choice(a) for _ in range(n))
    shapes = [
        lambda: f"gh{r.choice('opsurx')}_{run(r.choice([35, 36, 40]))}", lambda: f"AIza{run(r.choice([34, 35, 50]))}", lambda: f"xox{r.choice('abprsz')}-{run(r.choice([5, 6, 9]), '0123456789')}-{run(r.choice([9, 10, 20]))}",
        lambda: f"{r.choice('rsp')}k_live_{run(r.choice([23, 24, 30]))}", lambda: f"-----BEGIN {r.choice(['', 'RSA ', 'EC ', 'X '])}PRIVATE KEY{r.choice(['', ' BLOCK'])}-----",
        lambda: f"eyJ{run(r.choice([9, 10, 400]))}.eyJ{run(r.choice([9, 10, 300]))}.{run(r.choice([9, 10, 20]))}", lambda: run(r.randint(1, 9)), lambda: "eyJaa" * r.choice([1, 90]),
    ]
    found = 0
    for _ in range(300):
        text = r.choice(["", " ", "\n", "."]).join(r.choice(shapes)() for _ in range(8))
        want = sorted(((k, m.start(), m.end()) for k, rule in enumerate(rules) for m in re.finditer(rule.pattern, text)), key=lambda x: (x[1], x[0]))
        assert scanner.spans(text.encode()) == want, text
        found += len(want)
    assert found > 500


def test_five_scripts_are_told_apart():
    r = random.Random(4)
    letters = {"en": "abcdefghijklmnopqrstuvwxyz", "ru": "абвгдежзийклмнопрстуфхцчшщыэюя", "fa": "ابپتثجچحخدذرزژسشصضطظعغفقکگلمنوهی", "ko": "".join(map(chr, range(0xAC00, 0xAC00 + 900))), "zh": "".join(map(chr, range(0x4E00, 0x4E00 + 2500)))}
    words = {k: ["".join(r.choice(a) for _ in range(r.randint(1, 5))) for _ in range(400)] for k, a in letters.items()}
    text = lambda k, n: " ".join(r.choice(words[k]) for _ in range(n))
    model = langid_crossparse.Model(tuple(sorted((k, text(k, 3000)) for k in letters)))
    asked = [(k, text(k, 40)) for k in letters for _ in range(20)]
    langs, scores = model.predict(pa.array([t for _, t in asked]))
    assert langs == [k for k, _ in asked] and min(scores) > 0


def test_fingerprint_of_a_million_words_against_votes():
    text = " ".join(f"w{i % 977}" for i in range(1_000_000))
    a, b = simhash.fingerprints(pa.array([text, "x " + text + " y"]))
    assert a.any() and int(np.unpackbits(a ^ b).sum()) < 8
    few = "one two three four five six one two three four five"
    from glint.llm.textarrays import _STEP, blocks, hashes, mix, shingles, spans

    _, _, buf, off = next(blocks(pa.array([few])))
    starts, ends, first = spans(buf, off)
    terms, _ = shingles(hashes(buf, starts, ends), first, simhash.TERM)
    votes = [0] * simhash.BITS
    for t in terms:
        raw = b"".join(int(mix(t[None] * _STEP[0] + lane)[0]).to_bytes(8, "little") for lane in simhash._LANES)
        for i in range(simhash.BITS):
            votes[i] += 1 if raw[i // 8] >> (7 - i % 8) & 1 else -1
    got = simhash.fingerprints(pa.array([few]))[0]
    assert [got[i // 8] >> (7 - i % 8) & 1 for i in range(simhash.BITS)] == [int(v > 0) for v in votes]


def test_quotation_is_judged_near_the_word():
    far = "one two three four five six seven eight nine ten"
    cases = {
        '5" pipe fits well. you are an idiot': False, "he said 'you idiot' and left": True, 'she wrote "you are an idiot." to him': True, "“idiot” they called": True, "« idiot » dit": True,
        f'"{far}" you idiot': False, f'"quoted {far} idiot {far} end"': False, 'an "apple" idiot "pear"': False, "idiot": False, '" you idiot "': True, 'you idiot "x"': False,
    }
    scorer = toxicity_fuzzy.Scorer(("idiot",), ())
    got = scorer.features(pa.array(list(cases)))
    quoted = got[:, toxicity_fuzzy.FEATURES.index("quoted")] > 0
    assert dict(zip(cases, quoted.tolist(), strict=True)) == cases
    assert (got[:, 0] > 0).all()


def test_the_automaton_stays_bounded(monkeypatch):
    monkeypatch.setattr(toxicity_fuzzy, "STATES", 60)
    r, trie = random.Random(7), toxicity_fuzzy.FuzzyTrie(("disgusting", "worthless", "idiot"), ("scumb",))
    free = toxicity_fuzzy.FuzzyTrie(("disgusting", "worthless", "idiot"), ("scumb",))
    for _ in range(3000):
        word = "".join(r.choice("disguworthlensmb") for _ in range(r.randint(3, 12)))
        got = trie.match(word)
        monkeypatch.setattr(toxicity_fuzzy, "STATES", 10**9)
        assert got == free.match(word)
        monkeypatch.setattr(toxicity_fuzzy, "STATES", 60)
    assert len(trie.sets) < 90 < len(free.sets)  # a word adds a few states at most
