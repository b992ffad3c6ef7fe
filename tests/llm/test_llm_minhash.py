import random

import numpy as np
from odd import LONG, documents, odd_rows, words

from gleaner.llm import minhash as M


def test_agreement_is_weighted_similarity():
    rng = np.random.default_rng(1)
    e = np.sort(rng.integers(0, 2**63, 300).astype(np.uint64))
    for fractions in (False, True):
        a = rng.integers(1, 4, 300) * (rng.random(300) if fractions else 1)
        b = np.where(rng.random(300) < 0.8, a, a * 0.4 if fractions else rng.integers(1, 4, 300))
        s = M.signatures([(e, a), (e, b)], 4096)
        assert abs((s[0] == s[1]).mean() - M.similarity((e, a), (e, b))) < 0.03


def brute(rows):
    """Union over all pairs at 0.8, repeated ids being one document."""
    above = {d: d for d, *_ in rows if d is not None}

    def root(d):
        while above[d] != d:
            d = above[d]
        return d

    sets = [(d, M.elements(M.words_of(t), {})) for d, t, *_ in rows if d is not None and M.words_of(t)]
    for n, (a, x) in enumerate(sets):
        for b, y in sets[:n]:
            if M.similarity(x, y) >= 0.8:
                lo, hi = sorted((root(a), root(b)))
                above[hi] = lo
    return {d: root(d) for d in above}


def edited(text, rng, share):
    return [rng.choice("xyz") * 3 if rng.random() < share else w for w in text]


def test_classes_equal_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    base, other = words(1, 200), words(2, 150)
    rows = [(n, " ".join(edited(base, rng, rng.choice([0, 0.01, 0.02, 0.05]))), "a") for n in range(100, 160)]
    rows += [(n, " ".join(edited(other, rng, 0.03)), "a") for n in range(200, 220)]
    rows += [(n, " ".join(words(n, 80)), "a") for n in range(300, 320)]
    chain = words(9, 120)                                # neighbours are alike, the ends are not
    rows += [(400 + n, " ".join(words(50 + n, 4 * n) + chain[4 * n:]), "a") for n in range(6)]
    rows += [(500, "Four words only here", "a"), (501, "four WORDS only, here", "a"), (502, "!!!", "a"),
             (503, "!!!", "a"), (504, " ".join(base), "a"), (504, " ".join(other), "a")]
    rows = odd_rows(rows)
    monkeypatch.setattr(M, "BLOCK", 16)                  # buckets are cut into blocks
    got = {r["doc_id"]: r for r in M.near_duplicates(documents(spark, rows)).collect()}
    want = brute(rows)
    assert {d: got[d]["class_id"] for d in want} == want
    assert all(r["kept"] == (d is None or d == r["class_id"]) for d, r in got.items())
    assert got[502]["kept"] and got[503]["kept"] and got[None]["kept"]
    assert M.near_duplicates(documents(spark, rows)).count() == len(rows)
    assert M.near_duplicates(documents(spark, [])).count() == 0


def test_very_long_copies(spark):
    rows = [(1, LONG), (2, LONG + " more"), (3, LONG.upper())]
    got = {r["doc_id"]: r["class_id"] for r in M.near_duplicates(documents(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 1}
