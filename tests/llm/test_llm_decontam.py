import random

import pytest
from odd import LONG, documents, odd_rows

from gleaner.llm.decontam import contamination, words_of


def brute(docs, items, size=10):
    out = []
    for doc, text, *_ in docs:
        w, hit, found = words_of(text), set(), set()
        for item, t in items:
            v = words_of(t)
            for at in range(max(len(v) - size + 1, 1 if v else 0)):
                window = v[at:at + size]
                for p in range(len(w) - len(window) + 1):
                    if w[p:p + len(window)] == window:
                        hit.update(range(p, p + len(window)))
                        found.add(str(item))
        out.append((str(doc), len(w), len(hit), sorted(found)))
    return sorted(out)


def got(frame):
    return sorted((str(r["doc_id"]), r["n_words"], sum(b - a for a, b in r["spans"]), list(r["items"]))
                  for r in frame.collect())


@pytest.mark.parametrize("block", [400_000, 20])
def test_equals_brute_force(spark, block):
    rng = random.Random(5)
    few = ["aa", "bb", "cc", "dd"]
    docs = [(n, " ".join(rng.choice(few) for _ in range(rng.randint(0, 60)))) for n in range(60)]
    items = [(n, " ".join(rng.choice(few) for _ in range(rng.choice([0, 1, 3, 4, 7])))) for n in range(12)]
    items += [(100, docs[7][1]), (101, docs[7][1]), (102, None)]
    docs += docs[:3]                                    # repeated rows are answered each
    frame = contamination(documents(spark, docs), documents(spark, items).withColumnRenamed("doc_id", "item_id"),
                          size=4, terms_a_block=block)
    assert got(frame) == brute(docs, items, 4)


def test_odd_documents(spark):
    rows = odd_rows([(7, "THE Quick-brown fox! jumps over the lazy dog and... ran")])
    items = [(1, "quick brown fox jumps over the lazy dog and runs"), (2, None), (None, "no id here at all"),
             (3, " ".join(LONG.split()[40_000:40_012])), (4, "é漢字")]
    bench = documents(spark, items).withColumnRenamed("doc_id", "item_id")
    known = [i for i in items if i[0] is not None]
    assert got(contamination(documents(spark, rows), bench)) == brute(rows, known)
    assert got(contamination(documents(spark, rows), bench.filter("false"))) == brute(rows, [])
    assert contamination(documents(spark, []), bench).count() == 0


def test_proximity(spark):
    item = "one two three four five six seven eight nine ten"
    docs = [(1, "x " + item), (2, "one two three four oh five six seven eight nine ten"),
            (3, "ten nine eight seven six five four three two one")]
    rows = contamination(documents(spark, docs), documents(spark, [(9, item)]).withColumnRenamed("doc_id", "item_id"))
    assert {r["doc_id"]: (list(r["items"]), list(r["near_items"])) for r in rows.collect()} == {
        1: (["9"], []), 2: ([], ["9"]), 3: ([], [])}


def near_brute(docs, items, size=10, slack=3, share=0.8):
    """Items with a window of which `share` of the words lie within `slack` of their place."""
    out = {}
    for doc, text in docs:
        w, found = words_of(text), set()
        for item, t in items:
            v = words_of(t)
            for at in range(max(len(v) - size + 1, 1 if v else 0)):
                window = v[at:at + size]
                if any(sum(word in w[max(0, s + k - slack):max(0, s + k + slack + 1)] for k, word in enumerate(window))
                       >= share * len(window) for s in range(-size - slack, len(w) + slack)):
                    found.add(str(item))
        out[doc] = found
    return out


def test_proximity_with_any_word_replaced(spark):
    item = "one two three four five six seven eight nine ten".split()
    cut = lambda *gone: " ".join("other" if n in gone else w for n, w in enumerate(item))
    docs = [(n, cut(n)) for n in range(10)] + [(10, cut(0, 9)), (11, cut(0, 4, 9)), (12, cut(2, 3))]
    docs += [(20 + n, "one two three") for n in range(3)]
    rng = random.Random(3)
    few = [f"w{n}" for n in range(8)]
    docs += [(100 + n, " ".join(rng.choice(few) for _ in range(rng.randint(0, 40)))) for n in range(40)]
    items = [(9, " ".join(item))]
    items += [(n + 50, " ".join(rng.choice(few) for _ in range(rng.choice([2, 5, 9, 10, 12])))) for n in range(12)]
    for block in (400_000, 20):
        rows = contamination(documents(spark, docs), documents(spark, items).withColumnRenamed("doc_id", "item_id"),
                             terms_a_block=block).collect()
        assert len(rows) == len(docs)
        got = {r["doc_id"]: set(r["items"]) | set(r["near_items"]) for r in rows}
        assert got == near_brute(docs, items)
        assert all("9" in got[n] for n in (*range(11), 12)) and "9" not in got[11]
