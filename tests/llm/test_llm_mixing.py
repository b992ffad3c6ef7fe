import random

import pytest
from odd import documents, odd_rows

from gleaner.llm.mixing import capped_targets, mixture


def poured(sizes, weights, share, cap):
    """Clamp and reshare until none is above, by the letter."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[n % len(weights)] for n, s in enumerate(names)}
    left, full = share * sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in full]
        free = left - sum(cap * sizes[s] for s in full)
        target = {s: w[s] * free / sum(w[x] for x in rest) for s in rest}
        over = {s for s in rest if target[s] >= cap * sizes[s]}
        if not over:
            return {**{s: cap * sizes[s] for s in full}, **target}
        full |= over
        if len(full) == len(names):
            return {s: cap * sizes[s] for s in full}


@pytest.mark.parametrize("seed", range(6))
def test_targets_by_water_filling(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{n}": rng.choice([0, 1, 5, 50, 500, 5000]) for n in range(rng.randint(1, 9))}
    if seed % 2:
        sizes[None] = 70
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    got = {r["source"]: r["target"] for r in capped_targets(rows).collect()}
    assert got == pytest.approx(poured(sizes, (5, 2, 1), 1.5, 2))


def test_taken_words_come_near_the_target(spark):
    rng = random.Random(1)
    rows = odd_rows([(n, "w " * rng.choice([0, 1, 30, 200]), rng.choice("aaaaabcde")) for n in range(10, 700)])
    got = mixture(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        assert r["size"] == len((r["text"] or "").replace("\x0b", " ").split()) or r["doc_id"] == 6
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"] and r["n_tokens"] == "x"
        by.setdefault(r["source"], []).append(r)
    for own in by.values():
        largest = max(r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= largest
        assert own[0]["source_size"] == sum(r["size"] for r in own)
    key = lambda rs: sorted(str((r["doc_id"], r["source"], r["copies"])) for r in rs)
    assert key(mixture(documents(spark, rows).repartition(7)).collect()) == key(got)
    assert mixture(documents(spark, [])).count() == 0
