import numpy as np
import pytest

from gleaner.llm import flatgraph as G

SCHEMA = "vec_id bigint, embedding array<double>, label int, n_links string, shard string, rep string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows], SCHEMA)


def brute(rows):
    units = [(i, None if label is None else G.unit_of(v), label) for i, v, label in rows]
    links, comp = {i: 0 for i, *_ in rows}, {i: i for i, *_ in rows}
    pairs = [(a, b) for n, (a, x, p) in enumerate(units) for b, y, q in units[:n] if a != b and x is not None
             and y is not None and p == q and len(x) == len(y) and x @ y >= 0.93]
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    for _ in rows:
        for a, b in pairs:
            comp[a] = comp[b] = min(comp[a], comp[b])
    return links, comp


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, monkeypatch, small):
    rng = np.random.default_rng(3)
    rows = []
    for label in (0, 1):
        for group in range(12):
            base = rng.normal(size=24)
            for _ in range(8):
                rows.append((len(rows), (base + rng.normal(size=24) * 0.16).tolist(), label))
    base = rng.normal(size=24)
    rows += [(len(rows) + n, (base * (1 + n)).tolist(), 0) for n in range(10)]      # one direction
    rows += [(1000, rows[0][1], 1), (1001, rows[0][1], None), (1002, None, 0), (1003, [0.0] * 24, 0),
             (1004, [float("nan")] * 24, 0), (1005, [1.0, None], 0), (1006, [], 0), (1007, [1e300] * 24, 0),
             (1008, [2e300] * 24, 0), (1009, [1.0] * 12, 0), (1010, [float("inf")] * 24, 0)]
    if small:                                           # several shards, each in several blocks
        monkeypatch.setattr(G, "SHARD", 40)
        monkeypatch.setattr(G, "BLOCK", 20)
    got = {r["vec_id"]: r for r in G.near_vectors(table(spark, rows), recall=0.9).collect()}
    links, comp = brute(rows)
    found = sum(min(got[i]["n_links"], n) for i, n in links.items())
    assert all(got[i]["n_links"] <= n for i, n in links.items())
    assert found >= (0.98 if small else 1.0) * sum(links.values())
    if not small:
        assert {i: r["component_id"] for i, r in got.items()} == comp
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_empty_and_repeated_rows(spark):
    assert G.near_vectors(table(spark, [])).count() == 0
    rows = [(1, [1.0, 0.0], 5), (1, [1.0, 0.0], 5), (2, [1.0, 0.01], 5), (None, [1.0, 0.0], 5)]
    got = sorted((str(r["vec_id"]), r["n_links"], r["component_id"], r["kept"])
                 for r in G.near_vectors(table(spark, rows)).collect())
    assert got == [("1", 1, 1, True), ("1", 1, 1, True), ("2", 1, 1, False), ("None", 0, None, True)]
