import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import hardneg, sql
from gleaner.llm.hardneg import Bucket, hard_negatives, nearest
from gleaner.llm.queries import op11_hard_negatives

SCHEMA = "vec_id bigint, embedding array<float>, label int, shelf string, q string, anchor string, norm string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", "x", "x", "x") for i, v, label in rows], SCHEMA)


def brute_force(rows, every=10, k=5, n=10):
    real = sorted({(i, label, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v, label in rows
                   if i is not None and label is not None and v is not None
                   and all(x is not None and math.isfinite(x) for x in v)})
    out = []
    for i, label, q in real:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, p)), j, other == label) for j, other, p in real
                        if j != i and len(p) == len(q))
        for ps, pid in [(-s, j) for s, j, same in scored if same][:k]:
            hard = [(j, -s) for s, j, same in scored if not same and 30 * ps <= -100 * s <= 90 * ps][:n]
            out.extend((i, pid, r + 1, j, ps, s) for r, (j, s) in enumerate(hard))
    return sorted(out)


def mined(df, every=10):
    rows = hard_negatives(df, F.col("vec_id") % every == 0).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()
    return sorted(map(tuple, rows))


def clustered(seed, n, dim=8):
    """Clusters of all lengths, a third of the rows one vector, a label that few rows have."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    rows = []
    for i in range(n):
        if i % 3 == 0:
            v = centres[0]
        else:
            v = centres[rng.integers(12)] * rng.uniform(0.1, 2) + rng.normal(size=dim) * 0.3
        rows.append((i, [float(x) for x in v], 7 if i % 97 == 0 else int(rng.integers(3))))
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, monkeypatch, small):
    if small:                                        # many buckets, shelves and lanes
        for name, value in (("BUCKET", 16), ("SHELF", 2), ("LANE", 20)):
            monkeypatch.setattr(hardneg, name, value)
    rows = clustered(4, 420)
    assert mined(table(spark, rows).repartition(5)) == brute_force(rows)


def test_odd_rows(spark):
    rows = [*clustered(5, 40), (40, None, 1), (50, [1.0] * 8, None), (None, [1.0] * 8, 1), (60, [1.0, None] * 4, 1),
            (70, [float("nan")] * 8, 1), (80, [float("inf")] * 8, 1), (90, [0.0] * 8, 1), (100, [0.0] * 8, 1),
            (110, [1.0, 2.0], 1), (111, [1.0, 2.0], 1), (112, [0.5, 1.0], 2), (120, [], 1), (121, [], 1), (122, [], 2),
            (130, [-1.0] * 8, 4), (131, [1.0] * 8, 4), (0, clustered(5, 1)[0][1], clustered(5, 1)[0][2])]
    assert mined(table(spark, rows)) == brute_force(rows)
    assert mined(table(spark, [])) == []
    assert mined(table(spark, [(1, [1.0], 1), (2, [1.0], 2)])) == []


def test_scores_beyond_double_precision(spark):
    rows = [(10, [1e6, 1.0], 1), (11, [1e6, 2.0], 1), (12, [8e5, 0.03], 2), (13, [8e5, 0.02], 2),
            (14, [9e5, 0.91], 2), (15, [9e5, 0.9], 2), (16, [9e5, 1.8], 2), (17, [9e5, 1.81], 2), (20, [1e30, 1.0], 3)]
    got = mined(table(spark, rows))
    assert [r for r in got if r[0] == 10] == [r for r in brute_force(rows[:8]) if r[0] == 10]


def shelf_of(x, labels, size):
    x = np.floor(256 * x)
    order = np.argsort(-np.linalg.norm(x, axis=1), kind="stable")
    out = []
    for at in range(0, len(x), size):
        part = order[at:at + size]
        row = hardneg._bucket({"vec_id": part.tolist(), "position": list(range(len(part))), "dim": [x.shape[1]] * len(part),
                               "bucket": [at // size] * len(part), "label": [labels[i] for i in part],
                               "shorter": [-float(np.linalg.norm(x[i])) for i in part],
                               "q": [x[i].tobytes() for i in part]})
        out.append(Bucket.of({k: v[0] for k, v in row.items()}))
    return out


def test_far_vectors_are_never_multiplied():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(50, 16))
    x = np.concatenate([c + 0.05 * rng.normal(size=(40, 16)) for c in centres])
    labels = [str(i // 20) for i in range(len(x))]             # two labels in each cluster
    shelf = shelf_of(x, labels, 250)
    anchor = int(np.linalg.norm(x, axis=1).argmax())
    q, own = np.floor(256 * x[anchor]), labels[anchor]
    norm = float(np.linalg.norm(q))
    found, tried = nearest(shelf, anchor, own, q, norm, True, 5, [(0, int(0.9 * norm * norm), 2**62)])
    assert tried < 200 and {labels[i] for _, i, _ in found} == {own}
    # without a threshold, the k-th score of the longest vectors takes its place
    _, open_end = nearest(shelf, anchor, own, q, norm, False, 5, [(0, -2**62, 2**62)])
    assert open_end < len(x) / 2


def test_feasible_ranges_lose_no_row():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4)) * rng.uniform(0.01, 3, (300, 1))
    bucket = shelf_of(x, ["a"] * 300, 300)[0]
    for _ in range(200):
        d = rng.normal(size=4)
        d /= np.linalg.norm(d)
        least = rng.uniform(0.001, 1)
        real = set(np.flatnonzero(bucket.unit @ d >= least).tolist())
        assert real <= set(bucket.feasible(d, least).tolist())


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = sorted(con.execute(f"SELECT {', '.join(names)} FROM ({sql.OP11})").fetchall())
    assert sorted(map(tuple, op11_hard_negatives(spark, folder).select(*names).collect())) == want
    assert want

