import numpy as np
import pytest
from conftest import ranked

from gleaner import session
from gleaner.operators import als as als_module
from gleaner.operators import products, sweeps
from gleaner.operators.als import ImplicitALS
from gleaner.operators.products import above, best_of, best_products, search
from gleaner.operators.splits import unix

CUT = unix("2023-06-01")
GROUP_A, GROUP_B = [1, 2, 3, 4, 5, 6], [10, 11, 12, 13, 14, 15]
HISTORIES = {0: [1, 2], 1: [10, 11], 2: [9999], 4: GROUP_A + GROUP_B, 5: [1, 1, 2]}


@pytest.fixture(scope="module")
def table(spark):
    rows = [(u, i, unix("2023-05-01")) for u in range(20) for i in GROUP_A]
    rows += [(u, i, unix("2023-05-01")) for u in range(20, 40) for i in GROUP_B]
    rows += [(0, 777, unix("2023-05-01"))]
    return spark.createDataFrame(rows, "user_idx int, item_idx int, ts bigint")


@pytest.fixture(scope="module")
def model(table):
    return ImplicitALS(factors=4, iterations=5, min_user_interactions=5, blocks=2,
                       shelf_items=6, step_items=3).fit(table, CUT)


def _factors(df):
    rows = df.collect()
    return {r[0]: np.array(r["features"], dtype=np.float64) for r in rows}


def test_thresholds_and_stats(model):
    assert model.stats().first().asDict() == {
        "users_trained": 40, "items_trained": 12, "factors": 4}


def test_too_few_interactions(table):
    with pytest.raises(ValueError, match="no interactions"):
        ImplicitALS(min_user_interactions=99).fit(table, CUT)
    with pytest.raises(RuntimeError):
        ImplicitALS().recommend(table, 3)


def test_recommendations_stay_in_the_group(model, histories):
    got = ranked(model.recommend(histories({0: [1, 2], 1: [10, 11], 2: [9999]}), 3))
    assert set(got) == {0, 1}
    assert set(got[0]) <= set(GROUP_A) - {1, 2} and set(got[1]) <= set(GROUP_B) - {10, 11}


@pytest.mark.parametrize("mode", ["scaled", "plain"])
def test_fold_in_solves_the_normal_equations(model, histories, mode):
    model.reg_mode = mode
    y = _factors(model.item_factors)
    every = np.stack(list(y.values()))
    got = _factors(model.fold_in(histories(HISTORIES)))
    assert set(got) == {0, 1, 4, 5}
    for user in got:
        ys = np.stack([y[i] for i in sorted(set(HISTORIES[user]))])
        reg = model.regularization * (len(ys) if mode == "scaled" else 1)
        left = every.T @ every + (model.alpha - 1) * ys.T @ ys + reg * np.eye(4)
        want = np.linalg.solve(left, model.alpha * ys.sum(axis=0))
        np.testing.assert_allclose(got[user], want, rtol=2e-3, atol=2e-4)
    model.reg_mode = "scaled"


def test_folding_in_a_trained_user_gives_its_vector(model, table):
    trained = _factors(model.user_factors)
    got = _factors(model.fold_in(table.filter("user_idx in (3, 30) and item_idx < 700")))
    for user in (3, 30):
        np.testing.assert_allclose(got[user], trained[user], rtol=1e-3, atol=1e-4)


@pytest.mark.parametrize("shelf", [6, 1000])
def test_shelved_search_is_exact(model, histories, shelf, monkeypatch):
    """Shelves of 6 items in steps of 3 give the same lists as one dense product."""
    monkeypatch.setattr(model, "shelf_items", shelf)
    y = _factors(model.item_factors)
    ids = np.array(sorted(y))
    dense = np.stack([y[i] for i in ids]).astype(np.float32)
    vectors = _factors(model.fold_in(histories(HISTORIES)))
    got = ranked(model.recommend(histories(HISTORIES), 15))
    for user, vector in vectors.items():
        scores = dense @ vector.astype(np.float32)
        keep = [n for n, i in enumerate(ids) if i not in HISTORIES[user]]
        want = [int(ids[n]) for n in sorted(keep, key=lambda n: (-scores[n], ids[n]))][:15]
        near = np.sort(scores[keep])
        if len(near) < 2 or np.min(np.diff(near)) > 1e-6:  # no ties within float error
            assert got.get(user, []) == want
        else:
            assert set(got.get(user, [])) == set(want)


def test_ties_go_to_the_smaller_id():
    ids = np.array([[9, 3, 7, 1], [9, 3, 7, 1]])
    scores = np.array([[2.0, 2, 2, 0], [1, 5, 4, 3]])
    best, values = best_of(ids, scores, 2)
    assert best.tolist() == [[3, 7], [3, 7]] and values.tolist() == [[2, 2], [5, 4]]
    # more places than items
    assert best_of(ids, scores, 9)[0].tolist() == [[3, 7, 9, 1], [3, 7, 1, 9]]


def test_lists_do_not_depend_on_parallelism(table, histories, spark):
    def lists():
        model = ImplicitALS(factors=4, iterations=3, min_user_interactions=5).fit(table, CUT)
        return ranked(model.recommend(histories({0: [1, 2], 1: [10, 11]}), 3))

    first = lists()
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert lists() == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_bad_arguments(model, histories):
    with pytest.raises(ValueError):
        model.recommend(histories({0: [1]}), 0)


def _by_length(rng, n, factors, spread):
    """Items whose lengths fall off, as those of seldom bought items do."""
    y = rng.normal(size=(n, factors)) * (np.arange(1, n + 1) ** -spread)[:, None]
    return y[np.argsort(-np.linalg.norm(y, axis=1))].astype(np.float32)


def _dense(ids, y, x, wanted):
    scores = np.round((x @ y.T).astype(np.float64), 5)
    return [[(int(ids[n]), s[n]) for n in np.lexsort((ids, -s))[:w]] for s, w in zip(scores, wanted)]


@pytest.mark.parametrize("step", [7, 64, 5000])
def test_search_equals_the_dense_product(step):
    rng = np.random.default_rng(step)
    y, ids = _by_length(rng, 900, 8, 0.5), rng.permutation(900).astype(np.int32)
    y[100:140] = y[100]                                  # ties go to the smaller id
    x = rng.normal(size=(50, 8)).astype(np.float32)
    wanted = rng.integers(1, 40, 50)
    wanted[7] = 850                                      # one that has seen nearly everything
    row, found, score, _ = search(ids, y, x, wanted, np.full(50, -np.inf), step, 1 << 16)
    got = [[(int(i), s) for r, i, s in zip(row, found, score) if r == n] for n in range(50)]
    want = _dense(ids, y, x, wanted)
    assert [[i for i, _ in g] for g in got] == [[i for i, _ in w] for w in want]
    # a threshold leaves what reaches it
    least = np.array([w[len(w) // 2][1] for w in want])
    row, found, score, _ = search(ids, y, x, wanted, least, step, 1 << 16)
    for n in range(50):
        assert [int(i) for r, i in zip(row, found) if r == n] == [i for i, s in want[n] if s >= least[n]]


def test_far_items_are_never_multiplied():
    rng = np.random.default_rng(2)
    y = _by_length(rng, 40_000, 16, 0.8)
    x = rng.normal(size=(64, 16)).astype(np.float32)
    *_, formed = search(np.arange(len(y), dtype=np.int32), y, x, np.full(64, 20), np.full(64, -np.inf), 512, 1 << 24)
    assert formed < 0.1 * 64 * len(y)
    # nor does one user with a long history cost the others more
    wanted = np.full(64, 20)
    wanted[0] = 20_000
    *_, more = search(np.arange(len(y), dtype=np.int32), y, x, wanted, np.full(64, -np.inf), 512, 1 << 24)
    assert more <= formed + len(y)


def _tables(spark, y, x, wanted):
    items = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(y)], "id int, features array<float>")
    users = spark.createDataFrame([(n, v.tolist(), int(w)) for n, (v, w) in enumerate(zip(x, wanted))],
                                  "user_idx int, features array<float>, wanted int")
    return items, users


def test_users_are_sent_to_shelves_in_reach_only(spark):
    rng = np.random.default_rng(3)
    y = _by_length(rng, 600, 8, 1.0)
    x = rng.normal(size=(40, 8)).astype(np.float32)
    items, users = _tables(spark, y, x, [5] * 39 + [590])
    found = best_products(items, users, 8, 50, 10, 1 << 20).collect()
    want = _dense(np.arange(600), y, x, [5] * 39 + [590])
    by_user = {}
    for r in found:
        by_user.setdefault(r["user_idx"], []).append((-r["score"], r["item_idx"]))
    for n, w in enumerate(want):
        assert [i for _, i in sorted(by_user[n])[:len(w)]] == [i for i, _ in w]
    # the first of 12 shelves, and little more, for all but the last user
    assert sum(len(v) for n, v in by_user.items() if n < 39) < 39 * 5 * 2


def test_no_items_or_users(spark):
    items, users = _tables(spark, np.ones((3, 4)), np.ones((2, 4)), [2, 2])
    assert best_products(items.limit(0), users, 4, 2, 2, 1 << 20).count() == 0
    assert best_products(items, users.limit(0), 4, 2, 2, 1 << 20).count() == 0


def test_all_pairs_above_a_score(spark):
    """Every pair beyond the user's bound, whatever the blocks; nothing else leaves a task."""
    rng = np.random.default_rng(8)
    y, x = rng.normal(size=(300, 4)).astype(np.float32), rng.normal(size=(40, 4)).astype(np.float32)
    least = np.sort(x.astype(np.float64) @ y.T.astype(np.float64), axis=1)[:, -7]
    items = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(y)], "item_idx int, features array<float>")
    users = spark.createDataFrame([(u, [float(v) for v in r], float(b)) for u, (r, b) in enumerate(zip(x, least))],
                                  "user_idx int, features array<float>, least double")
    whole = x.astype(np.float64) @ y.T.astype(np.float64)
    want = {(u, i) for u, i in zip(*np.nonzero(whole > least[:, None] + 1e-9))}
    for per_block in (300, 37):
        got = {(r[0], r[1]): r[2] for r in above(items, users, 4, per_block, 1 << 16).collect()}
        assert want <= set(got) and len(got) <= len(want) + 40
        assert all(abs(whole[key] - score) < 1e-9 for key, score in got.items())


def test_shelves_in_rounds_keep_what_is_wanted(spark):
    """Many shelves of vectors of the same length: no more rows are kept than are wanted."""
    rng = np.random.default_rng(9)
    y = rng.normal(size=(400, 4))
    y = (y / np.linalg.norm(y, axis=1)[:, None]).astype(np.float32)
    x = rng.normal(size=(10, 4)).astype(np.float32)
    items = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(y)], "id int, features array<float>")
    users = spark.createDataFrame([(u, [float(v) for v in r], 6) for u, r in enumerate(x)],
                                  "user_idx int, features array<float>, wanted int")
    got = {}
    for r in best_products(items, users, 4, 20, 10, 1 << 20).collect():
        got.setdefault(r["user_idx"], []).append(r["item_idx"])
    scores = np.round((x @ y.T).astype(np.float64), 5)
    for u in range(10):
        assert sorted(got[u]) == sorted(sorted(range(400), key=lambda i: (-scores[u, i], i))[:6])


def test_training_checkpoints_every_iteration(spark, table, monkeypatch):
    """The shuffles of an iteration can only be removed once its factors are checkpointed."""
    asked = {}

    class Noted(als_module.ALS):
        def fit(self, ratings):
            asked["interval"] = self.getCheckpointInterval()
            return super().fit(ratings)

    monkeypatch.setattr(als_module, "ALS", Noted)
    ImplicitALS(factors=2, iterations=3, blocks=2).fit(table, CUT)
    assert asked["interval"] == 1


def test_a_far_product_costs_one_comparison(monkeypatch):
    """Only products that reach a row's bound are rounded and sorted, not every one that is formed."""
    sorted_ = []
    monkeypatch.setattr(products, "best_of", lambda ids, scores, k: (sorted_.append(np.isfinite(scores).sum()),
                                                                     best_of(ids, scores, k))[1])
    rng = np.random.default_rng(11)
    y = _by_length(rng, 20_000, 16, 0.0)                 # no lengths to go by
    x, ids = rng.normal(size=(40, 16)).astype(np.float32), rng.permutation(20_000).astype(np.int32)
    wanted = np.full(40, 30)
    row, found, score, formed = search(ids, y, x, wanted, np.full(40, -np.inf), 500, 1 << 24)
    assert formed > 0.5 * 40 * 20_000 and sum(sorted_) < 0.05 * formed
    assert [found[row == n].tolist() for n in range(40)] == [[i for i, _ in w] for w in _dense(ids, y, x, wanted)]


def test_small_blocks_give_the_factors_of_training_whole(spark, monkeypatch):
    """Beyond MLlib's memory the iterations run in blocks of few ratings, of which none holds more vectors
    than it has ratings; the factors are the same, also with repeated pairs and one very popular item."""
    rng = np.random.default_rng(12)
    rows = [(int(u), int(i), unix("2023-05-01")) for u in range(-3, 300) for i in rng.choice(90, rng.integers(5, 30)) ** 2]
    rows += [(u, 7, unix("2023-05-01")) for u in range(300)]
    table = spark.createDataFrame(rows, "user_idx int, item_idx int, ts bigint")

    def fitted():
        model = ImplicitALS(factors=5, iterations=3, blocks=3).fit(table, CUT)
        return _factors(model.user_factors), _factors(model.item_factors)

    whole = fitted()
    held, filled = [], sweeps.packed
    monkeypatch.setattr(als_module, "WHOLE_ROWS", 100)
    monkeypatch.setattr(sweeps, "LEAST_ROWS", 400)
    monkeypatch.setattr(sweeps, "GATHERED", 64)          # the popular item's ratings come in pieces
    monkeypatch.setattr(sweeps, "packed", lambda *args: (held.append(filled(*args)), held[-1])[1])
    monkeypatch.setattr(sweeps, "discard", lambda table: None)
    cut = fitted()
    for old, new in zip(whole, cut):
        assert set(old) == set(new)
        for key in old:
            np.testing.assert_allclose(new[key], old[key], rtol=1e-3, atol=1e-5)
    users, items = held
    assert users.count() > 6 and items.count() > 6       # not the model's three blocks
    spread = users.selectExpr("length(named) / 4 AS vectors", "length(places) / 4 AS ratings").collect()
    assert all(r["vectors"] <= r["ratings"] < 0.4 * len(rows) for r in spread)


def test_passing_tables_leave_nothing_behind(spark):
    """Settings come back, and a table that is discarded is gone."""
    import os

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    with session.passing(spark):
        assert spark.conf.get(key) != before
        table = session.snapshot(spark.range(9).repartition(3), "passing")
    assert spark.conf.get(key) == before and table.count() == 9
    folder = table.inputFiles()[0].rsplit("/", 1)[0].split(":", 1)[1]
    session.discard(table)
    assert not os.path.exists(folder)
