import random

import pytest
from conftest import ranked
from pyspark.sql import functions as F

from gleaner.operators.candidates import item_weights
from gleaner.operators.category import CategoryPopularity
from gleaner.operators.content import Content
from gleaner.operators.covisitation import CoVisitation
from gleaner.operators.popularity import Popularity
from gleaner.operators.splits import unix

CUT = unix("2023-06-01")


# popularity --------------------------------------------------------------------------------
@pytest.fixture
def sales(interactions):
    return interactions([(u, 1, "2023-05-01") for u in range(5)]
                        + [(u, 2, "2023-05-01") for u in range(3)]
                        + [(u, 99, "2020-01-01") for u in range(100)])


def test_popularity_window_and_cutoff(sales, histories):
    h = histories({0: [1]})
    assert Popularity().fit(sales, CUT).pool == [1, 2]
    assert Popularity(window_days=None).fit(sales, CUT).pool == [99, 1, 2]
    assert Popularity(window_days=None).fit(sales, unix("2021-01-01")).pool == [99]
    assert ranked(Popularity().fit(sales, CUT).recommend(h, 1)) == {0: [2]}


def test_popularity_unseen_in_order(histories):
    model = Popularity(pool=[1, 2, 3, 4, 5])
    assert ranked(model.recommend(histories({0: [2, 4], 1: [8, 9]}), 3)) == {
        0: [1, 3, 5], 1: [1, 2, 3]}
    assert ranked(Popularity(pool=[1, 2, 3]).recommend(histories({0: [1, 2]}), 3)) == {0: [3]}


def test_popularity_serves_users_without_history(histories, spark):
    users = spark.createDataFrame([(0,), (5,)], "user_idx int")
    got = ranked(Popularity(pool=[4, 3]).recommend(histories({0: [4]}), 2, users))
    assert got == {0: [3], 5: [4, 3]}


@pytest.mark.parametrize("model", [Popularity(), CoVisitation(), CategoryPopularity(),
                                   Content(items=None)])
def test_recommend_before_fit_fails(model, histories):
    with pytest.raises(RuntimeError):
        model.recommend(histories({0: [1]}), 3)


# co-visitation -----------------------------------------------------------------------------
@pytest.fixture
def baskets(interactions):
    """Item 70 goes with 31 as often as 32 does, but is bought five times as often."""
    alone = [(u, 70, "2023-04-02") for u in range(7, 35)]
    return interactions(alone + [(u, i, "2023-04-02") for i in (70, 32, 31) for u in range(7)])


def test_covisitation_normalises_by_popularity(baskets, histories):
    model = CoVisitation().fit(baskets, CUT)
    got = {r["item_idx"]: r["score"] for r in model.recommend(histories({4: [31]}), 3).collect()}
    assert got == pytest.approx({32: 7 / 7, 70: 7 / (7 * 35) ** 0.5})
    assert ranked(model.recommend(histories({4: [31]}), 3)) == {4: [32, 70]}
    assert model.stats().first().asDict() == {"edges": 6, "items_with_neighbours": 3}


@pytest.mark.parametrize("settings,cutoff,item", [
    ({"min_cooccurrence": 8}, CUT, 31),                   # pairs are bought 7 times
    ({}, unix("2025-11-01"), 31),                         # beyond the window
    ({}, CUT, 404)])                                      # nobody has bought it
def test_covisitation_finds_nothing(baskets, histories, settings, cutoff, item):
    assert CoVisitation(**settings).fit(baskets, cutoff).recommend(histories({0: [item]}), 5).isEmpty()


def test_covisitation_takes_the_latest_items(interactions, histories):
    early = [(0, item, f"2023-04-{item - 40}") for item in (50, 51, 52, 53)]
    late = [(u, item, "2023-04-20") for item in (53, 52) for u in (1, 2, 3)]
    model = CoVisitation(max_items_per_user=2).fit(interactions(early + late), CUT)
    assert ranked(model.recommend(histories({8: [50], 9: [52]}), 5)) == {9: [53]}


def test_covisitation_counts_repeated_items(interactions, histories):
    """A basket with an item twice contributes twice, as a self join would."""
    rows = [(0, 1, "2023-05-01"), (0, 1, "2023-05-02"), (0, 2, "2023-05-03")]
    model = CoVisitation(min_cooccurrence=2)
    pairs = model.pairs(model.baskets(interactions(rows), CUT)).collect()
    assert [tuple(p) for p in pairs] == [(1, 2, 2)]


# category popularity -----------------------------------------------------------------------
@pytest.fixture
def shelves(interactions):
    """Sales of each item of category 5 and of category 6, all to different users."""
    sales = [(5, 11, 9), (5, 12, 7), (5, 13, 6), (5, 14, 1), (6, 21, 25), (6, 22, 16)]
    sold = [(item, category) for category, item, n in sales for _ in range(n)]
    return interactions([(u, item, "2023-05-20", category) for u, (item, category) in enumerate(sold)], category=True)


def test_category_popularity(shelves, histories):
    model = CategoryPopularity().fit(shelves, CUT)
    assert model.stats().first().asDict() == {"pool_rows": 6, "categories": 2}
    own = {3: [11], 4: [21, 13, 12, 11], 5: [555]}
    assert ranked(model.recommend(histories(own), 3)) == {3: [12, 13, 14], 4: [14, 22]}


def _brute_category(pool, member, history, k, c=60.0):
    taste = {}
    for item in history:
        for category in member.get(item, ()):
            taste[category] = taste.get(category, 0) + 1
    score = {}
    for category, w in taste.items():
        for rn, item in enumerate(pool.get(category, ()), start=1):
            if item not in history:
                score[item] = score.get(item, 0.0) + w / (c + rn)
    return sorted(score, key=lambda i: (-round(score[i], 10), i))[:k]


@pytest.mark.parametrize("share_multi", [0.0, 0.2, 1.0])
def test_category_pruning_is_exact(interactions, histories, share_multi):
    rng = random.Random(int(share_multi * 10) + 1)
    home = {i: {rng.randrange(5)} | ({rng.randrange(5)} if rng.random() < share_multi else set())
            for i in range(250)}
    rows = []
    for item, categories in home.items():
        for category in categories:
            for _ in range(rng.randrange(1, 9)):
                rows.append((len(rows), item, "2023-05-01", category))
    model = CategoryPopularity(per_category=60).fit(interactions(rows, category=True), CUT)
    counts = {}
    for _, item, _, category in rows:
        counts.setdefault(category, {}).setdefault(item, 0)
        counts[category][item] += 1
    pool = {c: sorted(n, key=lambda i: (-n[i], i))[:60] for c, n in counts.items()}
    given = {u: [rng.randrange(250) for _ in range(rng.choice([1, 2, 6, 25]))] for u in range(60)}
    for k in (3, 20, 200):
        got = ranked(model.recommend(histories(given), k))
        for user, history in given.items():
            assert got.get(user, []) == _brute_category(pool, home, history, k)


def test_entries_do_not_grow_with_the_pools(interactions, histories):
    """All items sit in two categories; longer pools give a user no more entries."""
    opened = []
    for n in (400, 1600):
        rows = [(u, i, "2023-05-01", c) for i in range(n) for c in (i % 4, (i + 1 + i % 3) % 4)
                for u in range(1 + 200 // (i + 1))]
        model = CategoryPopularity(per_category=n).fit(interactions(list(dict.fromkeys(rows)), category=True), CUT)
        weights = item_weights(histories({0: [0, 1, 2], 1: [3]}))
        opened.append({r["user_idx"]: r["count"] for r in
                       model.entries(weights, 20).groupBy("user_idx").count().collect()})
    assert opened[0] == opened[1]
    assert all(20 <= n <= 8 * (20 + 3) for n in opened[0].values())


# content -----------------------------------------------------------------------------------
ITEM_SCHEMA = "item_idx int, main_category_idx int, store_idx int, price double"


@pytest.fixture
def catalogue(spark):
    return spark.createDataFrame(
        [(1, 1, 1, 20.0), (2, 1, 1, 20.0), (3, 1, 1, 20.0), (100, 1, 1, 22.0),
         (10, 1, 2, 500.0), (11, 1, 2, 500.0)], ITEM_SCHEMA)


@pytest.fixture
def bought(interactions):
    return interactions([(u, i, "2023-05-01") for u in range(50) for i in (1, 2, 3, 10, 11)])


def test_content_reaches_cold_items(catalogue, bought, histories):
    model = Content(catalogue).fit(bought, CUT)
    h = histories({0: [1]})
    assert 100 in ranked(model.recommend(h, 5))[0]
    assert model.stats().first()["cold_items"] == 1
    none = Content(catalogue, cold_slots=0, per_store=2, per_category=2).fit(bought, CUT)
    assert 100 not in ranked(none.recommend(h, 5))[0]


def test_content_prefers_store_and_price(catalogue, bought, histories):
    got = ranked(Content(catalogue).fit(bought, CUT).recommend(histories({0: [1]}), 2))[0]
    assert got == [2, 3]
    every = ranked(Content(catalogue).fit(bought, CUT).recommend(histories({0: [1], 1: [77]}), 9))
    assert every == {0: [2, 3, 100, 10, 11]}


def _median(values):
    values = sorted(values)
    n = len(values)
    return (values[(n - 1) // 2] + values[n // 2]) / 2


def _brute_content(items, pop, history, k, per_store, per_category, cold, dup=False):
    seen = set(history)
    profile = [r for i in history for r in items if r[0] == i]
    prices = [r[3] for r in profile if r[3] is not None]
    med = _median(prices) if prices else None
    by_pop = lambda r: (-pop.get(r[0], 0), r[0], r[3] is not None, r[3] or 0)
    out = {}

    def offer(row, signal):
        if row[0] in seen:
            return
        near = med is not None and row[3] is not None and abs(row[3] - med) <= med * 0.5
        key = (row[0], row[3])
        out[key] = max(out.get(key, 0), signal + (0.5 if near else 0.0))

    for store in {r[2] for r in profile if r[2] is not None}:
        mine = sorted([r for r in items if r[2] == store], key=by_pop)
        zero = sorted([r for r in mine if pop.get(r[0], 0) == 0],
                      key=lambda r: (r[0], r[3] is not None, r[3] or 0))
        for row in mine[:per_store] + zero[:cold]:
            offer(row, 2.0)
    weight = {}
    for row in profile:
        if row[1] is not None:
            weight[row[1]] = weight.get(row[1], 0) + 1
    for category, w in weight.items():
        for row in sorted([r for r in items if r[1] == category], key=by_pop)[:per_category]:
            offer(row, w / (w + 3.0))
    ranking = sorted(out, key=lambda key: (-out[key], -pop.get(key[0], 0), key[0],
                                           key[1] is not None, key[1] or 0))
    return [i for i, _ in ranking[:k]]


@pytest.mark.parametrize("seed,repeats", [(1, 0), (2, 25)])
def test_content_pruning_is_exact(spark, interactions, histories, seed, repeats):
    rng = random.Random(seed)

    def row(item):
        return (item, rng.choice([None, 0, 1, 2]), rng.choice([None, 0, 1, 2, 3]),
                rng.choice([None, 5.0, 10.0, 11.0, 14.0, 40.0]))

    items = [row(i) for i in range(150)]
    items = list(dict.fromkeys(items + [row(rng.randrange(150)) for _ in range(repeats)]))
    pop = {i: rng.choice([0, 1, 2, 3, 9]) for i in range(150)}
    sold = [(n, i, "2023-05-01") for i, times in pop.items() for n in range(times)]
    given = {u: [rng.randrange(150) for _ in range(rng.choice([1, 2, 5, 30]))] for u in range(50)}
    model = Content(spark.createDataFrame(items, ITEM_SCHEMA), per_store=25, per_category=30,
                    cold_slots=6).fit(interactions(sold), CUT)
    for k in (4, 30, 120):
        got = ranked(model.recommend(histories(given), k))
        for user, history in given.items():
            assert got.get(user, []) == _brute_content(items, pop, history, k, 25, 30, 6)


def test_store_of_repeated_items_only(spark, interactions, histories):
    """Every item of the store has two price rows; the user's other store item is still found."""
    items = [(1, None, 1, 10.0), (1, None, 1, 12.0), (2, None, 1, 10.0), (2, None, 1, 12.0)]
    model = Content(spark.createDataFrame(items, ITEM_SCHEMA)).fit(
        interactions([(9, 1, "2023-05-01"), (9, 2, "2023-05-01")]), CUT)
    got = model.recommend(histories({0: [1]}), 5).collect()
    assert {r["item_idx"] for r in got} == {2} and len(got) == 2


def test_content_opens_few_entries(spark, interactions, histories):
    """A user of many large stores: rows come to a few times k, not to stores x pool."""
    rng = random.Random(6)
    items = [(n, 0, n % 40, round(10 * 2 ** rng.uniform(-2, 2), 2)) for n in range(8000)]
    sold = [(u, i, "2023-05-01") for i in range(8000) for u in range(max(1, int(2000 / (i // 40 + 1) ** 1.2)))]
    model = Content(spark.createDataFrame(items, ITEM_SCHEMA)).fit(interactions(sold), CUT)
    given = {0: list(range(0, 40)), 1: list(range(40, 60))}
    k = 200
    weights = item_weights(histories(given))
    profile = model.profile(weights)
    own = (profile.groupBy("user_idx", "store_idx").agg(F.sum("items").alias("h"))
           .join(model.median_prices(profile), "user_idx", "left"))
    opened = {r["user_idx"]: r["count"] for r in
              model.opened(own, model._needs(own, k)).groupBy("user_idx").count().collect()}
    assert k <= opened[0] <= 3 * k and k <= opened[1] <= 3 * k
    assert all(len(v) == k for v in ranked(model.recommend(histories(given), k)).values())


def test_content_counts_without_opening_shelves(spark, interactions, histories):
    model = Content(spark.createDataFrame([(1, 1, 1, 20.0), (2, 1, 1, 21.0)], ITEM_SCHEMA)).fit(
        interactions([(9, 1, "2023-05-01")]), CUT)
    own = spark.createDataFrame([(0, 1, 1, 20.0)], "user_idx int, store_idx int, h int, med_price double")
    text = model._needs(own, 1)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in text and "entries" not in text
    assert tuple(model._needs(own, 1).first()) == (0, 0, 0, True)
    assert tuple(model._needs(own, 2).first()) == (0, None, None, False)


@pytest.mark.parametrize("rows", [1, 2])
def test_content_opens_few_entries_of_even_popularity(spark, interactions, histories, rows):
    """Where all items sell alike, or all have two price rows, pools are not opened whole."""
    items = [(n, 0, n % 20, round(10.0 + n % 7 + more, 2)) for n in range(4000) for more in range(rows)]
    sold = [(u, i, "2023-05-01") for i in range(4000) for u in range(4)]
    model = Content(spark.createDataFrame(items, ITEM_SCHEMA)).fit(interactions(sold), CUT)
    weights = item_weights(histories({0: list(range(20))}))
    profile = model.profile(weights)
    own = (profile.groupBy("user_idx", "store_idx").agg(F.sum("items").alias("h"))
           .join(model.median_prices(profile), "user_idx", "left"))
    k = 30
    assert model.opened(own, model._needs(own, k)).count() <= 4 * (k + 20) * rows
    got = ranked(model.recommend(histories({0: list(range(20))}), k))
    assert len(got[0]) == k
