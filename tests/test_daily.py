"""Counts by day: any window read off one table equals a count over the interactions."""
import random

import pytest

from gleaner.operators.category import CategoryPopularity
from gleaner.operators.content import Content
from gleaner.operators.daily import DailyCounts, counted
from gleaner.operators.popularity import Popularity
from gleaner.operators.splits import SECONDS_PER_DAY, TimeSplit, unix
from gleaner.plans.runs import rolling_pools, rolling_runs

START = unix("2023-01-01")


@pytest.fixture
def rows():
    rng = random.Random(8)
    return [(u % 30, 0 if u % 3 == 0 else rng.randrange(40), START + rng.randrange(200 * SECONDS_PER_DAY), rng.randrange(3))
            for u in range(900)]


def test_windows_equal_counts_over_the_rows(interactions, rows):
    table = interactions(rows, category=True)
    daily = DailyCounts.of(table)
    assert daily.table.count() == len({(r[1], r[3]) for r in rows})
    for cutoff in (START, START + 60 * SECONDS_PER_DAY, START + 400 * SECONDS_PER_DAY):
        for window in (None, 1, 30):
            for keys in (["item_idx"], ["category_idx", "item_idx"], ["category_idx"]):
                got, want = (sorted(map(tuple, counted(x, cutoff, window, *keys).collect())) for x in (daily, table))
                assert got == want


def test_tables_without_categories_and_empty_ones(interactions, rows):
    plain = interactions([r[:3] for r in rows])
    cutoff = START + 90 * SECONDS_PER_DAY
    got = counted(DailyCounts.of(plain), cutoff, None, "item_idx").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, counted(plain, cutoff, None, "item_idx").collect()))
    assert DailyCounts.of(plain.limit(0)).between(None, cutoff).count() == 0


def test_bounds_are_midnights(interactions, rows):
    daily = DailyCounts.of(interactions(rows, category=True))
    with pytest.raises(ValueError):
        daily.between(None, START + 1)


def test_channels_fit_alike_on_counts(spark, interactions, rows):
    table = interactions(rows, category=True)
    daily, cutoff = DailyCounts.of(table), START + 120 * SECONDS_PER_DAY
    assert Popularity(30).fit(daily, cutoff).pool == Popularity(30).fit(table, cutoff).pool
    items = spark.createDataFrame([(i, i % 3, i % 5, 10.0 + i) for i in range(45)],
                                  "item_idx int, main_category_idx int, store_idx int, price double")
    for model, parts in ((lambda: CategoryPopularity(60, 8), ("pool", "item_categories")),
                         (lambda: Content(items, per_store=4), ("catalogue", "stores", "categories"))):
        a, b = model().fit(daily, cutoff), model().fit(table, cutoff)
        for part in parts:
            x, y = getattr(a, part), getattr(b, part).select(*getattr(a, part).columns)
            assert sorted(map(tuple, x.collect()), key=str) == sorted(map(tuple, y.collect()), key=str)


def test_pools_of_all_windows_read_the_counts_only(spark, interactions, rows):
    daily = DailyCounts.of(interactions(rows, category=True))
    items = spark.createDataFrame([(i, 0, 0, 1.0) for i in range(40)],
                                  "item_idx int, main_category_idx int, store_idx int, price double")
    day = lambda n: START + n * SECONDS_PER_DAY
    windows = {str(n): TimeSplit((day(n), day(n + 20), day(n + 40))) for n in (60, 80, 100, 120)}
    pools = rolling_pools(daily, windows, items)
    files = pools.inputFiles()
    assert files and all("/daily-counts-" in f for f in files)
    got = {}
    for r in pools.collect():
        got.setdefault((r["window"], r["channel"]), {})[r["category_idx"], r["item_idx"]] = r["n"]
    for n in (60, 80, 100, 120):
        recent = [r for r in rows if day(n - 90) <= r[2] < day(n)]
        want = {}
        for r in recent:
            want[r[3], r[1]] = want.get((r[3], r[1]), 0) + 1
        assert got[str(n), "category_popularity"] == want
        assert sum(got[str(n), "popularity"].values()) == len(recent)
        assert sum(got[str(n), "content"].values()) == sum(r[2] < day(n) for r in rows)


def test_finished_windows_are_kept_when_a_later_one_fails(interactions, rows):
    table, kept = interactions(rows, category=True), []
    day = lambda n: START + n * SECONDS_PER_DAY
    windows = {"good": TimeSplit((day(60), day(90), day(120))), "empty": TimeSplit((day(500), day(510), day(520)))}
    with pytest.raises(ValueError):
        rolling_runs(table, windows, keep=lambda window, section, df: kept.append((window, section)),
                     segment="valid", k=5, eval_ks=(5,), channels=("popularity", "category_popularity"),
                     bootstrap_samples=0)
    assert ("good", "metrics:category_popularity") in kept and {w for w, _ in kept} == {"good"}
