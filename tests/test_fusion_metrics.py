import math
import random

import pytest
from conftest import ranked
from pyspark.sql import functions as F

from gleaner.operators import bootstrap, diagnostics, fusion, metrics, quality

D2, D3 = 1 / math.log2(3), 1 / math.log2(4)


def test_round_robin(lists):
    def one(*channels, k):
        return ranked(fusion.round_robin(
            {str(n): lists({0: items}) for n, items in enumerate(channels)}, k)).get(0, [])

    assert one([10, 11, 12], [20, 21, 22], k=4) == [10, 20, 11, 21]
    assert one([10, 11], [10, 12], k=3) == [10, 11, 12]
    assert one([10, -1], [20, 21], k=4) == [10, 20, 21]
    with pytest.raises(ValueError):
        fusion.round_robin({}, 3)


def test_round_robin_equals_the_definition(lists):
    rng = random.Random(5)
    given = [{u: [rng.choice([-1, *range(12)]) for _ in range(6)] for u in range(80)}
             for _ in range(3)]
    got = ranked(fusion.round_robin({str(n): lists(g) for n, g in enumerate(given)}, 7))
    for u in range(80):
        want = []
        for depth in range(6):
            for channel in given:
                item = channel[u][depth]
                if item >= 0 and item not in want and len(want) < 7:
                    want.append(item)
        assert got.get(u, []) == want


def test_weighted_rrf(lists):
    def one(*channels, k=4, **kw):
        return ranked(fusion.weighted_rrf(
            {str(n): lists({0: items}) for n, items in enumerate(channels)}, k, **kw)).get(0, [])

    assert one([1, 2, 3], [4, 2, 5])[0] == 2
    assert one([1, 2, 3], [4, 2, 5], weights=[1, 0]) == [1, 2, 3]
    assert one([1, 1, -1], [2, -1, -1]) == [1, 2]
    for bad in ([0, 0], [-1, 1], [1], [float("nan"), 1]):
        with pytest.raises(ValueError):
            one([1], [2], weights=bad)
    with pytest.raises(ValueError):
        one([1], [2], rank_constant=-1)
    with pytest.raises(ValueError):
        one([1], [2], k=0)


def test_union_ceiling(lists, histories):
    truths = histories({0: [1, 2], 1: [3]})
    got = fusion.union_recall_ceiling({"a": lists({0: [1]}), "b": lists({0: [9], 1: [3]})}, truths)
    assert got.first()[0] == pytest.approx(0.75)


@pytest.fixture
def score(lists, histories):
    def run(recs, truths, k, **kw):
        table = metrics.evaluate({"c": lists(recs)}, histories(truths), (k,), **kw)
        return {r["metric"]: r["value"] for r in table.collect()}

    return run


def test_hand_computed_scores(score):
    assert score({0: [1, 2, 3]}, {0: [1, 2, 3]}, 3) == pytest.approx({"recall@3": 1, "ndcg@3": 1})
    assert score({0: [4, 5, 6]}, {0: [1, 2, 3]}, 3) == {"recall@3": 0, "ndcg@3": 0}
    assert score({0: [1, 8, 9]}, {0: [1]}, 3)["ndcg@3"] == pytest.approx(1)
    assert score({0: [8, 9, 1]}, {0: [1]}, 3)["ndcg@3"] == pytest.approx(D3)
    assert score({0: [9, 1, 9]}, {0: [1]}, 3) == pytest.approx({"recall@3": 1, "ndcg@3": D2})
    # three truths, two places, both hit
    assert score({0: [1, 2]}, {0: [1, 2, 3]}, 2) == pytest.approx({"recall@2": 2 / 3, "ndcg@2": 1})
    # padding never hits, even if the truths hold it
    assert score({0: [-1, -1]}, {0: [-1, 1]}, 2) == {"recall@2": 0, "ndcg@2": 0}
    # users without candidates count as zero; users without truths do not count
    assert score({0: [1], 7: [1]}, {0: [1], 1: [2]}, 1)["recall@1"] == 0.5


def test_coverage_and_validation(score, lists, histories):
    recs = {u: [1, 2, 3] for u in range(100)}
    assert score(recs, {u: [1] for u in range(100)}, 3, n_items=1000)["coverage"] == 3 / 1000
    empty = metrics.coverage({"c": lists({0: [1]})}, 0).first()["coverage"]
    assert empty == 0
    with pytest.raises(ValueError):
        metrics.evaluate({"c": lists({0: [1]})}, histories({0: [1]}), (5,), k_max=2)


def test_a_channel_without_hits_reports_zero(lists, histories):
    table = metrics.evaluate({"a": lists({0: [1]}), "b": lists({0: [2]})}, histories({0: [1]}), (1,))
    got = {(r["channel"], r["metric"]): r["value"] for r in table.collect()}
    assert got[("a", "recall@1")] == 1 and got[("b", "recall@1")] == 0


def test_history_segments(histories):
    got = metrics.history_segments(histories({0: range(4), 1: range(5), 2: range(10)})).collect()
    assert {r["user_idx"]: r["segment"] for r in got} == {0: "1-4", 1: "5-9", 2: "10+"}


def test_bootstrap_known_delta_and_repeatability(lists, histories):
    base, better = lists({0: [0], 1: [0]}), lists({0: [1], 1: [2]})
    truths = histories({0: [1], 1: [2]})
    for method in ("poisson", "exact", "hashed"):
        one = bootstrap.paired_bootstrap(base, better, truths, 1, 30, method=method).first()
        assert (one["delta"], one["ci95_low"], one["ci95_high"]) == (1.0, 1.0, 1.0)
        again = bootstrap.paired_bootstrap(base, better, truths, 1, 30, method=method).first()
        assert one == again and one["n_users"] == 2
        none = bootstrap.paired_bootstrap(base, base, truths, 1, 30, method=method).first()
        assert none["ci95_low"] == none["ci95_high"] == 0
    with pytest.raises(ValueError):
        bootstrap.paired_bootstrap(base, better, truths, 1, 0)


def test_bootstrap_interval_is_near_exact_resampling(lists, histories):
    import numpy as np

    rng = random.Random(3)
    users = range(1500)
    base = {u: [rng.randrange(4)] for u in users}
    cand = {u: [rng.randrange(4)] for u in users}
    truth = {u: [rng.randrange(4)] for u in users}
    diff = np.array([(cand[u] == truth[u]) * 1.0 - (base[u] == truth[u]) for u in users])
    draw = np.random.default_rng(0)
    means = [draw.choice(diff, len(diff)).mean() for _ in range(2000)]
    want = np.quantile(means, [0.025, 0.975])
    for method in ("poisson", "exact", "hashed"):
        got = bootstrap.paired_bootstrap(lists(base), lists(cand), histories(truth), 1, 1000,
                                         method=method).first()
        assert got["delta"] == pytest.approx(diff.mean())
        assert abs(got["ci95_low"] - want[0]) < 0.006 and abs(got["ci95_high"] - want[1]) < 0.006


def test_catalogue_diagnostics(spark, histories):
    table = spark.createDataFrame([(1, 1), (2, 2), (3, 9)], "item_idx int, ts bigint")
    row = diagnostics.catalogue_diagnostics(table, 5, histories({0: [1, 3], 1: [3]})).first()
    assert (row["n_items_before_cutoff"], row["n_items_all_dates"]) == (2, 3)
    assert row["cold_truth_fraction_micro"] == pytest.approx(2 / 3)
    assert row["train_catalogue_recall_ceiling_macro"] == pytest.approx(0.25)


def test_reachability(interactions, histories):
    rows = [(1, 1, "2023-02-01", 7), (2, 2, "2023-02-01", 7), (1, 2, "2023-04-01", 7),
            (2, 3, "2023-04-01", 8)]
    table = interactions(rows, category=True)
    args = (histories({1: [2], 2: [3]}), histories({1: [1], 2: [2]}))
    row = diagnostics.channel_reachability(table, *args).first()
    assert row["same_category_micro"] + row["cross_category_micro"] == 1
    assert row["same_category_micro"] == 0.5
    skipped = diagnostics.channel_reachability(table.drop("category_idx"), *args).first()
    assert "category_idx" in skipped["skipped"]


def test_long_tail_equals_ranking(interactions):
    rng = random.Random(2)
    rows = [(n, min(int(rng.paretovariate(0.7)), 400), "2023-01-01") for n in range(3000)]
    counts = {}
    for _, item, _ in rows:
        counts[item] = counts.get(item, 0) + 1
    order = sorted(counts.values(), reverse=True)
    top = int(len(order) * 0.01)
    row = quality.item_long_tail(interactions(rows)).first()
    assert row["top_items"] == top
    assert row["top_1pct_share"] == pytest.approx(100 * sum(order[:top]) / len(rows))
    assert row["single_interaction_items_pct"] == pytest.approx(100 * order.count(1) / len(order))


@pytest.mark.parametrize("method", ["poisson", "exact"])
def test_resampled_means_have_the_moments_they_must_have(spark, method, monkeypatch):
    rng = random.Random(5)
    rows = [(u, rng.choice([-0.5, -0.25, 0.0, 0.0, 0.0, 0.25, 0.5, 1.0])) for u in range(400)]
    differences = spark.createDataFrame(rows, "user_idx int, diff double")
    row = bootstrap.moments_of(differences, 1_000, method=method).first()
    mean = sum(d for _, d in rows) / 400
    spread = (sum((d - mean) ** 2 for _, d in rows) / 400) ** 0.5 / 400 ** 0.5
    assert (row["delta"], row["std_error"], row["n_users"]) == (pytest.approx(mean), pytest.approx(spread), 400)
    assert row["mean_fits"] and row["spread_fits"] and row["interval_fits"]
    # resamples that are off are noticed
    right = bootstrap.resampled_means
    for change, fact in ((F.col("mean") + spread, "mean_fits"), (F.col("mean") * 2, "spread_fits"),
                         (F.col("mean") * 2, "interval_fits")):
        monkeypatch.setattr(bootstrap, "resampled_means",
                            lambda *a, c=change: right(*a).select(c.alias("mean")))
        assert not bootstrap.moments_of(differences, 1_000, method=method).first()[fact]


def test_lists_are_not_broadcast(spark, lists, histories):
    """Lists of one channel are alike and their files tiny; none is collected for a join with the truths."""
    from gleaner.session import snapshot

    recs = snapshot(lists({u: [1, 2, 3] for u in range(200)}), "same-lists")
    found = metrics.found_by({"a": recs}, histories({u: [3, 4] for u in range(200)}))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 200
