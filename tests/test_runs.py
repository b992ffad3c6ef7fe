import pytest
from conftest import ranked

from gleaner.operators import metrics
from gleaner.operators.splits import DEFAULT_SPLIT, TimeSplit, unix
from gleaner.plans import runs


@pytest.fixture
def demo(interactions):
    """60 synthetic users in two groups, and three users to look at."""
    rows = [(u, (1 if u < 40 else 101) + (u + j) % 20, "2023-02-01")
            for u in range(60) for j in range(12)]
    seen = {1000: [1, 2, 3], 1001: [101, 102, 103], 1002: [9999]}
    future = {1000: [4, 5], 1001: [104], 1002: [205]}
    rows += [(u, i, "2023-02-01") for u, items in seen.items() for i in items]
    rows += [(u, i, "2023-04-01") for u, items in future.items() for i in items]
    assert len(rows) == 731
    return interactions(rows)


def test_demo_lists(demo, lists):
    run = runs.evaluation_run(demo, "valid", k=10, eval_ks=(10,), bootstrap_samples=50,
                              n_examples=2)
    pop, covis = ranked(run.recs["popularity"]), ranked(run.recs["covisitation"])
    assert pop == {1000: list(range(4, 14)), 1001: list(range(1, 11)), 1002: list(range(1, 11))}
    assert covis == {1000: [4, 20, 5, 19, 6, 18, 7, 17, 8, 16],
                     1001: [104, 120, 105, 119, 106, 118, 107, 117, 108, 116]}
    # without known items only popularity has candidates, and so do the fusions
    assert 1002 not in ranked(run.recs["als"])
    for fused in ("round_robin", "weighted_rrf"):
        assert ranked(run.recs[fused])[1002] == list(range(1, 11))
    values = {(r["section"], r["name"], r["metric"]): r["value"] for r in run.results.collect()}
    assert values[("results", "covisitation", "recall@10")] == pytest.approx(2 / 3)
    assert values[("results", "covisitation", "ndcg@10")] == pytest.approx(0.63991, abs=1e-5)
    assert values[("sample", "", "n_users")] == 3
    assert "skipped" in run.parameters["reachability"]
    assert run.examples.filter("kind = 'history' and user_idx = 1000").count() == 3
    assert set(run.timings) >= {"eval_set", "popularity_fit", "als_recommend", "weighted_rrf"}


def test_record_is_kept_and_not_overwritten(demo, spark, tmp_path):
    path = str(tmp_path / "runs")
    options = {"segment": "valid", "k": 5, "eval_ks": (5,), "channels": ("popularity",)}
    runs.recorded_run(demo, path, "a", **options)
    stored = spark.read.parquet(f"{path}/results").filter("run_id = 'a'")
    assert stored.filter("section = 'results' and metric = 'recall@5'").count() == 1
    status = [r["status"] for r in spark.read.parquet(f"{path}/status").orderBy("at").collect()]
    assert status == ["running", "completed"]
    with pytest.raises(Exception, match="(?i)exist"):
        runs.recorded_run(demo, path, "a", **options)
    with pytest.raises(ValueError, match="no user"):
        runs.recorded_run(demo.filter("false"), path, "b", **options)
    last = spark.read.parquet(f"{path}/status").filter("run_id = 'b'").orderBy("at").collect()
    assert [r["status"] for r in last] == ["running", "failed"] and "no user" in last[-1]["note"]


@pytest.mark.parametrize("bad", [
    {"k": 0}, {"eval_ks": (600,)}, {"n_examples": -1}, {"bootstrap_samples": -1},
    {"channels": ("popularity", "popularity")}, {"channels": ("content",)},
    {"channels": ("unknown",)}, {"weights": [1.0]}, {"rank_constant": -1}])
def test_arguments_are_checked_first(demo, bad):
    with pytest.raises(ValueError):
        runs.evaluation_run(demo, **bad)


def test_rolling_windows_label_their_results(interactions):
    rows = [(u, i, "2022-01-01") for u in range(6) for i in (1, 2)]
    rows += [(u, 3, "2022-05-01") for u in range(6)] + [(u, 4, "2022-08-01") for u in range(6)]
    windows = {"spring": TimeSplit.of("2022-03-01", "2022-06-01", "2022-07-01"),
               "summer": TimeSplit.of("2022-07-01", "2022-09-01", "2022-10-01")}
    got = runs.rolling_runs(interactions(rows), windows, k=3, eval_ks=(3,),
                            channels=("popularity",))
    assert {r["window"] for r in got.select("window").distinct().collect()} == set(windows)


def test_rolling_evaluation_runs_all_channels(monkeypatch):
    from types import SimpleNamespace

    from gleaner.plans import catalog

    asked = {}
    monkeypatch.setattr(runs, "rolling_runs", lambda table, windows, **options: asked.update(rolling=options))
    monkeypatch.setattr(runs, "evaluation_run", lambda table, segment, split, **options: (
        asked.update(once=options), SimpleNamespace(results=None))[1])
    w = SimpleNamespace(interactions="table", items="items")
    catalog.rolling_evaluation(w)
    catalog.evaluation_run(w)
    assert asked["rolling"] == {**asked["once"], "segment": "valid"}
    assert len(asked["rolling"]["channels"]) == 5


def test_baseline(interactions):
    rows = [(u, i, "2023-05-20") for u in range(4) for i in (1, 2)]
    rows += [(9, 3, "2023-05-20")] + [(u, 3, "2023-07-01") for u in range(4)]
    out = runs.baseline_run(interactions(rows), ks=(1, 2))
    got = {r["metric"]: r["value"] for r in out["metrics"].collect()}
    assert got["recall@1"] == 1 and got["coverage"] == pytest.approx(1 / 3)
    assert out["split_summary"].count() == 3 and DEFAULT_SPLIT.stops[1] == unix("2023-06-01")


def test_segments_are_scored_apart(lists, histories):
    seg = metrics.history_segments(histories({0: [1], 1: list(range(12))}))
    got = metrics.evaluate({"c": lists({0: [5], 1: [6]})}, histories({0: [5], 1: [7]}), (1,),
                           segments=seg)
    values = {r["segment"]: r["value"] for r in got.filter("metric = 'recall@1'").collect()}
    assert values == {"1-4": 1.0, "10+": 0.0}


def test_windows_run_beside_each_other(interactions, monkeypatch):
    """Both wait for the other to have begun, so one after the other they would never end."""
    from threading import Barrier

    both, inside, build = Barrier(2, timeout=60), [], runs.build_eval_set
    monkeypatch.setattr(runs, "build_eval_set", lambda *args, **options: (both.wait(), build(*args, **options))[1])
    rows = [(u, i, "2022-01-01") for u in range(6) for i in (1, 2)]
    rows += [(u, 3, "2022-05-01") for u in range(6)] + [(u, 4, "2022-08-01") for u in range(6)]
    windows = {"spring": TimeSplit.of("2022-03-01", "2022-06-01", "2022-07-01"),
               "summer": TimeSplit.of("2022-07-01", "2022-09-01", "2022-10-01")}
    options = {"k": 3, "eval_ks": (3,), "channels": ("popularity",), "bootstrap_samples": 0}
    got = runs.rolling_runs(interactions(rows), windows, keep=lambda window, section, table: inside.append(window), **options)
    assert set(inside) == set(windows)
    assert [r["window"] for r in got.select("window").distinct().orderBy("window").collect()] == sorted(windows)
    with pytest.raises(ValueError):
        runs.rolling_runs(interactions(rows), windows, at_once=0, **options)
