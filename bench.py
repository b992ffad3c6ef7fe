"""Time the steps of a full evaluation on the warehouse tables; prints one JSON line.

Each step is forced to completion: tables are written, reports are collected. Settings follow
a full evaluation: all qualified users of the test period, 500 candidates each. The steps run
on the given tables and, before that, on the ones a tenth the size next to them, so that fixed
cost and cost per row can be told apart.
"""
from __future__ import annotations

import json
import os
import shutil
import tempfile
import time
import uuid

from gleaner.operators import bootstrap, diagnostics, fusion, ingest, metrics, quality
from gleaner.operators.als import ImplicitALS
from gleaner.operators.category import CategoryPopularity
from gleaner.operators.content import Content
from gleaner.operators.covisitation import CoVisitation
from gleaner.operators.popularity import Popularity
from gleaner.operators.splits import build_eval_set, eval_profile, split_summary
from gleaner.session import build_session, shared_folder, snapshot
from gleaner.sources import read_interactions, warehouse, write_by_year

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
K, KS = 500, (10, 100, 500)


def steps(spark, folder: str) -> dict[str, float]:
    seconds: dict[str, float] = {}

    def timed(name, step):
        start = time.perf_counter()
        out = step()
        seconds[name] = round(time.perf_counter() - start, 3)
        return out

    split = warehouse.WAREHOUSE_SPLIT

    def store(table, name):
        path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        write_by_year(table, path)
        return read_interactions(spark, path)

    def ingest_reviews():
        reviews = snapshot(ingest.clean_reviews(
            warehouse.raw_reviews(spark, folder), time_range=(0, ingest.TIMESTAMP_MS_MAX)), "reviews")
        maps = [snapshot(ingest.dense_ids(reviews, key, idx), idx) for key, idx in (
            ("user_id", "user_idx"), ("parent_asin", "item_idx"), ("category", "category_idx"))]
        return store(ingest.encode_dedupe(reviews, *maps), "encoded")

    timed("ingest", ingest_reviews)
    inter = timed("interactions", lambda: store(warehouse.interactions(spark, folder), "inter"))
    items = warehouse.items(spark, folder)
    timed("split_summary", lambda: split_summary(inter, split).collect())
    ev = timed("eval_set", lambda: build_eval_set(inter, split, "test"))
    timed("eval_profile", lambda: eval_profile(ev).collect())
    lists = {}
    for model in (Popularity(90, 2_000), CoVisitation(), CategoryPopularity(90, 2_000),
                  Content(items), ImplicitALS(factors=32, iterations=10,
                                              min_user_interactions=10)):
        timed(f"{model.name}_fit", lambda m=model: m.fit(inter, ev.cutoff))
        lists[model.name] = timed(f"{model.name}_recommend", lambda m=model: snapshot(
            m.recommend(ev.histories, K, ev.users), f"recs-{m.name}"))
        if model.name == "covisitation":
            graph = model.graph
    fused = {"round_robin": timed("round_robin", lambda: snapshot(
                 fusion.round_robin(lists, K), "recs-rr")),
             "weighted_rrf": timed("weighted_rrf", lambda: snapshot(
                 fusion.weighted_rrf(lists, K), "recs-rrf"))}
    everything = {**lists, **fused}
    found = timed("hits", lambda: snapshot(metrics.found_by(everything, ev.truths), "found"))
    timed("metrics", lambda: metrics.evaluate(
        everything, ev.truths, KS, diagnostics.catalogue_size(inter, ev.cutoff), K,
        found=found).collect())
    timed("history_segments", lambda: metrics.evaluate(
        everything, ev.truths, KS, segments=metrics.history_segments(ev.histories),
        found=found).collect())
    timed("union_ceiling", lambda: fusion.union_recall_ceiling(lists, ev.truths, found).collect())
    timed("paired_bootstrap", lambda: bootstrap.interval_of(bootstrap.differences_of(
        found, ev.truths, "popularity", "weighted_rrf", K)).collect())
    timed("catalogue_diagnostics", lambda: diagnostics.catalogue_diagnostics(
        inter, ev.cutoff, ev.truths).collect())
    timed("reachability", lambda: diagnostics.channel_reachability(
        inter, ev.truths, ev.histories, graph).collect())
    timed("quality", lambda: [t.collect() for t in (
        quality.overall_scale(inter), quality.user_activity(inter), quality.item_long_tail(inter),
        quality.yearly_volume(inter), quality.eligibility(inter, split),
        quality.anomalies(inter))])
    return seconds


def main() -> None:
    shared = tempfile.mkdtemp(prefix="bench-")
    spark = build_session("bench", f"local[{CPUS}]", {
        "spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "12g",
        "spark.checkpoint.dir": shared,
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    sf = os.path.basename(FOLDER.rstrip("/")).removeprefix("sf")
    small = os.path.join(os.path.dirname(FOLDER.rstrip("/")), "sf0.01")
    try:
        spark.range(1_000_000).selectExpr("sum(id)").collect()  # session warm-up, not timed
        before = steps(spark, small) if sf == "0.1" and os.path.isdir(small) else {}
        seconds = steps(spark, FOLDER)
    finally:
        spark.stop()
        shutil.rmtree(shared, ignore_errors=True)
    print(json.dumps({"metric": "evaluation_total", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": sf, "queries_at_sf0.01": before}))


if __name__ == "__main__":
    main()
