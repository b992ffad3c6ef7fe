"""Whole runs: baseline, full evaluation, data quality. Results are long tables."""
from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, fields
from functools import reduce
from threading import Lock

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators import bootstrap, diagnostics, fusion, metrics, quality
from gleaner.operators.als import ImplicitALS
from gleaner.operators.category import CategoryPopularity
from gleaner.operators.content import Content
from gleaner.operators.covisitation import CoVisitation
from gleaner.operators.daily import DailyCounts
from gleaner.operators.popularity import Popularity
from gleaner.operators.splits import (
    DEFAULT_SPLIT,
    EvalSet,
    TimeSplit,
    build_eval_set,
    eval_profile,
    sample_fingerprint,
    split_summary,
)
from gleaner.session import snapshot
from gleaner.sources import inventory_digest, save_results, source_inventory


@dataclass(frozen=True)
class ChannelSettings:
    """A channel's class and parameters. `deep` names the parameter that grows with k."""

    model: type
    options: Mapping[str, object]
    deep: str | None = None

    def build(self, k: int, items: DataFrame | None = None):
        own = dict(self.options)
        if self.deep:
            own[self.deep] = max(POOL_FLOOR, POOL_DEPTH * k)
        if "items" in {f.name for f in fields(self.model)}:
            own["items"] = items
        return self.model(**own)


# Pools hold four times the list length, and 2,000 at least.
POOL_DEPTH, POOL_FLOOR = 4, 2_000
# Channel settings of a full evaluation.
CHANNELS: Mapping[str, ChannelSettings] = {
    settings.model.name: settings for settings in (
        ChannelSettings(Popularity, {"window_days": 90}, "pool_size"),
        ChannelSettings(CategoryPopularity, {"window_days": 90}, "per_category"),
        ChannelSettings(CoVisitation, {"window_days": 365, "max_items_per_user": 20,
                                       "top_n_neighbours": 50, "min_cooccurrence": 3}),
        ChannelSettings(ImplicitALS, {"factors": 32, "iterations": 10, "min_user_interactions": 10,
                                      "min_item_interactions": 5}),
        ChannelSettings(Content, {"per_store": 200, "per_category": 400, "cold_slots": 50}))}
DEFAULT_CHANNELS = ("popularity", "covisitation", "als")
COUNTED = (Popularity, CategoryPopularity, Content)      # channels whose fit needs counts only


def _long(section: str, table: DataFrame, label: str | None = None) -> DataFrame:
    """(section, name, metric, value): the numeric columns of a small table as rows."""
    name = F.col(label) if label else F.lit("")
    numeric = [f.name for f in table.schema.fields
               if f.name != label and f.dataType.typeName() not in ("string", "boolean")]
    return table.select(F.lit(section).alias("section"), name.alias("name"), F.inline(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
        for c in numeric])))


def baseline_run(interactions: DataFrame, split: TimeSplit = DEFAULT_SPLIT,
                 segment: str = "test", ks: Sequence[int] = (10, 100, 500),
                 max_users: int | None = None, window_days: int = 90) -> dict[str, DataFrame]:
    """Split sizes, evaluation set profile and the popularity baseline's metrics."""
    evaluation = build_eval_set(interactions, split, segment, max_users=max_users)
    if evaluation.users.isEmpty():
        raise ValueError("no user qualifies for the evaluation")
    k = max(ks)
    model = Popularity(window_days or None, max(2_000, 4 * k)).fit(interactions, evaluation.cutoff)
    recs = snapshot(model.recommend(evaluation.histories, k), "baseline-recs")
    n_items = interactions.agg(F.countDistinct("item_idx"))
    return {"split_summary": split_summary(interactions, split),
            "profile": eval_profile(evaluation),
            "metrics": metrics.evaluate({"popularity": recs}, evaluation.truths, ks, n_items, k)}


@dataclass
class Run:
    """Tables of one evaluation. `results` holds (section, name, metric, value)."""

    evaluation: EvalSet
    recs: dict[str, DataFrame]
    results: DataFrame
    timings: dict[str, float]
    parameters: dict[str, str]
    examples: DataFrame | None = None


def evaluation_run(interactions: DataFrame, segment: str = "valid",
                   split: TimeSplit = DEFAULT_SPLIT, k: int = 500,
                   eval_ks: Sequence[int] = (10, 100, 500), max_users: int | None = None,
                   seed: int = 42, channels: Sequence[str] = DEFAULT_CHANNELS,
                   items: DataFrame | None = None, weights: Sequence[float] | None = None,
                   rank_constant: float = 60.0, bootstrap_samples: int = 1_000,
                   n_examples: int = 0, settings: Mapping[str, ChannelSettings] = CHANNELS,
                   keep: Callable[[str, DataFrame], None] | None = None,
                   counts: DailyCounts | None = None) -> Run:
    """Evaluation set, channels, both fusions, intervals, segments and diagnostics.

    Every list is joined to the truths once; all reports start from the hits. `keep` is
    called with each section of the results as soon as it is known. Channels made of counts
    read them off `counts`, where given, instead of the interactions.
    """
    if k < 1 or not eval_ks or any(not 1 <= x <= k for x in eval_ks):
        raise ValueError("eval_ks must lie between 1 and k")
    if n_examples < 0 or bootstrap_samples < 0:
        raise ValueError("examples and bootstrap_samples must not be negative")
    if len(set(channels)) != len(channels):
        raise ValueError("channels must not repeat")
    unknown = [c for c in channels if c not in settings]
    if unknown:
        raise ValueError(f"unknown channels {unknown}")
    if "content" in channels and items is None:
        raise ValueError("the content channel needs the item attributes that were built with "
                         "the interactions' own item map")
    weights = fusion.check_weights(weights, len(channels), k, rank_constant)

    timings: dict[str, float] = {}

    def timed(label: str, step: Callable):
        start = time.perf_counter()
        out = step()
        timings[label] = time.perf_counter() - start
        return out

    evaluation = timed("eval_set", lambda: build_eval_set(
        interactions, split, segment, max_users=max_users, seed=seed))
    if evaluation.users.isEmpty():
        raise ValueError("no user qualifies for the evaluation")
    cutoff, histories, truths = evaluation.cutoff, evaluation.histories, evaluation.truths
    parameters = {"segment": segment, "split": split.describe(), "k": str(k), "seed": str(seed),
                  "max_users": str(max_users), "weights": str(weights),
                  "rank_constant": str(rank_constant)}
    sections: list[DataFrame] = []

    def report(label: str, *tables: DataFrame) -> None:
        section = snapshot(reduce(DataFrame.unionByName, tables), "results")
        sections.append(section)
        if keep:
            keep(label, section)

    report("sample", _long("sample", eval_profile(evaluation)),
           _long("sample", sample_fingerprint(evaluation.users)),
           _long("catalogue", diagnostics.catalogue_diagnostics(interactions, cutoff, truths)))
    recs: dict[str, DataFrame] = {}
    found: dict[str, DataFrame] = {}
    n_items = snapshot(diagnostics.catalogue_size(interactions, cutoff), "catalogue-size")   # every list's coverage reads it
    segments = snapshot(metrics.history_segments(histories), "history-segments")

    def score(name: str) -> None:
        """Hits of one list, and its metrics over all users and by history length."""
        one = {name: recs[name]}
        found[name] = snapshot(metrics.found_by(one, truths), f"found-{name}")
        scores = metrics.evaluate(one, truths, eval_ks, n_items, k, found=found[name])
        by_length = metrics.evaluate(one, truths, eval_ks, k_max=k, segments=segments, found=found[name])
        timed(f"{name}_metrics", lambda: report(
            f"metrics:{name}",
            scores.select(F.lit("results").alias("section"), F.col("channel").alias("name"), "metric", "value"),
            by_length.select(F.concat(F.lit("history:"), "segment").alias("section"),
                             F.col("channel").alias("name"), "metric", "value")))

    graph = None
    for name in channels:
        model = settings[name].build(k, items)
        parameters[name] = ", ".join(
            f"{f.name}={getattr(model, f.name)}" for f in fields(model)
            if isinstance(getattr(model, f.name), int | float | str | None))
        source = counts if counts and isinstance(model, COUNTED) else interactions
        timed(f"{name}_fit", lambda m=model, s=source: m.fit(s, cutoff))
        recs[name] = timed(f"{name}_recommend", lambda m=model, n=name: snapshot(
            m.recommend(histories, k, evaluation.users), f"recs-{n}"))
        if hasattr(model, "stats"):
            report(f"stats:{name}", _long(f"stats:{name}", model.stats()))
        score(name)
        if name == "covisitation":
            graph = model.graph
    reach = diagnostics.channel_reachability(interactions, truths, histories, graph)
    if "skipped" in reach.columns:
        parameters["reachability"] = "skipped: the interactions have no category_idx"
    else:
        report("reachability", _long("reachability", reach))
    if len(channels) > 1:
        lists = dict(recs)
        recs["round_robin"] = timed("round_robin", lambda: snapshot(
            fusion.round_robin(lists, k), "recs-round-robin"))
        recs["weighted_rrf"] = timed("weighted_rrf", lambda: snapshot(
            fusion.weighted_rrf(lists, k, weights, rank_constant), "recs-rrf"))
        for fused in ("round_robin", "weighted_rrf"):
            score(fused)
        every = reduce(DataFrame.unionByName, found.values())
        report("union", _long("union", fusion.union_recall_ceiling(lists, truths, every)))
        if "popularity" in recs and bootstrap_samples:
            report("bootstrap", *[
                _long(f"bootstrap:{fused}@{at}", bootstrap.interval_of(bootstrap.differences_of(
                    every, truths, "popularity", fused, at), bootstrap_samples, seed))
                for fused in ("round_robin", "weighted_rrf") for at in eval_ks])
    shown = metrics.examples(evaluation, recs, n_examples) if n_examples else None
    return Run(evaluation, recs, reduce(DataFrame.unionByName, sections), timings, parameters, shown)


def recorded_run(interactions: DataFrame, path: str, run_id: str,
                 sources: Sequence[str] = (), **options) -> Run:
    """`evaluation_run` with a stored record under `path`; an existing run is refused.

    Each section of the results is stored when it is known, so a failure in the last channel
    loses nothing of the others. `sources` are listed with one digest of the whole list. A
    status row is appended at start and end, also when the run fails.
    """
    spark = interactions.sparkSession

    def note(status: str, text: str = "") -> None:
        spark.range(1).select(
            F.lit(run_id).alias("run_id"), F.lit(status).alias("status"),
            F.lit(text).alias("note"), F.current_timestamp().alias("at"),
        ).write.mode("append").parquet(f"{path}/status")

    def pairs(entries: Mapping[str, object]) -> DataFrame:
        return spark.range(1).select(F.inline(F.array(*[
            F.struct(F.lit(str(name)).alias("name"), F.lit(str(value)).alias("value"))
            for name, value in entries.items()])))

    def keep(label: str, section: DataFrame) -> None:
        section.write.mode("append").parquet(f"{path}/results/run_id={run_id}")

    # written first: fails if the run exists
    save_results(pairs({name: value for name, value in {**options, "run_id": run_id}.items()
                        if not isinstance(value, DataFrame)}), f"{path}/options", run_id)
    note("running")
    try:
        if sources:
            listed = snapshot(source_inventory(spark, sources), "inventory")
            save_results(listed, f"{path}/sources", run_id)
            save_results(inventory_digest(listed), f"{path}/sources_digest", run_id)
        run = evaluation_run(interactions, keep=keep, **options)
        save_results(pairs(run.parameters), f"{path}/parameters", run_id)
        save_results(pairs(run.timings), f"{path}/timings", run_id)
        if run.examples is not None:
            save_results(run.examples, f"{path}/examples", run_id)
    except Exception as error:
        note("failed", f"{type(error).__name__}: {error}")
        raise
    note("completed")
    return run


def rolling_runs(interactions: DataFrame, windows: Mapping[str, TimeSplit],
                 keep: Callable[[str, str, DataFrame], None] | None = None, at_once: int = 2,
                 **options) -> DataFrame:
    """The same frozen settings over several splits, results labelled by window.

    The interactions are counted by day once; every window's pools are read off those counts.
    `keep` is called with the window and each section of its results as soon as it is known, so a
    failure in one window loses nothing of those before it or beside it. A run is many short jobs one
    after the other, so `at_once` windows run beside each other; calls of `keep` never overlap.
    """
    if at_once < 1:
        raise ValueError("at_once must be at least 1")
    counts = DailyCounts.of(interactions)
    lock = Lock()

    def one(label: str, split: TimeSplit) -> DataFrame:
        def kept(section: str, table: DataFrame) -> None:
            with lock:
                keep(label, section, table)

        run = evaluation_run(interactions, split=split, counts=counts, keep=keep and kept, **options)
        return run.results.withColumn("window", F.lit(label))

    with ThreadPoolExecutor(at_once) as pool:
        started = [pool.submit(inheritable_thread_target(interactions.sparkSession)(one), label, split)
                   for label, split in windows.items()]
        try:
            parts = [window.result() for window in started]
        except BaseException:
            pool.shutdown(cancel_futures=True)      # no further window begins behind a failure
            raise
    return reduce(DataFrame.unionByName, parts)


def rolling_pools(counts: DailyCounts, windows: Mapping[str, TimeSplit], items: DataFrame,
                  segment: str = "valid") -> DataFrame:
    """(window, channel, category_idx, item_idx, n): what each window's popularity, category and
    content channels are made of, all of it read off one table of daily counts."""
    parts = []
    for label, split in windows.items():
        cutoff = split.feature_cutoff(segment)
        none = F.lit(None).cast("int").alias("category_idx")
        sold = Content(items).with_popularity(counts, cutoff).filter("pop > 0")
        for channel, pool in (
                ("popularity", Popularity().ranked(counts, cutoff).select(none, "item_idx", "n")),
                ("category_popularity", CategoryPopularity().ranked(counts, cutoff).select(
                    "category_idx", "item_idx", F.col("pop").alias("n"))),
                ("content", sold.select(none, "item_idx", F.col("pop").alias("n")))):
            parts.append(pool.select(F.lit(label).alias("window"), F.lit(channel).alias("channel"),
                                     "category_idx", "item_idx", "n"))
    return reduce(DataFrame.unionByName, parts)


def quality_run(interactions: DataFrame, split: TimeSplit = DEFAULT_SPLIT) -> dict[str, DataFrame]:
    """All sections of the data-quality report."""
    return {"scale": quality.overall_scale(interactions),
            "user_activity": quality.user_activity(interactions),
            "item_long_tail": quality.item_long_tail(interactions),
            "yearly_volume": quality.yearly_volume(interactions),
            "split_summary": split_summary(interactions, split),
            "eligibility": quality.eligibility(interactions, split),
            "anomalies": quality.anomalies(interactions)}


def quality_report(interactions: DataFrame, split: TimeSplit = DEFAULT_SPLIT) -> DataFrame:
    """The numeric content of the report as one long table."""
    labels = {"split_summary": "segment", "eligibility": "segment", "yearly_volume": "year"}
    parts = []
    for section, table in quality_run(interactions, split).items():
        label = labels.get(section)
        if label:
            table = table.withColumn(label, F.col(label).cast("string"))
        parts.append(_long(section, table, label))
    return reduce(DataFrame.unionByName, parts)


