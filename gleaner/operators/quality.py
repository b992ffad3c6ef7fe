"""Data-quality report as tables."""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import day_of, year_of
from gleaner.operators.splits import DEFAULT_SPLIT, TimeSplit, before, in_period, segment_rows


def overall_scale(interactions: DataFrame) -> DataFrame:
    return (interactions.agg(
        F.count(F.lit(1)).alias("interactions"),
        F.countDistinct("user_idx").alias("users"),
        F.countDistinct("item_idx").alias("items"),
        F.countDistinct("category_idx").alias("categories"),
        day_of(F.min("ts")).alias("first_date"),
        day_of(F.max("ts")).alias("last_date"))
        .withColumn("mean_per_user", F.try_divide("interactions", "users"))
        .withColumn("mean_per_item", F.try_divide("interactions", "items")))


def _count_of_counts(interactions: DataFrame, key: str) -> DataFrame:
    """(n, keys): how many users or items have exactly n rows. A short table at any scale."""
    return (interactions.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
            .groupBy("n").agg(F.count(F.lit(1)).alias("keys")))


def user_activity(interactions: DataFrame) -> DataFrame:
    """One row: users per activity bucket, and exact percentiles of rows per user."""
    n, keys = F.col("n"), F.col("keys")

    def users_with(low: int, high: int | None = None):
        inside = n >= low if high is None else n.between(low, high)
        return F.sum(F.when(inside, keys).otherwise(F.lit(0)))

    return _count_of_counts(interactions, "user_idx").agg(
        users_with(1, 1).alias("users_1"), users_with(2, 4).alias("users_2_4"),
        users_with(5, 9).alias("users_5_9"), users_with(10, 49).alias("users_10_49"),
        users_with(50).alias("users_50_plus"), F.sum(keys).alias("users"),
        F.max(n).alias("max_rows"),
        F.percentile(n, 0.5, keys).alias("median_rows"),
        F.percentile(n, 0.9, keys).alias("p90_rows"),
        F.percentile(n, 0.99, keys).alias("p99_rows"))


def item_long_tail(interactions: DataFrame) -> DataFrame:
    """One row: share of all rows held by the top 1% of items, and share of items seen once.

    Items with equal counts are interchangeable, so the top 1% is read off the short table
    of counts; items are never ranked one by one.
    """
    counts = _count_of_counts(interactions, "item_idx")
    totals = counts.agg(F.sum("keys").alias("items"), F.sum(F.col("n") * F.col("keys")).alias("rows"),
                        F.sum(F.when(F.col("n") == 1, F.col("keys")).otherwise(0)).alias("once"))
    # one row per distinct count
    above = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    limit = F.floor(F.col("items") * 0.01)
    taken = F.least(F.col("keys"), F.greatest(limit - F.col("above"), F.lit(0)))
    ladder = (counts.withColumn("above", F.coalesce(F.sum("keys").over(above), F.lit(0)))
              .withColumn("items", totals.select("items").scalar())
              .withColumn("rows", totals.select("rows").scalar())
              .withColumn("once", totals.select("once").scalar()))
    return ladder.agg(
        F.sum(taken).alias("top_items"),
        (F.sum(taken * F.col("n")) * 100.0 / F.max("rows")).alias("top_1pct_share"),
        (F.max("once") * 100.0 / F.max("items")).alias("single_interaction_items_pct"))


def yearly_volume(interactions: DataFrame, years: int = 12) -> DataFrame:
    total = interactions.agg(F.count(F.lit(1)))
    return (interactions.groupBy("year").agg(F.count(F.lit(1)).alias("interactions"))
            .orderBy(F.desc("year")).limit(years)
            .withColumn("share_pct", F.col("interactions") * 100.0 / total.scalar()))


def eligibility(interactions: DataFrame, split: TimeSplit = DEFAULT_SPLIT) -> DataFrame:
    """Per evaluated segment: users active in it who also have a history."""
    rows = []
    for segment in ("valid", "test"):
        active = (segment_rows(interactions, split, segment).select("user_idx").distinct())
        known = active.join(before(interactions, split.feature_cutoff(segment))
                            .select("user_idx").distinct(), "user_idx", "left_semi")
        rows.append(known.agg(F.count(F.lit(1)).alias("eligible_users"))
                    .select(F.lit(segment).alias("segment"), "eligible_users"))
    return rows[0].unionByName(rows[1])


def anomalies(interactions: DataFrame) -> DataFrame:
    return interactions.agg(
        F.count_if(~F.col("rating").between(1, 5)).alias("rating_out_of_range"),
        F.count_if(F.col("user_idx").isNull() | F.col("item_idx").isNull()).alias("null_ids"),
        F.count_if(year_of(F.col("ts")) != F.col("year")).alias("year_mismatch"),
        F.round(100.0 * F.count_if("verified_purchase") / F.count(F.lit(1)), 1)
        .alias("verified_pct"),
        F.round(F.avg("rating"), 3).alias("mean_rating"))


def window_volume(interactions: DataFrame, windows: Mapping[str, tuple[int, int]],
                  norm: str) -> DataFrame:
    """Per named period: interactions, per day, and relative to the period `norm`. One scan.

    Every period has a row, also an empty one; relative to an empty `norm` all are null.
    """
    if norm not in windows:
        raise ValueError(f"{norm!r} is none of the windows")
    lo, hi = min(a for a, _ in windows.values()), max(b for _, b in windows.values())
    periods = F.array(*[F.struct(F.lit(name).alias("window"), F.lit(a).alias("lo"),
                                 F.lit(b).alias("hi")) for name, (a, b) in windows.items()])
    ts = F.col("ts")
    holding = F.filter(periods, lambda p: (ts >= p["lo"]) & (ts < p["hi"]))
    held = (in_period(interactions, lo, hi).select(F.inline(holding))
            .groupBy("window").agg(F.count(F.lit(1)).alias("interactions")))
    volume = (interactions.sparkSession.range(1).select(F.inline(periods)).join(held, "window", "left")
              .withColumn("interactions", F.coalesce("interactions", F.lit(0)))
              .withColumn("per_day", F.col("interactions") / ((F.col("hi") - F.col("lo")) / 86400)))
    usual = volume.filter(F.col("window") == norm).select("per_day")
    return volume.select(
        "window", "interactions", "per_day", day_of(F.col("lo")).alias("start"),
        day_of(F.col("hi")).alias("stop"),
        F.try_divide(F.col("per_day"), usual.scalar()).alias("relative_to_norm"))
