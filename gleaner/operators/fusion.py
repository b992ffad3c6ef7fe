"""Fusion of several channels' ranked lists. recs = (user_idx, rank, item_idx[, ...])."""
from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import top_k


def stack(channels: Mapping[str, DataFrame]) -> DataFrame:
    """All lists in one table with the channel's name and number (order of the mapping)."""
    if not channels:
        raise ValueError("at least one channel is needed")
    parts = [recs.select(F.lit(name).alias("channel"), F.lit(no).alias("channel_no"),
                         "user_idx", "rank", "item_idx")
             for no, (name, recs) in enumerate(channels.items())]
    return reduce(DataFrame.unionByName, parts)


def _by_user(channels: Mapping[str, DataFrame]) -> DataFrame:
    """The stacked candidates, moved once: a user has at most channels x k rows, and both the
    aggregation by (user, item) and the ranking by user can stay in these partitions."""
    return stack(channels).filter(F.col("item_idx") >= 0).drop("channel").repartition("user_idx")


def round_robin(channels: Mapping[str, DataFrame], k: int) -> DataFrame:
    """Everyone's first, then everyone's second, and so on, each item once.

    An item's turn is its earliest (rank, channel), so the interleaving is one aggregation
    and one per-user top-k.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    # one sortable number: rank first, then channel
    turn = F.col("rank").cast("bigint") * len(channels) + F.col("channel_no")
    turns = (_by_user(channels).groupBy("user_idx", "item_idx").agg(F.min(turn).alias("_turn")))
    return top_k(turns, ["user_idx"], [F.asc("_turn")], k).drop("_turn")


def check_weights(weights: Sequence[float] | None, n_channels: int, k: int,
                  rank_constant: float) -> list[float]:
    if n_channels < 1 or k < 1:
        raise ValueError("at least one channel and k >= 1 are needed")
    weights = [1.0] * n_channels if weights is None else [float(w) for w in weights]
    if len(weights) != n_channels:
        raise ValueError("one weight per channel is needed")
    if any(not math.isfinite(w) or w < 0 for w in weights) or not any(w > 0 for w in weights):
        raise ValueError("weights must be finite and non-negative, at least one positive")
    if not math.isfinite(rank_constant) or rank_constant < 0:
        raise ValueError("rank_constant must be finite and non-negative")
    return weights


def weighted_rrf(channels: Mapping[str, DataFrame], k: int,
                 weights: Sequence[float] | None = None,
                 rank_constant: float = 60.0) -> DataFrame:
    """Reciprocal rank fusion: sum of weight / (rank_constant + rank), best k.

    `rank` is the position in the channel's list; an item repeated there counts once, at its
    first place; negative ids are no candidates.
    """
    weights = check_weights(weights, len(channels), k, rank_constant)
    used = [(name, w) for name, w in zip(channels, weights, strict=True) if w > 0]
    first_place = [F.min(F.when(F.col("channel_no") == no, F.col("rank"))).alias(f"_r{no}")
                   for no in range(len(used))]
    parts = [F.coalesce(F.lit(w) / (F.lit(float(rank_constant)) + F.col(f"_r{no}")), F.lit(0.0))
             for no, (_, w) in enumerate(used)]
    scored = (_by_user({name: channels[name] for name, _ in used})
              .groupBy("user_idx", "item_idx").agg(*first_place)
              .select("user_idx", "item_idx", F.round(reduce(add, parts), 10).alias("score")))
    return top_k(scored, ["user_idx"], [F.desc("score"), F.asc("item_idx")], k)


def union_recall_ceiling(channels: Mapping[str, DataFrame], truths: DataFrame,
                         found: DataFrame | None = None) -> DataFrame:
    """Recall if every candidate of every channel were kept: the best any fusion could do.

    `found` holds all channels' hits, if they have been made already.
    """
    if found is None:
        reached = (stack(channels).filter(F.col("item_idx") >= 0).select("user_idx", "item_idx")
                   .join(truths.select("user_idx", "item_idx"), ["user_idx", "item_idx"], "left_semi"))
    else:
        reached = found.filter(F.col("channel").isin(*channels)).select("user_idx", "item_idx")
    per_user = (truths.join(reached.distinct().withColumn("found", F.lit(1)),
                            ["user_idx", "item_idx"], "left")
                .groupBy("user_idx")
                .agg((F.count("found") / F.count(F.lit(1))).alias("share")))
    return per_user.agg(F.avg("share").alias("union_recall_ceiling"))
