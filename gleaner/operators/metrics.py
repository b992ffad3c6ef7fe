"""Recall, NDCG and coverage over ranked lists, for any number of lists in one pass."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import group_positions
from gleaner.operators.fusion import stack

# History-length segments, closed on the left and open on the right.
HISTORY_SEGMENTS = (("1-4", 1, 5), ("5-9", 5, 10), ("10+", 10, None))


def truth_sizes(truths: DataFrame) -> DataFrame:
    return truths.groupBy("user_idx").agg(F.count(F.lit(1)).alias("n_truth"))


def hits(recs: DataFrame, truths: DataFrame) -> DataFrame:
    """Every ranked entry with a hit flag. Negative ids never hit; a repeated item hits at
    each of its places.

    Lists compress so well that a table of many millions of rows can have a small file, so they are
    kept from being broadcast by the size of it.
    """
    wanted = truths.select("user_idx", "item_idx", F.lit(True).alias("_hit"))
    return (recs.hint("merge").join(wanted, ["user_idx", "item_idx"], "left")
            .withColumn("hit", F.coalesce("_hit", F.lit(False)) & (F.col("item_idx") >= 0))
            .drop("_hit"))


def found_by(channels: Mapping[str, DataFrame], truths: DataFrame) -> DataFrame:
    """(channel, user_idx, rank, item_idx) of every hit of every list.

    Small next to the lists: write it down once and hand it to all reports as `found`, so
    that no list is joined to the truths again.
    """
    return (hits(stack(channels), truths).filter("hit")
            .select("channel", "user_idx", "rank", "item_idx"))


def ideal_dcg(n_truth: Column, k: int) -> Column:
    """DCG of a list whose first min(n_truth, k) places all hit."""
    places = F.sequence(F.lit(1), F.least(n_truth, F.lit(k)).cast("int"))
    return F.aggregate(places, F.lit(0.0), lambda acc, i: acc + 1.0 / F.log2(i + F.lit(1.0)))


def _gains(ks: Sequence[int]) -> list[Column]:
    """Summed over hits and divided by the number of users, these are the macro averages."""
    out = []
    for k in ks:
        within = F.col("rank") <= k
        out.append(F.sum(F.when(within, 1.0 / F.col("n_truth")).otherwise(0.0))
                   .alias(f"recall@{k}"))
        out.append(F.sum(F.when(within, 1.0 / F.log2(F.col("rank") + F.lit(1.0))
                                / ideal_dcg(F.col("n_truth"), k)).otherwise(0.0))
                   .alias(f"ndcg@{k}"))
    return out


def _check(ks: Sequence[int], k_max: int | None) -> None:
    if not ks or min(ks) < 1:
        raise ValueError("ks must be positive")
    if k_max is not None and max(ks) > k_max:
        raise ValueError(f"k={max(ks)} is beyond the list length {k_max}")


def evaluate(channels: Mapping[str, DataFrame], truths: DataFrame, ks: Sequence[int] = (10,),
             n_items: DataFrame | int | None = None, k_max: int | None = None,
             segments: DataFrame | None = None, found: DataFrame | None = None) -> DataFrame:
    """Long table (channel, [segment,] metric, value, n_users).

    The mean runs over the users who have truths; a user without hits adds nothing to the
    sum, so hits are summed directly and no per-user table is made. `segments` (user_idx,
    segment) repeats the evaluation per segment. `n_items` adds coverage. `found` is what
    `found_by` gives, if it has been made already.
    """
    _check(ks, k_max)
    by = ["channel"] + (["segment"] if segments is not None else [])
    sizes = truth_sizes(truths)
    # only hits need the user's truth count
    if found is None:
        found = found_by(channels, truths)
    found = found.filter(F.col("channel").isin(*channels)).join(sizes, "user_idx")
    if segments is not None:
        found = found.join(segments, "user_idx")
        users = (sizes.join(segments, "user_idx").groupBy("segment")
                 .agg(F.count(F.lit(1)).alias("n_users")))
    else:
        users = sizes.agg(F.count(F.lit(1)).alias("n_users"))
    sums = found.groupBy(*by).agg(*_gains(ks))
    names = [f"{m}@{k}" for k in ks for m in ("recall", "ndcg")]
    # every channel reports, also one without any hit
    frame = users.select("*", F.explode(F.array(*map(F.lit, channels))).alias("channel"))
    frame = frame.join(sums, by, "left")
    value = [F.struct(F.lit(n).alias("metric"),
                      F.coalesce(F.try_divide(F.coalesce(F.col(f"`{n}`"), F.lit(0.0)),
                                              F.col("n_users")), F.lit(0.0)).alias("value"))
             for n in names]
    long = frame.select(*by, "n_users", F.inline(F.array(*value)))
    if n_items is not None:
        if segments is not None:
            raise ValueError("coverage is defined for the whole evaluation only")
        covered = coverage(channels, n_items).select(
            "channel", F.lit("coverage").alias("metric"), F.col("coverage").alias("value"))
        long = long.unionByName(
            covered.withColumn("n_users", users.scalar()).select("channel", "n_users", "metric",
                                                                  "value"))
    return long.select(*by, "metric", "value", "n_users")


def coverage(channels: Mapping[str, DataFrame], n_items: DataFrame | int) -> DataFrame:
    """Share of the catalogue that each channel recommends to anyone."""
    total = n_items.scalar() if isinstance(n_items, DataFrame) else F.lit(n_items)
    shown = F.countDistinct(F.when(F.col("item_idx") >= 0, F.col("item_idx")))
    share = F.when(F.col("total") > 0, F.col("n") / F.col("total")).otherwise(F.lit(0.0))
    return (stack(channels).groupBy("channel").agg(shown.alias("n"))
            .withColumn("total", total).select("channel", share.alias("coverage")))


def history_segments(histories: DataFrame) -> DataFrame:
    """(user_idx, segment) by history length."""
    n = F.col("n")
    label = F.lit(None).cast("string")
    for name, low, high in HISTORY_SEGMENTS:
        inside = (n >= low) if high is None else (n >= low) & (n < high)
        label = F.when(inside, F.lit(name)).otherwise(label)
    return (histories.groupBy("user_idx").agg(F.count(F.lit(1)).alias("n"))
            .select("user_idx", label.alias("segment")))


def examples(evaluation, channels: Mapping[str, DataFrame], n: int) -> DataFrame:
    """The first n users by id with history, truths and lists; a report, not a selection.

    Long form (user_idx, kind, pos, item_idx): kind is "history", "truth" or a channel's name.
    """
    if n < 0:
        raise ValueError("the number of examples must not be negative")
    chosen = evaluation.users.select("user_idx").orderBy("user_idx").limit(n)
    history = group_positions(evaluation.histories.join(chosen, "user_idx", "left_semi"),
                              ["user_idx"], ["ts", "item_idx"], "pos", label="examples-history")
    truth = group_positions(evaluation.truths.join(chosen, "user_idx", "left_semi"),
                            ["user_idx"], ["item_idx"], "pos", label="examples-truth")
    lists = (stack(channels).join(chosen, "user_idx", "left_semi")
             .select("user_idx", F.col("channel").alias("kind"),
                     F.col("rank").cast("bigint").alias("pos"), "item_idx"))
    part = [t.select("user_idx", F.lit(kind).alias("kind"), (F.col("pos") + 1).alias("pos"),
                     "item_idx") for kind, t in (("history", history), ("truth", truth))]
    return part[0].unionByName(part[1]).unionByName(lists)
