"""Mixing sources to target weights by capped water-filling, in DataFrame operations only."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.session import snapshot

WORD = r"[^\x20\x09-\x0D]+"
_FIRST, _LAST = Window.unboundedPreceding, Window.unboundedFollowing


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def capped_targets(totals: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5,
                   max_epochs: float = 2.0) -> DataFrame:
    """source, source_size -> the same with `target`.

    Sources in code point order, null last, take the weights in turn and divide `share` times
    the sum of sizes. A source is clamped at `max_epochs` times its size and its excess goes
    to the others by weight until none is above. That fixed point has one water level: with
    sources ordered by the level at which they are full, a source is full where the level
    that it and all later ones would share reaches its own. Sources of size 0 get 0; if all
    are full, each has its clamp. There is one row per source here, no row of any document.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    s = (totals.withColumn("_n", F.row_number().over(by_name))
         .withColumn("_w", F.element_at(cycle, ((F.col("_n") - 1) % len(weights) + 1).cast("int")))
         .withColumn("_cap", F.col("source_size") * F.lit(float(max_epochs)))
         .withColumn("_full", F.col("_cap") / F.col("_w")))
    fill = Window.orderBy("_full", "_n")
    everything = Window.orderBy("_full", "_n").rowsBetween(_FIRST, _LAST)
    s = (s.withColumn("_sum", F.sum("source_size").over(everything) * F.lit(float(share)))
         .withColumn("_below", F.coalesce(F.sum("_cap").over(fill.rowsBetween(_FIRST, -1)), F.lit(0.0)))
         .withColumn("_rest", F.sum("_w").over(fill.rowsBetween(0, _LAST)))
         .withColumn("_own", (F.col("_sum") - F.col("_below")) / F.col("_rest"))
         .withColumn("_level", F.min_by(
             F.when(F.col("_own") < F.col("_full"), F.col("_own")),
             F.when(F.col("_own") < F.col("_full"), F.struct("_full", "_n"))).over(everything)))
    return s.select("source", "source_size", F.when(
        F.col("_level").isNull() | (F.col("_full") <= F.col("_level")), F.col("_cap"))
        .otherwise(F.col("_w") * F.col("_level")).alias("target"))


def mixture(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5,
            max_epochs: float = 2.0, seed: int = 7) -> DataFrame:
    """The rows of `docs` with size, source_size, target, copies and taken = copies * size.

    Size is the number of words (null text: 0). A source's target is its whole repetitions,
    which every row gets, and a rest below its size. The rest goes, in the order of a seeded
    MD5 of doc_id, to documents until half of the next one would pass it, so a source's
    taken words differ from its target by at most half of one document. Rows that share a
    doc_id within a source are taken together. Reruns agree and do not depend on the layout.

    The order is cut without sorting a source: sums by 65,536 hash ranges per source find the
    range where the target ends, and only that range is ordered. Rows then compare their
    hash with their source's last one. Columns of `docs` keep their values, except that
    columns with the names of the results above are replaced. An empty table gives no row.
    """
    made = ("size", "source_size", "target", "copies", "taken", "_key", "_last", "_whole")
    keep = [c for c in docs.columns if c not in made]
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")))
    rows = docs.select(*keep, size_of(F.col("text")).alias("size"), key.alias("_key"))
    sized = snapshot(rows.select("source", "size", "_key"), "mix-sizes")
    ranges = snapshot(sized.groupBy("source", F.substring("_key", 1, 4).alias("_range"))
                      .agg(F.sum("size").alias("_size")), "mix-ranges")
    totals = ranges.groupBy("source").agg(F.sum("_size").alias("source_size"))
    plan = snapshot(
        capped_targets(totals, weights, share, max_epochs)
        .withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(
            F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint"))
        .withColumn("_want", F.col("target") - F.col("_whole") * F.col("source_size")), "mix-plan")
    p = plan.select(F.col("source").alias("_source"), "_want")
    before = Window.partitionBy("source").orderBy("_range").rowsBetween(_FIRST, -1)
    # the first range at whose end the wanted words are reached; earlier ones are taken whole
    edge = (ranges.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0)))
            .join(p, F.col("source").eqNullSafe(F.col("_source")))
            .filter(F.col("_before") + F.col("_size") >= F.col("_want"))
            .groupBy("_source").agg(F.min_by(F.struct("_range", "_before", "_want"), "_range").alias("_e"))
            .select("_source", "_e.*"))
    inside = Window.partitionBy("_source").orderBy("_key").rowsBetween(_FIRST, -1)
    # a range that is passed in its first half may end inside the range before: keys below
    # the edge range count as taken, so the last key is sought in the edge range or is its floor
    last = (sized.withColumn("_r", F.substring("_key", 1, 4))
            .join(edge, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_r") == F.col("_range")))
            .groupBy("_source", "_range", "_before", "_want", "_key").agg(F.sum("size").alias("_size"))
            .withColumn("_at", F.col("_before") + F.coalesce(F.sum("_size").over(inside), F.lit(0)))
            .groupBy("_source").agg(
                F.max(F.when(F.col("_at") + F.col("_size") / 2 < F.col("_want"), F.col("_key"))).alias("_key"),
                F.first("_range").alias("_range"))
            .select("_source", F.coalesce("_key", "_range").alias("_last")))
    plan = snapshot(plan.join(last, F.col("source").eqNullSafe(F.col("_source")), "left")
                    .select(F.col("source").alias("_of"), "source_size", "target", "_whole", "_last"),
                    "mix-cut")
    copies = F.col("_whole") + F.when(F.col("_key") <= F.col("_last"), 1).otherwise(0)
    return (rows.join(plan, F.col("source").eqNullSafe(F.col("_of")))
            .select(*keep, "size", "source_size", "target", copies.alias("copies"),
                    (copies * F.col("size")).alias("taken")))
