"""Ranking helpers that keep working when one group holds a large share of all rows."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.expressions import int_array
from gleaner.session import snapshot

# monotonically_increasing_id() keeps the partition number above this bit
_ROW_BITS = 33
SPREAD = 64


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out by `keys` to all shuffle partitions (`spark.sql.shuffle.partitions`).

    For rows that each become very many right behind it: partitions are otherwise put together by
    their bytes, which say nothing of that.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int,
          rank: str = "rank", spread_by: Sequence[str] | None = None) -> DataFrame:
    """First `k` rows of every group with their 1-based rank. `order` must be total.

    The group limit is applied before the shuffle, so at most `k` rows per group leave an
    input partition. With `spread_by`, a group is first ranked in SPREAD independent parts,
    so that a group holding a third of the rows is not sorted by one task. Both are exact:
    a row among the group's first `k` is among the first `k` of its part.
    """
    if spread_by:
        part = F.pmod(F.xxhash64(*spread_by), F.lit(SPREAD)).alias("_part")
        inner = Window.partitionBy(*group, "_part").orderBy(*order)
        df = (df.withColumn("_part", part)
              .withColumn(rank, F.row_number().over(inner))
              .filter(F.col(rank) <= k)
              .drop("_part", rank))
    outer = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(outer)).filter(F.col(rank) <= k)


def _laid_out(df: DataFrame, order: Sequence[str], label: str) -> DataFrame:
    """Range-partition by `order`, number the rows in place, and write the layout down.

    Range bounds are sampled anew by each execution, so sizes and positions must be read
    from one and the same written layout.
    """
    placed = (df.repartitionByRange(*order)
              .sortWithinPartitions(*order)
              .withColumn("_slot", F.monotonically_increasing_id()))
    return (snapshot(placed, label)
            .withColumn("_part", F.shiftright("_slot", _ROW_BITS))
            .withColumn("_row", F.col("_slot").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))))


def global_positions(df: DataFrame, order: Sequence[str], position: str,
                     label: str = "positions") -> DataFrame:
    """0-based position of every row in the total order `order`, without a global window.

    Only the partition sizes (one number per partition) come to the driver.
    """
    laid = _laid_out(df, order, label)
    sizes = laid.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()
    counts = {row["_part"]: row["n"] for row in sizes}
    starts, start = [], 0
    for part in range(max(counts, default=-1) + 1):
        starts.append(start)
        start += counts.get(part, 0)
    first = F.element_at(int_array(starts, "bigint"), (F.col("_part") + 1).cast("int"))
    return laid.select(*df.columns, (first + F.col("_row")).alias(position))


def group_positions(df: DataFrame, group: Sequence[str], order: Sequence[str], position: str,
                    label: str = "group-positions") -> DataFrame:
    """0-based position of every row inside its group, with groups of any size.

    Rows are laid out by (group, order) in range partitions, so a large group is split over
    several of them. A row's position is its place inside its part of the group, plus the
    sizes of the group's earlier parts.
    """
    laid = _laid_out(df, [*group, *order], label)
    inside = Window.partitionBy(*group, "_part").orderBy("_slot")
    earlier = (Window.partitionBy(*group).orderBy("_part")
               .rowsBetween(Window.unboundedPreceding, -1))
    carried = (laid.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"))
               .withColumn("_before", F.sum("_n").over(earlier))
               .filter(F.col("_before").isNotNull())     # only groups cut by a partition bound
               .drop("_n"))
    return (laid.withColumn("_inside", F.row_number().over(inside) - 1)
            .join(carried, [*group, "_part"], "left")
            .withColumn(position, F.col("_inside") + F.coalesce("_before", F.lit(0).cast("bigint")))
            .select(*df.columns, position))
