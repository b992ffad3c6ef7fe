"""Counts by item, category and day, summed up, from which any window is read off."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.operators.splits import SECONDS_PER_DAY, before
from gleaner.session import snapshot


@dataclass
class DailyCounts:
    """(item_idx, category_idx, sums): `sums` holds a (day, upto) for each day with rows, in order,
    `upto` being the number of rows up to and with that day.

    An array has at most one entry for each day of the calendar, however often an item sells.
    Interactions without categories have null there.
    """

    table: DataFrame

    @classmethod
    def of(cls, interactions: DataFrame) -> DailyCounts:
        """One scan; rows are combined by day before they are shuffled."""
        category = F.col("category_idx") if "category_idx" in interactions.columns else F.lit(None).cast("int")
        day = F.floor(F.col("ts") / SECONDS_PER_DAY).cast("int")
        days = (interactions.select("item_idx", category.alias("category_idx"), day.alias("day"))
                .groupBy("item_idx", "category_idx", "day").agg(F.count(F.lit(1)).alias("n")))
        running = Window.partitionBy("item_idx", "category_idx").orderBy("day")
        return cls(snapshot(
            days.withColumn("upto", F.sum("n").over(running)).groupBy("item_idx", "category_idx")
            .agg(F.sort_array(F.collect_list(F.struct("day", "upto"))).alias("sums")), "daily-counts"))

    def between(self, lo: int | None, hi: int) -> DataFrame:
        """(item_idx, category_idx, n) of lo <= ts < hi, without those that have none. Bounds are
        midnights; None is the beginning."""
        for bound in (lo, hi):
            if bound is not None and bound % SECONDS_PER_DAY:
                raise ValueError("windows of daily counts begin and end at midnight")

        def upto(ts: int) -> Column:
            earlier = F.filter("sums", lambda s: s["day"] < ts // SECONDS_PER_DAY)
            return F.coalesce(F.get(earlier, F.size(earlier) - 1)["upto"], F.lit(0))

        n = upto(hi) if lo is None else upto(hi) - upto(lo)
        return self.table.select("item_idx", "category_idx", n.alias("n")).filter("n > 0")


def counted(source: DataFrame | DailyCounts, cutoff: int, window_days: int | None, *keys: str,
            name: str = "n") -> DataFrame:
    """Rows by `keys` before the cutoff, at most `window_days` old: counted over interactions, or
    read off their daily counts."""
    if isinstance(source, DailyCounts):
        lo = cutoff - window_days * SECONDS_PER_DAY if window_days else None
        return source.between(lo, cutoff).groupBy(*keys).agg(F.sum("n").alias(name))
    return before(source, cutoff, window_days).groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
